import pytest

from blockloom.plans import catalogue
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sf, duck):
    df = catalogue.QUERIES[name](spark, sf)
    if name in catalogue.ORACLE_SQL:
        same_rows(df, duck, catalogue.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    rows = e.entry(spark).collect()
    assert len(rows) == 5 and all(0 < r["model_bytes"] <= r["raw_bytes"] * 1.01 for r in rows)
