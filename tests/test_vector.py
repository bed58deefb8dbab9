import random

import pytest
from pyspark.sql import functions as F

from blockloom.operators import sequence, vector
from blockloom.sources import blocktable, records


@pytest.fixture(scope="module")
def pair(spark):
    random.seed(0)
    values = [random.randrange(50) if i % 3 else i for i in range(3000)]
    rows = list(enumerate(values))
    random.shuffle(rows)
    return values, spark.createDataFrame(rows, "idx bigint, v bigint").repartition(5)


def listed(df):
    rows = sorted((r["idx"], r["v"]) for r in df.collect())
    assert [i for i, _ in rows] == list(range(len(rows)))
    return [v for _, v in rows]


def test_operations_equal_those_of_a_list(pair):
    x, seq = pair
    n = len(x)
    assert listed(vector.sort(seq)) == sorted(x)
    assert listed(vector.sort(seq, descending=True)) == sorted(x, reverse=True)
    assert listed(vector.sort(seq, key=F.struct(F.col("v") % 7, -F.col("v")))) == sorted(x, key=lambda v: (v % 7, -v))
    assert vector.clear(seq).count() == 0
    assert listed(vector.unique(seq)) == [v for i, v in enumerate(x) if not i or v != x[i - 1]]
    assert listed(vector.reverse(seq)) == x[::-1]
    assert listed(vector.rotate(seq, 7)) == x[7:] + x[:7]
    assert listed(vector.smallest(seq, 9)) == sorted(x)[:9]
    assert listed(vector.insert(seq, 5, vector.part(seq, 0, 3))) == x[:5] + x[:3] + x[5:]
    assert listed(vector.erase(seq, 4, 10)) == x[:4] + x[10:]
    assert listed(vector.resize(seq, 5)) == x[:5] and listed(vector.resize(seq, n + 2, 9)) == x + [9, 9]
    assert listed(vector.assign(seq, 4, 3)) == [3] * 4
    assert listed(vector.push_back(seq, vector.part(seq, 1, 2))) == x + [x[1]]
    assert listed(vector.pop_back(seq)) == x[:-1]
    assert sorted(listed(vector.shuffle(seq, 3))) == sorted(x) and listed(vector.shuffle(seq, 3)) == listed(vector.shuffle(seq, 3))
    assert vector.front_back(seq).first()[:] == (x[0], x[-1])
    with pytest.raises(IndexError):
        vector.at(seq, n)


def test_early_stops(pair):
    x, seq = pair
    go_on = F.col("v") < 40
    first = next(i for i, v in enumerate(x) if v >= 40)
    assert vector.visited(seq, go_on).first()[0] == first + 1
    last = next(i for i, v in enumerate(reversed(x)) if v >= 40)
    assert vector.visited(seq, go_on, backward=True).first()[0] == last + 1
    assert vector.visited(seq, F.lit(True), 10, 30).first()[0] == 20
    assert vector.visited(seq, F.lit(True), 10, 10).first()[0] == 0


def test_buckets_meet(pair, monkeypatch):
    x, seq = pair
    monkeypatch.setattr(vector, "BUCKET", 100)
    assert listed(vector.unique(seq)) == [v for i, v in enumerate(x) if not i or v != x[i - 1]]


def test_index_equals_one_window(pair, spark):
    _, seq = pair
    rows = seq.select((F.col("idx") * 7 % 3001).alias("k"), "v")
    assert listed(sequence.index(rows, ["k"], F.col("v"), 7)) == listed(sequence.index_small(rows, ["k"], F.col("v")))
    empty = rows.limit(0)
    assert listed(sequence.index(empty, ["k"], F.col("v"))) == []


def test_sort_is_stable_and_splits_equal_values(spark):
    rows = spark.range(4000).select((F.col("id") * 7 % 4000).alias("idx"), F.struct(F.lit(1).alias("k"), (F.col("id") * 7 % 4000).alias("at")).alias("v"))
    for descending in (False, True):
        done = vector.sort(rows, key=F.col("v.k"), descending=descending)
        assert done.where("idx <> v.at").count() == 0
    spread = sequence.index(rows.select("idx", "v.k"), ["k", "idx"], F.col("k"), partitions=8).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(spread) >= 3 and max(r["count"] for r in spread) < 2000


def test_nth_element(pair):
    x, seq = pair
    for k in (0, 1, 7, 1500, 2998, 2999):
        assert vector.nth(seq, k).collect() == [(k, sorted(x)[k])]
    assert vector.nth(seq, 3000).count() == vector.nth(seq, -1).count() == 0
    same = seq.select("idx", F.lit(5).cast("bigint").alias("v"))
    assert vector.nth(same, 1234).collect() == [(1234, 5)]


@pytest.mark.parametrize("width", [1, 2, 4, 8])
@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 512, 1300])
def test_block_table(spark, tmp_path, width, n):
    kind = {1: "tinyint", 2: "smallint", 4: "int", 8: "bigint"}[width]
    top = 1 << (8 * width - 1)
    x = [(i * 37 % (2 * top)) - top if i < 512 or i % 5 else None for i in range(n)]
    if n > 20:
        x[17], x[18] = top - 1, -top
    seq = spark.createDataFrame(list(enumerate(x)), f"idx bigint, v {kind}").repartition(3)
    blocktable.write(blocktable.encode(seq, 256), str(tmp_path / "t"))
    stored = blocktable.read(spark, str(tmp_path / "t"))
    assert listed(blocktable.decode(stored, kind)) == x
    assert dict(blocktable.decode(stored, kind).dtypes)["v"] == kind
    assert [r["v"] for r in blocktable.between(stored, 200, 300).orderBy("idx").collect()] == x[200:300]
    if n:
        assert blocktable.equal_to(stored, x[0]).count() == x.count(x[0])
        f = blocktable.footprint(spark, str(tmp_path / "t")).first()
        assert f["files"] >= 1 and f["bytes"] > 0 and stored.count() == -(-n // 256)


def test_block_tables_take_few_bits(spark):
    lines = spark.range(2000).select(F.col("id").alias("idx"), (F.col("id") * 1000 + F.col("id") % 3 + 10**15).alias("v"))
    assert {(r["strategy"], r["bits"] <= 3) for r in blocktable.encode(lines, 256).collect()} == {("line", True)}
    near = spark.range(2000).select(F.col("id").alias("idx"), (F.xxhash64("id") % 100 + 10**15).alias("v"))
    assert {(r["strategy"], r["bits"]) for r in blocktable.encode(near, 256).collect()} == {("base", 8)}
    with pytest.raises(Exception, match="gaps or repeats"):
        blocktable.encode(lines.where("idx <> 7"), 256).collect()


@pytest.mark.parametrize("kind,values", [
    ("double", [1.5, None, float("inf"), -0.0, 2.0] * 99), ("float", [1.5, None] * 99), ("string", ["a", "", None, "é" * 50] * 99), ("binary", [b"", b"x\0", None] * 99),
    ("date", [None] * 300), ("struct<a:int,b:string>", [(1, "x"), (2, None), None] * 99), ("array<float>", [[1.0, 2.0], [], None] * 99), ("decimal(20,2)", [None] * 99), ("map<string,int>", [{"a": 1}, {}, None] * 99),
])
def test_block_tables_of_all_types(spark, kind, values):
    seq = spark.createDataFrame(list(enumerate(values)), f"idx bigint, v {kind}")
    got = listed_any(blocktable.round_trip(seq, 100))
    assert got == [tuple(v) if isinstance(v, tuple) else v for v in values]


def listed_any(df):
    rows = sorted(((r["idx"], r["v"]) for r in df.collect()), key=lambda r: r[0])
    return [bytes(v) if isinstance(v, bytearray) else tuple(v) if type(v).__name__ == "Row" else v for _, v in rows]


def test_sizes_of_partial_blocks(spark):
    """A block of 100 elements: 6 whole rows, packed without runs, then 4 elements as they are."""
    from blockloom.operators import stats

    seq = spark.range(356).select(F.col("id").alias("idx"), (F.col("id") * 0 + 5).alias("v"))
    planes = stats.plane_sizes(stats.row_stats(seq)).where("blk = 1").collect()
    assert {(r["kind"], r["size"], r["n"]) for r in planes} == {(stats.PARTIAL, 1 + 4, 100)}
    sizes = {r["blk"]: (r["size"], r["raw_bytes"]) for r in stats.block_sizes(stats.plane_sizes(stats.row_stats(seq))).collect()}
    assert sizes == {0: (8 + 4, 2048), 1: (8 * 5 + 4 + 1, 800)}
    short = stats.block_sizes(stats.plane_sizes(stats.row_stats(seq.where("idx < 9")))).collect()
    assert [(r["size"], r["raw_bytes"]) for r in short] == [(9 * 8 + 1, 72)]


def test_strategies_by_brute_force(spark):
    """Each strategy wins on data made for it, with the size by its definition."""
    import math
    import random
    from collections import Counter

    from blockloom.operators import strategy

    r = random.Random(1)
    made = {
        "copy": [r.randrange(-(2**63), 2**63) for _ in range(512)],
        "block": [b + r.randrange(2) for b in [r.randrange(200) for _ in range(32)] for _ in range(16)],
        "planes": [r.choice([3, 250]) + 256 * r.choice([9, 70, 200, 201]) for _ in range(512)],
        "planes_delta": [i * 259 + 12 for i in range(512)],
    }
    bits = lambda xs: sum(c * math.log2(len(xs) / c) for c in Counter(xs).values())
    coded = lambda *streams: math.ceil(round(sum(map(bits, streams)) / 8, 6)) + sum(len(set(x)) for x in streams)
    for name, values in made.items():
        seq = spark.createDataFrame(list(enumerate(values)), "idx bigint, v bigint")
        row = strategy.sizes(seq, elements=512).first()
        planes = [[v >> 8 * p & 255 for v in values] for p in range(8)]
        assert row["entropy"] == coded([b for p in planes for b in p]) and row["planes"] == coded(*planes)
        assert row["planes_delta"] == coded(*([(a - b) & 255 for a, b in zip(p, [0, *p])] for p in planes)) and row["raw_bytes"] == 4096
        sizes = {"copy": row["raw_bytes"], **{s: row[s] for s in strategy.STRATEGIES[1:]}}
        best = strategy.best(strategy.sizes(seq, elements=512)).first()
        assert best["csize"] == min(sizes.values()) and best["strategy"] == next(s for s in strategy.STRATEGIES if sizes[s] == best["csize"])
        assert best["strategy"] == name or name == "planes_delta" and best["strategy"] == "block", (name, sizes)


def test_delta_lanes_of_superblocks(spark):
    """Both superblocks have lanes of their own; the short one has a single lane."""
    x = [i * 7919 % 70_000 for i in range(700)]
    seq = spark.createDataFrame(list(enumerate(x)), "idx bigint, v bigint")
    streams = sequence.streams(seq, 4, elements=600)
    got = sorted((r["sb"], r["pos"], r["lane"], r["d"]) for r in sequence.delta(streams).collect())
    want = []
    for sb, part in enumerate((x[:600], x[600:])):
        stream = [v >> 8 * p & 255 for p in range(4) for v in part]
        lane = lambda i: 0 if len(stream) <= 2048 else min(i // (len(stream) // 4), 3)
        want += [(sb, i, lane(i), (b - (stream[i - 1] if i and lane(i - 1) == lane(i) else 0)) & 255) for i, b in enumerate(stream)]
    assert got == want
    back = sorted((r["sb"], r["pos"], r["b"]) for r in sequence.undo_delta(sequence.delta(streams)).collect())
    assert back == sorted((r["sb"], r["pos"], r["b"]) for r in streams.collect())


def test_records(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes(range(24)))
    got = records.binary_records(spark, str(tmp_path / "a.bin"), 12).orderBy("idx").collect()
    assert [bytes(r["record"]) for r in got] == [bytes(range(12)), bytes(range(12, 24))]
    (tmp_path / "cut.bin").write_bytes(bytes(range(25)))
    with pytest.raises(Exception, match="EOF|crashed"):
        records.binary_records(spark, str(tmp_path / "cut.bin"), 12).collect()
    (tmp_path / "large").write_bytes(b"".join(i.to_bytes(8, "little") for i in range(500_000)))
    large = records.binary_records(spark, str(tmp_path / "large"), 8)
    assert large.where("record <> unhex(concat(lpad(hex(idx & 255), 2, '0'), lpad(hex(idx >> 8 & 255), 2, '0'), lpad(hex(idx >> 16 & 255), 2, '0'), '0000000000'))").count() == 0
    records.write_report(spark.createDataFrame([(1, "a")], "n int, s string"), str(tmp_path / "report"))
    assert {r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()} == {"n;s", "1;a"}
    (tmp_path / "n.txt").write_text("1 2.5\n\n x -3\n")
    assert [r["v"] for r in records.numbers(spark, str(tmp_path / "n.txt")).collect()] == [1.0, 2.5, None, -3.0]


def test_stream(spark, tmp_path):
    from blockloom.streaming import encode

    src = str(tmp_path / "src")
    spark.range(2000).select(F.col("id"), (F.col("id") * 3).alias("v")).repartition(2).write.parquet(src)
    stream = spark.readStream.schema("id bigint, v bigint").option("maxFilesPerTrigger", 1).parquet(src)
    encode.encode_stream(stream, ["id"], F.col("v"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = encode.decode_stream_table(spark, str(tmp_path / "out"))
    assert sorted(r["v"] for r in got.collect()) == [3 * i for i in range(2000)]


def test_windows_of_a_stream(spark, tmp_path):
    from blockloom.streaming import encode

    src = str(tmp_path / "timed")
    spark.range(600).select(F.timestamp_seconds(F.col("id")).alias("at"), F.col("id").alias("v")).write.parquet(src)
    stream = spark.readStream.schema("at timestamp, v bigint").parquet(src)
    q = encode.windowed_sizes(stream, "at", "v").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("windows").orderBy("start").collect()
    assert [(r["n"], r["raw_bytes"], r["v_min"], r["v_max"]) for r in got] == [(300, 2400, 0, 299), (300, 2400, 300, 599)]


def test_words_that_matches_are_looked_for_in(spark):
    from blockloom.functions import levels

    rows = spark.createDataFrame([(w,) for w in (1, 2, 3, 4, 6, 8, 9, 12, 5, 513, 16)], "w bigint").select("w", levels.word_bytes(F.col("w")).alias("b")).collect()
    assert {r["w"]: r["b"] for r in rows} == {1: 4, 2: 4, 3: 3, 4: 4, 6: 6, 8: 8, 9: 3, 12: 4, 5: None, 513: None, 16: 8}
