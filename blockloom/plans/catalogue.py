"""Registered queries and the SQL that must give the same rows.

Each query is a DataFrame plan over the operators; its SQL is written for itself, in the
dialect of the engine that checks it, from the definitions and not from the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import levels
from ..operators import sequence, stats, strategy, vector
from ..sources import blocktable

LEVELS = list(range(10))


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(spark, sf):
    ts = F.col("ts")
    return sequence.index(_table(spark, sf, "events"), ["event_id"], F.unix_micros(ts.cast("timestamp")))


def users(spark, sf):
    return sequence.index(_table(spark, sf, "events"), ["event_id"], F.col("user_id"))


def customers(spark, sf):
    return sequence.index(_table(spark, sf, "orders"), ["o_orderkey"], F.col("o_custkey"))


def big(df: DataFrame) -> DataFrame:
    """Every whole-number column as bigint."""
    return df.select([F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") or t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


# Sequences in SQL.
TS = "seq AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, epoch_us(ts) AS v FROM events)"
USER = "seq AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, user_id AS v FROM events)"
CUST = "seq AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_custkey AS v FROM orders)"
BYTES = """planes AS (SELECT idx, p AS plane, (v >> (8 * p)) & 255 AS b FROM seq, range(8) t(p))"""
ROWS = """
x AS (SELECT idx, idx // 256 AS blk, (idx % 256) // 16 AS rw, plane, CASE WHEN b > 127 THEN b - 256 ELSE b END AS x FROM planes),
y AS (SELECT *, (x - coalesce(lag(x) OVER (PARTITION BY blk, plane ORDER BY idx), 0)) & 255 AS u FROM x),
z AS (SELECT *, CASE WHEN u > 127 THEN u - 256 ELSE u END AS d FROM y),
q AS (SELECT *, coalesce(lag(d) OVER (PARTITION BY blk, plane, rw ORDER BY idx), 0) AS dp FROM z),
rs AS (SELECT blk, plane, rw AS "row", CAST(count(*) AS BIGINT) AS n, CAST(min(x) AS BIGINT) AS mn, CAST(max(x) AS BIGINT) AS mx, CAST(min(d) AS BIGINT) AS dmn,
       CAST(max(d) AS BIGINT) AS dmx, CAST(count(*) FILTER (d <> 0) AS BIGINT) AS rle, CAST(count(*) FILTER (d <> dp) AS BIGINT) AS drle
       FROM q GROUP BY ALL)"""


def _width_sql(spread: str, six: int) -> str:
    return f"CASE WHEN {spread} = 0 THEN 0 WHEN {spread} < 2 THEN 1 WHEN {spread} < 4 THEN 2 WHEN {spread} < 8 THEN 3 WHEN {spread} < 16 THEN 4 WHEN {spread} < 32 THEN 5 WHEN {spread} < 64 THEN {six} ELSE 8 END"


CHOICES = f"""
w AS (SELECT *, {_width_sql('(mx - mn)', 8)} AS b0, {_width_sql('(dmx - dmn)', 6)} AS b1 FROM rs),
p0 AS (SELECT *, least(b0, b1) AS bits, CASE WHEN b0 <= b1 THEN mn ELSE dmn END AS base FROM w),
p1 AS (SELECT *, 2 * bits + CASE WHEN bits = 8 THEN 0 ELSE 1 END AS plain, n = 16 AS whole FROM p0),
ch AS (SELECT *, CASE WHEN drle + 2 < least(plain, rle + 2) THEN 6 WHEN rle + 2 < plain THEN 7 WHEN bits = 8 THEN 15 WHEN b1 < b0 THEN bits + 8 ELSE bits END AS header,
       least(plain, rle + 2, drle + 2) AS size FROM p1)"""
PLANES = """
c0 AS (SELECT *, CASE WHEN base <> coalesce(lag(base) OVER (PARTITION BY blk, plane ORDER BY "row"), 0) THEN 1 ELSE 0 END AS changed FROM ch),
c1 AS (SELECT blk, plane, sum(n) AS n, sum(size) AS rows_size, sum(CASE WHEN header IN (6, 7) OR bits = 8 THEN 1 ELSE 0 END) AS others, sum(changed) AS changes, min(mn) = max(mx) AS same,
       coalesce(sum(plain) FILTER (whole), 0) AS plain_size, count(*) FILTER (whole) AS whole_rows, coalesce(min(mn) FILTER (whole) = max(mx) FILTER (whole), false) AS whole_same
       FROM c0 GROUP BY blk, plane),
c2 AS (SELECT *, (16 - others) - (changes + 2) AS saved, 8 + rows_size - greatest((16 - others) - (changes + 2), 0) AS total, n = 256 AS filled,
       CASE WHEN whole_rows = 0 THEN 0 WHEN whole_same THEN 1 ELSE 8 + plain_size END + n - 16 * whole_rows AS partial FROM c1),
pl AS (SELECT blk, plane, CAST(CASE WHEN NOT filled THEN 4 WHEN same THEN 0 WHEN total > 256 THEN 1 WHEN saved > 0 THEN 3 ELSE 2 END AS BIGINT) AS kind,
       CAST(CASE WHEN NOT filled THEN partial WHEN same THEN 1 ELSE least(total, 256) END AS BIGINT) AS size, CAST(changes AS BIGINT) AS changes, CAST(others AS BIGINT) AS others, filled AND saved > 0 AS bases_rle, n FROM c2)"""
BLOCKS = """bl AS (SELECT blk, CAST(sum(size) + CASE WHEN max(n) >= 16 THEN 4 ELSE 0 END + CASE WHEN max(n) < 256 THEN 1 ELSE 0 END AS BIGINT) AS size, CAST(sum(n) AS BIGINT) AS raw_bytes FROM pl GROUP BY blk)"""


def sql(*parts: str, then: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + then


QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, check: str | None = None):
    def add(f):
        QUERIES[name] = f
        if check:
            ORACLE_SQL[name] = check
        return f

    return add


@query("q01_block_index", sql(CUST, then="SELECT idx, idx // 256 AS blk, (idx % 256) // 16 AS \"row\", idx % 16 AS place, v FROM seq"))
def q01(spark, sf):
    return big(sequence.placed(customers(spark, sf)))


@query("q02_byte_planes", sql(TS, BYTES, then="SELECT idx, plane, b FROM planes"))
def q02(spark, sf):
    return big(sequence.planes(micros(spark, sf)))


@query("q03_plane_merge", sql(USER, then="SELECT idx, v FROM seq"))
def q03(spark, sf):
    return sequence.merge(sequence.planes(users(spark, sf)))


_COUNT = "least(16384, (SELECT count(*) FROM seq) - 16384 * (idx // 16384))"
_STREAM = f"st AS (SELECT idx // 16384 AS sb, idx % 16384 + plane * {_COUNT} AS pos, 8 * {_COUNT} AS n, b FROM planes)"
_LANE = "CASE WHEN n <= 2048 THEN 0 ELSE least(pos // (n // 4), 3) END"


@query("q04_byte_delta", sql(TS, BYTES, _STREAM, then=f"SELECT sb, pos, CAST({_LANE} AS BIGINT) AS lane, (b - coalesce(lag(b) OVER (PARTITION BY sb, {_LANE} ORDER BY pos), 0)) & 255 AS d FROM st"))
def q04(spark, sf):
    return big(sequence.delta(sequence.streams(micros(spark, sf))))


@query("q05_delta_inverse", sql(TS, BYTES, _STREAM, then=f"SELECT sb, pos, CAST({_LANE} AS BIGINT) AS lane, b FROM st"))
def q05(spark, sf):
    return big(sequence.undo_delta(sequence.delta(sequence.streams(micros(spark, sf)))))


@query("q06_row_min_max", sql(TS, BYTES, ROWS, then='SELECT blk, plane, "row", n, mn, mx FROM rs'))
def q06(spark, sf):
    return big(stats.row_stats(micros(spark, sf)).select("blk", "plane", "row", "n", "mn", "mx"))


@query("q07_row_delta_min_max", sql(TS, BYTES, ROWS, then='SELECT blk, plane, "row", dmn, dmx FROM rs'))
def q07(spark, sf):
    return big(stats.row_stats(micros(spark, sf)).select("blk", "plane", "row", "dmn", "dmx"))


@query("q08_bit_widths", sql(USER, BYTES, ROWS, CHOICES, then='SELECT blk, plane, "row", CAST(b0 AS BIGINT) AS b0, CAST(b1 AS BIGINT) AS b1 FROM w'))
def q08(spark, sf):
    return big(stats.row_widths(stats.row_stats(users(spark, sf))).select("blk", "plane", "row", "b0", "b1"))


@query("q09_run_counts", sql(USER, BYTES, ROWS, then='SELECT blk, plane, "row", rle FROM rs'))
def q09(spark, sf):
    return big(stats.row_stats(users(spark, sf)).select("blk", "plane", "row", "rle"))


@query("q10_delta_run_counts", sql(TS, BYTES, ROWS, then='SELECT blk, plane, "row", drle FROM rs'))
def q10(spark, sf):
    return big(stats.row_stats(micros(spark, sf)).select("blk", "plane", "row", "drle"))


@query("q11_header_histogram", sql(TS, BYTES, ROWS, CHOICES, then="SELECT CAST(header AS BIGINT) AS header, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM ch GROUP BY header"))
def q11(spark, sf):
    return stats.row_choices(stats.row_stats(micros(spark, sf))).groupBy("header").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query("q12_plane_sizes", sql(TS, BYTES, ROWS, CHOICES, PLANES, then="SELECT blk, plane, kind, size FROM pl"))
def q12(spark, sf):
    return big(stats.plane_sizes(stats.row_stats(micros(spark, sf))).select("blk", "plane", "kind", "size"))


@query("q13_bases_rle", sql(CUST, BYTES, ROWS, CHOICES, PLANES, then="SELECT blk, plane, changes, others, bases_rle FROM pl"))
def q13(spark, sf):
    return big(stats.plane_sizes(stats.row_stats(customers(spark, sf))).select("blk", "plane", "changes", "others", "bases_rle"))


@query("q14_block_sizes", sql(TS, BYTES, ROWS, CHOICES, PLANES, BLOCKS, then="SELECT blk, size, raw_bytes, CAST(raw_bytes AS DOUBLE) / size AS ratio FROM bl"))
def q14(spark, sf):
    blocks = stats.block_sizes(stats.plane_sizes(stats.row_stats(micros(spark, sf))))
    return blocks.select("blk", "size", "raw_bytes", (F.col("raw_bytes").cast("double") / F.col("size")).alias("ratio"))


@query("q15_early_abort", sql(USER, BYTES, ROWS, CHOICES, PLANES, BLOCKS, then="""SELECT blk // 16 AS sb, CAST(sum(raw_bytes) AS BIGINT) AS head_bytes, CAST(sum(size) AS BIGINT) AS head_size, sum(raw_bytes) >= sum(size) * 2 AS go_on
FROM bl WHERE blk % 16 < 1 GROUP BY ALL"""))
def q15(spark, sf):
    blocks = stats.block_sizes(stats.plane_sizes(stats.row_stats(users(spark, sf))))
    return stats.early_abort(blocks, 16, 2)


_WORD = "wd AS (SELECT idx, idx // 256 AS blk, idx - lag(idx) OVER (PARTITION BY idx // 256, v ORDER BY idx) AS distance FROM seq)"


@query("q16_match_distance", sql(USER, _WORD, then="SELECT idx, blk, distance FROM wd"))
def q16(spark, sf):
    return big(stats.earlier_words(users(spark, sf), F.col("v")))


@query("q17_match_bytes", sql(USER, _WORD, then="SELECT blk, count(*) AS matches, CAST(sum(CASE WHEN distance < 128 THEN 1 ELSE 2 END) AS BIGINT) AS bytes FROM wd WHERE distance IS NOT NULL GROUP BY blk"))
def q17(spark, sf):
    words = stats.earlier_words(users(spark, sf), F.col("v")).where("distance is not null")
    return words.groupBy("blk").agg(F.count(F.lit(1)).alias("matches"), F.sum(levels.varint_bytes(F.col("distance"))).alias("bytes"))


_WIDTHS = "(1),(2),(3),(4),(6),(8),(12),(16),(255),(513),(1000)"
_TOTALS = "(0),(100),(65792),(131072),(131073),(10000000)"


def _grid(spark):
    w = spark.createDataFrame([(x,) for x in (1, 2, 3, 4, 6, 8, 12, 16, 255, 513, 1000)], "width bigint")
    t = spark.createDataFrame([(x,) for x in (0, 100, 65792, 131072, 131073, 10_000_000)], "total bigint")
    return w.crossJoin(spark.range(10).select(F.col("id").alias("level"))).crossJoin(t)  # 660 rows, a fixed grid


@query("q18_superblock_plan", f"""
WITH g AS (SELECT CAST(w AS BIGINT) AS width, l AS level, CAST(b AS BIGINT) AS total FROM (VALUES {_WIDTHS}) x(w), range(10) y(l), (VALUES {_TOTALS}) z(b)),
d AS (SELECT *, greatest(width * 256, (131072 // (width * 256)) * (width * 256)) AS base FROM g),
s AS (SELECT *, CASE WHEN level >= 1 AND total > base THEN (level - 1) // 2 ELSE 0 END AS shift FROM d)
SELECT width, level, total, shift, base * CAST(pow(2, shift) AS BIGINT) AS superblock, greatest(1, CAST(ceil(total / (base * pow(2, shift))) AS BIGINT)) AS n FROM s""")
def q18(spark, sf):
    w, lv, t = F.col("width"), F.col("level"), F.col("total")
    sb = levels.superblock(lv, t, w)
    return _grid(spark).select("width", "level", "total", levels.shift_of(lv, t, w).alias("shift"), sb.alias("superblock"), F.greatest(F.lit(1).cast("bigint"), F.ceil(t / sb)).alias("n"))


@query("q19_bound", "SELECT o_orderkey, CAST(o_orderkey * 4096 AS BIGINT) AS total, CAST(12 + greatest(1, (o_orderkey * 4096 + 65791) // 65792) * 4 + o_orderkey * 4096 AS BIGINT) AS bound FROM orders")
def q19(spark, sf):
    total = F.col("o_orderkey") * 4096
    return _table(spark, sf, "orders").select("o_orderkey", total.alias("total"), levels.bound(total).alias("bound"))


@query("q20_frame_header", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 255 ELSE o_orderkey % 5 END AS BIGINT) AS shift, CAST(o_custkey * 8 AS BIGINT) AS total, CASE WHEN o_orderkey % 3 = 0 THEN CAST(4096 AS BIGINT) END AS superblock FROM orders")
def q20(spark, sf):
    k = F.col("o_orderkey")
    shift = F.when(k % 3 == 0, 255).otherwise(k % 5)
    built = _table(spark, sf, "orders").select("o_orderkey", blocktable.header(shift, F.col("o_custkey") * 8, F.lit(4096)).alias("h"))
    return built.select("o_orderkey", *blocktable.parse_header(F.col("h")))


@query("q21_entropy_levels", """
WITH g AS (SELECT CAST(w AS BIGINT) AS width, l AS level FROM (VALUES (1),(2),(8)) x(w), range(10) y(l)),
s AS (SELECT *, CASE WHEN level = 0 THEN 0 WHEN width = 1 THEN level WHEN level = 1 THEN 0 WHEN level - 1 >= 4 THEN level ELSE level - 1 END AS setting FROM g)
SELECT width, level, CAST(setting AS BIGINT) AS setting, CAST(CASE WHEN setting < 1 THEN 1 WHEN setting > 8 THEN 22 ELSE 2 * setting - 1 END AS BIGINT) AS zstd FROM s""")
def q21(spark, sf):
    g = _grid(spark).where("total = 0 and width in (1, 2, 8)").select("width", "level")
    g = g.withColumn("setting", levels.entropy_level(F.col("level"), F.col("width")))
    return g.select("width", "level", "setting", levels.zstd_level(F.col("setting")).alias("zstd"))


def _coded(name: str, by: str, value: str) -> str:
    return f"""{name} AS (SELECT sb, CAST(ceil(round(sum(c * (log2(n) - log2(c))) / 8, 6)) + count(*) AS BIGINT) AS {name}, CAST(sum(c) AS BIGINT) AS raw_bytes
FROM (SELECT sb, count(*) AS c, CAST(sum(count(*)) OVER (PARTITION BY {by}) AS DOUBLE) AS n FROM by_ GROUP BY {by}, {value}) GROUP BY sb)"""


_BEST = [
    "by_ AS (SELECT idx // {per} AS sb, plane, b, (b - coalesce(lag(b) OVER (PARTITION BY idx // {per}, plane ORDER BY idx), 0)) & 255 AS d FROM planes)",
    _coded("entropy", "sb", "b"), _coded("pl_", "sb, plane", "b"), _coded("dl", "sb, plane", "d"), "bs AS (SELECT blk // {blocks} AS sb, sum(size) AS block FROM bl GROUP BY ALL)",
    "sz AS (SELECT sb, entropy.raw_bytes, block, entropy, pl_ AS planes, dl AS planes_delta, CAST(least(entropy.raw_bytes, block, entropy, pl_, dl) AS BIGINT) AS csize FROM entropy JOIN bs USING (sb) JOIN pl_ USING (sb) JOIN dl USING (sb))",
    "best AS (SELECT sb, CASE csize WHEN raw_bytes THEN 'copy' WHEN block THEN 'block' WHEN entropy THEN 'entropy' WHEN planes THEN 'planes' ELSE 'planes_delta' END AS strategy, raw_bytes, csize FROM sz)",
]


def _best(per: int) -> list[str]:
    return [x.replace("{per}", str(per)).replace("{blocks}", str(per // 256)) for x in _BEST]


@query("q22_best_strategy", sql(USER, BYTES, ROWS, CHOICES, PLANES, BLOCKS, *_best(16_384), then="SELECT sb, strategy, raw_bytes, csize FROM best"))
def q22(spark, sf):
    """The smallest of the modelled strategies of each superblock."""
    return strategy.best(strategy.sizes(users(spark, sf)))


_HEAD = "seq AS (SELECT (idx // 16384) * 1024 + idx % 16384 AS idx, v FROM whole WHERE idx % 16384 < 1024)"


@query("q47_sampled_strategy", sql(TS.replace("seq AS", "whole AS"), _HEAD, BYTES, ROWS, CHOICES, PLANES, BLOCKS, *_best(1024), then="SELECT sb, strategy FROM best"))
def q47(spark, sf):
    """The strategy that the first sixteenth of each superblock speaks for."""
    return strategy.sampled(micros(spark, sf))


@query("q23_rate_level", """
WITH r(level, rate) AS (VALUES (9,1),(8,5),(7,7),(6,9),(5,20),(4,40),(3,60),(2,230),(1,300)),
o AS (SELECT o_orderkey, o_orderkey % 500 AS wanted FROM orders)
SELECT o.o_orderkey, o.wanted, CAST(CASE WHEN o.wanted > 450 THEN 0 ELSE coalesce((SELECT max(r.level) FROM r WHERE r.rate >= o.wanted), 1) END AS BIGINT) AS level FROM o""")
def q23(spark, sf):
    """The level of the first rate not below the wanted one; beyond 1.5 times the last rate a copy (0)."""
    wanted = F.col("o_orderkey") % 500
    found = F.coalesce(*[F.when(wanted <= rate, level) for level, rate in levels.RATES], F.lit(levels.RATES[-1][0]))
    level = F.when(wanted > 1.5 * levels.RATES[-1][1], 0).otherwise(found)
    return _table(spark, sf, "orders").select("o_orderkey", wanted.alias("wanted"), level.cast("bigint").alias("level"))


_SIZES = "SELECT {name!r} AS name, (SELECT count(*) FROM bl) AS blocks, CAST(sum(raw_bytes) AS BIGINT) AS raw_bytes, CAST(sum(size) AS BIGINT) AS model_bytes FROM bl"


@query("q24_ratio_report", " UNION ALL ".join(f"SELECT * FROM ({sql(s, BYTES, ROWS, CHOICES, PLANES, BLOCKS, then=_SIZES.format(name=n))})" for n, s in (("events.ts", TS), ("events.user_id", USER), ("orders.o_custkey", CUST))))
def q24(spark, sf):
    from . import report

    return report.sizes({"events.ts": micros(spark, sf), "events.user_id": users(spark, sf), "orders.o_custkey": customers(spark, sf)}).select("name", "blocks", "raw_bytes", "model_bytes")


@query("q25_element_at", sql(CUST, then="SELECT idx, v FROM seq WHERE idx = 777"))
def q25(spark, sf):
    return vector.at(customers(spark, sf), 777)


@query("q26_slice", sql(CUST, then="SELECT idx - 250 AS idx, v FROM seq WHERE idx >= 250 AND idx < 1300"))
def q26(spark, sf):
    return vector.part(customers(spark, sf), 250, 1300)


@query("q27_sort", sql(CUST, then="SELECT row_number() OVER (ORDER BY v) - 1 AS idx, v FROM seq"))
def q27(spark, sf):
    return vector.sort(customers(spark, sf))


@query("q28_unique", "WITH s AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, event_type AS v FROM events), k AS (SELECT *, lag(v) OVER (ORDER BY idx) AS b FROM s) SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, v FROM k WHERE idx = 0 OR v <> b")
def q28(spark, sf):
    return vector.unique(sequence.index(_table(spark, sf, "events"), ["event_id"], F.col("event_type")))


@query("q29_reverse", sql(CUST, then="SELECT (SELECT count(*) FROM seq) - 1 - idx AS idx, v FROM seq"))
def q29(spark, sf):
    return vector.reverse(customers(spark, sf))


@query("q30_rotate", sql(CUST, then="SELECT (idx - 100 + (SELECT count(*) FROM seq)) % (SELECT count(*) FROM seq) AS idx, v FROM seq"))
def q30(spark, sf):
    return vector.rotate(customers(spark, sf), 100)


@query("q31_partial_sort", sql(CUST, then="SELECT row_number() OVER (ORDER BY v) - 1 AS idx, v FROM (SELECT v FROM seq ORDER BY v LIMIT 50)"))
def q31(spark, sf):
    return vector.smallest(customers(spark, sf), 50)


@query("q32_nth_element", sql(CUST, then="SELECT * FROM (SELECT row_number() OVER (ORDER BY v) - 1 AS idx, v FROM seq) WHERE idx = 1234"))
def q32(spark, sf):
    return vector.nth(customers(spark, sf), 1234)


@query("q33_insert_range", sql(CUST, then="SELECT CASE WHEN idx >= 500 THEN idx + 40 ELSE idx END AS idx, v FROM seq UNION ALL SELECT idx + 500, v FROM seq WHERE idx < 40"))
def q33(spark, sf):
    seq = customers(spark, sf)
    return vector.insert(seq, 500, vector.part(seq, 0, 40))


@query("q34_erase_range", sql(CUST, then="SELECT CASE WHEN idx >= 900 THEN idx - 300 ELSE idx END AS idx, v FROM seq WHERE idx < 600 OR idx >= 900"))
def q34(spark, sf):
    return vector.erase(customers(spark, sf), 600, 900)


@query("q35_resize", sql(CUST, then="SELECT idx, v FROM seq UNION ALL SELECT (SELECT count(*) FROM seq) + i, CAST(-1 AS BIGINT) FROM range(300) t(i)"))
def q35(spark, sf):
    seq = customers(spark, sf)
    return vector.resize(seq, vector.size(seq) + 300, -1)


@query("q36_assign", "SELECT i AS idx, CAST(7 AS BIGINT) AS v FROM range(1000) t(i)")
def q36(spark, sf):
    return vector.assign(customers(spark, sf), 1000, 7)


@query("q37_fill", sql(CUST, then="SELECT idx, CASE WHEN idx >= 100 AND idx < 200 THEN 0 ELSE v END AS v FROM seq"))
def q37(spark, sf):
    return vector.fill(customers(spark, sf), 100, 200, 0)


@query("q38_for_each", sql(CUST, then="SELECT idx, v * 2 + idx AS v FROM seq"))
def q38(spark, sf):
    return vector.transform(customers(spark, sf), F.col("v") * 2 + F.col("idx"))


@query("q39_stop_forward", sql(CUST, then="SELECT coalesce(min(idx) FILTER (v % 97 = 0) + 1, count(*)) AS visited FROM seq"))
def q39(spark, sf):
    return vector.visited(customers(spark, sf), F.col("v") % 97 != 0)


@query("q40_stop_backward", sql(CUST, then="SELECT coalesce((SELECT count(*) FROM seq) - max(idx) FILTER (v % 97 = 0), count(*)) AS visited FROM seq"))
def q40(spark, sf):
    return vector.visited(customers(spark, sf), F.col("v") % 97 != 0, backward=True)


@query("q41_equality", sql(CUST, then="SELECT count(*) AS n_a, count(*) AS n_b, (SELECT count(*) FROM seq a JOIN (SELECT row_number() OVER (ORDER BY v) - 1 AS idx, v FROM seq) b ON a.idx = b.idx WHERE a.v <> b.v) AS different FROM seq"))
def q41(spark, sf):
    seq = customers(spark, sf)
    return vector.differences(seq, vector.sort(seq))


@query("q42_codec_round_trip", sql(TS, then="SELECT idx, v FROM seq"))
def q42(spark, sf):
    """Written as a block table, read and decoded."""
    return blocktable.round_trip(micros(spark, sf))


def _round_trip(name: str, table: str, order: list[str], value: str, in_sql: str, elements: int = blocktable.ELEMENTS) -> None:
    """Registers the round trip of a column of another type, nulls included."""

    @query(name, f"SELECT row_number() OVER (ORDER BY {', '.join(order)}) - 1 AS idx, {in_sql} AS v FROM {table}")
    def run(spark, sf):
        return blocktable.round_trip(sequence.index(_table(spark, sf, table), order, F.expr(value)), elements)


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_round_trip("q48_round_trip_double", "lineitem", _LINE, "l_extendedprice", "l_extendedprice")
_round_trip("q49_round_trip_timestamp", "events", ["event_id"], "ts", "ts")
_round_trip("q50_round_trip_text", "documents", ["doc_id"], "text", "text", blocktable.FEW)
_round_trip("q51_round_trip_nulls", "orders", ["o_orderkey"], "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END")
_round_trip("q52_round_trip_small_int", "lineitem", _LINE, "CAST(l_linenumber AS TINYINT)", "CAST(l_linenumber AS TINYINT)")


@query("q53_round_trip_records", f"SELECT row_number() OVER (ORDER BY {', '.join(_LINE)}) - 1 AS idx, l_quantity AS a, l_linenumber AS b, l_returnflag AS c FROM lineitem")
def q53(spark, sf):
    """Records of several fields."""
    record = F.struct(F.col("l_quantity").alias("a"), F.col("l_linenumber").alias("b"), F.col("l_returnflag").alias("c"))
    return blocktable.round_trip(sequence.index(_table(spark, sf, "lineitem"), _LINE, record)).select("idx", "v.a", "v.b", "v.c")


@query("q54_round_trip_floats", "SELECT row_number() OVER (ORDER BY vec_id, place) - 1 AS idx, v FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS place, unnest(embedding) AS v FROM embeddings)")
def q54(spark, sf):
    """All components of all vectors as one sequence of floats."""
    each = _table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("at", "v"))
    return blocktable.round_trip(sequence.index(each, ["vec_id", "at"], F.col("v")))


_BLOCKTABLE = """
g AS (SELECT idx // 16384 AS sb_idx, min(idx) AS first_idx, count(*) AS n, min(v) AS v_min, max(v) AS v_max, arg_min(v, idx) AS a, arg_max(v, idx) AS z FROM seq GROUP BY ALL),
l AS (SELECT *, CAST(trunc(CAST(z - a AS DOUBLE) / greatest(n - 1, 1)) AS BIGINT) AS step FROM g),
o AS (SELECT l.sb_idx, max(s.v - l.a - (s.idx - l.first_idx) * l.step) - min(s.v - l.a - (s.idx - l.first_idx) * l.step) AS spread FROM l JOIN seq s ON s.idx // 16384 = l.sb_idx GROUP BY ALL),
w AS (SELECT l.*, CASE WHEN v_max = v_min THEN 0 ELSE length(ltrim(bin(v_max - v_min), '0')) END AS bb, CASE WHEN spread = 0 THEN 0 ELSE length(ltrim(bin(spread), '0')) END AS bl FROM l JOIN o USING (sb_idx))"""


@query("q55_block_table", sql(CUST, _BLOCKTABLE, then="SELECT sb_idx, first_idx, n AS n_elems, CASE WHEN least(bb, bl) >= 64 THEN 'copy' WHEN bb <= bl THEN 'base' ELSE 'line' END AS strategy, CAST(least(64, bb, bl) AS BIGINT) AS bits, v_min, v_max FROM w"))
def q55(spark, sf):
    """How each superblock of a column is kept."""
    return blocktable.encode(customers(spark, sf)).select("sb_idx", "first_idx", "n_elems", "strategy", "bits", "v_min", "v_max")


@query("q56_header_status", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (0, 1) THEN 'short' WHEN o_orderkey % 7 = 2 THEN 'shift' WHEN o_orderkey % 7 = 3 THEN 'short' ELSE 'ok' END AS status FROM orders""")
def q56(spark, sf):
    """What reading a header says of whole, cut and wrong ones."""
    k = F.col("o_orderkey") % 7
    built = blocktable.header(F.when(k == 2, 9).when(k.isin(3, 4), 255).otherwise(k % 5), F.col("o_custkey") * 8, F.lit(4096))
    cut = F.when(k == 0, F.lit(b"")).when(k == 1, F.substring(built, 1, 7)).when(k == 3, F.substring(built, 1, 11)).otherwise(built)
    return _table(spark, sf, "orders").select("o_orderkey", blocktable.header_status(cut).alias("status"))


@query("q57_sort_by_key", sql(CUST, then="SELECT row_number() OVER (ORDER BY v % 100, v DESC, idx) - 1 AS idx, v FROM seq"))
def q57(spark, sf):
    """Sorted by a comparator of two keys."""
    return vector.sort(customers(spark, sf), key=F.struct(F.col("v") % 100, -F.col("v")))


@query("q58_clear", sql(CUST, then="SELECT idx, v FROM seq WHERE false"))
def q58(spark, sf):
    return vector.clear(customers(spark, sf))


@query("q43_push_pop", sql(CUST, then="SELECT idx, v FROM seq UNION ALL SELECT (SELECT count(*) FROM seq) + idx, v FROM seq WHERE idx < 45"))
def q43(spark, sf):
    seq = customers(spark, sf)
    return vector.pop_back(vector.push_back(seq, vector.part(seq, 0, 50)), 5)


@query("q44_footprint", sql(USER, BYTES, ROWS, CHOICES, PLANES, BLOCKS, then="SELECT CAST(sum(raw_bytes) AS BIGINT) AS raw_bytes, CAST(sum(size) AS BIGINT) AS model_bytes FROM bl"))
def q44(spark, sf):
    return vector.byte_footprint(stats.block_sizes(stats.plane_sizes(stats.row_stats(users(spark, sf)))))


@query("q45_shuffle", sql(CUST, then="SELECT row_number() OVER (ORDER BY md5(concat_ws(':', 7, idx)), idx) - 1 AS idx, v FROM seq"))
def q45(spark, sf):
    return vector.shuffle(customers(spark, sf), 7)


@query("q46_validation", """
SELECT CAST(w AS BIGINT) AS width, CAST(s AS BIGINT) AS shift, CASE WHEN w < 1 OR w >= 65535 THEN 'width' WHEN s > 15 OR w * 256 * CAST(pow(2, s) AS BIGINT) > 16777215 THEN 'parameter' ELSE 'ok' END AS status
FROM (VALUES (0),(1),(8),(1000),(65534),(65535)) x(w), (VALUES (0),(4),(8),(15),(16)) y(s)""")
def q46(spark, sf):
    grid = [(w, s) for w in (0, 1, 8, 1000, 65534, 65535) for s in (0, 4, 8, 15, 16)]
    w, s = F.col("width"), F.col("shift")
    bytes_ = w * levels.BLOCK_ELEMENTS * F.pow(F.lit(2), s).cast("bigint")
    status = F.when((w < 1) | (w >= levels.MAX_SUPERBLOCK_BYTES // levels.BLOCK_ELEMENTS), "width").when((s > 15) | (bytes_ > levels.MAX_SUPERBLOCK_BYTES), "parameter").otherwise("ok")
    return spark.createDataFrame(grid, "width bigint, shift bigint").select("width", "shift", status.alias("status"))
