"""Mixing sources to target weights by capped water-filling.

Sizes are words. Every source gets a target in proportion to its weight; a target above
``max_epochs`` times the source's size is clamped there and the excess goes to the other
sources by weight until no target is above its cap. That fixed point is found directly:
in ascending order of cap / weight, the sources before the first one that its level does
not fill are clamped, all others share one level.

A target of 1.4 times a source's size takes every document once (whole repetitions) and
then documents in a seeded random order until the remaining 0.4 is reached; the document
at the border gives a part of its words (a fractional repetition). The order is the md5
of seed and doc_id, so reruns and other engines agree. Running sums are taken in two
levels (sums of 4,096 hash ranges of a source, then inside a range), so no source meets
in one task.

Defined results: a null text has size 0; a null source is a source of its own, ranked
last; empty tables give no rows; repeated rows count each; documents of size 0 take 0;
columns of the input other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table, text_or_empty, words

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_EPOCHS = 2
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share_percent=SHARE_PERCENT, max_epochs=MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, size). Only the table of sources is ordered as a whole."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long")
    cap = F.col("source_size") * max_epochs
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    levels = (
        per.withColumn("w", w)
        .withColumn("cap", cap)
        .withColumn("budget", (F.sum("source_size").over(Window.partitionBy()) * share_percent).cast("double") / 100)
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("double")) / F.sum("w").over(after).cast("double"))
        .withColumn("free", F.col("w").cast("double") * F.col("level") <= F.col("cap").cast("double"))
        .withColumn("nth", F.row_number().over(order))
    )
    first = F.min(F.when(F.col("free"), F.col("nth"))).over(Window.partitionBy())
    share = F.max(F.when(F.col("nth") == F.col("first"), F.col("level"))).over(Window.partitionBy())
    levels = levels.withColumn("first", first).withColumn("share", share)
    target = F.when(F.col("nth") >= F.col("first"), F.col("w").cast("double") * F.col("share")).otherwise(F.col("cap").cast("double"))
    return levels.select("source", "source_size", target.alias("target"))


def order_key(seed=SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def n_words() -> Column:
    return F.size(words(text_or_empty())).cast("long")


def borders(mixed: DataFrame) -> DataFrame:
    """(source, whole, border) of a mix: rows before the border (order_key, doc_id, size, rest) are taken whole + 1 times, later
    ones whole times, and rows at it share rest words besides. A null border: none is left out."""
    whole = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long")
    same = mixed.groupBy("source", "order_key", "doc_id", "size").agg(F.count(F.lit(1)).alias("rows"), F.sum("taken").alias("taken"), F.first(whole).alias("whole"))
    same = same.withColumn("rest", F.col("taken") - F.col("rows") * F.col("size") * F.col("whole"))
    cut = F.when(F.col("rest") < F.col("rows") * F.col("size"), F.struct("order_key", "doc_id", "size", "rest"))
    return same.groupBy("source").agg(F.first("whole").alias("whole"), F.min(cut).alias("border"))


def mix(docs: DataFrame, weights=WEIGHTS, share_percent=SHARE_PERCENT, max_epochs=MAX_EPOCHS, seed=SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, order_key) for documents (doc_id, text, source)."""
    sizes = materialise(docs.select("doc_id", "source", n_words().alias("size"), order_key(seed).alias("order_key")))
    targets = source_targets(sizes, weights, share_percent, max_epochs)
    whole = F.floor(F.col("target") / F.col("source_size")).cast("long")
    per_source = targets.select(
        F.col("source"),
        "source_size",
        "target",
        F.when(F.col("source_size") == 0, 0).otherwise(whole).alias("whole"),
    ).withColumn("extra", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    part = F.substring("order_key", 1, 3)
    sizes = sizes.withColumn("part", part)
    parts = sizes.groupBy("source", "part").agg(F.sum("size").alias("n"))
    by_part = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.coalesce(F.sum("n").over(by_part), F.lit(0))).drop("n")
    starts = starts.alias("s").join(per_source.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).drop(F.col("t.source"))
    inside = Window.partitionBy("source", "part").orderBy("order_key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = sizes.withColumn("upto", F.sum("size").over(inside) - F.col("size")).alias("d")
    joined = running.join(starts.alias("t"), (F.col("d.part") == F.col("t.part")) & F.col("d.source").eqNullSafe(F.col("t.source")))
    left = F.col("extra") - F.col("start") - F.col("upto")
    taken = F.col("size") * F.col("whole") + F.least(F.col("size"), F.greatest(left, F.lit(0).cast("long")))
    return joined.select("d.doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "d.source", "order_key")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
         2 * source_size AS cap FROM per),
levels AS (
  SELECT *, row_number() OVER o AS nth,
         (CAST(150 * sum(source_size) OVER () AS DOUBLE) / 100
          - CAST(coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / CAST(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM ranked WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
firsts AS (SELECT *, min(CASE WHEN w * level <= cap THEN nth END) OVER () AS first FROM levels),
shares AS (SELECT *, max(CASE WHEN nth = first THEN level END) OVER () AS share FROM firsts),
targets AS (SELECT source, source_size, CASE WHEN nth >= first THEN w * share ELSE CAST(cap AS DOUBLE) END AS target FROM shares),
plans AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM targets),
run AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS before FROM sizes)
SELECT r.doc_id, r.size, p.source_size, p.target,
       CAST(r.size * p.whole + least(r.size, greatest(CAST(round(p.target) AS BIGINT) - p.whole * p.source_size - r.before, 0)) AS BIGINT) AS taken
FROM run r JOIN plans p ON r.source IS NOT DISTINCT FROM p.source
"""
