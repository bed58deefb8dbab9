"""Operations of a compressed vector on sequences (idx, v) with idx 0 to n - 1.

A sequence is immutable: what changes one returns another. Nothing is ordered as a whole in
one task; where positions move, they are computed from idx, and where rows vanish they are
numbered anew by buckets of BUCKET positions with the counts of the buckets before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import index

BUCKET = 65_536


def size(seq: DataFrame) -> int:
    return seq.count()


def at(seq: DataFrame, n: int) -> DataFrame:
    """The element at n; raises IndexError where there is none."""
    found = seq.where(F.col("idx") == n)
    if n < 0 or found.isEmpty():
        raise IndexError(n)
    return found


def part(seq: DataFrame, first: int, last: int) -> DataFrame:
    """Elements first to last - 1, renumbered from 0."""
    return seq.where((F.col("idx") >= first) & (F.col("idx") < last)).select((F.col("idx") - first).alias("idx"), "v")


def front_back(seq: DataFrame) -> DataFrame:
    return seq.agg(F.min_by("v", "idx").alias("front"), F.max_by("v", "idx").alias("back"))


def renumber(rows: DataFrame) -> DataFrame:
    """Rows (idx, v) with gaps in idx, numbered from 0 without gaps."""
    rows = rows.withColumn("bucket", F.floor(F.col("idx") / BUCKET))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("bucket").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("idx")) - 1
    return rows.join(starts, F.col("bucket") == F.col("of")).select((F.col("start") + inside).cast("bigint").alias("idx"), "v")


def previous(seq: DataFrame, name: str = "before") -> DataFrame:
    """Adds the value before each one; null at idx 0."""
    rows = seq.withColumn("bucket", F.floor(F.col("idx") / BUCKET))
    last = rows.groupBy("bucket").agg(F.max_by("v", "idx").alias("last")).select((F.col("bucket") + 1).alias("next"), "last")
    w = Window.partitionBy("bucket").orderBy("idx")
    rows = rows.withColumn("near", F.lag("v").over(w)).withColumn("first", F.row_number().over(w) == 1)
    met = rows.join(last, F.col("bucket") == F.col("next"), "left")
    return met.select("idx", "v", F.when(F.col("first"), F.col("last")).otherwise(F.col("near")).alias(name))


def sort(seq: DataFrame, descending: bool = False, key: Column | None = None) -> DataFrame:
    """By value, or by a key (a struct to compare by several); stable: equal ones keep their order, also over many partitions. Nulls come first (last if descending)."""
    keyed = seq.select((F.col("v") if key is None else key).alias("k"), "idx", "v")
    return index(keyed, ["k", "idx"], F.col("v"), descending=("k",) if descending else ())


def unique(seq: DataFrame) -> DataFrame:
    """Without elements equal to the one before."""
    near = previous(seq)
    return renumber(near.where((F.col("idx") == 0) | ~F.col("v").eqNullSafe(F.col("before"))).select("idx", "v"))


def reverse(seq: DataFrame) -> DataFrame:
    n = size(seq)
    return seq.select((F.lit(n - 1) - F.col("idx")).cast("bigint").alias("idx"), "v")


def rotate(seq: DataFrame, k: int) -> DataFrame:
    """The element at k becomes the first."""
    n = size(seq)
    return seq.select(F.pmod(F.col("idx") - k, F.lit(max(1, n))).cast("bigint").alias("idx"), "v")


def smallest(seq: DataFrame, k: int) -> DataFrame:
    """The k smallest, in order: a top-k, no full sort."""
    least = seq.orderBy("v").limit(k)
    return least.select((F.row_number().over(Window.orderBy("v")) - 1).cast("bigint").alias("idx"), "v")


def nth(seq: DataFrame, k: int, slack: float = 0.005) -> DataFrame:
    """(idx, v): the value that a sort would put at k, of a sequence of numbers without nulls.

    Approximate quantiles bound it, the values below are counted, and only those between are sorted.
    """
    n = size(seq)
    if not 0 <= k < n:
        return seq.limit(0)
    at = [max(0.0, k / n - slack), min(1.0, (k + 1) / n + slack)]
    low, high = seq.agg(F.percentile_approx("v", at, round(4 / slack)).alias("q")).first().q
    low = None if at[0] == 0 else low
    high = None if at[1] == 1 else high
    least = F.lit(True) if low is None else F.col("v") >= low
    most = F.lit(True) if high is None else F.col("v") <= high
    below, inside = seq.agg(F.count_if(~least), F.count_if(least & most)).first()
    if not below <= k < below + inside:  # the quantiles were too far off
        return sort(seq).where(F.col("idx") == k)
    counts = seq.where(least & most).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("v")) + below  # different values of about 2 * slack of all
    return counts.select("v", "n", upto.alias("upto")).where((F.col("upto") > k) & (F.col("upto") - F.col("n") <= k)).select(F.lit(k).cast("bigint").alias("idx"), "v")


def clear(seq: DataFrame) -> DataFrame:
    return seq.limit(0)


def insert(seq: DataFrame, position: int, other: DataFrame) -> DataFrame:
    m = size(other)
    moved = seq.select(F.when(F.col("idx") >= position, F.col("idx") + m).otherwise(F.col("idx")).alias("idx"), "v")
    return moved.unionByName(other.select((F.col("idx") + position).alias("idx"), "v"))


def erase(seq: DataFrame, first: int, last: int) -> DataFrame:
    kept = seq.where((F.col("idx") < first) | (F.col("idx") >= last))
    return kept.select(F.when(F.col("idx") >= last, F.col("idx") - (last - first)).otherwise(F.col("idx")).alias("idx"), "v")


def constant(seq: DataFrame, first: int, last: int, value) -> DataFrame:
    """A run of one value of the sequence's type at positions first to last - 1."""
    return seq.sparkSession.range(first, last).select(F.col("id").alias("idx"), F.lit(value).cast(seq.schema["v"].dataType).alias("v"))


def resize(seq: DataFrame, n: int, value=0) -> DataFrame:
    have = size(seq)
    kept = seq.where(F.col("idx") < n)
    return kept.unionByName(constant(seq, have, n, value)) if n > have else kept


def assign(seq: DataFrame, n: int, value) -> DataFrame:
    return constant(seq, 0, n, value)


def fill(seq: DataFrame, first: int, last: int, value) -> DataFrame:
    hit = (F.col("idx") >= first) & (F.col("idx") < last)
    return seq.select("idx", F.when(hit, F.lit(value).cast(seq.schema["v"].dataType)).otherwise(F.col("v")).alias("v"))


def push_back(seq: DataFrame, other: DataFrame) -> DataFrame:
    return insert(seq, size(seq), other)


def pop_back(seq: DataFrame, k: int = 1) -> DataFrame:
    n = size(seq)
    return seq.where(F.col("idx") < n - k)


def transform(seq: DataFrame, value: Column) -> DataFrame:
    return seq.select("idx", value.alias("v"))


def visited(seq: DataFrame, go_on: Column, first: int = 0, last: int | None = None, backward: bool = False) -> DataFrame:
    """(visited): elements that a loop sees until, and with, the first where go_on is false."""
    last = size(seq) if last is None else last
    seen = seq.where((F.col("idx") >= first) & (F.col("idx") < last))
    stop = F.when(~go_on, F.col("idx"))
    n = (F.lit(last) - F.max(stop)) if backward else (F.min(stop) - first + 1)
    return seen.agg(F.coalesce(n, F.count(F.lit(1))).cast("bigint").alias("visited"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n_a, n_b, different): equal sequences have equal sizes and none different."""
    met = a.select("idx", F.col("v").alias("x"), F.lit(1).alias("in_a")).join(b.select("idx", F.col("v").alias("y"), F.lit(1).alias("in_b")), "idx", "full")
    same = F.col("x").eqNullSafe(F.col("y")) & F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    n = lambda c: F.count(c).cast("bigint")
    return met.agg(n("in_a").alias("n_a"), n("in_b").alias("n_b"), F.count_if(~same).cast("bigint").alias("different"))


def shuffle(seq: DataFrame, seed: int) -> DataFrame:
    """The same permutation for the same seed and size: by the MD5 of seed and position."""
    keyed = seq.select(F.md5(F.concat_ws(":", F.lit(seed), F.col("idx")).cast("binary")).alias("k"), "idx", "v")
    return index(keyed, ["k", "idx"], F.col("v"))


def byte_footprint(blocks: DataFrame) -> DataFrame:
    """(raw_bytes, model_bytes) of a sequence, from block sizes."""
    return blocks.agg(F.sum("raw_bytes").alias("raw_bytes"), F.sum("size").alias("model_bytes"))
