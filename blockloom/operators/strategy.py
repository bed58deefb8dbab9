"""Which way of compressing a superblock is the smallest, as a query over sizes.

Sizes are models of whole superblocks: ``copy`` takes all bytes; ``block`` what stats.block_sizes()
says; ``entropy``, ``planes`` and ``planes_delta`` what an entropy coder without context needs for the bytes as they are, for
each byte plane on its own, and for each plane's differences of neighbours (the counts of byte values give
the bits, and each different value a byte of its table). Real compression is left to the storage format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats
from .sequence import ELEMENTS, bytes_array

#: Ties go to the first.
STRATEGIES = ("copy", "block", "entropy", "planes", "planes_delta")


def _bits(count: Column, by: list[str]) -> Column:
    """Bits for values that come count times, of all rows with the same columns by."""
    n = F.sum(count).over(Window.partitionBy(*by))
    return count * (F.log2(n) - F.log2(count))


def _bytes_of(bits: Column) -> Column:
    return F.ceil(F.round(bits / 8, 6)).cast("bigint")


def sizes(seq: DataFrame, width: int = 8, elements: int = ELEMENTS) -> DataFrame:
    """(sb, raw_bytes, block, entropy, planes, planes_delta) of each superblock of whole numbers."""
    order = Window.partitionBy("sb").orderBy("idx")
    v = F.col("v").cast("bigint")
    near = seq.select(F.floor(F.col("idx") / elements).alias("sb"), "idx", v.alias("v")).withColumn("v1", F.coalesce(F.lag("v").over(order), F.lit(0).cast("bigint")))
    pairs = F.posexplode(F.arrays_zip(bytes_array(F.col("v"), width).alias("a"), bytes_array(F.col("v1"), width).alias("b"))).alias("plane", "y")
    each = near.select("sb", pairs).select("sb", "plane", F.col("y.a").alias("b"), (F.col("y.a") - F.col("y.b")).bitwiseAND(255).alias("d"))
    counts = each.groupBy("sb", "plane", "b", "d").agg(F.count(F.lit(1)).alias("n"))

    def coded(by: list[str], value: str) -> DataFrame:
        c = counts.groupBy(*by, value).agg(F.sum("n").alias("c"))
        return c.withColumn("bits", _bits(F.col("c"), by)).groupBy("sb").agg((_bytes_of(F.sum("bits")) + F.count(F.lit(1))).alias("size"), F.sum("c").alias("raw_bytes"))

    entropy = coded(["sb"], "b").select("sb", "raw_bytes", F.col("size").alias("entropy"))
    planes = coded(["sb", "plane"], "b").select("sb", F.col("size").alias("planes"))
    delta = coded(["sb", "plane"], "d").select("sb", F.col("size").alias("planes_delta"))
    blocks = stats.block_sizes(stats.plane_sizes(stats.row_stats(seq, width), width), width)
    block = blocks.groupBy(F.floor(F.col("blk") / (elements // 256)).alias("sb")).agg(F.sum("size").alias("block"))
    return entropy.join(block, "sb").join(planes, "sb").join(delta, "sb")


def best(sizes_: DataFrame) -> DataFrame:
    """(sb, strategy, raw_bytes, csize): the smallest."""
    of = {"copy": F.col("raw_bytes"), **{s: F.col(s) for s in STRATEGIES[1:]}}
    least = F.least(*of.values())
    name = F.coalesce(*[F.when(c == least, s) for s, c in of.items()])
    return sizes_.select("sb", name.alias("strategy"), "raw_bytes", least.alias("csize"))


def sampled(seq: DataFrame, width: int = 8, elements: int = ELEMENTS, share: int = 16) -> DataFrame:
    """(sb, strategy): the smallest on the first blocks of each superblock, a share of it. One block's worth at least; only those rows are worked on."""
    head = max(256, elements // share // 256 * 256)
    sb = F.floor(F.col("idx") / elements)
    first = seq.where(F.col("idx") % elements < head).select((sb * head + F.col("idx") % elements).alias("idx"), "v")
    return best(sizes(first, width, head)).select("sb", "strategy")
