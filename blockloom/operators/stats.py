"""Statistics of rows, planes and blocks, and the sizes that they would be encoded to.

A row is 16 bytes of one plane of one block of 256 elements. Neighbours are taken from the
sequence itself (one window over each block) before values are split into bytes, and every
aggregate is by block and something, so a single exchange by block serves all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import BLOCK_ELEMENTS, ROW_BYTES
from .sequence import bytes_array, placed

SAME, RAW, NORMAL, NORMAL_RLE, PARTIAL = 0, 1, 2, 3, 4


def signed(b: Column) -> Column:
    return F.when(b > 127, b - 256).otherwise(b)


def wrap(b: Column) -> Column:
    """A difference of bytes as a signed byte."""
    return signed(b.bitwiseAND(255))


def bit_width(spread: Column) -> Column:
    """Bits for values from 0 to spread; 7 is never used."""
    w = F.when(spread == 0, 0)
    for bits in (1, 2, 3, 4, 5, 6):
        w = w.when(spread < 1 << bits, bits)
    return w.otherwise(8)


def direct_width(spread: Column) -> Column:
    return F.when(bit_width(spread) == 6, 8).otherwise(bit_width(spread))


def byte_rows(seq: DataFrame, width: int = 8) -> DataFrame:
    """(blk, row, plane, idx, x, d, dd, same): signed bytes, differences to the byte before and to the difference before."""
    w = Window.partitionBy("blk").orderBy("idx")
    v = F.col("v").cast("bigint")
    near = placed(seq).select("idx", "blk", "row", "place", v.alias("v"), F.lag(v, 1).over(w).alias("v1"), F.lag(v, 2).over(w).alias("v2"))
    split = lambda c: bytes_array(F.coalesce(c, F.lit(0).cast("bigint")), width)
    each = near.select("idx", "blk", "row", "place", F.posexplode(F.arrays_zip(split(F.col("v")).alias("a"), split(F.col("v1")).alias("b"), split(F.col("v2")).alias("c"))).alias("plane", "y"))
    a, b, c = (F.col(f"y.{k}") for k in "abc")
    before = F.when(F.col("place") > 0, wrap(b - c)).otherwise(0)
    return each.select("blk", "row", "plane", "idx", signed(a).alias("x"), wrap(a - b).alias("d"), before.alias("d_before"))


def row_stats(seq: DataFrame, width: int = 8) -> DataFrame:
    """(blk, plane, row, n, mn, mx, dmn, dmx, rle, drle)."""
    return byte_rows(seq, width).groupBy("blk", "plane", "row").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("x").alias("mn"),
        F.max("x").alias("mx"),
        F.min("d").alias("dmn"),
        F.max("d").alias("dmx"),
        F.sum((F.col("d") != 0).cast("bigint")).alias("rle"),
        F.sum((F.col("d") != F.col("d_before")).cast("bigint")).alias("drle"),
    )


def row_widths(rows: DataFrame) -> DataFrame:
    """Adds b0 (direct) and b1 (delta)."""
    return rows.select("*", direct_width(F.col("mx") - F.col("mn")).alias("b0"), bit_width(F.col("dmx") - F.col("dmn")).alias("b1"))


def row_choices(rows: DataFrame) -> DataFrame:
    """Adds how a row is encoded: bits, header, size, base (what its values are stored above)."""
    r = row_widths(rows)
    r = r.withColumn("bits", F.least("b0", "b1")).withColumn("plain", F.col("bits") * 2 + (F.col("bits") != 8).cast("int"))
    r = r.withColumn("base", F.when(F.col("b0") == F.col("bits"), F.col("mn")).otherwise(F.col("dmn")))
    rle, drle = F.col("rle") + 2, F.col("drle") + 2
    best = F.least("plain", rle)
    runs = F.when(drle < best, 6).when(rle < F.col("plain"), 7)
    packed = F.when(F.col("bits") == 8, 15).when(F.col("b1") < F.col("b0"), F.col("bits") + 8).otherwise(F.col("bits"))
    return r.select("*", F.coalesce(runs, packed).cast("bigint").alias("header"), F.least(best, drle).cast("bigint").alias("size"))


def plane_sizes(rows: DataFrame, width: int = 8) -> DataFrame:
    """(blk, plane, kind, size, bases_rle, others, changes, n) of all blocks, from row statistics.

    The last block may be partial: its whole rows are packed without runs, the bytes after them are kept as they are.
    """
    chosen = row_choices(rows)
    w = Window.partitionBy("blk", "plane").orderBy("row")
    chosen = chosen.withColumn("changed", (F.col("base") != F.coalesce(F.lag("base").over(w), F.lit(0))).cast("bigint"))
    whole = F.col("n") == ROW_BYTES
    sums = chosen.groupBy("blk", "plane").agg(
        F.sum("n").alias("n"),
        F.sum("size").alias("rows_size"),
        F.sum(((F.col("header") == 6) | (F.col("header") == 7) | (F.col("bits") == 8)).cast("bigint")).alias("others"),
        F.sum("changed").alias("changes"),
        (F.min("mn") == F.max("mx")).alias("same"),
        F.sum(F.when(whole, F.col("plain")).otherwise(0)).alias("plain_size"),
        F.count_if(whole).alias("whole_rows"),
        F.coalesce(F.min(F.when(whole, F.col("mn"))) == F.max(F.when(whole, F.col("mx"))), F.lit(False)).alias("whole_same"),
    )
    saved = (16 - F.col("others")) - (F.col("changes") + 2)
    total = 8 + F.col("rows_size") - F.greatest(saved, F.lit(0))
    full = F.col("n") == BLOCK_ELEMENTS
    packed = F.when(F.col("whole_rows") == 0, 0).when(F.col("whole_same"), 1).otherwise(8 + F.col("plain_size"))
    kind = F.when(~full, PARTIAL).when(F.col("same"), SAME).when(total > 256, RAW).when(saved > 0, NORMAL_RLE).otherwise(NORMAL)
    size = F.when(~full, packed + F.col("n") - F.col("whole_rows") * ROW_BYTES).when(F.col("same"), 1).otherwise(F.least(total, F.lit(256)))
    return sums.select("blk", "plane", kind.cast("bigint").alias("kind"), size.cast("bigint").alias("size"), F.col("changes"), "others", (full & (saved > 0)).alias("bases_rle"), "n")


def block_sizes(planes: DataFrame, width: int = 8) -> DataFrame:
    """(blk, size, raw_bytes): the kinds of planes, a mark for a partial block, and the planes."""
    n = F.max("n")
    head = F.when(n >= ROW_BYTES, (width + 1) // 2).otherwise(0) + F.when(n < BLOCK_ELEMENTS, 1).otherwise(0)
    return planes.groupBy("blk").agg((F.sum("size") + head).cast("bigint").alias("size"), F.sum("n").cast("bigint").alias("raw_bytes"))


def early_abort(blocks: DataFrame, blocks_a_superblock: int, target: float, width: int = 8) -> DataFrame:
    """(sb, n, head_bytes, head_size, go_on): whether the first sixteenth of a superblock reaches the target ratio."""
    at = blocks.withColumn("sb", F.floor(F.col("blk") / blocks_a_superblock)).withColumn("k", F.col("blk") % blocks_a_superblock)
    head = at.where(F.col("k") < max(1, blocks_a_superblock // 16))
    out = head.groupBy("sb").agg(F.sum("raw_bytes").alias("head_bytes"), F.sum("size").alias("head_size"))
    return out.withColumn("go_on", F.col("head_bytes") >= F.col("head_size") * target)


def earlier_words(seq: DataFrame, word: Column) -> DataFrame:
    """(idx, blk, distance): how far back in its block the same word was last; null at its first place."""
    w = Window.partitionBy("blk", "word").orderBy("idx")
    return placed(seq).withColumn("word", word).select("idx", "blk", (F.col("idx") - F.lag("idx").over(w)).alias("distance"))
