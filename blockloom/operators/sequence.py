"""Ordered columns as sequences (idx, v), and their byte planes.

index() numbers rows without gathering them in one task: rows are dealt by ranges of the order
columns, numbered inside their partition, and shifted by the sizes of the partitions before
it (one row a partition, broadcast). Ranges come from a sample and may differ when they are
made again, so the numbered rows are written once. index_small() is the one-window form for tables that are
known to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import BLOCK_ELEMENTS, ROW_BYTES
from ..sources.shared import settle


def index(df: DataFrame, order: list[str], value: Column, partitions: int | None = None, descending: tuple[str, ...] = ()) -> DataFrame:
    """(idx, v) from 0 in the given order, of which some columns may descend; rows that tie are in no particular order."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"order_{i}" for i in range(len(order))]
    dealt = df.select(*[F.col(o).alias(k) for o, k in zip(order, names)], value.alias("v"))
    keys = [F.col(k).desc() if o in descending else F.col(k).asc() for o, k in zip(order, names)]
    dealt = dealt.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("v", F.monotonically_increasing_id().alias("at"))
    dealt = settle(dealt)
    dealt = dealt.select("v", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("inside"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part").agg((F.max("inside") + 1).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return dealt.join(F.broadcast(starts), "part").select((F.col("start") + F.col("inside")).alias("idx"), "v")  # starts has a row a partition


def index_small(df: DataFrame, order: list[str], value: Column) -> DataFrame:
    """The same by one window: for results that fit a task."""
    return df.select((F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint").alias("idx"), value.alias("v"))


def placed(seq: DataFrame) -> DataFrame:
    """Adds block, row in the block and place in the row."""
    i = F.col("idx")
    return seq.select(
        "*",
        F.floor(i / BLOCK_ELEMENTS).alias("blk"),
        F.floor(i % BLOCK_ELEMENTS / ROW_BYTES).alias("row"),
        (i % ROW_BYTES).alias("place"),
    )


def bytes_array(value: Column, width: int) -> Column:
    return F.array(*[F.shiftright(value, 8 * p).bitwiseAND(255).cast("int") for p in range(width)])


def planes(seq: DataFrame, width: int = 8) -> DataFrame:
    """(idx, plane, b): every value as its unsigned bytes."""
    return seq.select("idx", F.posexplode(bytes_array(F.col("v").cast("bigint"), width)).alias("plane", "b"))


def merge(planes_: DataFrame, width: int = 8) -> DataFrame:
    """(idx, v) from planes; the top byte is the signed one."""
    top = F.when(F.col("b") > 127, F.col("b") - 256).otherwise(F.col("b")).cast("bigint")
    part = F.when(F.col("plane") == width - 1, top * (1 << 8 * (width - 1)) if width < 8 else top * F.lit(1 << 56)).otherwise(F.col("b").cast("bigint") * F.pow(F.lit(2), F.col("plane") * 8).cast("bigint"))
    return planes_.groupBy("idx").agg(F.sum(part).alias("v"))


#: Elements of a superblock; superblocks of more bytes than LANE_BYTES are differenced in independent lanes.
ELEMENTS, LANE_BYTES, LANES = 16_384, 2048, 4


def streams(seq: DataFrame, width: int = 8, elements: int = ELEMENTS) -> DataFrame:
    """(sb, pos, lane, b): of each superblock its planes one after another, cut into lanes; what is left over joins the last one."""
    total = seq.count()
    i, sb = F.col("idx"), F.floor(F.col("idx") / elements)
    n = F.least(F.lit(elements).cast("bigint"), F.lit(total) - sb * elements)
    pos = i % elements + F.col("plane") * n
    lane = F.when(n * width <= LANE_BYTES, 0).otherwise(F.least(F.floor(pos / F.floor(n * width / LANES)), F.lit(LANES - 1)))
    return planes(seq, width).select(sb.alias("sb"), pos.alias("pos"), lane.alias("lane"), "b")


def delta(streams_: DataFrame) -> DataFrame:
    """(sb, pos, lane, d): differences modulo 256 within each lane of each superblock."""
    w = Window.partitionBy("sb", "lane").orderBy("pos")
    return streams_.select("sb", "pos", "lane", (F.col("b") - F.coalesce(F.lag("b").over(w), F.lit(0))).bitwiseAND(255).alias("d"))


def undo_delta(deltas: DataFrame) -> DataFrame:
    """(sb, pos, lane, b): running sums modulo 256 in the same lanes."""
    w = Window.partitionBy("sb", "lane").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.select("sb", "pos", "lane", F.sum("d").over(w).bitwiseAND(255).cast("int").alias("b"))
