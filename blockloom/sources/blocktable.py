"""Sequences as tables of superblocks: one row, and one range of idx, a superblock.

A superblock keeps its elements in an array, as they are (``copy``), as what they exceed the
smallest one by (``base``) or as what they differ by from a straight line through the first and
the last one (``line``), whichever takes the fewest bits an element; columns of the row say how to undo
it, so an element is decoded without its neighbours. The arrays are stored by Parquet with zstd, which packs
small numbers and runs. Whole numbers have all three, other types (floats, dates, text, binary,
structs, arrays) are copied; nulls stay nulls.

The row holds the smallest and largest value, so a filter on values or on positions skips
superblocks (and Parquet row groups) before anything is decoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.levels import CUSTOM_SHIFT
from .shared import folder

#: Elements of a superblock: of fixed width, and of any length.
ELEMENTS, FEW = 16_384, 256
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Ranges from here on are copied: sums and differences of bigint could overflow.
WIDEST = 1 << 61


def _le(value: Column, n: int) -> Column:
    """Little-endian bytes of a number, as binary."""
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * n, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * (n - 1 - i) + 1, 2) for i in range(n)]))


def _number(raw: Column, first: int, n: int) -> Column:
    digits = F.concat(*[F.hex(F.substring(raw, first + n - 1 - i, 1)) for i in range(n)])
    return F.conv(digits, 16, 10).cast("bigint")


def header(shift: Column, total: Column, superblock: Column) -> Column:
    """A frame header: shift, 7 bytes of size and, for a shift of 255, 4 bytes of superblock size."""
    own = F.when(shift == CUSTOM_SHIFT, _le(superblock, 4)).otherwise(F.lit(b""))
    return F.concat(_le(shift, 1), _le(total, 7), own)


def parse_header(raw: Column) -> list[Column]:
    shift = _number(raw, 1, 1)
    return [shift.alias("shift"), _number(raw, 2, 7).alias("total"), F.when(shift == CUSTOM_SHIFT, _number(raw, 9, 4)).alias("superblock")]


def header_status(raw: Column) -> Column:
    """'ok', or what is wrong with the bytes of a header."""
    shift = _number(raw, 1, 1)
    short = (F.octet_length(raw) < 8) | (shift == CUSTOM_SHIFT) & (F.octet_length(raw) < 12)
    return F.when(F.octet_length(raw) == 0, "short").when(short, "short").when((shift > 4) & (shift != CUSTOM_SHIFT), "shift").otherwise("ok")


def _bits(spread: Column) -> Column:
    """Bits of numbers from 0 to spread."""
    return F.when(spread == 0, 0).otherwise(F.length(F.bin(spread)))


def encode(seq: DataFrame, elements: int = ELEMENTS) -> DataFrame:
    """Block table of a sequence (idx, v) of any type, nulls too; idx without gaps. One exchange, by superblock."""
    kind = seq.schema["v"].dataType
    whole = isinstance(kind, WHOLE)
    ranged = not isinstance(kind, (T.MapType, T.VariantType))
    v = F.col("v").cast("bigint") if whole else F.col("v")
    null = F.lit(None).cast("bigint" if whole else kind)
    rows = seq.select(F.floor(F.col("idx") / elements).alias("sb_idx"), "idx", v.alias("v")).groupBy("sb_idx").agg(
        F.min("idx").alias("first_idx"),
        F.max("idx").alias("last_idx"),
        F.count(F.lit(1)).alias("n_elems"),
        F.count_if(F.col("v").isNull()).alias("n_null"),
        (F.min("v") if ranged else F.first(null)).alias("v_min"),
        (F.max("v") if ranged else F.first(null)).alias("v_max"),
        F.transform(F.sort_array(F.collect_list(F.struct("idx", F.struct("v").alias("of")))) if ranged else F.array_sort(F.collect_list(F.struct("idx", F.struct("v").alias("of"))), lambda a, b: (a["idx"] - b["idx"]).cast("int")), lambda x: x["of"]["v"]).alias("payload"),
    )
    gaps = F.col("last_idx") - F.col("first_idx") + 1 != F.col("n_elems")
    rows = rows.withColumn("n_elems", F.when(gaps, F.raise_error(F.lit("idx has gaps or repeats in a superblock")).cast("bigint")).otherwise(F.col("n_elems")))
    if not whole:
        none = F.lit(None).cast("bigint")
        return rows.select("sb_idx", "first_idx", "n_elems", "n_null", F.lit("copy").alias("strategy"), none.alias("bits"), "v_min", "v_max", none.alias("base"), none.alias("step"), "payload")
    ends = F.element_at("payload", 1), F.element_at("payload", -1)
    narrow = (F.col("v_max").cast("decimal(38,0)") - F.col("v_min").cast("decimal(38,0)")) < WIDEST
    sloped = narrow & ends[0].isNotNull() & ends[1].isNotNull()
    rows = rows.withColumn("rise", F.when(sloped, F.expr("(element_at(payload, -1) - element_at(payload, 1)) div greatest(n_elems - 1, 1)")))
    off_line = F.transform("payload", lambda x, i: x - F.element_at("payload", 1) - i * F.col("rise"))
    rows = rows.withColumn("off", F.when(F.col("rise").isNotNull(), off_line)).withColumn("low", F.array_min("off"))
    width = 8 * {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8}[type(kind)]
    rows = rows.withColumn("bits_base", F.when(narrow, _bits(F.when(narrow, F.col("v_max") - F.col("v_min"))))).withColumn("bits_line", _bits(F.array_max("off") - F.col("low")))
    bits = F.least(F.lit(width), "bits_base", "bits_line")
    how = F.when(bits == width, "copy").when(bits == F.col("bits_base"), "base").otherwise("line")
    rows = rows.withColumn("strategy", how)
    is_ = lambda s: F.col("strategy") == s
    base = F.when(is_("base"), F.col("v_min")).when(is_("line"), F.element_at("payload", 1) + F.col("low"))
    stored = F.when(is_("copy"), F.col("payload")).when(is_("base"), F.transform("payload", lambda x: x - F.col("v_min"))).otherwise(F.transform("off", lambda x: x - F.col("low")))
    return rows.select("sb_idx", "first_idx", "n_elems", "n_null", "strategy", bits.cast("bigint").alias("bits"), "v_min", "v_max", base.alias("base"), F.when(is_("line"), F.col("rise")).alias("step"), stored.alias("payload"))


def decode(blocks: DataFrame, kind: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(idx, v) of a block table, with the columns to keep of its rows; kind: the type of v, as of the sequence that was encoded."""
    each = blocks.select(*keep, "first_idx", "base", "step", F.posexplode("payload").alias("at", "x"))
    v = F.col("x") if dict(each.dtypes)["x"] != "bigint" else F.col("x") + F.coalesce("base", F.lit(0)) + F.col("at") * F.coalesce("step", F.lit(0))
    return each.select(*keep, (F.col("first_idx") + F.col("at")).alias("idx"), (v.cast(kind) if kind else v).alias("v"))


def between(blocks: DataFrame, first: int, last: int) -> DataFrame:
    """Elements first to last - 1: other superblocks are skipped by their positions."""
    hit = (F.col("first_idx") < last) & (F.col("first_idx") + F.col("n_elems") > first)
    return decode(blocks.where(hit)).where((F.col("idx") >= first) & (F.col("idx") < last))


def equal_to(blocks: DataFrame, value) -> DataFrame:
    """Elements of a value: superblocks whose range excludes it are skipped."""
    return decode(blocks.where((F.col("v_min") <= value) & (F.col("v_max") >= value))).where(F.col("v") == value)


def write(blocks: DataFrame, path: str) -> None:
    blocks.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def read(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def footprint(spark, path: str) -> DataFrame:
    """(files, bytes) that a written block table takes on disk; file contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.select("length").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def round_trip(seq: DataFrame, elements: int = ELEMENTS) -> DataFrame:
    """The sequence from a block table that was written to the shared folder."""
    path = folder(seq.sparkSession)
    write(encode(seq, elements), path)
    return decode(read(seq.sparkSession, path), seq.schema["v"].dataType.simpleString())
