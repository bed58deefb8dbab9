"""Helpers shared by the operators: words, shared folders, materialising, ranges."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import sys
import tempfile
import uuid
import weakref

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words; everything else belongs to a word.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


#: Bytes that a cache of a Python worker may hold.
CACHE_BYTES = 32 << 20


class Cache(dict):
    """A cache of a Python worker, bounded by bytes, of two generations.

    When half of the bytes are used, what was put in becomes the old generation, and the old one before it
    goes; a user of an old entry puts it in again. Workers go from stage to stage: the cache in use empties those
    of other operators.
    """

    every: weakref.WeakSet = weakref.WeakSet()
    __hash__ = object.__hash__
    __eq__ = object.__eq__

    def __init__(self, most: int | None = None):
        super().__init__()
        self.held, self.most = 0, most or CACHE_BYTES
        self.old: dict = {}

    def use(self) -> Cache:
        for other in list(Cache.every):
            if other is not self:
                other.empty()
        Cache.every.add(self)
        return self

    def empty(self) -> None:
        self.clear()
        self.held, self.old = 0, {}

    def added(self, n: int, size: int) -> None:
        """After n entries of size bytes were put in."""
        self.held += size + 190 * n
        if self.held > self.most // 2:
            self.old = dict(self) if self.held <= self.most else {}
            self.clear()
            self.held = 0

    def keep(self, key, value):
        size = sys.getsizeof(key) + sys.getsizeof(value) + 100
        if size <= self.most >> 4:
            self[key] = value
            self.added(0, size)
        return value


def give_back(spark: SparkSession | None = None) -> None:
    """Gives freed memory of this process back to the system: the driver would keep what models and Arrow tables took.

    With a session also the driver's JVM collects its garbage. Many small jobs fill it with finished plans, which
    keep their broadcasts and the shuffle files of executors: Spark removes those once the plans are collected.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)
    if spark is not None:
        spark.sparkContext._jvm.System.gc()


#: Rows and bytes of the Arrow batches that Python workers get: fixed values of Spark's defaults, and what replaces them.
BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"))


def small_batches(spark: SparkSession) -> None:
    """Sets smaller Arrow batches for the session, where it has Spark's defaults: long texts would take several times 64 MB in each task, in the JVM and in Python."""
    for name, default, value in BATCHES:
        if spark.conf.get(name) == default:
            spark.conf.set(name, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a non-null text; empty for a text without words."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see.

    It lies in the folder that the session names in ``spark.checkpoint.dir``. Only where that
    is unset (tests on one machine) a temporary folder is made and set.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = sc._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="blockloom-")
            sc.setCheckpointDir(base)
    if "://" not in base and base.startswith("/"):
        base = "file://" + base
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write to a table in the shared folder and read it again: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of ids that a broadcast may have; beyond it the same join is shuffled.
BROADCAST_IDS = 2_000_000


def bounded(df: DataFrame) -> DataFrame:
    """Rows of a few bytes, to be broadcast if a count shows that they are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def range_bounds(df: DataFrame, key: str, buckets: int) -> list[int]:
    """At most ``buckets - 1`` ascending split points of a long key, for ranges of similar row counts."""
    if buckets < 2:
        return []
    at = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(key, F.array(*map(F.lit, at)), 10 * buckets).alias("q")).first()
    return sorted(set(row.q or []))


def range_bucket(key: str, bounds: list[int]) -> Column:
    """0 for null and the lowest keys, rising with the key."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    lits = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    # How many cuts are below the key. Without a lambda: exchanges that hold one aren't reused.
    here = F.col(key).cast("long")
    below = lambda cuts: (F.array_position(F.sort_array(F.array_append(cuts, here)), here) - 1).cast("int")
    block = below(lits([b[-1] for b in blocks]))  # the block whose last bound is not below the key
    inside = F.when(block < len(blocks), below(F.element_at(F.array(*map(lits, blocks)), F.least(block, F.lit(len(blocks) - 1)) + 1))).otherwise(0)
    found = F.when(F.col(key).isNull(), 0).otherwise(F.least(block * step, F.lit(len(bounds))) + inside)
    return F.coalesce(found, F.lit(0))  # never null, as the optimizer can see
