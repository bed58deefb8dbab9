"""Encoding of streams: each micro-batch becomes superblocks of its own, and counts by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sequence import index
from ..sources import blocktable


def encode_stream(stream: DataFrame, order: list[str], value, path: str, checkpoint: str, elements: int = blocktable.ELEMENTS) -> StreamingQuery:
    """Appends block tables under path, one folder a micro-batch.

    A batch that runs again after a failure replaces its own folder, so each row is stored once.
    """

    def store(batch: DataFrame, number: int) -> None:
        blocks = blocktable.encode(index(batch, order, value), elements)
        blocks.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/part={number}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decode_stream_table(spark, path: str) -> DataFrame:
    """(batch, idx, v) of what encode_stream() stored; idx counts within a batch."""
    return blocktable.decode(spark.read.parquet(path), keep=("batch",))


def windowed_sizes(stream: DataFrame, time: str, value: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows, bytes and range of a column by event-time window, with a watermark: what a size model needs of a stream."""
    w = F.window(time, window)
    stats = stream.withWatermark(time, late).groupBy(w).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("v_min"), F.max(value).alias("v_max"))
    return stats.select(F.col("window.start").alias("start"), "n", (F.col("n") * 8).alias("raw_bytes"), "v_min", "v_max")
