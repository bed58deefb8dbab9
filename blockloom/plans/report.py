"""Size reports of columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sequence, stats


def sizes(columns: dict[str, DataFrame], width: int = 8) -> DataFrame:
    """(name, blocks, raw_bytes, model_bytes, ratio, same, raw, normal, normal_rle, partial) of sequences."""
    kinds = {"same": stats.SAME, "raw": stats.RAW, "normal": stats.NORMAL, "normal_rle": stats.NORMAL_RLE, "partial": stats.PARTIAL}

    def one(name: str, seq: DataFrame) -> DataFrame:
        planes = stats.plane_sizes(stats.row_stats(seq, width))
        of_kind = planes.groupBy("blk").agg(*[F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()])
        per = stats.block_sizes(planes, width).join(of_kind, "blk")
        total = per.agg(F.count(F.lit(1)).alias("blocks"), F.sum("raw_bytes").alias("raw_bytes"), F.sum("size").alias("model_bytes"), *[F.sum(n).alias(n) for n in kinds])
        return total.select(F.lit(name).alias("name"), "blocks", "raw_bytes", "model_bytes", (F.col("raw_bytes") / F.col("model_bytes")).alias("ratio"), *kinds)

    return reduce(DataFrame.unionByName, [one(n, s) for n, s in columns.items()])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size report of five columns."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    seq = lambda t, order, value: sequence.index(read(t), order, value)
    line = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return sizes({
        "events.ts": seq("events", ["event_id"], F.unix_micros(F.col("ts").cast("timestamp"))),
        "events.user_id": seq("events", ["event_id"], F.col("user_id")),
        "orders.o_orderkey": seq("orders", ["o_orderkey"], F.col("o_orderkey")),
        "orders.o_custkey": seq("orders", ["o_orderkey"], F.col("o_custkey")),
        "lineitem.l_linenumber": seq("lineitem", line, F.col("l_linenumber").cast("bigint")),
    })
