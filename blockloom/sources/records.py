"""Fixed-width records and numbers from files, and reports to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def binary_records(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(idx, record) of files of records of width bytes, in the order of their paths.

    Files are cut between records, so a large file is the work of many tasks. A file that doesn't end with a whole record
    raises an error.
    """
    splits = spark.sparkContext.binaryRecords(path, width)
    return spark.createDataFrame(splits.zipWithIndex().map(lambda x: (x[1], bytearray(x[0]))), "idx bigint, record binary")


def numbers(spark: SparkSession, path: str) -> DataFrame:
    """(v) of files of numbers between white space; what is no number is null."""
    words = F.explode(F.split(F.trim("value"), r"\s+"))
    return spark.read.text(path).where(F.trim("value") != "").select(words.alias("w")).select(F.expr("try_cast(w AS double)").alias("v"))


def write_report(report: DataFrame, path: str) -> None:
    """A report as CSV with semicolons and a header."""
    report.write.mode("errorifexists").option("sep", ";").option("header", True).csv(path)
