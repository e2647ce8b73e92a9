"""Sinks: result tables and one-line results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlight.functions.calendar import month_key
from meterlight.schema import DAY, HOUSEHOLD

def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> str:
    df.write.mode("overwrite").csv(path, header=True, encoding=encoding)
    return path


def write_table(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def write_by_month(df: DataFrame, path: str) -> str:
    """Panel partitioned by month, so that a date filter skips whole folders.

    Rows are brought together by month, in tasks whose size follows the session's advisory
    partition size: a large month fills several, small ones share one. A task's rows are
    sorted by month, so it holds one file open at a time.
    """
    (
        df.withColumn("year_month", month_key(F.col(DAY)))
        .hint("rebalance", "year_month")
        .sortWithinPartitions("year_month", HOUSEHOLD, DAY)
        .write.mode("overwrite")
        .partitionBy("year_month")
        .option("maxRecordsPerFile", 5_000_000)
        .parquet(path)
    )
    return path


def write_text_line(spark: SparkSession, text: str, path: str) -> str:
    """A single value, such as the name of the best model."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def read_text_line(spark: SparkSession, path: str) -> str:
    return spark.read.text(path).first().value.strip()
