"""Tables stored by household: hash buckets, sorted inside, so that aggregates, windows and joins by household shuffle nothing.

A written table is one file a bucket, rows sorted by household and day (or by household, without a day). Spark takes a bucketed scan
as already partitioned by household: an aggregate, a window or a join by it needs no exchange, and a join of two tables with
the same number of buckets meets bucket by bucket. Queries that don't group by household read the same files as any other table.

A bucket is a task that sorts its rows, so the number of buckets is chosen from the size: ``buckets_for``. A household has one row a
calendar day after deduplication, so no bucket is hot.

Catalog entries belong to a session. The number of buckets lies beside the files, and ``open_bucketed`` makes an entry for files that an
earlier session has written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.types import StructType

from meterlight.schema import DAY, HOUSEHOLD
from meterlight.session import new_path
from meterlight.sources.sinks import read_text_line, write_text_line

ROWS_OF_BUCKET = 500_000  # of some 400 bytes each in a sort
BUCKETS = "_buckets"


def buckets_for(spark: SparkSession, rows: int | None = None) -> int:
    """As many buckets as the session has shuffle partitions; more if ``rows`` asks for them."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-(rows or 0) // ROWS_OF_BUCKET))


def _register(spark: SparkSession, path: str, schema: StructType, buckets: int) -> str:
    name = f"meterlight_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    order = ", ".join(c for c in (HOUSEHOLD, DAY) if c in schema.names)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet "
        f"CLUSTERED BY ({HOUSEHOLD}) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return name


def write_bucketed(
    df: DataFrame, path: str, buckets: int, metrics: dict[str, Column] | None = None
) -> DataFrame | tuple[DataFrame, dict]:
    """Write ``df`` into buckets by household and read it as such; with ``metrics`` also what they observe meanwhile.

    A plan that ends partitioned by household into as many partitions (``by_household``) is written without another
    shuffle.
    """
    spark = df.sparkSession
    name = _register(spark, path, df.schema, buckets)
    observation = None
    if metrics:
        observation = Observation(name)
        df = df.observe(observation, *[c.alias(k) for k, c in metrics.items()])
    df.write.insertInto(name, overwrite=True)
    write_text_line(spark, str(buckets), f"{path}/{BUCKETS}")
    table = spark.table(name)
    return (table, observation.get) if observation else table


def by_household(df: DataFrame, buckets: int) -> DataFrame:
    """``df`` partitioned as ``write_bucketed`` stores it: a partition is a bucket, and gets one file."""
    return df.repartition(buckets, HOUSEHOLD)


def store_bucketed(df: DataFrame, label: str, buckets: int | None = None) -> DataFrame:
    """``df`` in buckets in the session's shared folder."""
    buckets = buckets or buckets_for(df.sparkSession)
    return write_bucketed(by_household(df, buckets), new_path(df.sparkSession, label), buckets)


def open_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``write_bucketed`` has written, in this or an earlier session."""
    buckets = int(read_text_line(spark, f"{path}/{BUCKETS}"))
    return spark.table(_register(spark, path, spark.read.parquet(path).schema, buckets))
