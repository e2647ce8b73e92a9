"""A panel laid out along a space-filling curve over (household, day), so that filters on either skip files.

Households are cut into ranges of their ids, days into ranges of the calendar; the bits of the two numbers are
interleaved (a Morton code), and each code's rows are a partition: a file holds a block of some households and some
days, and files that follow each other hold blocks that touch. A manifest beside the files, one row each, keeps their first and last day and household. A scan
reads the manifest, and then only the files whose block meets its filters, which are applied to the rows as well. A
sort by household or by day alone would serve one of the filters and read everything for the other.

Inside a file rows are sorted by household and day, so row groups are skipped likewise. Nulls in either column make a file
match every filter's block, never a filter.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlight.schema import DAY, HOUSEHOLD
from meterlight.session import materialize

MOST_ROWS = 5_000_000  # of a file
#: Households whose ids the ranges are drawn from.
SAMPLE = 16_384
MANIFEST = "_manifest"


def _bucketed(df: DataFrame, ranges: int) -> DataFrame:
    """Each distinct household's range, by quantiles of the ids of at most SAMPLE households."""
    households = materialize(df.select(HOUSEHOLD).where(F.col(HOUSEHOLD).isNotNull()).distinct(), "households")
    drawn = households.orderBy(F.xxhash64(HOUSEHOLD), HOUSEHOLD).limit(SAMPLE)
    ids = sorted(r[0] for r in drawn.collect())
    edges = sorted({ids[len(ids) * i // ranges] for i in range(1, ranges)}) if ids else []
    place = F.size(F.filter(F.lit(edges), lambda e: e <= F.col(HOUSEHOLD))) if edges else F.lit(0)
    return households.select(F.col(HOUSEHOLD).alias("_household"), place.alias("_range"))


def morton(household: Column, day: Column, household_bits: int, day_bits: int) -> Column:
    """The bits of two numbers in turn, from the lowest on, days first; what one has more comes on top."""
    code, at = F.lit(0), 0
    for i in range(max(household_bits, day_bits)):
        for value, bits in ((day, day_bits), (household, household_bits)):
            if i < bits:
                code = code + F.shiftleft(F.shiftright(value, i).bitwiseAND(F.lit(1)), at)
                at += 1
    return code


@dataclass(frozen=True)
class PanelLayout:
    spark: SparkSession
    path: str

    @property
    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{MANIFEST}")

    def files(
        self, start: str | date | None = None, end: str | date | None = None, households: list[str] | None = None
    ) -> list[str]:
        """Files that may hold rows between two days (both included), of some households."""
        kept = self.manifest
        if start:
            kept = kept.where(F.col("nulls") | (F.col("last_day") >= F.lit(start).cast("date")))
        if end:
            kept = kept.where(F.col("nulls") | (F.col("first_day") <= F.lit(end).cast("date")))
        if households:
            inside = F.lit(False)
            for h in households:
                inside |= F.lit(h).between(F.col("first_household"), F.col("last_household"))
            kept = kept.where(F.col("nulls") | inside)
        return sorted(r["file"] for r in kept.select("file").collect())

    def _read(self, files: list[str]) -> DataFrame:
        if files:
            return self.spark.read.parquet(*files)
        return self.spark.read.parquet(self.path).where(F.lit(False))

    def scan(
        self, start: str | date | None = None, end: str | date | None = None, households: list[str] | None = None
    ) -> DataFrame:
        """The rows between two days (both included), of some households."""
        rows = self._read(self.files(start, end, households))
        if start:
            rows = rows.where(F.col(DAY) >= F.lit(start).cast("date"))
        if end:
            rows = rows.where(F.col(DAY) <= F.lit(end).cast("date"))
        return rows.where(F.col(HOUSEHOLD).isin(households)) if households else rows

    def last_day(self) -> date | None:
        return self.manifest.agg(F.max("last_day")).first()[0]

    def since(self, rows: int) -> DataFrame:
        """Rows of the last days, at least ``rows`` of them if there are so many: from the first day on from which
        on whole files hold enough."""
        by_first = self.manifest.where("NOT nulls").groupBy("first_day").agg(F.sum("rows").alias("rows"))
        held, start = 0, None
        # One row for each first day of a file: fewer than days.
        for r in by_first.orderBy(F.desc("first_day")).toLocalIterator():
            held, start = held + r["rows"], r["first_day"]
            if held >= rows:
                return self.scan(start=start)
        return self.scan()


def write_layout(df: DataFrame, path: str, household_bits: int = 4, day_bits: int = 4) -> PanelLayout:
    """``df`` in a file for each of 2^household_bits x 2^day_bits blocks (more for a large block), and their manifest.

    A filter on one household reads about one in 2^household_bits files, one on few days one or two in
    2^day_bits. A panel of many terabytes takes as many bits as make its blocks a few hundred megabytes.
    """
    spark = df.sparkSession
    days = df.agg(F.min(DAY).alias("first"), F.max(DAY).alias("last")).first()
    span = (days["last"] - days["first"]).days + 1 if days["first"] else 1
    since_first = F.datediff(F.col(DAY), F.lit(days["first"] or date(1970, 1, 1)))
    day_range = F.coalesce(F.floor(since_first * (1 << day_bits) / span).cast("int"), F.lit(0))
    ranged = df.join(_bucketed(df, 1 << household_bits), F.col(HOUSEHOLD) == F.col("_household"), "left")
    code = morton(F.coalesce("_range", F.lit(0)), day_range, household_bits, day_bits)
    blocks = ranged.repartitionById(1 << (household_bits + day_bits), code.cast("int"))
    sorted_blocks = blocks.sortWithinPartitions(HOUSEHOLD, DAY).select(*df.columns)
    sorted_blocks.write.mode("overwrite").option("maxRecordsPerFile", MOST_ROWS).parquet(path)
    found = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count("*").alias("rows"),
        F.min(DAY).alias("first_day"),
        F.max(DAY).alias("last_day"),
        F.min(HOUSEHOLD).alias("first_household"),
        F.max(HOUSEHOLD).alias("last_household"),
        F.bool_or(F.col(DAY).isNull() | F.col(HOUSEHOLD).isNull()).alias("nulls"),
    )
    found.coalesce(1).write.mode("overwrite").parquet(f"{path}/{MANIFEST}")
    return PanelLayout(spark, path)
