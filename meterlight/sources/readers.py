"""Source scans: readings, weather, households, holidays, customer categories, documents."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlight.functions.numeric import number_or_null
from meterlight.schema import (
    DAY,
    ENERGY_COLUMNS,
    HOUSEHOLD,
    HOUSEHOLD_SOURCE_COLUMNS,
    ORDINAL,
    WEATHER_SOURCE_COLUMNS,
)

# Accepted date layouts; with slashes the month comes first.
DATE_LAYOUTS = [
    "yyyy-M-d",
    "yyyy/M/d",
    "yyyyMMdd",
    "M/d/yyyy",
    "M-d-yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
]

# Cell texts that mean "missing" in a CSV file.
MISSING_TEXTS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

FILE_ORDER = "_file_order"


def missing_to_null(text: Column) -> Column:
    return F.when(~text.isin(MISSING_TEXTS), text)


def parse_date(text: Column, required: bool = True) -> Column:
    """Date from any accepted layout, with or without a time of day.

    A missing cell stays null; a text in no accepted layout fails the query, or becomes
    null when ``required`` is off.
    """
    date_part = F.regexp_replace(F.trim(text), r"[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?Z?$", "")
    parsed = F.coalesce(
        *[F.try_to_timestamp(date_part, F.lit(layout)).cast("date") for layout in DATE_LAYOUTS]
    )
    if not required:
        return parsed
    failure = F.raise_error(F.concat(F.lit("not a date: "), text)).cast("date")
    return F.when(text.isNotNull() & parsed.isNull(), failure).otherwise(parsed)


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header line; every column as text, missing cells as null.

    Only the header is looked at to name the columns. The hidden file-order column ranks
    rows by file, by block in the file and by line in the block, whichever way Spark packs
    blocks into tasks.
    """
    raw = spark.read.csv(path, header=True, encoding=encoding, inferSchema=False)
    cells = [missing_to_null(F.col(f"`{name}`")).alias(name) for name in raw.columns]
    order = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return raw.select(*cells, order.alias(FILE_ORDER))


def scan_readings(spark: SparkSession, path: str) -> DataFrame:
    """Daily readings: mixed-layout dates, numbers coerced, ``ingest_ordinal`` = file order."""
    raw = read_csv(spark, path)
    if "LCLid" in raw.columns:
        raw = raw.withColumnRenamed("LCLid", HOUSEHOLD)
    energy = [c for c in ENERGY_COLUMNS if c in raw.columns]
    ordinal = (
        F.col(ORDINAL).cast("int") if ORDINAL in raw.columns else F.col(FILE_ORDER)
    ).alias(ORDINAL)
    return raw.select(
        HOUSEHOLD,
        parse_date(F.col(DAY)).alias(DAY),
        *[number_or_null(F.col(c)).alias(c) for c in energy],
        ordinal,
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """First row per key in the given order.

    Spark limits each map task to one row per key before the shuffle, so a key holding a
    large share of the rows costs one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def scan_weather(spark: SparkSession, path: str) -> DataFrame:
    """Daily weather: one row per day (the first in file order), sorted by day."""
    raw = read_csv(spark, path)
    present = {s: t for s, t in WEATHER_SOURCE_COLUMNS.items() if s in raw.columns}
    weather = raw.select(
        parse_date(F.split(F.col("time"), " ")[0]).alias(DAY),
        *[number_or_null(F.col(s)).alias(t) for s, t in present.items()],
        FILE_ORDER,
    )
    return first_per_key(weather, [DAY], [FILE_ORDER]).drop(FILE_ORDER).orderBy(DAY)


def scan_households(spark: SparkSession, path: str, keep_order: bool = False) -> DataFrame:
    """Household attributes; with ``keep_order`` the panel takes a household's first row."""
    raw = read_csv(spark, path)
    raw = raw if keep_order else raw.drop(FILE_ORDER)
    return raw.withColumnsRenamed(
        {s: t for s, t in HOUSEHOLD_SOURCE_COLUMNS.items() if s in raw.columns}
    )


def scan_holidays(spark: SparkSession, path: str) -> DataFrame:
    """Distinct holiday dates."""
    raw = read_csv(spark, path)
    return raw.select(parse_date(F.col("`Bank holidays`")).alias(DAY)).distinct()


def scan_acorn_details(spark: SparkSession, path: str) -> DataFrame:
    """Customer-category details, a Latin-1 file."""
    return read_csv(spark, path, encoding="ISO-8859-1").drop(FILE_ORDER)


def scan_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _files(spark: SparkSession, path: str) -> list[str]:
    """Files under a path, none if it is missing."""
    try:
        return spark.read.text(path, wholetext=True).inputFiles()
    except AnalysisException:
        return []


def scan_documents(spark: SparkSession, labelled_paths: dict[str, str]) -> DataFrame:
    """Whole text files with their source label; missing files are skipped.

    All files are read in one scan and joined with their labels by name. Bytes that are not
    UTF-8 are dropped.
    """
    labels, found = [], []
    for path, label in labelled_paths.items():
        if files := _files(spark, path):
            found.append(path)
            labels += [(_one_slash(file), len(labels) + i, label) for i, file in enumerate(files)]
    schema = "file string, doc_id long, source string"
    table = spark.createDataFrame(labels, schema)
    if not labels:
        return table.select("doc_id", "source", F.lit("").alias("text"))
    text = F.replace(F.make_valid_utf8(F.col("value")), F.lit("\ufffd"), F.lit(""))
    file = F.regexp_replace("_metadata.file_path", r"^(\w+):/+", "$1:/")
    read = spark.read.text(found, wholetext=True)
    return read.select(file.alias("file"), text.alias("text")).join(table, "file").select(
        "doc_id", "source", "text"
    )


def _one_slash(uri: str) -> str:
    return re.sub(r"^(\w+):/+", r"\1:/", uri)


def document_table(documents: DataFrame) -> DataFrame:
    """Documents already held in a table, with the same columns as ``scan_documents``."""
    return documents.select("doc_id", "source", "text")
