"""Cleaning: type coercion, deduplication and imputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlight.functions.numeric import number_or_null
from meterlight.functions.quantiles import exact_median
from meterlight.schema import (
    DAY,
    ENERGY_COLUMNS,
    HOUSEHOLD,
    ORDINAL,
    TARGET,
    numeric_columns,
    string_columns,
)
from meterlight.session import materialize
from meterlight.sources.readers import first_per_key, parse_date

UNKNOWN = "Unknown"


def coerce_types(df: DataFrame) -> DataFrame:
    """Day to date, energy columns to double with unreadable values null."""
    changes = {c: number_or_null(F.col(c)) for c in ENERGY_COLUMNS if c in df.columns}
    if DAY in df.columns:
        kind = df.schema[DAY].dataType
        if isinstance(kind, T.StringType):
            changes[DAY] = parse_date(F.col(DAY))
        elif not isinstance(kind, T.DateType):
            changes[DAY] = F.to_date(DAY)
    return df.withColumns(changes)


def drop_null_target(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=[TARGET])


def dedup_readings(df: DataFrame) -> DataFrame:
    """First row per (household, day) in ingest order; whole-row dedup without the keys."""
    if HOUSEHOLD not in df.columns or DAY not in df.columns:
        return df.dropDuplicates()
    return first_per_key(df, [HOUSEHOLD, DAY], [ORDINAL])


def household_days() -> WindowSpec:
    """The one window of the panel: a household's days in order.

    After deduplication a household has at most one row per calendar day, which bounds the
    window however the raw rows are spread over households.
    """
    return Window.partitionBy(HOUSEHOLD).orderBy(DAY)


def filled(column: str) -> Column:
    """Last value so far; before the first value, that first value.

    Once forward filling is done only leading nulls are left, and they all take the
    household's first value. Both frames share one sort and are linear, unlike a frame that
    ends at unbounded following.
    """
    days = household_days()
    so_far = days.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = days.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(
        F.last(column, ignorenulls=True).over(so_far),
        F.first(column, ignorenulls=True).over(whole),
    )


def fill_forward_backward(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Fill the numeric columns, or the given ones, within each household."""
    if HOUSEHOLD not in df.columns:
        return df
    return df.withColumns({c: filled(c) for c in columns or numeric_columns(df)})


def null_counts(columns: list[str]) -> dict[str, Column]:
    return {c: F.count_if(F.col(c).isNull()) for c in columns}


def medians_of_incomplete(df: DataFrame, nulls: dict[str, int], **options) -> dict[str, float]:
    """Exact median of each column that has both nulls and values."""
    medians = {c: exact_median(df, c, **options) for c, n in nulls.items() if n}
    return {c: m for c, m in medians.items() if m is not None}


def fill_median(df: DataFrame, nulls: dict[str, int] | None = None, **options) -> DataFrame:
    """Fill each numeric column's remaining nulls with its median over the whole table.

    Null counts come from one pass over ``df``, or from the caller who saw them when ``df``
    was written; complete columns cost nothing further.
    """
    if nulls is None:
        columns = numeric_columns(df)
        nulls = df.agg(*[c.alias(n) for n, c in null_counts(columns).items()]).first().asDict()
    medians = medians_of_incomplete(df, nulls, **options)
    return df.na.fill(medians) if medians else df


def fill_unknown(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Fill null strings in all string columns, or the given ones."""
    columns = string_columns(df) if columns is None else columns
    return df.na.fill(UNKNOWN, columns) if columns else df


def preprocess(df: DataFrame) -> DataFrame:
    """Coerce, deduplicate, drop missing targets, then impute.

    The table is stored once before the medians, and null counts are observed in that write.
    """
    filled = (
        df.transform(coerce_types)
        .transform(dedup_readings)
        .transform(drop_null_target)
        .transform(fill_forward_backward)
    )
    stored, nulls = materialize(filled, "filled", null_counts(numeric_columns(filled)))
    return stored.transform(fill_median, nulls).transform(fill_unknown)
