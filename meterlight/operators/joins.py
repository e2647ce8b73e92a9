"""Enrichment joins and household selection.

None of the joins carries a broadcast hint for a side that grows with the data. Dimension
tables come from stored tables whose size Catalyst knows, so it broadcasts the small ones
and shuffles the others; adaptive execution splits a hot key of a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlight.schema import DAY, HOLIDAY_FLAG, HOUSEHOLD, TOP_HOUSEHOLDS


def join_households(readings: DataFrame, households: DataFrame) -> DataFrame:
    return readings.join(households, HOUSEHOLD, "left")


def join_weather(readings: DataFrame, weather: DataFrame) -> DataFrame:
    """Weather has at most one row per calendar day; days without weather get nulls."""
    return readings.join(weather, DAY, "left").select(
        *readings.columns, *[c for c in weather.columns if c != DAY]
    )


def holiday_flag(df: DataFrame, holidays: DataFrame | None) -> DataFrame:
    """1 on bank holidays, else 0; constant 0 without a holiday table."""
    if holidays is None:
        return df.withColumn(HOLIDAY_FLAG, F.lit(0))
    marked = holidays.select(DAY).distinct().withColumn("_holiday", F.lit(1))
    return (
        df.join(marked, DAY, "left")
        .select(*df.columns, F.coalesce("_holiday", F.lit(0)).alias(HOLIDAY_FLAG))
    )


def top_households(df: DataFrame, n: int = TOP_HOUSEHOLDS) -> DataFrame:
    """Rows of the ``n`` households with the most rows; ties go to the smaller id."""
    ids = (
        df.groupBy(HOUSEHOLD)
        .agg(F.count("*").alias("_rows"))
        .orderBy(F.desc("_rows"), HOUSEHOLD)
        .limit(n)
        .select(HOUSEHOLD)
    )
    return df.join(ids, HOUSEHOLD, "left_semi")


def load_and_merge(
    readings: DataFrame,
    households: DataFrame,
    weather: DataFrame,
    sample: bool = False,
    n_households: int = TOP_HOUSEHOLDS,
    presorted_sample: DataFrame | None = None,
) -> DataFrame:
    """Readings with household attributes and weather.

    Sampling is off by default. With ``sample``, a ready-made sample is used as it is and
    otherwise the top households are kept. Rows are not sorted here: every operator that
    needs the (household, day) order states it, see ``sorted_panel``.
    """
    if sample:
        readings = (
            presorted_sample
            if presorted_sample is not None
            else top_households(readings, n_households)
        )
    return readings.transform(join_households, households).transform(join_weather, weather)


def sorted_panel(df: DataFrame) -> DataFrame:
    """Total order for presentation; a range shuffle, so one household may span tasks."""
    return df.orderBy(HOUSEHOLD, DAY)


def with_scalar(df: DataFrame, source: DataFrame, **values: Column) -> DataFrame:
    """Add columns computed from one-row aggregates of ``source``.

    Each becomes a scalar subquery: computed once, no join.
    """
    return df.withColumns(
        {name: source.agg(value.alias(name)).scalar() for name, value in values.items()}
    )
