"""The feature table: from raw tables to one stored panel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from meterlight.operators.clean import (
    coerce_types,
    dedup_readings,
    drop_null_target,
    fill_forward_backward,
    fill_unknown,
    medians_of_incomplete,
    null_counts,
)
from meterlight.operators.features import (
    calendar_features,
    drop_short_history,
    lag_features,
    rolling_features,
)
from meterlight.operators.joins import holiday_flag, join_households, join_weather
from meterlight.schema import (
    CALENDAR_COLUMNS,
    ENERGY_COLUMNS,
    HOLIDAY_FLAG,
    HOUSEHOLD,
    LAG_COLUMNS,
    ORDINAL,
    ROLLING_COLUMNS,
    TARGET,
    WEATHER_COLUMNS,
)
from meterlight.session import new_path, shuffle_partitions
from meterlight.sources.bucketed import buckets_for, by_household, write_bucketed
from meterlight.sources.readers import FILE_ORDER, first_per_key

DERIVED_COLUMNS = [*CALENDAR_COLUMNS, HOLIDAY_FLAG, *LAG_COLUMNS, *ROLLING_COLUMNS]


@dataclass(frozen=True)
class Panel:
    """``cleaned`` holds every imputed household-day, ``features`` the modelling rows."""

    cleaned: DataFrame
    features: DataFrame


def unfinished_panel(
    readings: DataFrame,
    households: DataFrame,
    weather: DataFrame,
    holidays: DataFrame | None,
    buckets: int | None = None,
) -> DataFrame:
    """Everything up to the table-wide medians, with every window in one pass.

    Deduplicating before the joins gives the same rows as after them, since a dimension has
    one row per key, and bounds each household by its calendar days before anything is
    shuffled by household. Ids are made final before that shuffle and the household join
    comes last, so the fills, lags and rolling statistics ride on a single shuffle and sort,
    and on the join's own shuffle when the household table is too large to broadcast. The
    target has no nulls left to fill, so its lags wait neither for the fills nor for the
    medians. With ``buckets`` that shuffle makes as many partitions, as the stored table has.
    """
    measured = [c for c in readings.columns if c in ENERGY_COLUMNS] + [
        c for c in weather.columns if c in WEATHER_COLUMNS
    ]
    attributes = [c for c in households.columns if c not in (HOUSEHOLD, FILE_ORDER)]
    order = [FILE_ORDER] if FILE_ORDER in households.columns else households.columns
    one_per_household = first_per_key(households, [HOUSEHOLD], order).drop(FILE_ORDER)
    panel = (
        readings.transform(coerce_types)
        .transform(dedup_readings)
        .transform(drop_null_target)
        .drop(ORDINAL)
        .transform(fill_unknown, [HOUSEHOLD])
        .transform(join_weather, weather)
        .transform(holiday_flag, holidays)
        .transform(lambda df: by_household(df, buckets) if buckets else df)
        .transform(join_households, one_per_household)
        .transform(fill_unknown, attributes)
        .transform(fill_forward_backward, [c for c in measured if c != TARGET])
        .transform(calendar_features)
        .transform(lag_features)
        .transform(rolling_features)
    )
    leading = [c for c in panel.columns if c not in DERIVED_COLUMNS]
    return panel.select(*leading, *DERIVED_COLUMNS)


def build_panel(
    readings: DataFrame,
    households: DataFrame,
    weather: DataFrame,
    holidays: DataFrame | None,
    buckets: int | None = None,
) -> Panel:
    """Write the panel once, in buckets by household; null counts are observed during the write, at no extra pass.

    The one shuffle by household also makes the buckets, and what groups the stored panel by household has none.
    Their number, and that of the shuffle before, follows the rows, so that no task's sorts outgrow its memory.
    """
    spark = readings.sparkSession
    enough = buckets_for(spark, readings.count())
    buckets = buckets or enough
    plan = unfinished_panel(readings, households, weather, holidays, buckets)
    measured = [c for c in ENERGY_COLUMNS + WEATHER_COLUMNS if c in plan.columns]
    with shuffle_partitions(spark, enough):
        stored, nulls = write_bucketed(plan, new_path(spark, "panel"), buckets, null_counts(measured))
    medians = medians_of_incomplete(stored, nulls)
    cleaned = stored.na.fill(medians) if medians else stored
    return Panel(cleaned=cleaned, features=drop_short_history(cleaned))
