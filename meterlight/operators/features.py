"""Calendar, holiday, lag and rolling features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.functions.calendar import calendar_parts
from meterlight.operators.clean import household_days
from meterlight.operators.joins import holiday_flag
from meterlight.schema import (
    DAY,
    LAGS,
    ROLLING_WINDOWS,
    TARGET,
    lag_column,
    numeric_columns,
    rolling_column,
)


def calendar_features(df: DataFrame) -> DataFrame:
    return df.withColumns(calendar_parts(F.col(DAY)))


def lag_features(df: DataFrame, lags: list[int] = LAGS, target: str = TARGET) -> DataFrame:
    """Target a number of rows (not calendar days) earlier in the household."""
    days = household_days()
    return df.withColumns(
        {lag_column(n) if target == TARGET else f"{target}_lag_{n}": F.lag(target, n).over(days)
         for n in lags}
    )


def rolling_mean(
    df: DataFrame, windows: list[int] = ROLLING_WINDOWS, target: str = TARGET
) -> DataFrame:
    """Mean of the previous rows, the current one left out."""
    days = household_days()
    return df.withColumns(
        {rolling_column("mean", n): F.avg(target).over(days.rowsBetween(-n, -1)) for n in windows}
    )


def rolling_std(
    df: DataFrame, windows: list[int] = ROLLING_WINDOWS, target: str = TARGET
) -> DataFrame:
    """Sample standard deviation over the same frame; null for a single row."""
    days = household_days()
    return df.withColumns(
        {
            rolling_column("std", n): F.stddev_samp(target).over(days.rowsBetween(-n, -1))
            for n in windows
        }
    )


def rolling_features(
    df: DataFrame, windows: list[int] = ROLLING_WINDOWS, target: str = TARGET
) -> DataFrame:
    days = household_days()
    columns = {}
    for n in windows:
        frame = days.rowsBetween(-n, -1)
        columns[rolling_column("mean", n)] = F.avg(target).over(frame)
        columns[rolling_column("std", n)] = F.stddev_samp(target).over(frame)
    return df.withColumns(columns)


def drop_short_history(df: DataFrame, lags: list[int] = LAGS) -> DataFrame:
    """Drop rows without the longest lag, then zero-fill numeric nulls."""
    kept = df.filter(F.col(lag_column(max(lags))).isNotNull())
    return kept.na.fill(0, numeric_columns(kept))


def build_features(df: DataFrame, holidays: DataFrame | None) -> DataFrame:
    """All features; lags and rolling statistics share one shuffle and one sort."""
    return (
        df.transform(calendar_features)
        .transform(holiday_flag, holidays)
        .transform(lag_features)
        .transform(rolling_features)
        .transform(drop_short_history)
    )
