"""Calendar expressions on a date column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterlight.schema import SEASON_NAMES, WEEKDAY_NAMES


def day_of_week(day: Column) -> Column:
    """Monday is 0."""
    return F.weekday(day)


def is_weekend(day: Column) -> Column:
    return (F.weekday(day) >= 5).cast("int")


def season_of_month(month: Column) -> Column:
    """December to February 0, March to May 1, June to August 2, September to November 3."""
    return F.floor(F.pmod(month, F.lit(12)) / 3).cast("int")


def season(day: Column) -> Column:
    return season_of_month(F.month(day))


def name_of(number: Column, names: list[str]) -> Column:
    """Name for a zero-based number; null outside the list."""
    return F.get(F.array(*[F.lit(n) for n in names]), number.cast("int"))


def season_name(number: Column) -> Column:
    return name_of(number, SEASON_NAMES)


def weekday_name(number: Column) -> Column:
    return name_of(number, WEEKDAY_NAMES)


def calendar_parts(day: Column) -> dict[str, Column]:
    return {
        "day_of_week": day_of_week(day),
        "day_of_month": F.dayofmonth(day),
        "month": F.month(day),
        "week_of_year": F.weekofyear(day),
        "quarter": F.quarter(day),
        "is_weekend": is_weekend(day),
        "season": season(day),
    }


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_label(day: Column) -> Column:
    return F.date_format(day, "MMM yyyy")


def iso_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def weekday_label(day: Column) -> Column:
    return F.date_format(day, "EEEE")
