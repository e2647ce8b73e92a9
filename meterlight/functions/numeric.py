"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterlight.schema import PRICE_GBP_PER_KWH


def number_or_null(value: Column) -> Column:
    """Text or number to double; whatever does not parse, and NaN, becomes null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def safe_ratio(numerator: Column, denominator: Column, default: float = 1.0) -> Column:
    """Ratio, or ``default`` where the denominator is zero or either side is missing."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(default))


def percent_of(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole) * 100


def share_percent(condition: Column) -> Column:
    """Percentage of rows meeting the condition; a null condition counts as not met."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0)) * 100


def pearson(x: str, y: str) -> Column:
    """Correlation over rows with both values; null where either side is constant.

    The built-in ``corr`` fails on a constant column under ANSI rules.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(x))) * F.stddev_pop(F.when(both, F.col(y)))
    return F.try_divide(F.covar_pop(x, y), spread)


def corrected_skewness(value: Column) -> Column:
    """Small-sample corrected skewness (G1); Spark's built-in is the population form."""
    n = F.count(value).cast("double")
    return F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(value: Column) -> Column:
    """Small-sample corrected excess kurtosis (G2)."""
    n = F.count(value).cast("double")
    return F.when(
        n > 3, ((n + 1) * F.kurtosis(value) + 6) * (n - 1) / ((n - 2) * (n - 3))
    )


def monthly_kwh(daily: Column) -> Column:
    return daily * 30


def annual_kwh(daily: Column) -> Column:
    return daily * 365


def cost_gbp(kwh: Column, price: float = PRICE_GBP_PER_KWH) -> Column:
    return kwh * price
