"""Column names, schemas and the constants every operator shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

HOUSEHOLD = "household_id"
DAY = "day"
TARGET = "energy_sum"
ORDINAL = "ingest_ordinal"

# Energy statistics of one household-day, in source order.
ENERGY_COLUMNS = [
    "energy_median",
    "energy_mean",
    "energy_max",
    "energy_count",
    "energy_std",
    "energy_sum",
    "energy_min",
]

# Source weather column -> our column.
WEATHER_SOURCE_COLUMNS = {
    "temperatureMax": "temperature_max",
    "temperatureMin": "temperature_min",
    "windSpeed": "wind_speed",
    "humidity": "humidity",
    "cloudCover": "cloud_cover",
    "pressure": "pressure",
    "visibility": "visibility",
    "dewPoint": "dew_point",
}
WEATHER_COLUMNS = list(WEATHER_SOURCE_COLUMNS.values())

# Source household column -> our column.
HOUSEHOLD_SOURCE_COLUMNS = {
    "LCLid": HOUSEHOLD,
    "stdorToU": "tariff",
    "Acorn": "acorn",
    "Acorn_grouped": "acorn_grouped",
    "file": "file",
}
HOUSEHOLD_ATTRIBUTES = ["tariff", "acorn", "acorn_grouped", "file"]

CALENDAR_COLUMNS = [
    "day_of_week",
    "day_of_month",
    "month",
    "week_of_year",
    "quarter",
    "is_weekend",
    "season",
]
HOLIDAY_FLAG = "is_bank_holiday"

# Row lags and trailing window lengths of the target.
LAGS = [1, 2, 3, 7, 14]
ROLLING_WINDOWS = [7, 14, 30]

# Names by season number and by weekday number (Monday first).
SEASON_NAMES = ["Winter", "Spring", "Summer", "Autumn"]
WEEKDAY_NAMES = [
    "Monday",
    "Tuesday",
    "Wednesday",
    "Thursday",
    "Friday",
    "Saturday",
    "Sunday",
]
WEEKDAY_SHORT_NAMES = [name[:3] for name in WEEKDAY_NAMES]

# Parameters of the published analyses.
TEST_DAYS = 60
TOP_HOUSEHOLDS = 500
CLUSTERS = 4
ELBOW_RANGE = range(2, 9)
CONTAMINATION = 0.05
PRICE_GBP_PER_KWH = 0.34
TOU_EFFECT_PERCENT = 7.6

PROFILE_COLUMNS = [
    "mean_energy",
    "std_energy",
    "max_energy",
    "min_energy",
    "median_energy",
    "weekend_ratio",
    "seasonal_variation",
    "peak_season_energy",
    "peak_month_energy",
]

READINGS_SCHEMA = T.StructType(
    [T.StructField(HOUSEHOLD, T.StringType()), T.StructField(DAY, T.DateType())]
    + [T.StructField(name, T.DoubleType()) for name in ENERGY_COLUMNS]
    + [T.StructField(ORDINAL, T.IntegerType())]
)


def lag_column(lag: int) -> str:
    return f"{TARGET}_lag_{lag}"


def rolling_column(stat: str, window: int) -> str:
    return f"{TARGET}_rolling_{stat}_{window}"


LAG_COLUMNS = [lag_column(n) for n in LAGS]
ROLLING_COLUMNS = [rolling_column(s, n) for n in ROLLING_WINDOWS for s in ("mean", "std")]


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns in schema order; the ingest ordinal is bookkeeping, not data."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name != ORDINAL
    ]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def feature_columns(df: DataFrame) -> list[str]:
    """Model inputs: numeric columns without the target and same-day energy statistics."""
    excluded = {TARGET, *ENERGY_COLUMNS}
    return [name for name in numeric_columns(df) if name not in excluded]
