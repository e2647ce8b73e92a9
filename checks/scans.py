"""Scans and sinks, cleaning, joins and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.tables import (
    ATTRIBUTES,
    CALENDAR_SQL,
    DOUBLES,
    ENERGY,
    LAG_SQL,
    LAGS,
    NUMERIC,
    ROLLING,
    ROLLING_SQL,
    WEATHER,
    listed,
)
from meterlight.functions import calendar
from meterlight.operators import clean, eda, features, forecast, joins, metrics
from meterlight.plans.panel import build_panel
from meterlight.session import materialize, new_path
from meterlight.sources import readers, sinks

READING = ["household_id", "day", *ENERGY, "ingest_ordinal"]
READING_SQL = listed(READING)
MERGED = [*READING, *ATTRIBUTES, *WEATHER]


def rounded(columns) -> str:
    return " ".join(columns)


# Scans


@query(
    "scan_readings",
    f"SELECT household_id, day, {listed(ENERGY)}, CAST(ingest_ordinal AS INTEGER) AS ingest_ordinal FROM readings",
    rounds=rounded(ENERGY),
)
def scan_readings(ws):
    return readers.scan_readings(ws.spark, ws.raw_files["readings"])


@query("scan_weather", f"SELECT day, {listed(WEATHER)} FROM weather", rounds=rounded(WEATHER))
def scan_weather(ws):
    return readers.scan_weather(ws.spark, ws.raw_files["weather"])


@query("scan_households", f"SELECT household_id, {listed(ATTRIBUTES)} FROM households")
def scan_households(ws):
    return readers.scan_households(ws.spark, ws.raw_files["households"])


@query("scan_holidays", "SELECT day FROM holidays")
def scan_holidays(ws):
    return readers.scan_holidays(ws.spark, ws.raw_files["holidays"])


@query(
    "scan_acorn_details",
    """SELECT 'Catégorie ' || p_brand AS main_categories, p_type AS categories, p_name AS reference,
  CAST(p_partkey AS VARCHAR) AS acorn_a FROM part""",
)
def scan_acorn_details(ws):
    table = readers.scan_acorn_details(ws.spark, ws.raw_files["acorn_details"])
    return table.toDF("main_categories", "categories", "reference", "acorn_a")


@query("scan_documents", "SELECT doc_id, source, text FROM documents")
def scan_documents(ws):
    return ws.documents


# Cleaning


@query("coerce_types", f"SELECT {READING_SQL} FROM readings", rounds=rounded(ENERGY))
def coerce_types(ws):
    """Readings whose day and numbers are text, as a file would hold them."""
    as_text = ws.readings.withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit("bad")) for c in ENERGY}
    ).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    return clean.coerce_types(as_text)


@query(
    "drop_null_target",
    f"SELECT {READING_SQL} FROM readings WHERE energy_sum IS NOT NULL",
    rounds=rounded(ENERGY),
)
def drop_null_target(ws):
    return clean.drop_null_target(ws.readings)


@query(
    "dedup_readings",
    f"""SELECT {READING_SQL} FROM (
  SELECT *, row_number() OVER (PARTITION BY household_id, day ORDER BY ingest_ordinal) AS place FROM readings)
WHERE place = 1""",
    rounds=rounded(ENERGY),
)
def dedup_readings(ws):
    return clean.dedup_readings(ws.readings)


def _targeted(ws):
    """Joined, deduplicated rows with a target."""
    merged = joins.load_and_merge(ws.readings, ws.households, ws.weather)
    return merged.transform(clean.dedup_readings).transform(clean.drop_null_target)


@query(
    "fill_forward_backward",
    f"SELECT household_id, day, {listed(ENERGY + WEATHER)}, {listed(ATTRIBUTES)} FROM filled",
    rounds=rounded(ENERGY + WEATHER),
)
def fill_forward_backward(ws):
    return _targeted(ws).transform(clean.fill_forward_backward).drop("ingest_ordinal")


@query(
    "fill_median",
    "WITH m AS (SELECT "
    + listed(ENERGY + WEATHER, "median({0}) AS {0}")
    + " FROM targeted) SELECT household_id, day, "
    + listed(ENERGY + WEATHER, "coalesce(t.{0}, m.{0}) AS {0}")
    + " FROM targeted t CROSS JOIN m",
    rounds=rounded(ENERGY + WEATHER),
)
def fill_median(ws):
    """Medians straight on the rows with gaps, so that every gap takes one."""
    rows = materialize(_targeted(ws).drop("ingest_ordinal", *ATTRIBUTES), "targeted")
    return clean.fill_median(rows)


@query(
    "fill_unknown",
    f"SELECT household_id, {listed(ATTRIBUTES, '''coalesce({0}, 'Unknown') AS {0}''')} FROM households",
)
def fill_unknown(ws):
    return clean.fill_unknown(ws.households)


@query(
    "preprocess",
    f"SELECT household_id, day, {listed(ENERGY + WEATHER)}, {listed(ATTRIBUTES)} FROM cleaned",
    rounds=rounded(ENERGY + WEATHER),
)
def preprocess(ws):
    merged = joins.load_and_merge(ws.readings, ws.households, ws.weather)
    return clean.preprocess(merged).drop("ingest_ordinal")


@query(
    "drop_short_history",
    "SELECT household_id, day, energy_sum, "
    + listed(LAGS, "coalesce({0}, 0) AS {0}")
    + f" FROM (SELECT *, {LAG_SQL} FROM cleaned) WHERE energy_sum_lag_14 IS NOT NULL",
    rounds=rounded(["energy_sum", *LAGS]),
)
def drop_short_history(ws):
    lagged = ws.cleaned.select("household_id", "day", "energy_sum", *LAGS)
    return features.drop_short_history(lagged)


# Joins


@query(
    "join_households",
    f"SELECT {listed(READING, 'r.{0}')}, {listed(ATTRIBUTES, 'h.{0}')} "
    "FROM readings r LEFT JOIN households h ON r.household_id = h.household_id",
    rounds=rounded(ENERGY),
)
def join_households(ws):
    return joins.join_households(ws.readings, ws.households)


@query(
    "join_weather",
    f"SELECT {listed(READING, 'r.{0}')}, {listed(WEATHER, 'w.{0}')} "
    "FROM readings r LEFT JOIN weather w ON r.day = w.day",
    rounds=rounded(ENERGY + WEATHER),
)
def join_weather(ws):
    return joins.join_weather(ws.readings, ws.weather)


@query(
    "holiday_flag",
    """SELECT household_id, day, ingest_ordinal,
  CAST(day IN (SELECT day FROM holidays) AS INTEGER) AS is_bank_holiday FROM readings""",
)
def holiday_flag(ws):
    rows = ws.readings.select("household_id", "day", "ingest_ordinal")
    return joins.holiday_flag(rows, ws.holidays)


@query(
    "top_households",
    f"""SELECT {READING_SQL} FROM readings WHERE household_id IN (
  SELECT household_id FROM readings GROUP BY 1 ORDER BY count(*) DESC, household_id LIMIT 20)""",
    rounds=rounded(ENERGY),
)
def top_households(ws):
    return joins.top_households(ws.readings, 20)


@query("load_and_merge", f"SELECT {listed(MERGED)} FROM merged", rounds=rounded(ENERGY + WEATHER))
def load_and_merge(ws):
    return joins.load_and_merge(ws.readings, ws.households, ws.weather)


@query(
    "sorted_panel",
    f"SELECT household_id, day, ingest_ordinal, energy_sum, {listed(ATTRIBUTES)} FROM merged",
    rounds="energy_sum",
)
def sorted_panel(ws):
    merged = joins.load_and_merge(ws.readings, ws.households, ws.weather)
    columns = ["household_id", "day", "ingest_ordinal", "energy_sum", *ATTRIBUTES]
    return joins.sorted_panel(merged.select(*columns))


# Features


@query("calendar_features", f"SELECT household_id, day, {CALENDAR_SQL} FROM cleaned")
def calendar_features(ws):
    return features.calendar_features(ws.cleaned.select("household_id", "day"))


def _series(ws):
    return ws.cleaned.select("household_id", "day", "energy_sum")


@query(
    "lag_features",
    f"SELECT household_id, day, energy_sum, {LAG_SQL} FROM cleaned",
    rounds=rounded(["energy_sum", *LAGS]),
)
def lag_features(ws):
    return features.lag_features(_series(ws))


MEANS = [c for c in ROLLING if "mean" in c]
DEVIATIONS = [c for c in ROLLING if "std" in c]


@query(
    "rolling_mean",
    f"SELECT household_id, day, energy_sum, {listed(MEANS)} FROM (SELECT *, {ROLLING_SQL} FROM cleaned)",
    rounds=rounded(["energy_sum", *MEANS]),
)
def rolling_mean(ws):
    return features.rolling_mean(_series(ws))


@query(
    "rolling_std",
    f"SELECT household_id, day, energy_sum, {listed(DEVIATIONS)} FROM (SELECT *, {ROLLING_SQL} FROM cleaned)",
    rounds=rounded(["energy_sum", *DEVIATIONS]),
)
def rolling_std(ws):
    return features.rolling_std(_series(ws))


ALL_FEATURES_SQL = f"SELECT household_id, day, {listed(NUMERIC)}, {listed(ATTRIBUTES)} FROM features"


@query("build_features", ALL_FEATURES_SQL, rounds=rounded(DOUBLES))
def build_features(ws):
    """The whole path from the raw tables, not the session's stored table."""
    return build_panel(ws.readings, ws.households, ws.weather, ws.holidays).features


@query("chained_features", ALL_FEATURES_SQL, rounds=rounded(DOUBLES))
def chained_features(ws):
    """The same table operator by operator."""
    plain = ws.cleaned.select("household_id", "day", *ENERGY, *ATTRIBUTES, *WEATHER)
    return features.build_features(plain, ws.holidays)


@query(
    "month_label",
    """SELECT DISTINCT day, strftime(day, '%b %Y') AS month_label, strftime(day, '%Y-%m-%d') AS iso_label,
  strftime(day, '%A') AS weekday_label, strftime(day, '%Y-%m') AS month_key FROM features""",
)
def month_label(ws):
    day = F.col("day")
    return (
        ws.features.select("day")
        .distinct()
        .select(
            day,
            calendar.month_label(day).alias("month_label"),
            calendar.iso_label(day).alias("iso_label"),
            calendar.weekday_label(day).alias("weekday_label"),
            calendar.month_key(day).alias("month_key"),
        )
    )


# Splits and samples


@query(
    "time_split",
    "SELECT household_id, day, energy_sum, split FROM marked",
    rounds="energy_sum",
)
def time_split(ws):
    rows = ws.features.select("household_id", "day", "energy_sum")
    train, test = eda.time_split(rows)
    return train.withColumn("split", F.lit("train")).unionByName(
        test.withColumn("split", F.lit("test"))
    )


MODEL_INPUTS = ["temperature_max", "month", "energy_sum_lag_1", "solar_output", "tariff_price"]


@query(
    "fill_missing_features",
    """SELECT household_id, day, energy_sum, temperature_max, CAST(month AS DOUBLE) AS month, energy_sum_lag_1,
  CAST(0 AS DOUBLE) AS solar_output, CAST(0 AS DOUBLE) AS tariff_price FROM features""",
    rounds="energy_sum temperature_max month energy_sum_lag_1 solar_output tariff_price",
)
def fill_missing_features(ws):
    return forecast.project_features(
        ws.features, MODEL_INPUTS, ["household_id", "day", "energy_sum"]
    )


@query(
    "row_sample",
    """SELECT household_id, day, energy_sum FROM features
WHERE CAST('0x' || substr(md5(household_id || '|' || CAST(day AS VARCHAR) || '|42'), 1, 8) AS BIGINT) % 100 < 10""",
    rounds="energy_sum",
)
def row_sample(ws):
    return eda.row_sample(ws.features.select("household_id", "day", "energy_sum"))


@query(
    "train_val_stack",
    """SELECT household_id, day, energy_sum, CAST(CASE split WHEN 'train' THEN -1 ELSE 0 END AS INTEGER) AS fold
FROM marked""",
    rounds="energy_sum",
)
def train_val_stack(ws):
    train, test = eda.time_split(ws.features.select("household_id", "day", "energy_sum"))
    return eda.train_val_stack(train, test)


# Sinks

NAIVE_MODELS = {"last_day": LAGS[0], "last_week": LAGS[3], "weekly_mean": ROLLING[0]}
NAIVE_SQL = "\nUNION ALL\n".join(
    f"SELECT '{name}' AS Model, split, energy_sum, {column} AS prediction FROM marked"
    for name, column in NAIVE_MODELS.items()
)
METRICS_SQL = """avg(abs(energy_sum - prediction)) AS MAE, sqrt(avg((energy_sum - prediction) ** 2)) AS RMSE,
  coalesce(avg(abs((energy_sum - prediction) / nullif(energy_sum, 0))) * 100, 0) AS MAPE,
  1 - sum((energy_sum - prediction) ** 2) / (var_pop(energy_sum) * count(*)) AS R2"""
LEADERBOARD_SQL = f"SELECT Model, {METRICS_SQL} FROM ({NAIVE_SQL}) WHERE split = 'test' GROUP BY Model"


def naive_leaderboard(ws):
    rows = metrics.long_predictions(ws.naive, NAIVE_MODELS, ["energy_sum"])
    return metrics.regression_metrics(rows, ["Model"])


@query("sink_table", LEADERBOARD_SQL, rounds="MAE RMSE MAPE R2")
def sink_table(ws):
    """The leaderboard written as CSV and read back."""
    path = sinks.write_csv(naive_leaderboard(ws), new_path(ws.spark, "leaderboard"))
    schema = "Model string, MAE double, RMSE double, MAPE double, R2 double"
    return ws.spark.read.schema(schema).csv(path, header=True)


@query(
    "sink_by_month",
    """SELECT strftime(day, '%Y-%m') AS year_month, count(*) AS n, sum(energy_sum) AS total FROM features
GROUP BY 1""",
    rounds="total",
)
def sink_by_month(ws):
    """The feature table written in month folders, and read back."""
    path = sinks.write_by_month(ws.features, new_path(ws.spark, "by-month"))
    return ws.spark.read.parquet(path).groupBy("year_month").agg(
        F.count("*").alias("n"), F.sum("energy_sum").alias("total")
    )
