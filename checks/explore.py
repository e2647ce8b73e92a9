"""Filters, aggregates, profiles and insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.scans import LEADERBOARD_SQL, METRICS_SQL, NAIVE_MODELS, naive_leaderboard, rounded
from checks.tables import (
    ATTRIBUTES,
    ENERGY,
    NUMERIC,
    PROFILE,
    SEASON_NAME_SQL,
    WEATHER,
    listed,
)
from meterlight.functions.numeric import safe_ratio
from meterlight.operators import anomaly, eda, forecast, insights, metrics, profiles, retrieval

SLICE = {"start": "1997-01-01", "end": "1999-12-31", "acorn": "ASIA", "tariff": "Std"}
SLICE_SQL = (
    "features WHERE day BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' "
    "AND acorn_grouped = 'ASIA' AND tariff = 'Std'"
)


# Filters


@query(
    "eda_filter",
    f"SELECT household_id, day, energy_sum, {listed(ATTRIBUTES)} FROM {SLICE_SQL}",
    rounds="energy_sum",
)
def eda_filter(ws):
    """Files outside the days are not read."""
    part = eda.eda_filter(ws.laid_out.scan(SLICE["start"], SLICE["end"]), **SLICE)
    return part.select("household_id", "day", "energy_sum", *ATTRIBUTES)


@query(
    "household_slice",
    "SELECT household_id, day, energy_sum FROM features WHERE household_id = 'MAC000007'",
    rounds="energy_sum",
)
def household_slice(ws):
    part = ws.laid_out.scan(households=["MAC000007"])
    return eda.household_slice(part, "MAC000007").select("household_id", "day", "energy_sum")


@query(
    "household_compare",
    """SELECT day, energy_sum, household_id FROM features
WHERE household_id IN ('MAC000001', 'MAC000003', 'MAC000009')""",
    rounds="energy_sum",
)
def household_compare(ws):
    chosen = ["MAC000001", "MAC000003", "MAC000009"]
    return eda.household_compare(ws.laid_out.scan(households=chosen), ",".join(chosen))


@query(
    "recent_rows",
    "SELECT household_id, day, energy_sum FROM features ORDER BY day DESC, household_id DESC LIMIT 30",
    rounds="energy_sum",
)
def recent_rows(ws):
    return eda.recent_rows(ws.laid_out.since(30)).select("household_id", "day", "energy_sum")


@query(
    "filter_options",
    """SELECT DISTINCT 'acorn_group' AS kind, acorn_grouped AS value FROM features WHERE acorn_grouped IS NOT NULL
UNION ALL SELECT DISTINCT 'tariff', tariff FROM features WHERE tariff IS NOT NULL
UNION ALL SELECT DISTINCT 'household', household_id FROM features""",
)
def filter_options(ws):
    return eda.filter_options(ws.features)


# Aggregates


@query(
    "kpis",
    """SELECT count(DISTINCT household_id) AS n_households,
  strftime(min(day), '%b %Y') || ' – ' || strftime(max(day), '%b %Y') AS date_range,
  round(avg(energy_sum), 2) AS avg_daily_energy, count(*) AS total_records FROM features""",
    rounds="avg_daily_energy",
)
def kpis(ws):
    return eda.kpis(ws.features)


@query(
    "eda_counts",
    f"SELECT count(*) AS record_count, count(DISTINCT household_id) AS household_count FROM {SLICE_SQL}",
)
def eda_counts(ws):
    return eda.eda_counts(eda.eda_filter(ws.features, **SLICE))


@query(
    "daily_mean",
    "SELECT day, avg(energy_sum) AS mean_energy FROM features GROUP BY day",
    rounds="mean_energy",
)
def daily_mean(ws):
    return eda.daily_mean(ws.features)


@query(
    "monthly_mean",
    "SELECT strftime(day, '%Y-%m') AS year_month, avg(energy_sum) AS mean_energy FROM features GROUP BY 1",
    rounds="mean_energy",
)
def monthly_mean(ws):
    return eda.monthly_mean(ws.features)


@query(
    "seasonal_box",
    f"""WITH q AS (SELECT season, quantile_cont(energy_sum, 0.25) AS q1, median(energy_sum) AS median,
    quantile_cont(energy_sum, 0.75) AS q3 FROM features GROUP BY season)
SELECT season, {SEASON_NAME_SQL} AS season_name, count(*) AS n, q1, median, q3,
  min(energy_sum) FILTER (energy_sum >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
  max(energy_sum) FILTER (energy_sum <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (energy_sum < q1 - 1.5 * (q3 - q1) OR energy_sum > q3 + 1.5 * (q3 - q1)) AS outliers
FROM features JOIN q USING (season) GROUP BY season, q1, median, q3""",
    rounds="q1 median q3 whisker_low whisker_high",
)
def seasonal_box(ws):
    return eda.seasonal_box(ws.features)


DAILY_WEATHER_SQL = (
    "SELECT day, avg(energy_sum) AS mean_energy, avg(temperature_min) AS weather_value "
    "FROM features GROUP BY day"
)


@query("weather_daily", DAILY_WEATHER_SQL, rounds="mean_energy weather_value")
def weather_daily(ws):
    return eda.weather_daily(ws.features, "temperature_min")


@query(
    "weather_trend",
    f"""SELECT regr_slope(mean_energy, weather_value) AS slope, regr_intercept(mean_energy, weather_value) AS intercept,
  regr_r2(mean_energy, weather_value) AS r2, CAST(regr_count(mean_energy, weather_value) AS BIGINT) AS n
FROM ({DAILY_WEATHER_SQL})""",
    rounds="slope intercept r2",
)
def weather_trend(ws):
    return eda.weather_trend(eda.weather_daily(ws.features, "temperature_min"))


@query(
    "acorn_mean_std",
    """SELECT acorn_grouped, avg(energy_sum) AS mean_energy, stddev_samp(energy_sum) AS std_energy FROM features
WHERE acorn_grouped NOT IN ('ACORN-', 'ACORN-U') GROUP BY 1""",
    rounds="mean_energy std_energy",
)
def acorn_mean_std(ws):
    return eda.acorn_mean_std(ws.features)


@query(
    "day_type_mean",
    """SELECT day_type, avg(energy_sum) AS mean_energy
FROM (VALUES ('Weekday'), ('Weekend'), ('Bank Holiday')) AS kinds(day_type)
LEFT JOIN (SELECT energy_sum, CASE WHEN is_bank_holiday = 1 THEN 'Bank Holiday' WHEN is_weekend = 1 THEN 'Weekend'
  ELSE 'Weekday' END AS day_type FROM features) USING (day_type) GROUP BY day_type""",
    rounds="mean_energy",
)
def day_type_mean(ws):
    return eda.day_type_mean(ws.features)


HEATMAP = [c for c in ENERGY if c != "energy_count"] + WEATHER[:6]


def correlations_sql(columns: list[str]) -> str:
    """All ordered pairs, as one row of ``corr`` aggregates turned into (x, y, r)."""
    pairs = [(x, y) for x in columns for y in columns if x < y]
    cells = ", ".join(f"corr({x}, {y}) AS \"{x}|{y}\"" for x, y in pairs)
    names = ", ".join(f'"{x}|{y}"' for x, y in pairs)
    alone = "\nUNION ALL ".join(
        f"SELECT '{c}', '{c}', CASE WHEN stddev_pop({c}) > 0 THEN CAST(1 AS DOUBLE) END FROM features"
        for c in columns
    )
    return f"""WITH r AS (SELECT split_part(pair, '|', 1) AS x, split_part(pair, '|', 2) AS y, r
  FROM (SELECT {cells} FROM features) UNPIVOT INCLUDE NULLS (r FOR pair IN ({names})))
SELECT x, y, r FROM r UNION ALL SELECT y, x, r FROM r UNION ALL {alone}"""


@query("correlation_matrix", correlations_sql(HEATMAP), rounds="r")
def correlation_matrix(ws):
    return eda.correlation_matrix(ws.features)


@query(
    "day_of_week_mean",
    """SELECT day_of_week, strftime(any_value(day), '%a') AS day_name, avg(energy_sum) AS mean_energy
FROM features GROUP BY day_of_week""",
    rounds="mean_energy",
)
def day_of_week_mean(ws):
    return eda.day_of_week_mean(ws.features)


def peaks_sql(keys: str = "") -> str:
    """Peak facts per segment (``keys`` is a column with a trailing comma, or nothing)."""
    column = keys.rstrip(", ")
    join = f"USING ({column})" if column else "ON true"
    group = f"GROUP BY {column}" if column else ""
    return f"""WITH d AS (SELECT {keys} strftime(any_value(day), '%A') AS name, avg(energy_sum) AS mean
    FROM features GROUP BY {keys} day_of_week),
  s AS (SELECT {keys} {SEASON_NAME_SQL} AS name, avg(energy_sum) AS mean FROM features GROUP BY {keys} season),
  g AS (SELECT {keys} (avg(energy_sum) FILTER (is_weekend = 1) / avg(energy_sum) FILTER (is_weekend = 0) - 1) * 100 AS gap
    FROM features {group}),
  de AS (SELECT {keys} arg_max(name, mean) AS peak_day, arg_min(name, mean) AS lowest_day FROM d {group}),
  se AS (SELECT {keys} arg_max(name, mean) AS peak_season, arg_min(name, mean) AS lowest_season FROM s {group})
SELECT {keys} peak_day, lowest_day, peak_season, lowest_season, gap AS weekend_pct_diff
FROM de JOIN se {join} JOIN g {join}"""


@query(
    "peak_insights",
    f"SELECT * REPLACE (round(weekend_pct_diff, 1) AS weekend_pct_diff) FROM ({peaks_sql()})",
    rounds="weekend_pct_diff",
)
def peak_insights(ws):
    return eda.peak_insights(ws.features)


@query(
    "daily_panel_mean",
    f"SELECT 'AGGREGATED' AS household_id, day, {listed(NUMERIC, 'avg({0}) AS {0}')} FROM features GROUP BY day",
    rounds=rounded(NUMERIC),
)
def daily_panel_mean(ws):
    return eda.daily_panel_mean(ws.features)


@query(
    "score_histogram",
    """WITH v AS (SELECT value AS v, min(value) OVER () AS low, max(value) OVER () AS high FROM events WHERE value IS NOT NULL)
SELECT CAST(least(floor(60 * (v - low) / (high - low)), 59) + 1 AS INTEGER) AS bin,
  any_value(low + least(floor(60 * (v - low) / (high - low)), 59) * (high - low) / 60) AS bin_start, count(*) AS n
FROM v GROUP BY 1""",
    rounds="bin_start",
)
def score_histogram(ws):
    events = ws.spark.read.parquet(f"{ws.folder}/events.parquet")
    return eda.score_histogram(events, "value")


SUMMARY_LINES_SQL = """WITH lines AS (SELECT [
    '## Live Dataset Summary',
    '- Total records: ' || format('{:,}', count(*)),
    '- Unique households: ' || count(DISTINCT household_id),
    '- Date range: ' || min(day) || ' to ' || max(day),
    '- Average daily energy (kWh): ' || printf('%.2f', avg(energy_sum)),
    '- Median daily energy (kWh): ' || printf('%.2f', median(energy_sum)),
    '- Max daily energy (kWh): ' || printf('%.2f', max(energy_sum)),
    '- Min daily energy (kWh): ' || printf('%.2f', min(energy_sum)),
    '- Std deviation of daily energy (kWh): ' || printf('%.2f', stddev_samp(energy_sum)),
    '',
    '## Seasonal Average Energy Consumption',
    '- Winter: ' || printf('%.2f', avg(energy_sum) FILTER (season = 0)) || ' kWh',
    '- Spring: ' || printf('%.2f', avg(energy_sum) FILTER (season = 1)) || ' kWh',
    '- Summer: ' || printf('%.2f', avg(energy_sum) FILTER (season = 2)) || ' kWh',
    '- Autumn: ' || printf('%.2f', avg(energy_sum) FILTER (season = 3)) || ' kWh',
    '',
    '## Weekend vs Weekday',
    '- Weekend average: ' || printf('%.2f', avg(energy_sum) FILTER (is_weekend = 1)) || ' kWh',
    '- Weekday average: ' || printf('%.2f', avg(energy_sum) FILTER (is_weekend = 0)) || ' kWh'] AS l
  FROM features)
SELECT CAST(unnest(range(len(l))) AS INTEGER) AS line_no, unnest(l) AS line FROM lines"""


def models_lines_sql() -> str:
    return f"""SELECT * FROM ({SUMMARY_LINES_SQL})
UNION ALL SELECT * FROM (VALUES (1000, ''), (1001, '## Model Performance (Baseline)'), (2000, ''), (2001, '## Best Model: weekly_mean'))
UNION ALL SELECT CAST(1001 + row_number() OVER (ORDER BY Model) AS INTEGER),
  '- ' || Model || ': MAE=' || printf('%.4f', MAE) || ', RMSE=' || printf('%.4f', RMSE) || ', R²=' || printf('%.4f', R2)
FROM ({LEADERBOARD_SQL})"""


@query("live_summary", models_lines_sql())
def live_summary(ws):
    return retrieval.live_summary(ws.features, naive_leaderboard(ws), "weekly_mean")


# Anomaly reports over a fixed-threshold score


@query(
    "anomaly_metrics",
    """WITH a AS (SELECT count(*) AS n, count(*) FILTER (is_anomaly) AS odd, coalesce(avg(energy_sum) FILTER (is_anomaly), 0) AS o,
    avg(energy_sum) FILTER (NOT is_anomaly) AS u FROM flagged)
SELECT n AS total_records, odd AS anomalies_found, round(odd / n * 100, 2) AS anomaly_rate, round(o, 2) AS avg_anomaly_energy,
  round(u, 2) AS avg_normal_energy, round((o - u) / u * 100, 2) AS shift_percent FROM a""",
    rounds="anomaly_rate avg_anomaly_energy avg_normal_energy shift_percent",
)
def anomaly_metrics(ws):
    return anomaly.anomaly_metrics(ws.flagged)


@query(
    "anomaly_daily",
    "SELECT day, avg(energy_sum) AS mean_energy, bool_or(is_anomaly) AS is_anomaly FROM flagged GROUP BY day",
    rounds="mean_energy",
)
def anomaly_daily(ws):
    return anomaly.anomaly_daily(ws.flagged)


@query(
    "anomaly_timeline",
    """SELECT day, energy_sum AS mean_energy, is_anomaly FROM flagged WHERE household_id = 'MAC000007'""",
    rounds="mean_energy",
)
def anomaly_timeline(ws):
    return anomaly.anomaly_timeline(ws.flagged, "MAC000007")


@query(
    "anomaly_summary",
    """WITH h AS (SELECT household_id, count(*) AS n FROM flagged WHERE is_anomaly GROUP BY 1)
SELECT count(*) AS total_records, count(*) FILTER (is_anomaly) AS total_anomalies,
  count(*) FILTER (is_anomaly) / count(*) * 100 AS anomaly_percentage,
  coalesce(avg(energy_sum) FILTER (is_anomaly), 0) AS avg_anomaly_energy,
  coalesce(avg(energy_sum) FILTER (NOT is_anomaly), 0) AS avg_normal_energy,
  coalesce(max(energy_sum) FILTER (is_anomaly), 0) AS max_anomaly_energy,
  (SELECT count(*) FROM h) AS households_with_anomalies, (SELECT max(n) FROM h) AS max_anomalies_single_household,
  (SELECT household_id FROM h ORDER BY n DESC, household_id LIMIT 1) AS top_anomaly_household FROM flagged""",
    rounds="anomaly_percentage avg_anomaly_energy avg_normal_energy max_anomaly_energy",
)
def anomaly_summary(ws):
    return anomaly.anomaly_summary(ws.flagged)


@query(
    "anomaly_calendar_counts",
    """SELECT 'month' AS part, CAST(month AS VARCHAR) AS item, count(*) AS anomalies FROM flagged WHERE is_anomaly GROUP BY 2
UNION ALL SELECT 'weekday', strftime(day, '%A'), count(*) FROM flagged WHERE is_anomaly GROUP BY 2""",
)
def anomaly_calendar_counts(ws):
    return anomaly.anomaly_calendar_counts(ws.flagged)


@query(
    "top_anomalies",
    """SELECT strftime(day, '%Y-%m-%d') AS day, household_id, energy_sum, energy_mean, energy_max, anomaly_score FROM (
  SELECT * FROM flagged WHERE is_anomaly ORDER BY anomaly_score, household_id, day LIMIT 100)""",
    rounds="energy_sum energy_mean energy_max anomaly_score",
)
def top_anomalies(ws):
    return anomaly.top_anomalies(ws.flagged)


@query(
    "audit_anomaly_rate",
    """SELECT avg(CAST(is_anomaly AS INTEGER)) * 100 AS anomaly_rate, CAST(5 AS DOUBLE) AS expected_rate,
  CASE WHEN abs(avg(CAST(is_anomaly AS INTEGER)) * 100 - 5) > 2 THEN 'warning' ELSE 'ok' END AS rate_flag,
  avg(energy_sum) FILTER (NOT is_anomaly) AS normal_mean, avg(energy_sum) FILTER (is_anomaly) AS anomaly_mean,
  avg(energy_sum) FILTER (is_anomaly) / avg(energy_sum) FILTER (NOT is_anomaly) AS energy_ratio FROM flagged""",
    rounds="anomaly_rate expected_rate normal_mean anomaly_mean energy_ratio",
)
def audit_anomaly_rate(ws):
    return anomaly.share_flagged(ws.flagged, 0.05)


@query(
    "anomaly_features",
    """SELECT household_id, day, coalesce(energy_sum, 0) AS energy_sum, coalesce(energy_mean, 0) AS energy_mean,
  coalesce(energy_max, 0) AS energy_max, coalesce(energy_std, 0) AS energy_std, coalesce(energy_min, 0) AS energy_min,
  CAST(isodow(day) - 1 AS INTEGER) AS day_of_week, CAST(month(day) AS INTEGER) AS month,
  CAST(isodow(day) >= 6 AS INTEGER) AS is_weekend FROM readings""",
    rounds="energy_sum energy_mean energy_max energy_std energy_min",
)
def anomaly_features(ws):
    """Raw readings: calendar columns are derived and gaps become zero."""
    return anomaly.anomaly_features(ws.readings, ["household_id", "day"])


# Profiles and clusters (cluster = number in the household id modulo 4)


@query(
    "household_profile",
    f"SELECT household_id, {listed(PROFILE)}, reading_count FROM profiles",
    rounds=" ".join(PROFILE),
)
def household_profile(ws):
    return profiles.household_profile(ws.features)


@query(
    "weekend_weekday_join",
    """SELECT household_id, avg(energy_sum) FILTER (is_weekend = 1) AS weekend_avg,
  avg(energy_sum) FILTER (is_weekend = 0) AS weekday_avg,
  coalesce(avg(energy_sum) FILTER (is_weekend = 1) / nullif(avg(energy_sum) FILTER (is_weekend = 0), 0), 1) AS weekend_ratio
FROM features GROUP BY household_id""",
    rounds="weekend_avg weekday_avg weekend_ratio",
)
def weekend_weekday_join(ws):
    return profiles.weekend_weekday(ws.features)


@query(
    "safe_ratio",
    """SELECT household_id, day, coalesce(energy_std / nullif(energy_min - 1, 0), 1) AS ratio, ingest_ordinal FROM readings""",
    rounds="ratio",
)
def safe_ratio_query(ws):
    ratio = safe_ratio(F.col("energy_std"), F.col("energy_min") - 1)
    return ws.readings.select("household_id", "day", ratio.alias("ratio"), "ingest_ordinal")


@query(
    "cost_projection_scalar",
    """SELECT household_id, round(mean_energy, 2) AS avg_daily_kwh, round(mean_energy * 30, 1) AS monthly_kwh,
  round(mean_energy * 30 * 0.34, 2) AS monthly_cost_gbp, round(mean_energy * 365, 0) AS annual_kwh,
  round(mean_energy * 365 * 0.34, 0) AS annual_cost_gbp FROM profiles""",
    rounds="avg_daily_kwh monthly_kwh monthly_cost_gbp annual_kwh annual_cost_gbp",
)
def cost_projection_scalar(ws):
    return profiles.cost_projection(ws.profiles)


@query(
    "standardize",
    "WITH s AS (SELECT "
    + listed(PROFILE, "avg({0}) AS a_{0}, stddev_pop({0}) AS d_{0}")
    + " FROM profiles) SELECT household_id, reading_count, "
    + listed(PROFILE, "CASE WHEN d_{0} = 0 THEN 0 ELSE ({0} - a_{0}) / d_{0} END AS {0}")
    + " FROM profiles CROSS JOIN s",
    rounds=" ".join(PROFILE),
)
def standardize(ws):
    return profiles.standardize(ws.profiles)


@query(
    "label_clusters",
    "SELECT household_id, cluster, cluster_label, mean_energy FROM numbered JOIN cluster_names USING (cluster)",
    rounds="mean_energy",
)
def label_clusters(ws):
    return ws.bucketed.select("household_id", "cluster", "cluster_label", "mean_energy")


SUMMARY_SQL = f"SELECT cluster, cluster_label, {listed(PROFILE)}, count FROM summary"


@query("cluster_summary", SUMMARY_SQL, rounds=" ".join(PROFILE))
def cluster_summary(ws):
    return profiles.cluster_summary(ws.bucketed)


@query(
    "radar_normalize",
    "SELECT cluster, cluster_label, count, "
    + listed(PROFILE, "CASE WHEN max({0}) OVER () > 0 THEN {0} / max({0}) OVER () ELSE {0} END AS {0}")
    + " FROM summary",
    rounds=" ".join(PROFILE),
)
def radar_normalize(ws):
    return profiles.radar_normalize(profiles.cluster_summary(ws.bucketed))


@query(
    "cluster_scatter",
    "SELECT household_id, mean_energy AS x, std_energy AS y, CAST(cluster AS VARCHAR) AS cluster FROM numbered",
    rounds="x y",
)
def cluster_scatter(ws):
    return profiles.cluster_scatter(ws.bucketed)


@query(
    "household_lookup",
    """SELECT household_id, cluster, cluster_label, mean_energy, std_energy, max_energy, min_energy, weekend_ratio
FROM numbered JOIN cluster_names USING (cluster) WHERE household_id = 'MAC000005'""",
    rounds="mean_energy std_energy max_energy min_energy weekend_ratio",
)
def household_lookup(ws):
    return profiles.household_lookup(ws.bucketed, "MAC000005")


SAVINGS_SQL = """SELECT l.cluster_label AS low_cluster_label, h.cluster_label AS high_cluster_label,
  round(l.mean_energy, 2) AS low_cluster_avg, round(h.mean_energy, 2) AS high_cluster_avg,
  round(h.mean_energy - l.mean_energy, 2) AS potential_saving_kwh,
  round((h.mean_energy - l.mean_energy) / h.mean_energy * 100, 1) AS pct_saving,
  round((h.mean_energy - l.mean_energy) * 365, 0) AS annual_saving_kwh,
  round((h.mean_energy - l.mean_energy) * 365 * 0.34, 0) AS annual_saving_gbp
FROM (SELECT * FROM summary ORDER BY mean_energy LIMIT 1) l, (SELECT * FROM summary ORDER BY mean_energy DESC LIMIT 1) h"""


@query(
    "cluster_savings",
    SAVINGS_SQL,
    rounds="low_cluster_avg high_cluster_avg potential_saving_kwh pct_saving annual_saving_kwh annual_saving_gbp",
)
def cluster_savings(ws):
    return profiles.cluster_savings(profiles.cluster_summary(ws.bucketed))


@query(
    "cluster_balance",
    """SELECT cluster, cluster_label, count AS households, count / sum(count) OVER () * 100 AS share_percent,
  min(count) OVER () / sum(count) OVER () * 100 AS smallest_share_percent,
  CASE WHEN min(count) OVER () / sum(count) OVER () * 100 < 5 THEN 'warning' ELSE 'ok' END AS balance_flag FROM summary""",
    rounds="share_percent smallest_share_percent",
)
def cluster_balance(ws):
    return profiles.cluster_balance(ws.bucketed)


# Metrics over last week's value as the prediction


@query("regression_metrics", LEADERBOARD_SQL, rounds="MAE RMSE MAPE R2")
def regression_metrics(ws):
    return naive_leaderboard(ws)


TRIMMED_SQL = """coalesce(avg(abs((energy_sum - prediction) / energy_sum)) FILTER (energy_sum > 1) * 100,
  avg(abs((energy_sum - prediction) / nullif(energy_sum, 0))) * 100, 0)"""


@query(
    "trimmed_mape",
    f"""SELECT coalesce(avg(abs((energy_sum - prediction) / nullif(energy_sum, 0))) * 100, 0) AS MAPE,
  {TRIMMED_SQL} AS trimmed_mape, avg(CAST(energy_sum > 1 AS INTEGER)) * 100 AS kept_percent FROM naive""",
    rounds="MAPE trimmed_mape kept_percent",
)
def trimmed_mape(ws):
    return metrics.trimmed_mape(ws.naive)


@query(
    "leaderboard_long",
    f"UNPIVOT ({LEADERBOARD_SQL}) ON MAE, RMSE, MAPE, R2 INTO NAME metric VALUE value",
    rounds="value",
)
def leaderboard_long(ws):
    return metrics.leaderboard_long(naive_leaderboard(ws))


@query(
    "best_model",
    f"SELECT arg_min(Model, RMSE) AS best_model, min(RMSE) AS RMSE FROM ({LEADERBOARD_SQL})",
    rounds="RMSE",
)
def best_model(ws):
    return metrics.best_model(naive_leaderboard(ws))


@query(
    "forecast_metrics",
    f"SELECT {METRICS_SQL}, {TRIMMED_SQL} AS trimmed_mape FROM naive",
    rounds="MAE RMSE MAPE R2 trimmed_mape",
)
def forecast_metrics(ws):
    return forecast.all_metrics(ws.naive)


@query(
    "naive_curve",
    "SELECT day, energy_sum AS actual, prediction AS predicted FROM naive WHERE household_id = 'MAC000007'",
    rounds="actual predicted",
)
def naive_curve(ws):
    return forecast.actual_vs_predicted(eda.household_slice(ws.naive, "MAC000007"))


@query(
    "naive_insights",
    """WITH r AS (SELECT * FROM features ORDER BY day DESC, household_id DESC LIMIT 30)
SELECT round(avg(energy_sum_lag_7), 2) AS avg_daily_predicted, round(avg(energy_sum_lag_7) * 30, 1) AS estimated_monthly_kwh,
  round(avg(energy_sum_lag_7) * 30 * 0.34, 2) AS estimated_monthly_cost_gbp, 'last_week' AS model_type FROM r""",
    rounds="avg_daily_predicted estimated_monthly_kwh estimated_monthly_cost_gbp",
)
def naive_insights(ws):
    recent = eda.recent_rows(ws.features).withColumn("prediction", F.col(NAIVE_MODELS["last_week"]))
    return forecast.forecast_insights(recent, "last_week")


# Advice


def advice_sql(facts: str, keys: str = "") -> str:
    return f"""SELECT {keys} CAST(position AS INTEGER) AS position, title, detail FROM (
  SELECT {keys} 0 AS position, 'Shift Heavy Appliances' AS title, '**' || peak_day ||
    '** has the highest average consumption. Schedule heavy appliances on **' || lowest_day || '** to flatten demand peak.' AS detail FROM ({facts})
  UNION ALL SELECT {keys} 1, 'Consider Time-of-Use Tariffs', 'Dynamic pricing tariffs (ToU) show a ~7.6% lower baseline demand on average, encouraging consumption shifts to off-peak periods.' FROM ({facts})
  UNION ALL SELECT {keys} 2, 'Optimize Winter Heating', 'Winter consumption is significantly higher than ' || lowest_season ||
    '. Optimize insulation and heating schedules to close the seasonal gap.' FROM ({facts}) WHERE peak_season = 'Winter'
  UNION ALL SELECT {keys} 3, 'Weekend Consumption Awareness', 'Weekend usage is **' || printf('%.1f', weekend_pct_diff) ||
    '%** higher than weekdays. Reduce standby energy and active appliance usage.' FROM ({facts}) WHERE weekend_pct_diff > 3
  UNION ALL SELECT {keys} 4, 'Benchmark with Efficient Peers', 'The gap between high and low clusters is **' || printf('%.0f', pct_saving) ||
    '%**. Track background base load items.' FROM ({facts}) WHERE pct_saving > 15)"""


@query(
    "recommendations",
    advice_sql(f"SELECT * FROM ({peaks_sql()}) CROSS JOIN (SELECT pct_saving FROM ({SAVINGS_SQL}))"),
)
def recommendations(ws):
    savings = profiles.cluster_savings(profiles.cluster_summary(ws.bucketed))
    return insights.recommendations(insights.advice_facts(ws.features, savings))


@query(
    "recommendations_by_household",
    advice_sql(
        f"SELECT *, CAST(NULL AS DOUBLE) AS pct_saving FROM ({peaks_sql('household_id, ')})",
        "household_id, ",
    ),
)
def recommendations_by_household(ws):
    """Advice per household; many of them have a weekend gap above the threshold."""
    segment = ["household_id"]
    facts = insights.advice_facts(ws.features, segment=segment)
    return insights.recommendations(facts, segment=segment)


@query(
    "tariff_gap",
    """WITH t AS (SELECT avg(energy_sum) FILTER (tariff = 'Std') AS s, avg(energy_sum) FILTER (tariff = 'ToU') AS t FROM features)
SELECT s AS std_mean, t AS tou_mean, (s - t) / s * 100 AS tou_effect_percent FROM t""",
    rounds="std_mean tou_mean tou_effect_percent",
)
def tariff_gap(ws):
    return insights.tariff_gap(ws.features)
