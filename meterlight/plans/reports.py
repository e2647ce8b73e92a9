"""Report queries: each takes the feature table and parameters, and returns named tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.operators import anomaly, eda, forecast, insights, profiles, retrieval
from meterlight.schema import DAY, TEST_DAYS, WEATHER_COLUMNS
from meterlight.sources.model_store import Clusterer

# Fixed value: days beyond the test window a forecast needs.
EXTRA_DAYS = 30


def overview_report(df: DataFrame) -> dict[str, DataFrame]:
    return {"kpis": eda.kpis(df), "filters": eda.filter_options(df)}


def eda_report(
    df: DataFrame,
    start: str | None = None,
    end: str | None = None,
    acorn: str = eda.ALL,
    tariff: str = eda.ALL,
    weather: str = "temperature_min",
    compare: str | None = None,
) -> dict[str, DataFrame]:
    """Counts and chart tables of one slice; charts are left out when it is empty."""
    part = eda.eda_filter(df, start, end, acorn, tariff)
    report = {"counts": eda.eda_counts(part)}
    if part.isEmpty():
        return report
    report |= {
        "daily": eda.daily_mean(part),
        "monthly": eda.monthly_mean(part),
        "seasonal": eda.seasonal_box(part),
        "day_type": eda.day_type_mean(part),
    }
    if weather in WEATHER_COLUMNS and weather in part.columns:
        daily = eda.weather_daily(part, weather)
        report |= {"weather": daily, "weather_trend": eda.weather_trend(daily)}
    if "acorn_grouped" in part.columns:
        report["acorn"] = eda.acorn_mean_std(part)
    if len(eda.heatmap_columns(part)) >= 2:
        report["correlation"] = eda.correlation_matrix(part)
    if compare:
        report["comparison"] = eda.household_compare(part, compare)
    return report


def forecast_rows(
    df: DataFrame, household: str = eda.ALL, test_days: int = TEST_DAYS
) -> DataFrame:
    """Test window of one household, or of the daily mean over all of them."""
    series = (
        eda.daily_panel_mean(df) if household == eda.ALL else eda.household_slice(df, household)
    )
    if series.limit(test_days + EXTRA_DAYS).count() < test_days + EXTRA_DAYS:
        raise ValueError("too few days for this forecast")
    return eda.time_split(series, test_days)[1]


def forecasting_report(
    df: DataFrame,
    model: forecast.TreeModel,
    household: str = eda.ALL,
    test_days: int = TEST_DAYS,
    leaderboard: DataFrame | None = None,
) -> dict[str, DataFrame]:
    predictions = forecast.predict(model, forecast_rows(df, household, test_days))
    importance = forecast.feature_importance(model, df.sparkSession)
    report = {
        "metrics": forecast.all_metrics(predictions),
        "curve": forecast.actual_vs_predicted(predictions).orderBy(DAY),
        "importance": forecast.top_feature_importance(importance),
    }
    if leaderboard is not None:
        report["leaderboard"] = leaderboard
    return report


def clustering_report(
    clusterer: Clusterer,
    x: str = "mean_energy",
    y: str = "std_energy",
    household: str | None = None,
    elbow: DataFrame | None = None,
) -> dict[str, DataFrame]:
    labelled = clusterer.labelled
    summary = profiles.cluster_summary(labelled)
    report = {
        "summary": summary,
        "scatter": profiles.cluster_scatter(labelled, x, y),
        "radar": profiles.radar_normalize(summary),
    }
    if elbow is not None:
        report["elbow"] = elbow
    if household:
        report["lookup"] = profiles.household_lookup(labelled, household)
    return report


def anomalies_report(
    df: DataFrame,
    stored: anomaly.Forest,
    household: str | None = None,
    sensitivity: int = 5,
) -> dict[str, DataFrame]:
    part = df if household is None else eda.household_slice(df, household)
    if part.isEmpty():
        raise ValueError("no rows for this household")
    detected = anomaly.sensitivity_refit(part, sensitivity, stored)
    return {
        "metrics": anomaly.anomaly_metrics(detected),
        "timeline": anomaly.anomaly_timeline(detected, household),
        "distribution": eda.score_histogram(detected, "anomaly_score"),
        "details": anomaly.top_anomalies(detected),
    }


def insights_report(
    df: DataFrame, model: forecast.TreeModel, model_name: str, clusterer: Clusterer
) -> dict[str, DataFrame]:
    summary = profiles.cluster_summary(clusterer.labelled)
    savings = profiles.cluster_savings(summary)
    recent = forecast.predict(model, eda.recent_rows(df))
    return {
        "peaks": eda.peak_insights(df),
        "forecast": forecast.forecast_insights(recent, model_name),
        "savings": savings,
        "recommendations": insights.recommendations(insights.advice_facts(df, savings)),
        "tariffs": insights.tariff_gap(df),
        "day_of_week": eda.day_of_week_mean(df),
        "monthly": eda.monthly_mean(df),
    }


def chat_report(
    question: str,
    chunks: DataFrame,
    history: DataFrame | None = None,
    system_prompt: str = retrieval.DEFAULT_SYSTEM_PROMPT,
) -> dict[str, DataFrame]:
    """Sources and prompt messages for one question; ``history`` is (turn, role, text)."""
    sources = retrieval.retrieve_top_k(chunks, question)
    found = sources.withColumn("question_id", F.lit(0).cast("long"))
    order = F.struct(-F.col("score"), *retrieval.CHUNK_KEY)
    ranked = found.withColumn("rank", order)
    contexts = retrieval.build_context(ranked)
    asked = contexts.select(
        "question_id", F.lit(question).alias("question"), F.lit(0).cast("long").alias("conv_id")
    )
    spark = chunks.sparkSession
    empty = spark.createDataFrame([], "turn long, role string, text string")
    past = (empty if history is None else history).withColumn("conv_id", F.lit(0).cast("long"))
    messages = retrieval.chat_messages(past, asked, contexts, system_prompt)
    return {"sources": sources, "messages": messages.drop("question_id")}
