"""Fitted models: forecasters, clusters and the isolation forest.

What a model returns can't be stated in SQL; the queries whose names end in ``_rows`` state
what must hold of it in any case: which rows it answers for, and that it changes none.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from meterlight.operators import anomaly, eda, forecast, profiles
from meterlight.plans import reports, training
from meterlight.sources import model_store, sinks


@query("forecast_train")
def forecast_train(ws):
    """The first boosted model on the training part; what it learned, per feature."""
    return forecast.feature_importance(ws.trained.models["gbt_a"], ws.spark)


@query("forecast_predict")
def forecast_predict(ws):
    _, test = eda.time_split(ws.features)
    predicted = forecast.predict(ws.trained.models["gbt_a"], test)
    return predicted.select("household_id", "day", "energy_sum", "prediction")


@query(
    "forecast_predict_rows",
    "SELECT household_id, day, energy_sum, true AS predicted FROM marked WHERE split = 'test'",
    rounds="energy_sum",
)
def forecast_predict_rows(ws):
    """Every row of the test window has a finite prediction."""
    finite = F.col("prediction").isNotNull() & (F.abs("prediction") < float("inf"))
    predicted = forecast_predict(ws)
    return predicted.select("household_id", "day", "energy_sum", finite.alias("predicted"))


@query("compare_models")
def compare_models(ws):
    return ws.trained.leaderboard


@query("feature_importance")
def feature_importance(ws):
    return forecast.feature_importance(ws.trained.models["random_forest"], ws.spark)


@query("top_feature_importance")
def top_feature_importance(ws):
    return forecast.top_feature_importance(feature_importance(ws))


@query("actual_vs_predicted")
def actual_vs_predicted(ws):
    """Daily mean over all households in the test window."""
    return reports.forecasting_report(ws.features, ws.trained.models["gbt_a"])["curve"]


@query("tune_models")
def tune_models(ws):
    return training.tune(ws.features)


@query("model_store")
def model_store_query(ws):
    """Every model saved and loaded again; the largest difference in what they return."""
    _, test = eda.time_split(ws.features)
    kept = ["household_id", "day"]
    before = forecast.predict(ws.trained.models["gbt_a"], test).select(
        *kept, F.col("prediction").alias("before")
    )
    loaded = model_store.load_forecaster(f"{ws.saved}/forecaster_gbt_a")
    after = forecast.predict(loaded, test).select(*kept, F.col("prediction").alias("after"))
    forecasts = before.join(after, kept).agg(
        F.lit("forecaster").alias("model"),
        F.count("*").alias("rows"),
        F.max(F.abs(F.col("before") - F.col("after"))).alias("largest_difference"),
    )
    clusterer = model_store.load_clusterer(ws.spark, f"{ws.saved}/clusterer")
    again = clusterer.model.transform(profiles.profile_vectors(clusterer.labelled))
    clusters = again.join(ws.trained.clusterer.labelled, "household_id").agg(
        F.lit("clusterer").alias("model"),
        F.count("*").alias("rows"),
        F.max(F.abs(F.col("prediction") - F.col("cluster")).cast("double")).alias(
            "largest_difference"
        ),
    )
    forest = anomaly.load_forest(ws.spark, f"{ws.saved}/anomaly_detector")
    was = ws.trained.detected.select(*kept, F.col("anomaly_score").alias("before"))
    now = anomaly.detect(forest, ws.features).select(*kept, F.col("anomaly_score").alias("after"))
    scores = was.join(now, kept).agg(
        F.lit("anomaly_detector").alias("model"),
        F.count("*").alias("rows"),
        F.max(F.abs(F.col("before") - F.col("after"))).alias("largest_difference"),
    )
    best = sinks.read_text_line(ws.spark, f"{ws.saved}/best_model")
    return (
        forecasts.unionByName(clusters).unionByName(scores).withColumn("best_model", F.lit(best))
    )


@query(
    "model_store_rows",
    """SELECT 'forecaster' AS model, count(*) AS n, true AS same FROM marked WHERE split = 'test'
UNION ALL SELECT 'clusterer', count(DISTINCT household_id), true FROM features
UNION ALL SELECT 'anomaly_detector', count(*), true FROM features""",
)
def model_store_rows(ws):
    """Saved and loaded models answer for the same rows with the same values."""
    same = F.col("largest_difference") == 0
    return model_store_query(ws).select("model", F.col("rows").alias("n"), same.alias("same"))


@query("elbow")
def elbow(ws):
    return ws.trained.elbow


@query("kmeans_fit")
def kmeans_fit(ws):
    return ws.trained.clusterer.labelled


@query(
    "kmeans_fit_rows",
    "SELECT DISTINCT household_id, true AS clustered FROM features",
)
def kmeans_fit_rows(ws):
    """Every household is in one of the four clusters."""
    return kmeans_fit(ws).select(
        "household_id", F.col("cluster").between(0, 3).alias("clustered")
    )


@query("clustering_summary")
def clustering_summary(ws):
    return profiles.cluster_summary(ws.trained.clusterer.labelled)


@query("isoforest_fit")
def isoforest_fit(ws):
    """Node table of the fitted forest."""
    return anomaly.fit_forest(ws.features).nodes


@query("isoforest_score")
def isoforest_score(ws):
    kept = ["household_id", "day", "energy_sum", "anomaly_score", "is_anomaly"]
    return anomaly.detect(ws.trained.forest, ws.features).select(*kept)


@query(
    "isoforest_score_rows",
    "SELECT count(*) AS n, true AS flagged_share_holds FROM features",
)
def isoforest_score_rows(ws):
    """As many rows are flagged as the contamination says, but for ties at the edge."""
    flagged = F.count_if("is_anomaly")
    gap = F.abs(flagged - F.lit(ws.trained.forest.contamination) * F.count("*"))
    return isoforest_score(ws).agg(
        F.count("*").alias("n"), (gap <= F.count("*") * 0.005 + 1).alias("flagged_share_holds")
    )


@query(
    "isoforest_raw_rows",
    """SELECT count(*) AS n, count(*) FILTER (energy_std IS NULL) AS null_std,
  count(*) FILTER (energy_sum IS NULL) AS null_sum, sum(energy_mean) AS total FROM readings""",
    rounds="total",
)
def isoforest_raw_rows(ws):
    """Detection over raw readings, whose nulls count as zero and stay nulls."""
    detected = anomaly.detect(ws.trained.forest, ws.readings)
    return detected.filter(F.col("anomaly_score").isNotNull()).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("energy_std").isNull()).alias("null_std"),
        F.count_if(F.col("energy_sum").isNull()).alias("null_sum"),
        F.sum("energy_mean").alias("total"),
    )


@query("anomaly_score_histogram")
def anomaly_score_histogram(ws):
    return eda.score_histogram(ws.trained.detected, "anomaly_score")


@query("sensitivity_refit")
def sensitivity_refit(ws):
    """Sensitivity 10 % on one tariff's rows, which refits there."""
    part = eda.eda_filter(ws.features, tariff="ToU")
    detected = anomaly.sensitivity_refit(part, 10, ws.trained.forest)
    return anomaly.anomaly_metrics(detected)


@query("forecast_insights")
def forecast_insights(ws):
    name = ws.trained.best
    model = ws.trained.models[name]
    return reports.insights_report(ws.features, model, name, ws.trained.clusterer)["forecast"]
