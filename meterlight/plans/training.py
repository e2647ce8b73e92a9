"""Training jobs: all models, their tables and their audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from meterlight.operators import anomaly, audit, eda, forecast, metrics, profiles
from meterlight.schema import CLUSTERS, CONTAMINATION, ELBOW_RANGE, TEST_DAYS
from meterlight.session import materialize
from meterlight.sources import model_store, sinks
from meterlight.sources.model_store import Clusterer


@dataclass(frozen=True)
class Trained:
    """Everything a training run leaves behind."""

    models: dict[str, forecast.TreeModel]
    leaderboard: DataFrame
    best: str
    clusterer: Clusterer
    elbow: DataFrame
    forest: anomaly.Forest
    detected: DataFrame


def train_clusterer(
    features: DataFrame,
    k: int = CLUSTERS,
    k_range=(),
    restarts: int = profiles.RESTARTS,
) -> tuple[Clusterer, DataFrame]:
    """Labelled profiles with their model, and the elbow table of ``k_range`` from the same scans."""
    table = materialize(profiles.household_profile(features), "profiles")
    vectors = materialize(profiles.profile_vectors(table), "profile-vectors")
    models = profiles.fit_kmeans(vectors, sorted({k, *k_range}), restarts)
    clustered = profiles.assign_clusters(table, vectors, models[k])
    labelled = materialize(profiles.label_clusters(clustered), "clusters")
    return Clusterer(models[k], labelled), profiles.elbow(vectors, k_range, restarts, models)


def train_all(
    features: DataFrame,
    settings: dict[str, forecast.ModelSettings] = forecast.MODELS,
    k_range=ELBOW_RANGE,
    restarts: int = profiles.RESTARTS,
    contamination: float = CONTAMINATION,
    test_days: int = TEST_DAYS,
) -> Trained:
    train, test = eda.time_split(features, test_days)
    board, models = forecast.compare_models(train, test, settings)
    board = materialize(board, "leaderboard")
    clusterer, elbow = train_clusterer(features, k_range=k_range, restarts=restarts)
    forest, detected = anomaly.fit_detect(features, contamination, anomaly.REPORT_COLUMNS)
    best = metrics.best_model(board).first()["best_model"]
    return Trained(models, board, best, clusterer, elbow, forest, detected)


def save_all(trained: Trained, folder: str) -> str:
    """Models, leaderboard, elbow table and the best model's name under one folder."""
    for name, model in trained.models.items():
        model_store.save_forecaster(model, f"{folder}/forecaster_{name}")
    model_store.save_clusterer(trained.clusterer, f"{folder}/clusterer")
    anomaly.save_forest(trained.forest, f"{folder}/anomaly_detector")
    sinks.write_csv(trained.leaderboard, f"{folder}/model_comparison")
    sinks.write_csv(trained.elbow, f"{folder}/elbow_data")
    spark = trained.leaderboard.sparkSession
    sinks.write_text_line(spark, trained.best, f"{folder}/best_model")
    return folder


def tune(
    features: DataFrame,
    grids: dict[str, dict[str, list]] = forecast.TUNING_GRIDS,
    picks: int = 3,
    percent: int = 10,
) -> DataFrame:
    """Tuning on a row sample of the chronological split."""
    train, test = (eda.row_sample(part, percent) for part in eda.time_split(features))
    return forecast.tune_models(eda.train_val_stack(train, test), grids, picks)


def audit_all(features: DataFrame, trained: Trained) -> dict[str, DataFrame]:
    """The audit report, one table per section."""
    _, test = eda.time_split(features)
    marked = eda.marked_split(features)
    best = forecast.predict(trained.models[trained.best], test)
    rows = [
        forecast.predict(model, marked).selectExpr(
            f"'{name}' AS Model", "split", "energy_sum", "prediction"
        )
        for name, model in trained.models.items()
    ]
    overfit = rows[0]
    for part in rows[1:]:
        overfit = overfit.unionByName(part)
    vectors = profiles.profile_vectors(
        trained.clusterer.labelled.drop("cluster", "cluster_label")
    )
    return {
        "shape": audit.audit_shape(features),
        "target": audit.audit_target(features),
        "low_cardinality": audit.audit_low_cardinality(features),
        "high_correlation": audit.audit_high_corr(features),
        "zero_share": audit.audit_zero_share(features),
        "leakage": audit.audit_leakage(features),
        "split_shift": audit.audit_split_shift(features),
        "overfit": audit.audit_overfit(overfit),
        "small_actuals": audit.audit_small_actuals(test),
        "trimmed_mape": metrics.trimmed_mape(best),
        "residuals": audit.audit_residuals(best),
        "anomaly_rate": anomaly.share_flagged(
            trained.detected, trained.forest.contamination
        ),
        "clusters": audit.audit_clusters(trained.clusterer.labelled, vectors),
    }
