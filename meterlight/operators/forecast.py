"""Forecasting: training, prediction, comparison and tuning of tree ensembles.

Ensembles are grown by ``operators.trees`` over one stored, pre-binned table: boosted models together in stages, forests
beside them.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlight.functions.numeric import cost_gbp, monthly_kwh
from meterlight.operators import trees
from meterlight.operators.metrics import (
    METRICS,
    metric_columns,
    regression_metrics,
    trimmed_mape_column,
)
from meterlight.operators.trees import TreeModel
from meterlight.operators.trees import TreeSettings as ModelSettings
from meterlight.schema import DAY, TARGET, feature_columns
from meterlight.session import materialize, shared_folder

#: Jobs of independent models at the same time.
SIDE_BY_SIDE = 4


# The published parameters of the three models, and what their libraries take where nothing is given
# (an L2 penalty of 1 in one, growth to 31 leaves in the other).
MODELS = {
    "gbt_a": ModelSettings(True, 500, 6, 5, 0.05, 0.8, 0.8, l2=1.0),
    "gbt_b": ModelSettings(True, 500, 6, 20, 0.05, 0.8, 0.8, leaves=31),
    "random_forest": ModelSettings(False, 300, 12, 5, min_split=10),
}

# The grids searched when tuning.
_BOOSTED_GRID = {
    "trees": [100, 200, 300],
    "depth": [4, 6, 8],
    "learning_rate": [0.03, 0.07, 0.15],
    "row_share": [0.7, 0.9],
    "column_share": [0.7, 0.9],
}
TUNING_GRIDS = {
    "gbt_a": _BOOSTED_GRID,
    "gbt_b": _BOOSTED_GRID,
    "random_forest": {
        "trees": [50, 100, 150],
        "depth": [8, 12, 16],
        "min_split": [5, 10],
        "min_leaf": [2, 5],
    },
}


def settings_for(name: str, **changes) -> ModelSettings:
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; choose from {list(MODELS)}")
    return replace(MODELS[name], **changes)


def _side_by_side(jobs: dict[str, Callable], spark, most: int = SIDE_BY_SIDE) -> dict[str, object]:
    """Results of independent jobs, ``most`` at a time, each in a scheduler pool of its own."""

    def run(name: str, job: Callable):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        return job()

    with ThreadPoolExecutor(most) as threads:
        started = {name: threads.submit(run, name, job) for name, job in jobs.items()}
        return {name: job.result() for name, job in started.items()}


def _fitted(binned: trees.Binned, settings: dict[str, ModelSettings]) -> dict[str, TreeModel]:
    """The boosted models together in stages, the forests beside them, or after them where either takes all slots."""
    boosted = {n: s for n, s in settings.items() if s.boosted}
    jobs: dict[str, Callable] = {"": lambda: trees.fit_boosted(binned, boosted)} if boosted else {}
    jobs |= {n: lambda s=s: trees.fit_forest(binned, s) for n, s in settings.items() if not s.boosted}
    done = _side_by_side(jobs, binned.table.sparkSession, 1 if trees.is_spread(binned) else SIDE_BY_SIDE)
    models = done.pop("", {}) | done
    return {name: models[name] for name in settings}


def train_many(
    df: DataFrame, settings: dict[str, ModelSettings], features: list[str] | None = None
) -> dict[str, TreeModel]:
    shared_folder(df.sparkSession)
    return _fitted(trees.bin_table(df, features or feature_columns(df)), settings)


def train(df: DataFrame, settings: ModelSettings, features: list[str] | None = None) -> TreeModel:
    """One fitted model; it keeps its feature order."""
    return train_many(df, {"model": settings}, features)["model"]


def model_features(model: TreeModel) -> list[str]:
    return model.features


def fill_missing_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Features absent from the table are added as zero."""
    return df.withColumns({c: F.lit(0.0) for c in features if c not in df.columns})


def project_features(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Keys and target, then the features in the model's order."""
    padded = fill_missing_features(df, features)
    return padded.select(*keep, *[F.col(c).cast("double").alias(c) for c in features])


def predict(model: TreeModel | None, df: DataFrame) -> DataFrame:
    if model is None:
        raise RuntimeError("the model has not been trained")
    padded = fill_missing_features(df, model_features(model))
    return model.transform(padded)


def feature_importance(model: TreeModel, spark) -> DataFrame:
    rows = [(n, float(v)) for n, v in zip(model_features(model), model.importances())]
    return spark.createDataFrame(rows, "feature string, importance double")


def top_feature_importance(importance: DataFrame, n: int = 15) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def compare_models(
    train_df: DataFrame, test_df: DataFrame, settings: dict[str, ModelSettings] = MODELS
) -> tuple[DataFrame, dict[str, TreeModel]]:
    """Train every model; leaderboard of test metrics and the fitted models."""
    models = train_many(train_df, settings)
    parts = [
        regression_metrics(predict(model, test_df)).select(F.lit(name).alias("Model"), *METRICS)
        for name, model in models.items()
    ]
    board = parts[0]
    for part in parts[1:]:
        board = board.unionByName(part)
    return board, models


def actual_vs_predicted(predictions: DataFrame) -> DataFrame:
    return predictions.select(
        DAY, F.col(TARGET).alias("actual"), F.col("prediction").alias("predicted")
    )


def all_metrics(predictions: DataFrame) -> DataFrame:
    """The four metrics and the trimmed percentage error in one row."""
    measures = {**metric_columns(), "trimmed_mape": trimmed_mape_column()}
    return predictions.agg(*[c.alias(name) for name, c in measures.items()])


def forecast_insights(predictions: DataFrame, model_name: str | Column) -> DataFrame:
    """Mean prediction over the given rows, scaled to a month and its cost."""
    name = F.lit(model_name) if isinstance(model_name, str) else model_name
    mean = F.avg("prediction")
    return predictions.agg(
        F.round(mean, 2).alias("avg_daily_predicted"),
        F.round(monthly_kwh(mean), 1).alias("estimated_monthly_kwh"),
        F.round(cost_gbp(monthly_kwh(mean)), 2).alias("estimated_monthly_cost_gbp"),
    ).withColumn("model_type", name)


def grid_picks(grid: dict[str, list], picks: int, seed: int = 42) -> list[dict]:
    """A seeded choice of distinct grid points."""
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    return random.Random(seed).sample(points, min(picks, len(points)))


def _errors(models: dict[str, TreeModel], checked: DataFrame) -> dict[str, float]:
    """Validation error of many models over the same features, from one pass."""
    scored = checked.select(TARGET, trees.predictions(list(models.values()), checked.sparkSession).alias("all"))
    found = scored.agg(
        *[metric_columns(predicted=F.col("all")[i])["MAE"].alias(f"e{i}") for i in range(len(models))]
    ).first()
    return dict(zip(models, found))


def _halved(binned: trees.Binned, checked: DataFrame, points: dict[str, ModelSettings]) -> dict[str, float]:
    """Errors of boosted points that grow by a quarter of their trees at a time.

    After each quarter the worse half of the points left of each model (told by the name before '/') stops; its
    error is the last one. That saves most of the work but may miss a point that comes from behind.
    """
    errors: dict[str, float] = {}
    left, models = dict(points), {}
    for quarter in range(1, 5):
        rung = {n: replace(s, trees=max(1, s.trees * quarter // 4)) for n, s in left.items()}
        models = trees.fit_boosted(binned, rung, so_far={n: models[n].trees for n in rung if n in models})
        errors |= _errors(models, checked)
        for model in {n.split("/")[0] for n in left} if quarter < 4 else ():
            own = sorted((n for n in left if n.split("/")[0] == model), key=lambda n: errors[n])
            for loser in own[max(1, -(-len(own) // 2)) :]:
                del left[loser]
    return errors


def tune_models(
    folds: DataFrame,
    grids: dict[str, dict[str, list]] = TUNING_GRIDS,
    picks: int = 3,
    seed: int = 42,
    halving: bool = False,
) -> DataFrame:
    """Validation error of random grid points per model, on a fixed train/validation split.

    ``folds`` carries the marker of ``train_val_stack``. The best point of each model has
    ``best`` set. All points share one binned table and are grown side by side; ``halving`` stops
    losing boosted points early.
    """
    fit_part = folds.filter("fold = -1").drop("fold")
    features = feature_columns(fit_part)
    checked = materialize(folds.filter("fold = 0").select(TARGET, *features), "validation")
    points = {
        f"{name}/{i}": (name, point, settings_for(name, **point))
        for name, grid in grids.items()
        for i, point in enumerate(grid_picks(grid, picks, seed))
    }
    binned = trees.bin_table(fit_part, features)
    every = {key: s for key, (_, _, s) in points.items()}
    early = {key: s for key, s in every.items() if halving and s.boosted}
    models = _fitted(binned, {key: s for key, s in every.items() if key not in early})
    errors = (_errors(models, checked) if models else {}) | (_halved(binned, checked, early) if early else {})
    least = {name: min(errors[k] for k, (n, _, _) in points.items() if n == name) for name in grids}
    rows = [
        (name, ", ".join(f"{k}={v}" for k, v in point.items()), errors[key], errors[key] == least[name])
        for key, (name, point, _) in points.items()
    ]
    return folds.sparkSession.createDataFrame(
        rows, "Model string, parameters string, validation_mae double, best boolean"
    )
