"""Regression metrics over (actual, predicted) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlight.functions.numeric import share_percent
from meterlight.schema import TARGET

# Fixed value: actuals up to this many kWh are left out of the trimmed percentage error.
TRIM_ABOVE = 1.0
METRICS = ["MAE", "RMSE", "MAPE", "R2"]


def _percentage_error(y: Column, p: Column, where: Column) -> Column:
    """Mean absolute percentage error over the rows in ``where``; null if there are none."""
    return F.avg(F.when(where, F.abs(F.try_divide(y - p, y)))) * 100


def metric_columns(
    actual: str | Column = TARGET, predicted: str | Column = "prediction"
) -> dict[str, Column]:
    """MAE, RMSE, MAPE and R2 as aggregates of one pass.

    The total sum of squares comes from Spark's running variance, which keeps the centred
    sum, so no second pass for the mean is needed.
    """
    y = F.col(actual) if isinstance(actual, str) else actual
    p = F.col(predicted) if isinstance(predicted, str) else predicted
    residual = F.sum((y - p) * (y - p))
    total = F.var_pop(y) * F.count(y)
    return {
        "MAE": F.avg(F.abs(y - p)),
        "RMSE": F.sqrt(F.avg((y - p) * (y - p))),
        "MAPE": F.coalesce(_percentage_error(y, p, y != 0), F.lit(0.0)),
        "R2": F.when(total == 0, 0.0).otherwise(1 - F.try_divide(residual, total)),
    }


def trimmed_mape_column(
    actual: str = TARGET, predicted: str = "prediction", above: float = TRIM_ABOVE
) -> Column:
    """MAPE over the larger actuals; plain MAPE when there are none."""
    y, p = F.col(actual), F.col(predicted)
    return F.coalesce(
        _percentage_error(y, p, y > above), _percentage_error(y, p, y != 0), F.lit(0.0)
    )


def regression_metrics(
    predictions: DataFrame,
    keys: list[str] | None = None,
    actual: str = TARGET,
    predicted: str = "prediction",
) -> DataFrame:
    measures = metric_columns(actual, predicted)
    return predictions.groupBy(*(keys or [])).agg(
        *[c.alias(name) for name, c in measures.items()]
    )


def trimmed_mape(
    predictions: DataFrame, actual: str = TARGET, predicted: str = "prediction"
) -> DataFrame:
    mape = metric_columns(actual, predicted)["MAPE"]
    return predictions.agg(
        mape.alias("MAPE"),
        trimmed_mape_column(actual, predicted).alias("trimmed_mape"),
        share_percent(F.col(actual) > TRIM_ABOVE).alias("kept_percent"),
    )


def long_predictions(df: DataFrame, predictors: dict[str, str], keep: list[str]) -> DataFrame:
    """One row per model and input row, from columns that each hold a model's prediction."""
    models = F.array(
        *[F.struct(F.lit(m).alias("Model"), F.col(c).alias("prediction"))
          for m, c in predictors.items()]
    )
    return df.select(*keep, F.inline(models))


def leaderboard_long(leaderboard: DataFrame) -> DataFrame:
    """Leaderboard melted to (Model, metric, value)."""
    return leaderboard.unpivot(["Model"], METRICS, "metric", "value")


def best_model(leaderboard: DataFrame) -> DataFrame:
    """Model with the smallest RMSE; ties go to the first name."""
    best = F.min_by("Model", F.struct("RMSE", "Model"))
    return leaderboard.agg(best.alias("best_model"), F.min("RMSE").alias("RMSE"))
