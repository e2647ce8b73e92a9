"""Saving and loading fitted models on the shared store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from meterlight.operators.clusters import ClusterModel
from meterlight.operators.trees import TreeModel


@dataclass(frozen=True)
class Clusterer:
    """Fitted clusters with the labelled profiles they were fitted on."""

    model: ClusterModel
    labelled: DataFrame


def save_forecaster(model: TreeModel, path: str) -> str:
    return model.save(SparkSession.active(), path)


def load_forecaster(path: str) -> TreeModel:
    return TreeModel.load(SparkSession.active(), path)


def save_clusterer(clusterer: Clusterer, path: str) -> str:
    clusterer.model.save(clusterer.labelled.sparkSession, f"{path}/kmeans")
    clusterer.labelled.write.mode("overwrite").parquet(f"{path}/profiles")
    return path


def load_clusterer(spark: SparkSession, path: str) -> Clusterer:
    return Clusterer(
        ClusterModel.load(spark, f"{path}/kmeans"), spark.read.parquet(f"{path}/profiles")
    )
