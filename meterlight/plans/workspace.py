"""Stored tables shared by the queries of one session.

The raw tables, the feature table and the fitted models are built once per source folder
and written to the shared folder; queries read the stored tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlight.operators import eda, profiles, retrieval
from meterlight.plans.panel import Panel, build_panel
from meterlight.plans.training import Trained, save_all, train_all
from meterlight.schema import HOUSEHOLD, TARGET, lag_column
from meterlight.session import materialize, new_path, shuffle_partitions
from meterlight.sources import layout, sinks, testbed
from meterlight.sources.bucketed import buckets_for
from meterlight.sources.readers import document_table, scan_table

_open: dict[tuple[str, str], "Workspace"] = {}


class Workspace:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    @cached_property
    def readings(self) -> DataFrame:
        lines = scan_table(self.spark, self.folder, "lineitem").count()
        with shuffle_partitions(self.spark, buckets_for(self.spark, lines)):
            return materialize(testbed.readings(self.spark, self.folder), "readings")

    @cached_property
    def households(self) -> DataFrame:
        return materialize(testbed.households(self.spark, self.folder), "households")

    @cached_property
    def weather(self) -> DataFrame:
        return materialize(testbed.weather(self.spark, self.folder), "weather")

    @cached_property
    def holidays(self) -> DataFrame:
        return materialize(testbed.holidays(self.readings), "holidays")

    @cached_property
    def panel(self) -> Panel:
        return build_panel(self.readings, self.households, self.weather, self.holidays)

    @property
    def cleaned(self) -> DataFrame:
        return self.panel.cleaned

    @property
    def features(self) -> DataFrame:
        return self.panel.features

    @cached_property
    def laid_out(self) -> layout.PanelLayout:
        """The feature table along a curve over households and days."""
        return layout.write_layout(self.features, new_path(self.spark, "layout"))

    @cached_property
    def raw_files(self) -> dict[str, str]:
        """The raw tables as CSV files, keyed by table name."""
        tables = {
            "readings": (testbed.raw_readings(self.readings), "UTF-8"),
            "weather": (testbed.raw_weather(self.weather), "UTF-8"),
            "households": (testbed.raw_households(self.households), "UTF-8"),
            "holidays": (testbed.raw_holidays(self.holidays), "UTF-8"),
            "acorn_details": (testbed.raw_acorn_details(self.spark, self.folder), "ISO-8859-1"),
        }
        return {
            name: sinks.write_csv(table, new_path(self.spark, f"{name}-csv"), encoding)
            for name, (table, encoding) in tables.items()
        }

    @cached_property
    def profiles(self) -> DataFrame:
        return materialize(profiles.household_profile(self.features), "profiles")

    @cached_property
    def bucketed(self) -> DataFrame:
        """Profiles with a fixed cluster number from the household id, labelled."""
        number = F.substring(HOUSEHOLD, 4, 6).cast("int") % 4
        clustered = self.profiles.withColumn("cluster", number)
        return materialize(profiles.label_clusters(clustered), "bucketed")

    @cached_property
    def naive(self) -> DataFrame:
        """Test rows with last week's value as the prediction."""
        test = eda.time_split(self.features)[1]
        return test.withColumn("prediction", F.col(lag_column(7)))

    @cached_property
    def flagged(self) -> DataFrame:
        """Feature rows with a fixed-threshold anomaly score."""
        score = (60 - F.col(TARGET)) / 60
        return self.features.withColumn("anomaly_score", score).withColumn(
            "is_anomaly", F.col("anomaly_score") < 0
        )

    @cached_property
    def trained(self) -> Trained:
        """All models, in their published sizes."""
        return train_all(self.features)

    @cached_property
    def saved(self) -> str:
        return save_all(self.trained, new_path(self.spark, "models"))

    @cached_property
    def documents(self) -> DataFrame:
        return document_table(scan_table(self.spark, self.folder, "documents"))

    @cached_property
    def chunks(self) -> DataFrame:
        return materialize(retrieval.chunk_text(self.documents), "chunks")

    @cached_property
    def questions(self) -> DataFrame:
        items = scan_table(self.spark, self.folder, "benchmark")
        return items.select(
            F.col("item_id").alias("question_id"),
            F.col("text").alias("question"),
            F.col("item_id").alias("conv_id"),
        )

    @cached_property
    def retrieved(self) -> DataFrame:
        return materialize(retrieval.retrieve(self.chunks, self.questions), "retrieved")

    @cached_property
    def messages(self) -> DataFrame:
        return scan_table(self.spark, self.folder, "conversations")


def workspace(spark: SparkSession, folder: str) -> Workspace:
    """The session's workspace for a source folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _open or _open[key].spark is not spark:
        _open[key] = Workspace(spark, folder)
    return _open[key]
