"""Household profiles, clustering and cluster reports."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from meterlight.functions import calendar
from meterlight.functions.numeric import (
    annual_kwh,
    cost_gbp,
    monthly_kwh,
    percent_of,
    safe_ratio,
)
from meterlight.operators.clusters import ClusterModel, Silhouette, best_of, fit_all, silhouettes
from meterlight.operators.joins import with_scalar
from meterlight.schema import (
    CLUSTERS,
    DAY,
    ELBOW_RANGE,
    HOUSEHOLD,
    PROFILE_COLUMNS,
    TARGET,
)

# Names of the clusters.
HIGH, LOW, WEEKEND, BALANCED = (
    "High Consumers",
    "Low Consumers",
    "Weekend-Heavy",
    "Balanced",
)
RESTARTS = 10


def household_profile(df: DataFrame) -> DataFrame:
    """One row of consumption statistics per household, from a single aggregation.

    A season or month without readings counts as a mean of zero, provided the whole table
    has readings in it. The exact median per household is bounded by its calendar days.
    """
    y, day = F.col(TARGET), F.col(DAY)
    weekend = calendar.is_weekend(day) == 1

    def mean_where(condition: Column) -> Column:
        return F.avg(F.when(condition, y))

    raw = df.groupBy(HOUSEHOLD).agg(
        F.avg(y).alias("mean_energy"),
        F.stddev_samp(y).alias("std_energy"),
        F.max(y).alias("max_energy"),
        F.min(y).alias("min_energy"),
        F.median(y).alias("median_energy"),
        F.count(y).alias("reading_count"),
        mean_where(weekend).alias("weekend_avg"),
        mean_where(~weekend).alias("weekday_avg"),
        *[mean_where(calendar.season(day) == s).alias(f"season_{s}") for s in range(4)],
        *[mean_where(F.month(day) == m).alias(f"month_{m}") for m in range(1, 13)],
    )
    # Which seasons and months exist anywhere: one bit each, from a scan of the days alone.
    one = F.lit(1)
    bits = F.struct(
        F.bit_or(F.call_function("shiftleft", one, calendar.season(day))).alias("season"),
        F.bit_or(F.call_function("shiftleft", one, F.month(day))).alias("month"),
    )
    seen = with_scalar(raw, df, seen=bits)
    seasons = [F.coalesce(F.col(f"season_{s}"), F.lit(0.0)) for s in range(4)]
    months = [F.coalesce(F.col(f"month_{m}"), F.lit(0.0)) for m in range(1, 13)]

    def present(values: list[Column], bits: str, first: int) -> Column:
        return F.array_compact(
            F.array(
                *[
                    F.when(F.col(bits).bitwiseAND(F.lit(1 << (first + i))) != 0, v)
                    for i, v in enumerate(values)
                ]
            )
        )

    season_means = present(seasons, "seen.season", 0)
    return seen.select(
        HOUSEHOLD,
        "mean_energy",
        F.coalesce("std_energy", F.lit(0.0)).alias("std_energy"),
        "max_energy",
        "min_energy",
        "median_energy",
        "reading_count",
        safe_ratio(F.col("weekend_avg"), F.col("weekday_avg")).alias("weekend_ratio"),
        F.coalesce(_array_std(season_means), F.lit(0.0)).alias("seasonal_variation"),
        F.array_max(season_means).alias("peak_season_energy"),
        F.array_max(present(months, "seen.month", 1)).alias("peak_month_energy"),
    ).na.fill(0)


def _array_std(values: Column) -> Column:
    """Sample standard deviation of an array; null for fewer than two values."""
    n = F.size(values)
    zero = F.lit(0.0)
    mean = F.aggregate(values, zero, lambda a, v: a + v) / n
    squares = F.aggregate(values, zero, lambda a, v: a + (v - mean) * (v - mean))
    return F.when(n > 1, F.sqrt(squares / (n - 1)))


def weekend_weekday(df: DataFrame) -> DataFrame:
    """Weekend and weekday mean and their ratio per household."""
    weekend = calendar.is_weekend(F.col(DAY)) == 1
    means = df.groupBy(HOUSEHOLD).agg(
        F.avg(F.when(weekend, F.col(TARGET))).alias("weekend_avg"),
        F.avg(F.when(~weekend, F.col(TARGET))).alias("weekday_avg"),
    )
    ratio = safe_ratio(F.col("weekend_avg"), F.col("weekday_avg"))
    return means.withColumn("weekend_ratio", ratio)


def cost_projection(profiles: DataFrame) -> DataFrame:
    """Monthly and annual consumption and cost per household, from its daily mean."""
    daily = F.col("mean_energy")
    return profiles.select(
        HOUSEHOLD,
        F.round(daily, 2).alias("avg_daily_kwh"),
        F.round(monthly_kwh(daily), 1).alias("monthly_kwh"),
        F.round(cost_gbp(monthly_kwh(daily)), 2).alias("monthly_cost_gbp"),
        F.round(annual_kwh(daily), 0).alias("annual_kwh"),
        F.round(cost_gbp(annual_kwh(daily)), 0).alias("annual_cost_gbp"),
    )


# Scaling


def scale_parameters(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column; 1 in place of a zero deviation."""
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
    ).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def scaled(columns: list[str], parameters: dict[str, tuple[float, float]]) -> list[Column]:
    return [
        ((F.col(c) - F.lit(parameters[c][0])) / F.lit(parameters[c][1])).alias(c) for c in columns
    ]


def standardize(df: DataFrame, columns: list[str] = PROFILE_COLUMNS) -> DataFrame:
    """Columns as z-scores; a constant column becomes zero."""
    parameters = scale_parameters(df, columns)
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, *scaled(columns, parameters))


def profile_vectors(profiles: DataFrame) -> DataFrame:
    """(household, features) with standardized profile columns."""
    assembler = VectorAssembler(inputCols=PROFILE_COLUMNS, outputCol="features")
    return assembler.transform(standardize(profiles.drop("reading_count"))).select(
        HOUSEHOLD, "features"
    )


# Clustering


def fit_kmeans(
    vectors: DataFrame, k_range=(CLUSTERS,), restarts: int = RESTARTS
) -> dict[int, ClusterModel]:
    """For each number of clusters the best of several seeded starts, all from the same scans."""
    fits = [(k, seed) for k in k_range for seed in range(42, 42 + restarts)]
    return best_of(fit_all(vectors, fits), fits)


def silhouette(clustered: DataFrame) -> Silhouette:
    """Silhouette of plain distances of ``features`` and ``cluster``."""
    table = clustered.select(
        vector_to_array("features").alias("x"), F.array(F.col("cluster").cast("int")).alias("labels")
    )
    return silhouettes(table)[0]


def _assign(model: ClusterModel, vectors: DataFrame) -> DataFrame:
    return model.transform(vectors).withColumnRenamed("prediction", "cluster")


def elbow(
    vectors: DataFrame,
    k_range=ELBOW_RANGE,
    restarts: int = RESTARTS,
    models: dict[int, ClusterModel] | None = None,
) -> DataFrame:
    """Inertia and silhouette (with how far it may be off) per number of clusters."""
    models = models or fit_kmeans(vectors, k_range, restarts)
    x = vector_to_array("features")
    labels = F.array(*[models[k].nearest(x) for k in k_range])
    scores = silhouettes(vectors.select(x.alias("x"), labels.alias("labels")))
    rows = [(k, float(models[k].inertia), s.value, s.bound) for k, s in zip(k_range, scores)]
    return vectors.sparkSession.createDataFrame(
        rows, "k int, inertia double, silhouette double, silhouette_bound double"
    )


def assign_clusters(profiles: DataFrame, vectors: DataFrame, model: ClusterModel) -> DataFrame:
    assigned = _assign(model, vectors).select(HOUSEHOLD, "cluster")
    return profiles.join(assigned, HOUSEHOLD)


def cluster_labels(clustered: DataFrame) -> DataFrame:
    """(cluster, cluster_label): highest and lowest mean, then the most weekend-heavy.

    The windows run over one row per cluster.
    """
    means = clustered.groupBy("cluster").agg(
        F.avg("mean_energy").alias("mean"), F.avg("weekend_ratio").alias("ratio")
    )
    from_low = F.row_number().over(Window.orderBy("mean", "cluster"))
    from_high = F.row_number().over(Window.orderBy(F.desc("mean"), F.desc("cluster")))
    placed = means.withColumns({"is_low": from_low == 1, "is_high": from_high == 1}).withColumn(
        "is_edge", F.col("is_low") | F.col("is_high")
    )
    by_ratio = Window.partitionBy("is_edge").orderBy(F.desc("ratio"), "mean", "cluster")
    label = (
        F.when(F.col("is_low"), LOW)
        .when(F.col("is_high"), HIGH)
        .when(F.row_number().over(by_ratio) == 1, WEEKEND)
        .otherwise(BALANCED)
    )
    return placed.select("cluster", label.alias("cluster_label"))


def label_clusters(clustered: DataFrame) -> DataFrame:
    """Clustered profiles with their label; there are only as many labels as clusters."""
    return clustered.join(F.broadcast(cluster_labels(clustered)), "cluster")


def cluster_summary(labelled: DataFrame) -> DataFrame:
    """Mean profile, household count and label per cluster."""
    return labelled.groupBy("cluster", "cluster_label").agg(
        *[F.avg(c).alias(c) for c in PROFILE_COLUMNS], F.count("*").alias("count")
    )


def all_clusters() -> WindowSpec:
    """The whole of a table with one row per cluster."""
    return Window.partitionBy()


def radar_normalize(summary: DataFrame) -> DataFrame:
    """Summary columns divided by their maximum where that is positive."""

    def share(column: str) -> Column:
        peak = F.max(column).over(all_clusters())
        return F.when(peak > 0, F.col(column) / peak).otherwise(F.col(column))

    return summary.withColumns({c: share(c) for c in PROFILE_COLUMNS})


def cluster_scatter(labelled: DataFrame, x: str = "mean_energy", y: str = "std_energy") -> DataFrame:
    return labelled.select(
        HOUSEHOLD, F.col(x).alias("x"), F.col(y).alias("y"), F.col("cluster").cast("string")
    )


def household_lookup(labelled: DataFrame, household: str) -> DataFrame:
    """Cluster, label and main statistics of one household; empty if unknown."""
    return labelled.filter(F.col(HOUSEHOLD) == household).select(
        HOUSEHOLD,
        "cluster",
        "cluster_label",
        "mean_energy",
        "std_energy",
        "max_energy",
        "min_energy",
        "weekend_ratio",
    )


def cluster_savings(summary: DataFrame, segment: list[str] | None = None) -> DataFrame:
    """What the highest cluster would save at the lowest cluster's mean."""
    row = F.struct("mean_energy", "cluster_label")
    order = F.col("mean_energy")
    first = F.struct(order, -F.col("cluster"))
    ends = summary.groupBy(*(segment or [])).agg(
        F.min_by(row, F.struct(order, F.col("cluster"))).alias("low"),
        F.max_by(row, first).alias("high"),
    )
    low, high = F.col("low.mean_energy"), F.col("high.mean_energy")
    gap = high - low
    return ends.select(
        *(segment or []),
        F.col("low.cluster_label").alias("low_cluster_label"),
        F.col("high.cluster_label").alias("high_cluster_label"),
        F.round(low, 2).alias("low_cluster_avg"),
        F.round(high, 2).alias("high_cluster_avg"),
        F.round(gap, 2).alias("potential_saving_kwh"),
        F.round(percent_of(gap, high), 1).alias("pct_saving"),
        F.round(annual_kwh(gap), 0).alias("annual_saving_kwh"),
        F.round(cost_gbp(annual_kwh(gap)), 0).alias("annual_saving_gbp"),
    )


def cluster_balance(labelled: DataFrame) -> DataFrame:
    """Households and share per cluster; the smallest share is flagged below 5 %."""
    counts = labelled.groupBy("cluster", "cluster_label").agg(F.count("*").alias("households"))
    total = F.sum("households").over(all_clusters())
    smallest = percent_of(F.min("households").over(all_clusters()), total)
    return counts.select(
        "cluster",
        "cluster_label",
        "households",
        percent_of(F.col("households"), total).alias("share_percent"),
        smallest.alias("smallest_share_percent"),
        F.when(smallest < 5, "warning").otherwise("ok").alias("balance_flag"),
    )
