"""Isolation-forest anomaly detection and its reports.

Fitting draws at most ``sample_size`` rows per tree by hash, so one tree's group is small
whatever the table's size or skew; trees grow in parallel. The fitted forest has a fixed
maximum number of nodes and travels to the executors as a broadcast. Scoring is a
vectorised function over the eight input columns; all other columns stay in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlight.functions import calendar, isolation
from meterlight.functions.numeric import percent_of
from meterlight.functions.quantiles import exact_quantiles
from meterlight.operators.profiles import scale_parameters, scaled
from meterlight.schema import CONTAMINATION, DAY, HOUSEHOLD, TARGET
from meterlight.session import materialize

# Forest size and inputs.
TREES = 200
SAMPLE_SIZE = 256
SEED = 42
ENERGY_INPUTS = ["energy_sum", "energy_mean", "energy_max", "energy_std", "energy_min"]
CALENDAR_INPUTS = {
    "day_of_week": calendar.day_of_week,
    "month": F.month,
    "is_weekend": calendar.is_weekend,
}
# What the reports over detected rows look at.
REPORT_COLUMNS = [HOUSEHOLD, DAY, TARGET, "energy_mean", "energy_max"]
# Draw somewhat more rows than a tree needs, then keep exactly the sample size.
SURPLUS = 1.3
_HASH_RANGE = 1 << 40


@dataclass(frozen=True)
class Forest:
    """Fitted forest; ``offset`` is the raw score below which a row is flagged."""

    nodes: DataFrame
    inputs: tuple[str, ...]
    scaling: dict[str, tuple[float, float]]
    trees: int
    sample_size: int
    contamination: float
    offset: float | None = None


def anomaly_features(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Inputs of the forest: same-day energy and calendar columns, nulls as zero."""
    if DAY in df.columns:
        parts = {c: f(F.col(DAY)) for c, f in CALENDAR_INPUTS.items() if c not in df.columns}
        df = df.withColumns(parts)
    inputs = [c for c in [*ENERGY_INPUTS, *CALENDAR_INPUTS] if c in df.columns]
    kept = [c for c in (keep or []) if c not in inputs]
    return df.select(*kept, *inputs).na.fill(0, inputs)


def _draw(seed: int, *parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(_HASH_RANGE))


def tree_samples(
    df: DataFrame, inputs: list[str], rows: int, trees: int, sample_size: int, seed: int
) -> DataFrame:
    """At most ``sample_size`` rows for each tree, without replacement.

    A hash decides how many trees a row is offered to, on average as many as fill all trees'
    wishes, and another which ones: steps of a length without a common divisor with the
    number of trees, so no tree gets a row twice.
    """
    row_key = [c for c in (HOUSEHOLD, DAY) if c in df.columns] or inputs
    key = [F.col(c) for c in row_key]
    rate = min(float(trees), trees * SURPLUS * sample_size / rows)
    copies = int(rate) + (_draw(seed, *key) < int(_HASH_RANGE * (rate % 1.0))).cast("int")
    strides = F.array(*[F.lit(s) for s in range(1, trees + 1) if math.gcd(s, trees) == 1])
    stride = strides[F.pmod(_draw(seed + 1, *key), F.size(strides)).cast("int")]
    first = F.pmod(_draw(seed + 2, *key), F.lit(trees))
    offered = (
        df.withColumn("copies", copies)
        .filter("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .withColumn("tree", F.pmod(first + F.col("copy") * stride, F.lit(trees)).cast("int"))
        .withColumn("draw", _draw(seed + 3, F.col("tree"), *key))
    )
    by_draw = Window.partitionBy("tree").orderBy("draw", *inputs)
    return (
        offered.select("tree", "draw", *inputs)
        .withColumn("rank", F.row_number().over(by_draw))
        .filter(F.col("rank") <= sample_size)
        .drop("rank")
    )


def fit_forest(
    df: DataFrame,
    contamination: float = CONTAMINATION,
    trees: int = TREES,
    sample_size: int = SAMPLE_SIZE,
    seed: int = SEED,
) -> Forest:
    """Grow the trees. The flagging offset is set by ``calibrate`` from the scored rows."""
    keys = [c for c in (HOUSEHOLD, DAY) if c in df.columns]
    data = anomaly_features(df, keys)
    inputs = [c for c in data.columns if c not in keys]
    rows = data.count()
    if rows == 0:
        raise ValueError("no rows to fit")
    scaling = scale_parameters(data, inputs)
    sample_size = min(sample_size, rows)
    points = data.select(*keys, *scaled(inputs, scaling))
    samples = tree_samples(points, inputs, rows, trees, sample_size, seed)
    grow_tree, limit = isolation.grow_tree, isolation.depth_limit(sample_size)

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        return grow_tree(rows, inputs, limit, seed)

    grown = samples.groupBy("tree").applyInPandas(grow, isolation.NODE_SCHEMA)
    nodes = materialize(grown, "forest")
    return Forest(nodes, tuple(inputs), scaling, trees, sample_size, contamination)


def _nodes(forest: Forest) -> dict:
    """The forest on the driver; its size is bounded by its parameters and checked."""
    most = forest.trees * (2 * forest.sample_size - 1)
    table = forest.nodes.limit(most + 1).toPandas()
    if len(table) > most:
        raise ValueError("more nodes than the forest's parameters allow")
    return isolation.flat_forest(table, forest.sample_size)


def raw_score(forest: Forest, spark: SparkSession, values: dict[str, Column]) -> Column:
    """Column expression over the forest's (unscaled) inputs; nulls count as zero."""
    shared = spark.sparkContext.broadcast(_nodes(forest))
    score_batches = isolation.score_batches

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        points = (np.column_stack([c.to_numpy(dtype="float64") for c in columns]) for columns in batches)
        yield from map(pd.Series, score_batches(shared.value, points))

    filled = {c: F.coalesce(values[c].cast("double"), F.lit(0.0)) for c in forest.inputs}
    center, spread = zip(*(forest.scaling[c] for c in forest.inputs))
    return score(
        *[(filled[c] - F.lit(m)) / F.lit(w) for c, m, w in zip(forest.inputs, center, spread)]
    )


def with_raw_score(forest: Forest, df: DataFrame) -> DataFrame:
    """All columns of ``df`` as they are, and the raw score, for which nulls count as zero."""
    values = {c: F.col(c) if c in df.columns else CALENDAR_INPUTS[c](F.col(DAY)) for c in forest.inputs}
    return df.withColumn("raw_score", raw_score(forest, df.sparkSession, values))


def calibrate(forest: Forest, scored: DataFrame, contamination: float | None = None) -> Forest:
    """Offset at the contamination quantile of the fitted rows' raw scores."""
    share = forest.contamination if contamination is None else contamination
    offset = exact_quantiles(scored, "raw_score", [share])[0][0]
    return replace(forest, contamination=share, offset=offset)


def flagged(forest: Forest, scored: DataFrame) -> DataFrame:
    if forest.offset is None:
        raise RuntimeError("the detector has not been calibrated")
    score = F.col("raw_score") - F.lit(forest.offset)
    return (
        scored.withColumn("anomaly_score", score)
        .withColumn("is_anomaly", F.col("anomaly_score") < 0)
        .drop("raw_score")
    )


def detect(forest: Forest, df: DataFrame) -> DataFrame:
    """``df`` with ``anomaly_score`` (lower is stranger) and ``is_anomaly``."""
    return flagged(forest, with_raw_score(forest, df))


def fit_detect(
    df: DataFrame,
    contamination: float = CONTAMINATION,
    keep: list[str] | None = None,
    **options,
) -> tuple[Forest, DataFrame]:
    """Fit on a table and flag its rows; the scores are computed and stored once.

    ``keep`` names the columns stored beside the scores; reports need only a few.
    """
    forest = fit_forest(df, contamination, **options)
    scored = with_raw_score(forest, df)
    if keep is not None:
        scored = scored.select(*keep, "raw_score")
    scored = materialize(scored, "scores")
    forest = calibrate(forest, scored)
    return forest, flagged(forest, scored)


def sensitivity_refit(
    df: DataFrame, sensitivity: int, stored: Forest, **options
) -> DataFrame:
    """Flags at a sensitivity in percent.

    The stored detector serves its own contamination; any other is fitted on the given
    slice.
    """
    contamination = sensitivity / 100
    if contamination == stored.contamination:
        return detect(stored, df)
    return fit_detect(df, contamination, REPORT_COLUMNS, **options)[1]


# Reports over detected rows


def _energy_where(condition: Column, aggregate=F.avg) -> Column:
    return aggregate(F.when(condition, F.col(TARGET)))


def anomaly_metrics(detected: DataFrame) -> DataFrame:
    """Counts, rate and mean energy of anomalous and normal rows, and the shift."""
    odd = F.col("is_anomaly")
    zero = F.lit(0.0)
    facts = detected.agg(
        F.count("*").alias("total_records"),
        F.count_if(odd).alias("anomalies_found"),
        F.coalesce(_energy_where(odd), zero).alias("odd"),
        _energy_where(~odd).alias("usual"),
    )
    rate = percent_of(F.col("anomalies_found"), F.col("total_records"))
    shift = percent_of(F.col("odd") - F.col("usual"), F.col("usual"))
    return facts.select(
        "total_records",
        "anomalies_found",
        F.round(F.coalesce(rate, zero), 2).alias("anomaly_rate"),
        F.round("odd", 2).alias("avg_anomaly_energy"),
        F.round("usual", 2).alias("avg_normal_energy"),
        F.round(shift, 2).alias("shift_percent"),
    )


def anomaly_daily(detected: DataFrame) -> DataFrame:
    return detected.groupBy(DAY).agg(
        F.avg(TARGET).alias("mean_energy"), F.bool_or("is_anomaly").alias("is_anomaly")
    )


def anomaly_timeline(detected: DataFrame, household: str | None = None) -> DataFrame:
    """Daily means with a flag; for one household its own rows and flags."""
    if household is None:
        return anomaly_daily(detected)
    return detected.filter(F.col(HOUSEHOLD) == household).select(
        DAY, F.col(TARGET).alias("mean_energy"), "is_anomaly"
    )


def top_anomalies(detected: DataFrame, n: int = 100) -> DataFrame:
    wanted = [c for c in REPORT_COLUMNS if c != DAY] + ["anomaly_score"]
    return (
        detected.filter("is_anomaly")
        .orderBy("anomaly_score", HOUSEHOLD, DAY)
        .limit(n)
        .select(
            calendar.iso_label(F.col(DAY)).alias(DAY),
            *[c for c in wanted if c in detected.columns],
        )
    )


def anomaly_summary(detected: DataFrame) -> DataFrame:
    """Totals and the household with the most anomalies (ties: smallest id).

    Rows are first reduced to one partial row per household.
    """
    odd = F.col("is_anomaly")
    per_household = detected.groupBy(HOUSEHOLD).agg(
        F.count("*").alias("rows"),
        F.count_if(odd).alias("odd"),
        _energy_where(odd, F.sum).alias("odd_energy"),
        _energy_where(odd, F.max).alias("odd_max"),
        _energy_where(~odd, F.sum).alias("usual_energy"),
    )
    total, found = F.sum("rows"), F.sum("odd")
    zero = F.lit(0.0)
    has_odd = F.col("odd") > 0
    return per_household.agg(
        total.alias("total_records"),
        found.alias("total_anomalies"),
        percent_of(found, total).alias("anomaly_percentage"),
        F.coalesce(F.try_divide(F.sum("odd_energy"), found), zero).alias("avg_anomaly_energy"),
        F.coalesce(F.try_divide(F.sum("usual_energy"), total - found), zero).alias(
            "avg_normal_energy"
        ),
        F.coalesce(F.max("odd_max"), zero).alias("max_anomaly_energy"),
        F.count_if(has_odd).alias("households_with_anomalies"),
        F.max("odd").alias("max_anomalies_single_household"),
        F.min_by(
            F.when(has_odd, F.col(HOUSEHOLD)), F.struct(-F.col("odd"), HOUSEHOLD)
        ).alias("top_anomaly_household"),
    )


def anomaly_calendar_counts(detected: DataFrame) -> DataFrame:
    """Anomalies per month and per weekday name, as (part, item, anomalies)."""
    day = F.col(DAY)
    items = F.array(
        F.struct(F.lit("month").alias("part"), F.month(day).cast("string").alias("item")),
        F.struct(F.lit("weekday").alias("part"), calendar.weekday_label(day).alias("item")),
    )
    return (
        detected.filter("is_anomaly")
        .groupBy(DAY)
        .agg(F.count("*").alias("n"))
        .select("n", F.inline(items))
        .groupBy("part", "item")
        .agg(F.sum("n").alias("anomalies"))
    )


def share_flagged(detected: DataFrame, contamination: float) -> DataFrame:
    """Flagged share against the contamination asked for."""
    facts = detected.agg(
        (F.avg(F.col("is_anomaly").cast("double")) * 100).alias("anomaly_rate"),
        _energy_where(~F.col("is_anomaly")).alias("normal_mean"),
        _energy_where(F.col("is_anomaly")).alias("anomaly_mean"),
    )
    expected = F.lit(contamination * 100)
    off = F.abs(F.col("anomaly_rate") - expected) > 2
    return facts.select(
        "anomaly_rate",
        expected.alias("expected_rate"),
        F.when(off, "warning").otherwise("ok").alias("rate_flag"),
        "normal_mean",
        "anomaly_mean",
        F.try_divide("anomaly_mean", "normal_mean").alias("energy_ratio"),
    )


# Persistence


def save_forest(forest: Forest, path: str) -> str:
    spark = forest.nodes.sparkSession
    forest.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    parameters = [
        (i, c, *forest.scaling[c], forest.trees, forest.sample_size, forest.contamination,
         forest.offset)
        for i, c in enumerate(forest.inputs)
    ]
    schema = (
        "position int, input string, mean double, deviation double, trees int, "
        "sample_size int, contamination double, offset double"
    )
    spark.createDataFrame(parameters, schema).write.mode("overwrite").parquet(
        f"{path}/parameters"
    )
    return path


def load_forest(spark: SparkSession, path: str) -> Forest:
    rows = spark.read.parquet(f"{path}/parameters").orderBy("position").collect()
    one = rows[0]
    return Forest(
        spark.read.parquet(f"{path}/nodes"),
        tuple(r.input for r in rows),
        {r.input: (r.mean, r.deviation) for r in rows},
        one.trees,
        one.sample_size,
        one.contamination,
        one.offset,
    )
