"""K-means from many starts at once, and the silhouette of plain distances.

All starts of all numbers of clusters advance in one scan an iteration: a task puts each row to its nearest centre of
every fit and sums rows by centre, and one aggregate with a row for each centre brings the sums together. Fits whose
centres stand still drop out. Starts are drawn by k-means++ from at most SEED_ROWS rows.

The mean distance from a row to a cluster is bounded by the cluster's micro-clusters (number, centroid and mean squared
distance to it, V): to the rows of one, it lies between d and sqrt(d^2 + V), where d is the distance to the centroid,
as a norm is convex and a root concave. Micro-clusters form around at most MOST_SEEDS rows, so up to that many rows
each is a micro-cluster of its own and the silhouette is exact; beyond, its bound comes with it. Two scans give the
silhouettes of any number of clusterings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlight.session import materialize, ship

MOST_SCANS = 50
SHIFT = 1e-8
SEED_ROWS = 8192
#: Draws for each starting centre; more of them make a start better, for little.
TRIES = 12
MOST_SEEDS = 4096


@dataclass
class ClusterModel:
    """Centres of a fit, and the sum of squared distances to them."""

    centres: np.ndarray
    inertia: float
    features: str = "features"

    def nearest(self, point: Column) -> Column:
        """The nearest centre of an array of components; ties go to the smaller number."""
        gaps = [
            F.struct(sum((point[i] - float(v)) ** 2 for i, v in enumerate(centre)), F.lit(c))
            for c, centre in enumerate(self.centres)
        ]
        return F.array_min(F.array(*gaps))["col2"]

    def transform(self, vectors: DataFrame) -> DataFrame:
        return vectors.withColumn("prediction", self.nearest(vector_to_array(self.features)))

    def save(self, spark: SparkSession, path: str) -> str:
        row = [(self.centres.tolist(), self.inertia, self.features)]
        kind = "centres array<array<double>>, inertia double, features string"
        spark.createDataFrame(row, kind).coalesce(1).write.mode("overwrite").parquet(path)
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> ClusterModel:
        row = spark.read.parquet(path).first()
        return ClusterModel(np.array(row["centres"], float), row["inertia"], row["features"])


def points(vectors: DataFrame, features: str = "features") -> DataFrame:
    """The vectors as arrays ``x``, stored."""
    return materialize(vectors.select(vector_to_array(features).alias("x")), "points")


def _by_hash(table: DataFrame, most: int) -> DataFrame:
    return table.orderBy(F.xxhash64("x"), "x").limit(most)


def start(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Starting centres by k-means++: each among the best of a few draws by squared distance."""
    rng = np.random.default_rng((seed, k))
    chosen = [sample[rng.integers(len(sample))]]
    gap = ((sample - chosen[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        total = gap.sum()
        share = gap / total if total > 0 else np.full(len(sample), 1 / len(sample))
        tries = rng.choice(len(sample), TRIES, p=share)
        after = [np.minimum(gap, ((sample - sample[t]) ** 2).sum(axis=1)) for t in tries]
        best = int(np.argmin([a.sum() for a in after]))
        chosen.append(sample[tries[best]])
        gap = after[best]
    return np.array(chosen)


def _assigned(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def _summed(fits: list[np.ndarray]):
    """Rows, squared distances and sums of the rows of each centre of each fit."""
    firsts = np.cumsum([0, *map(len, fits)])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = np.concatenate(fits)
        n, cost, total = np.zeros(len(every), np.int64), np.zeros(len(every)), np.zeros_like(every)
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["x"].to_numpy()).astype(float)
            for first, centres in zip(firsts, fits):
                own = first + _assigned(x, centres)
                n += np.bincount(own, minlength=len(every))
                cost += np.bincount(own, ((x - every[own]) ** 2).sum(axis=1), len(every))
                for j in range(x.shape[1]):
                    total[:, j] += np.bincount(own, x[:, j], len(every))
        yield pd.DataFrame({"centre": np.arange(len(every)), "n": n, "cost": cost, "total": list(total)})

    return add


def _scan(table: DataFrame, fits: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Of each fit: rows and sums by centre, and inertia."""
    parts = table.mapInPandas(_summed(fits), "centre int, n long, cost double, total array<double>")
    size = fits[0].shape[1]
    summed = parts.groupBy("centre").agg(
        F.sum("n").alias("n"),
        F.sum("cost").alias("cost"),
        F.array(*[F.sum(F.col("total")[j]) for j in range(size)]).alias("total"),
    )
    rows = sorted(summed.collect(), key=lambda r: r["centre"])  # a row for each centre
    out, at = [], 0
    for centres in fits:
        own = rows[at : at + len(centres)]
        at += len(centres)
        n = np.array([r["n"] for r in own])
        out.append((n, np.array([r["total"] for r in own], float), sum(r["cost"] for r in own)))
    return out


def fit_all(vectors: DataFrame, fits: list[tuple[int, int]], features: str = "features") -> list[ClusterModel]:
    """A model for each (number of clusters, seed), from at most MOST_SCANS + 1 scans in all."""
    ship(vectors.sparkSession)
    table = points(vectors, features)
    sample = np.array([r["x"] for r in _by_hash(table, SEED_ROWS).collect()], float)
    if not len(sample):
        raise ValueError("there are no rows to cluster")
    centres = [start(sample, k, seed) for k, seed in fits]
    moving = list(range(len(fits)))
    for _ in range(MOST_SCANS):
        found = _scan(table, [centres[i] for i in moving])
        still = []
        for i, (n, total, _) in zip(moving, found):
            # A centre without rows stays where it is.
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres[i])
            if ((new - centres[i]) ** 2).sum() <= SHIFT:
                still.append(i)
            centres[i] = new
        moving = [i for i in moving if i not in still]
        if not moving:
            break
    return [ClusterModel(c, cost, features) for c, (_, _, cost) in zip(centres, _scan(table, centres))]


def best_of(models: list[ClusterModel], fits: list[tuple[int, int]]) -> dict[int, ClusterModel]:
    """The model with the least inertia for each number of clusters."""
    out: dict[int, ClusterModel] = {}
    for model, (k, _) in zip(models, fits):
        if k not in out or model.inertia < out[k].inertia:
            out[k] = model
    return out


# ---- silhouette ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Silhouette:
    """The mean silhouette, and by how much it may be off."""

    value: float
    bound: float


def _seeds_of(x: np.ndarray, label: np.ndarray, seeds: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The nearest seed of each row's own cluster."""
    gap = (seeds**2).sum(axis=1) - 2 * x @ seeds.T
    return np.where(of[None, :] == label[:, None], gap, np.inf).argmin(axis=1)


def _slices(batches: Iterator[pd.DataFrame], rows: int = 1024):
    for batch in batches:
        for first in range(0, len(batch), rows):
            part = batch.iloc[first : first + rows]
            yield np.stack(part["x"].to_numpy()).astype(float), np.stack(part["labels"].to_numpy()).astype(int)


def _micro(seeds: np.ndarray, labels: np.ndarray):
    """Rows, and sums of distances from the seed (plain and squared), by clustering and seed."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shape = (labels.shape[1], len(seeds))
        n, squares, total = np.zeros(shape, np.int64), np.zeros(shape), np.zeros((*shape, seeds.shape[1]))
        for x, own in _slices(batches):
            for p in range(shape[0]):
                at = _seeds_of(x, own[:, p], seeds, labels[:, p])
                away = x - seeds[at]
                np.add.at(n[p], at, 1)
                np.add.at(squares[p], at, (away**2).sum(axis=1))
                np.add.at(total[p], at, away)
        p, at = np.nonzero(n)
        yield pd.DataFrame({"p": p, "seed": at, "n": n[p, at], "squares": squares[p, at], "total": list(total[p, at])})

    return add


def _bounded(micro: list[tuple]):
    """Sums of lower and upper silhouettes by clustering."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high, rows = np.zeros(len(micro)), np.zeros(len(micro)), np.zeros(len(micro), np.int64)
        for x, own in _slices(batches):
            for p, (centroid, spread, n, of) in enumerate(micro):
                square = np.maximum(((x[:, None, :] - centroid[None]) ** 2).sum(axis=2), 0)
                every = np.unique(of)
                member = (of[:, None] == every[None, :]) * n[:, None]
                mean_low, mean_high = np.sqrt(square) @ member, np.sqrt(square + spread) @ member
                size = member.sum(axis=0)
                mine = every[None, :] == own[:, p][:, None]
                others = np.where(mine, np.maximum(size - 1, 1), size)
                mean_low, mean_high = mean_low / others, mean_high / others
                a_low, a_high = mean_low[mine], mean_high[mine]
                b_low = np.where(mine, np.inf, mean_low).min(axis=1)
                b_high = np.where(mine, np.inf, mean_high).min(axis=1)
                alone = (mine * size).sum(axis=1) == 1
                for total, a, b in ((low, a_high, b_low), (high, a_low, b_high)):
                    top = np.maximum(a, b)
                    fine = ~alone & np.isfinite(b) & (top > 0)
                    total[p] += ((b - a)[fine] / top[fine]).sum()
                rows[p] += len(x)
        yield pd.DataFrame({"p": np.arange(len(micro)), "low": low, "high": high, "n": rows})

    return score


def silhouettes(table: DataFrame, most_seeds: int = MOST_SEEDS) -> list[Silhouette]:
    """Silhouettes of rows ``x`` for each place of their array ``labels``.

    A row alone in its cluster counts as 0, as do all rows if there is one cluster.
    """
    ship(table.sparkSession)
    table = materialize(table.select("x", "labels"), "labelled-points")
    chosen = _by_hash(table, most_seeds).collect()
    if not chosen:
        return []
    # Clusters that no chosen row is in send one, the first by hash.
    each = table.select("x", "labels", F.posexplode("labels").alias("p", "label"))
    first = each.groupBy("p", "label").agg(F.min_by(F.struct("x", "labels"), F.struct(F.xxhash64("x"), "x")).alias("row"))
    seen = {(p, l) for r in chosen for p, l in enumerate(r["labels"])}
    chosen += [r["row"] for r in first.collect() if (r["p"], r["label"]) not in seen]
    seeds, labels = np.array([r["x"] for r in chosen], float), np.array([r["labels"] for r in chosen], int)
    parts = table.mapInPandas(_micro(seeds, labels), "p int, seed int, n long, squares double, total array<double>")
    size = seeds.shape[1]
    found = parts.groupBy("p", "seed").agg(
        F.sum("n").alias("n"),
        F.sum("squares").alias("squares"),
        F.array(*[F.sum(F.col("total")[j]) for j in range(size)]).alias("total"),
    )
    micro = []
    rows = found.collect()  # at most a row for each clustering and seed
    for p in range(labels.shape[1]):
        own = sorted((r for r in rows if r["p"] == p), key=lambda r: r["seed"])
        at, n = np.array([r["seed"] for r in own]), np.array([r["n"] for r in own])
        shift = np.array([r["total"] for r in own]) / n[:, None]
        spread = np.maximum(np.array([r["squares"] for r in own]) / n - (shift**2).sum(axis=1), 0)
        micro.append((seeds[at] + shift, spread, n, labels[at, p]))
    sums = table.mapInPandas(_bounded(micro), "p int, low double, high double, n long")
    sums = sums.groupBy("p").agg(F.sum("low").alias("low"), F.sum("high").alias("high"), F.sum("n").alias("n"))
    return [
        Silhouette((r["low"] + r["high"]) / 2 / r["n"], (r["high"] - r["low"]) / 2 / r["n"])
        for r in sums.orderBy("p").collect()
    ]
