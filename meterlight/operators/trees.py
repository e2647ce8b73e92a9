"""Boosted trees and forests over a stored, pre-binned table, several models at a time.

MLlib takes a job for each level of a boosted tree, fits its trees to doubled residuals and gives the first one full
weight; its forests have no least number of rows for a split. Here the published parameters hold as they stand, and a
task grows whole trees:

* Every feature is cut into at most BINS bins at quantiles of the whole table, found in one aggregate. The bins (a byte
  each) and the target are written once; all models read them.
* Every tree is grown from all rows: its row share or bootstrap sample is taken of the whole table.
* Boosting goes in stages. Every model's copy of the rows goes to a task of its own, which predicts them by the trees so far and
  grows STAGE more on what is left. The stage's trees are written to the shared folder, and the next stage goes on from them: a
  lost executor costs a task, a lost driver one stage, as ``fit_boosted`` with the same ``folder`` goes on where it was.
* A forest's trees are independent: each TREES_OF_TASK of them are a task, in which every tree takes a bootstrap sample by a hash
  of row and tree.
* Tables of more than ONE_TASK rows grow the same trees by ``operators.spread_trees``, with the rows spread over tasks.
* For trial runs SAMPLE may be set (None: off); then each stage and each task of a forest draws so many rows, a new draw each. The
  rows of all draws are found and stored in one scan; what is drawn from them is what the table would give.
* Trees grow level by level from sums by node, feature and bin. Where a level has at most CHUNK nodes, only the smaller child of a
  split is summed, its sibling is the difference; wider levels are summed CHUNK nodes at a time.

A task thus holds ONE_TASK rows and CHUNK nodes' sums, and models grow side by side. Columns are chosen for a tree by its
number. Nulls and NaN lie in a feature's last bin; rows with a null target are left out.
"""

from __future__ import annotations

import math
from collections.abc import Generator, Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlight.schema import TARGET
from meterlight.session import is_written, materialize, new_path, ship

BINS = 64
STAGE = 50
ONE_TASK = 1 << 17  # rows that a task holds
SAMPLE: int | None = None  # rows of a draw, for trial runs that need not see all; None: all rows, always
SPREAD_STAGES = 5  # stages at a time where rows are spread, as each begins by predicting them all
TREES_OF_TASK = 10
CHUNK = 256
LEAST_GAIN = 1e-9


@dataclass(frozen=True)
class TreeSettings:
    """Parameters of one ensemble."""

    boosted: bool
    trees: int
    depth: int
    min_leaf: int
    learning_rate: float = 0.05  # of boosted trees
    row_share: float = 1.0  # of boosted trees; a forest's take bootstrap samples
    column_share: float = 1.0
    l2: float = 0.0
    leaves: int | None = None  # best-first growth up to so many leaves; None: all levels in full
    min_split: int = 2  # rows of a node that may be split
    seed: int = 42

    @property
    def rate(self) -> float:
        """What a tree's values are multiplied by."""
        return self.learning_rate if self.boosted else 1.0 / max(1, self.trees)


@dataclass
class Tree:
    """Nodes from the root on; a leaf's feature is -1, the right child follows the left one."""

    feature: np.ndarray
    cut: np.ndarray  # last bin that goes left
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row (a column of ``bins``)."""
        node = np.zeros(bins.shape[1], np.int32)
        rows = np.arange(bins.shape[1])
        flat, first = bins.ravel(), np.maximum(self.feature, 0).astype(np.int64) * bins.shape[1]
        leaf = self.feature < 0
        while True:
            ended = leaf[node]
            if ended.all():
                return node
            right = flat[first[node] + rows] > self.cut[node]
            node = np.where(ended, node, self.left[node] + right).astype(np.int32)


KINDS = {"feature": np.int16, "cut": np.uint8, "left": np.int32, "value": np.float64, "gain": np.float64}
PACKED = "sizes binary, " + ", ".join(f"{k} binary" for k in KINDS)


def packed(trees: list[Tree]) -> dict[str, bytes]:
    out = {"sizes": np.array([len(t.feature) for t in trees], np.int32).tobytes()}
    return out | {k: b"".join(getattr(t, k).astype(kind).tobytes() for t in trees) for k, kind in KINDS.items()}


def unpacked(row) -> list[Tree]:
    ends = np.cumsum(np.frombuffer(bytes(row["sizes"]), np.int32))[:-1]
    sizes = len(row["sizes"]) // 4
    columns = {k: np.split(np.frombuffer(bytes(row[k]), kind), ends) for k, kind in KINDS.items()}
    return [Tree(**{k: c[i] for k, c in columns.items()}) for i in range(sizes)]


def predicted(bins: np.ndarray, base: float, rate: float, trees: list[Tree]) -> np.ndarray:
    out = np.full(bins.shape[1], base)
    for tree in trees:
        out += rate * tree.value[tree.leaf_of(bins)]
    return out


# ---- binned table -----------------------------------------------------------------------


@dataclass(frozen=True)
class Binned:
    """A stored table of ``key``, ``bins`` and ``y``, and what its bins stand for."""

    table: DataFrame
    features: list[str]
    edges: list[np.ndarray]
    rows: int
    mean: float


def bin_edges(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """At most ``bins`` - 1 upper edges of each feature, quantiles of the whole table."""
    shares = F.lit([(i + 1) / bins for i in range(bins - 1)])
    parts = [F.percentile_approx(F.nanvl(c, F.lit(None).cast("double")), shares, 4000).alias(c) for c in features]
    row = df.agg(*parts).first()
    return [np.unique(np.array(row[c] or [], float)) for c in features]


def to_bins(values: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """Feature × row; a value lies in the first bin whose upper edge it does not exceed."""
    return np.stack([np.searchsorted(e, v, side="left") for v, e in zip(values, edges)]).astype(np.uint8)


def _columns(batch: pd.DataFrame, features: list[str]) -> list[np.ndarray]:
    return [batch[c].to_numpy(float, na_value=np.nan) for c in features]


def bin_table(df: DataFrame, features: list[str], target: str = TARGET, bins: int = BINS) -> Binned:
    ship(df.sparkSession)
    names = [f"f{i}" for i in range(len(features))]
    rows = df.where(F.col(target).isNotNull()).select(
        F.col(target).cast("double").alias("y"), *[F.col(c).cast("double").alias(n) for c, n in zip(features, names)]
    )
    edges = bin_edges(rows, names, bins)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = np.ascontiguousarray(to_bins(_columns(batch, names), edges).T)
            yield pd.DataFrame({"key": batch["key"], "bins": [r.tobytes() for r in packed], "y": batch["y"]})

    keyed = rows.withColumn("key", F.xxhash64(F.monotonically_increasing_id()))  # a row's own, once it is stored
    facts = {"n": F.count("*"), "mean": F.avg("y")}
    table, seen = materialize(keyed.mapInPandas(binned, "key long, bins binary, y double"), "binned", facts)
    return Binned(table, features, edges, seen["n"], seen["mean"] or 0.0)


# ---- growing ------------------------------------------------------------------------------


def _spread(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """A random number below 2^64 for each row of a tree."""
    with np.errstate(over="ignore"):
        x = key ^ np.uint64((0x9E3779B97F4A7C15 * (tree + 1) + seed) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rows_of(key: np.ndarray, tree: int, settings: TreeSettings) -> np.ndarray:
    """Which rows a tree sees: a share of them, or a bootstrap sample (a Poisson number of each)."""
    if settings.boosted and settings.row_share >= 1:
        return np.arange(len(key))
    chance = _spread(key, tree, settings.seed) / 2.0**64
    if settings.boosted:
        return np.flatnonzero(chance < settings.row_share)
    steps = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
    return np.repeat(np.arange(len(key)), np.searchsorted(steps, chance, side="right"))


def columns_of(tree: int, n: int, settings: TreeSettings) -> np.ndarray:
    """Which features a tree may split on."""
    most = max(1, int(round(settings.column_share * n)))
    return np.sort(np.random.default_rng((settings.seed, tree)).permutation(n)[:most])


def sums_of(bins: np.ndarray, slot: np.ndarray, weight: np.ndarray, slots: int) -> np.ndarray:
    """Sum of weights and number of rows by slot, feature and bin: 2 × slot × feature × bin."""
    out = np.empty((2, slots, len(bins), BINS))
    first = slot.astype(np.int32) * BINS
    for f, row in enumerate(bins):
        at = first + row
        out[0, :, f] = np.bincount(at, weight, slots * BINS).reshape(slots, BINS)
        out[1, :, f] = np.bincount(at, minlength=slots * BINS).reshape(slots, BINS)
    return out


class Grower:
    """One tree in the making."""

    chunk: int | None = None  # nodes summed at a time; None: CHUNK
    leaves_from_parents = False  # whether the last level's values come from the sums of the level above

    def __init__(self, settings: TreeSettings, number: int, bins: np.ndarray, key: np.ndarray, target: np.ndarray):
        self._start(settings, number, len(bins))
        rows = rows_of(key, number, settings)
        self.bins, self.target = bins[self.columns][:, rows], target[rows]
        self.node = np.zeros(len(rows), np.int32)

    def _start(self, settings: TreeSettings, number: int, features: int) -> None:
        self.settings = settings
        self.columns = columns_of(number, features, settings)
        self.nodes = {k: [v] for k, v in (("feature", -1), ("cut", 0), ("left", 0), ("value", 0.0), ("gain", 0.0))}

    def grow(self) -> Tree:
        """The tree, where these rows are all there are."""
        steps, sums = self.steps(), None
        while True:
            try:
                sums = steps.send(sums)
            except StopIteration as end:
                return end.value

    def steps(self) -> Generator[np.ndarray, np.ndarray, Tree]:
        """Gives these rows' sums and takes those of all rows, until the tree is grown."""
        open_nodes: list[int] = [0]
        derived: dict[int, tuple] = {}  # a larger sibling's parent's sums, and the smaller sibling
        chunk = self.chunk or CHUNK
        for level in range(self.settings.depth + 1):
            last = level == self.settings.depth
            if last and level and self.leaves_from_parents:
                break
            split: dict[int, np.ndarray | None] = {}
            if len(open_nodes) <= chunk:
                asked = [n for n in open_nodes if n not in derived]
                sums = yield self._sums(asked)
                known = {n: sums[:, i] for i, n in enumerate(asked)}
                known |= {n: parent - known[small] for n, (parent, small) in derived.items()}
                split |= self._split(open_nodes, np.stack([known[n] for n in open_nodes], axis=1), last)
            else:
                for first in range(0, len(open_nodes), chunk):
                    some = open_nodes[first : first + chunk]
                    split |= self._split(some, (yield self._sums(some)), last)
            if not split:
                break
            keep = 2 * len(split) <= chunk
            open_nodes, derived = [], {}
            for node, (sums, left_is_small) in split.items():
                left = self.nodes["left"][node]
                open_nodes += [left, left + 1]
                if keep:
                    small, large = (left, left + 1) if left_is_small else (left + 1, left)
                    derived[large] = (sums, small)
            self._move(split)
        tree = Tree(**{k: np.array(v, KINDS[k]) for k, v in self.nodes.items()})
        return best_first(tree, self.settings.leaves) if self.settings.leaves else tree

    def _sums(self, nodes: list[int]) -> np.ndarray:
        slot = np.full(len(self.nodes["left"]), -1, np.int32)
        slot[nodes] = np.arange(len(nodes))
        own = slot[self.node]
        some = np.flatnonzero(own >= 0)
        if len(some) == len(own):
            return sums_of(self.bins, own, self.target, len(nodes))
        return sums_of(self.bins[:, some], own[some], self.target[some], len(nodes))

    def _real(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Targets and counts that sums stand for."""
        return sums[0], np.rint(sums[1])

    def _split(self, nodes: list[int], sums: np.ndarray, last: bool) -> dict[int, tuple]:
        """Values of nodes, and their children unless ``last``; sums and the smaller side of those split."""
        g, h = self._real(sums)  # node × feature × bin
        l2, least, whole = self.settings.l2, self.settings.min_leaf, self.settings.min_split
        total_g, total_h = g[:, 0].sum(axis=1), h[:, 0].sum(axis=1)
        score = total_g**2 / np.maximum(total_h + l2, 1)
        for node, value in zip(nodes, (total_g / np.maximum(total_h + l2, 1)).tolist()):
            self.nodes["value"][node] = value
        if last:
            return {}
        left_g, left_h = np.cumsum(g, axis=2)[:, :, :-1], np.cumsum(h, axis=2)[:, :, :-1]
        right_g, right_h = total_g[:, None, None] - left_g, total_h[:, None, None] - left_h
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2)
        fine = (left_h >= least) & (right_h >= least) & (total_h >= whole)[:, None, None]
        flat = np.where(fine, gain, -np.inf).reshape(len(nodes), -1)
        best = flat.argmax(axis=1)
        gained = flat[np.arange(len(nodes)), best] - score
        place, cut = np.divmod(best, BINS - 1)
        out = {}
        for i in np.flatnonzero(gained > LEAST_GAIN * np.maximum(1, total_h)):
            node, left = nodes[i], len(self.nodes["left"])
            for k, v in (("feature", self.columns[place[i]]), ("cut", cut[i]), ("left", left), ("gain", gained[i])):
                self.nodes[k][node] = v
            for k, v in (("feature", -1), ("cut", 0), ("left", 0), ("value", 0.0), ("gain", 0.0)):
                self.nodes[k] += [v, v]
            if self.leaves_from_parents:
                at = i, place[i], cut[i]
                self.nodes["value"][left] = left_g[at] / max(left_h[at] + l2, 1)
                self.nodes["value"][left + 1] = right_g[at] / max(right_h[at] + l2, 1)
            out[node] = (sums[:, i], 2 * left_h[i, place[i], cut[i]] <= total_h[i])
        return out

    def _move(self, split: dict[int, tuple]) -> None:
        """Rows of split nodes go to the children, the others are done."""
        column = np.full(len(self.nodes["left"]), -1, np.int16)
        cut, left = np.array(self.nodes["cut"], np.uint8), np.array(self.nodes["left"], np.int32)
        chosen = list(split)
        column[chosen] = np.searchsorted(self.columns, [self.nodes["feature"][n] for n in chosen])
        own = column[self.node]
        if (own < 0).any():
            on = np.flatnonzero(own >= 0)
            self.bins, self.target, self.node, own = self.bins[:, on], self.target[on], self.node[on], own[on]
        right = self.bins[own, np.arange(len(own))] > cut[self.node]
        self.node = left[self.node] + right


def best_first(tree: Tree, leaves: int) -> Tree:
    """The tree that growth by the greatest gain would have made; a split doesn't depend on the others."""
    open_nodes, kept = [0], []
    while open_nodes and len(kept) < leaves - 1:
        node = max(open_nodes, key=lambda n: (tree.gain[n] if tree.feature[n] >= 0 else -1.0, -n))
        open_nodes.remove(node)
        if tree.feature[node] < 0:
            break
        kept.append(node)
        open_nodes += [int(tree.left[node]), int(tree.left[node]) + 1]
    ended = np.ones(len(tree.feature), bool)
    ended[kept] = False
    return replace(tree, feature=np.where(ended, -1, tree.feature).astype(np.int16), gain=np.where(ended, 0.0, tree.gain))


GROWN = f"part int, {PACKED}"


def _opened(rows: pd.DataFrame, n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins (feature × row), keys and targets of a task, in an order of their own."""
    key, y = rows["key"].to_numpy(np.int64).view(np.uint64), rows["y"].to_numpy(float)
    bins = np.frombuffer(b"".join(rows["bins"]), np.uint8).reshape(-1, n_features)
    order = np.argsort(key)  # so that sums don't depend on how the rows came
    return np.ascontiguousarray(bins[order].T), key[order], y[order]


def _boost(settings: list[TreeSettings], so_far: list[list[Tree]], base: float, stage: int, n_features: int):
    """The next trees of a model, from the rows of its task."""

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        m = int(rows["part"].iloc[0])
        own, before = settings[m], so_far[m]
        bins, key, y = _opened(rows, n_features)
        fitted = predicted(bins, base, own.rate, before)
        new = []
        for number in range(len(before), min((len(before) // stage + 1) * stage, own.trees)):
            tree = Grower(own, number, bins, key, y - fitted).grow()
            fitted += own.rate * tree.value[tree.leaf_of(bins)]
            new.append(tree)
        return pd.DataFrame([{"part": m, **packed(new)}])

    return grow


def _plant(settings: TreeSettings, n_features: int):
    """A task's trees of a forest."""

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        bins, key, y = _opened(rows, n_features)
        numbers = range(part * TREES_OF_TASK, min((part + 1) * TREES_OF_TASK, settings.trees))
        return pd.DataFrame([{"part": part, **packed([Grower(settings, t, bins, key, y).grow() for t in numbers])}])

    return grow


# ---- models -------------------------------------------------------------------------------


@dataclass
class TreeModel:
    """A fitted ensemble; it predicts from the features by name, nulls counting as above every edge."""

    features: list[str]
    settings: TreeSettings
    base: float
    edges: list[np.ndarray] = field(repr=False)
    trees: list[Tree] = field(repr=False)

    def importances(self) -> np.ndarray:
        """Each feature's share of all gain."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            inner = t.feature >= 0
            total += np.bincount(t.feature[inner], t.gain[inner], len(self.features))
        return total / total.sum() if total.sum() > 0 else total

    def first(self, trees: int) -> TreeModel:
        """A boosted model as it was after so many trees."""
        return replace(self, trees=self.trees[:trees], settings=replace(self.settings, trees=trees))

    def predicted(self, values: list[np.ndarray]) -> np.ndarray:
        return predicted(to_bins(values, self.edges), self.base, self.settings.rate, self.trees)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", predictions([self], df.sparkSession)[0])

    def save(self, spark: SparkSession, path: str) -> str:
        row = {
            "features": self.features,
            "settings": {k: None if v is None else str(v) for k, v in vars(self.settings).items()},
            "base": self.base,
            "edges": [e.tolist() for e in self.edges],
            **{k: bytearray(v) for k, v in packed(self.trees).items()},
        }
        kind = f"features array<string>, settings map<string,string>, base double, edges array<array<double>>, {PACKED}"
        spark.createDataFrame([row], kind).coalesce(1).write.mode("overwrite").parquet(path)
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> TreeModel:
        row = spark.read.parquet(path).first()
        text = row["settings"]
        whole = {k: int(text[k]) for k in ("trees", "depth", "min_leaf", "min_split", "seed")}
        real = {k: float(text[k]) for k in ("learning_rate", "row_share", "column_share", "l2")}
        leaves = None if text["leaves"] is None else int(text["leaves"])
        settings = TreeSettings(boosted=text["boosted"] == "True", **whole, **real, leaves=leaves)
        edges = [np.array(e, float) for e in row["edges"]]
        return TreeModel(list(row["features"]), settings, row["base"], edges, unpacked(row))


def predictions(models: list[TreeModel], spark: SparkSession):
    """An array column with the prediction of each model; the models have the same features."""
    ship(spark)
    none = np.zeros(0)  # gains don't predict, and are a third of a tree
    models = [replace(m, trees=[replace(t, gain=none) for t in m.trees]) for m in models]

    @F.pandas_udf("array<double>")
    def each(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            values = [c.to_numpy(float, na_value=np.nan) for c in columns]
            yield pd.Series(list(np.stack([m.predicted(values) for m in models], axis=1)))

    return each(*[F.col(f"`{c}`").cast("double") for c in models[0].features])


def _all_rows(data: Binned) -> bool:
    return SAMPLE is None or data.rows <= SAMPLE


def is_spread(data: Binned) -> bool:
    """Whether the rows are more than a task holds."""
    return SAMPLE is None and data.rows > ONE_TASK


def _takes(data: Binned, draw: int) -> Column:
    """Whether a draw takes a row."""
    if _all_rows(data):
        return F.lit(True)
    chance = F.pmod(F.xxhash64("key", F.lit(draw)), F.lit(1 << 40)) / float(1 << 40)
    return chance < SAMPLE / data.rows


def drawn(data: Binned, draw: int) -> DataFrame:
    """All rows of the table, or about SAMPLE of them; another draw for each number."""
    return data.table.where(_takes(data, draw))


def _pool(data: Binned, draws: Iterable[int]) -> Binned:
    """The table with the rows of these draws only, found in one scan and stored; each draw of it is the same."""
    if _all_rows(data):
        return data
    any_takes = reduce(or_, [_takes(data, d) for d in draws])
    return replace(data, table=materialize(data.table.where(any_takes), "drawn"))


def _copies(data: Binned, draws: dict[int, int]) -> DataFrame:
    """The rows of each part, by the number of its draw, from one scan for all draws."""
    taken = []
    for draw in sorted(set(draws.values())):
        parts = F.array(*[F.lit(p) for p, of in draws.items() if of == draw])
        taken.append(F.when(_takes(data, draw), parts))
    return data.table.withColumn("part", F.explode(F.flatten(F.array_compact(F.array(*taken)))))


def fit_boosted(
    data: Binned,
    settings: dict[str, TreeSettings],
    stage: int = STAGE,
    folder: str | None = None,
    so_far: dict[str, list[Tree]] | None = None,
) -> dict[str, TreeModel]:
    """All boosted models of ``settings``, grown side by side in stages.

    Finished stages in ``folder`` are not grown again. ``so_far`` holds trees to go on from; a tree depends on those
    before it and its number alone, so a model grown in several calls is the one grown in a single call.
    """
    spark = data.table.sparkSession
    folder = folder or new_path(spark, "boosting")
    spread = is_spread(data)
    if spread:
        from meterlight.operators import spread_trees

        stage *= SPREAD_STAGES
    names, plans = list(settings), list(settings.values())
    trees = [list((so_far or {}).get(n, [])) for n in names]
    draws = {d for s, t in zip(plans, trees) for d in range(len(t) // stage, -(-s.trees // stage))}
    if draws:
        data = _pool(data, sorted(draws))
    step = 0
    while busy := [m for m, s in enumerate(plans) if data.rows and len(trees[m]) < s.trees]:
        path = f"{folder}/stage-{step}"
        if not is_written(spark, path):
            if spread:
                grown = spread_trees.boosted(data, {m: plans[m] for m in busy}, trees, stage)
            else:
                grow = _boost(plans, trees, data.mean, stage, len(data.features))
                copies = _copies(data, {m: len(trees[m]) // stage for m in busy})
                grown = copies.groupBy("part").applyInPandas(grow, GROWN)
            grown.write.mode("overwrite").parquet(path)
        for row in spark.read.parquet(path).collect():  # one row for each model
            trees[row["part"]] += unpacked(row)
        step += 1
    return {n: TreeModel(data.features, s, data.mean, data.edges, t) for n, s, t in zip(names, plans, trees)}


def fit_forest(data: Binned, settings: TreeSettings) -> TreeModel:
    """A forest, some trees a task."""
    parts = range(-(-settings.trees // TREES_OF_TASK)) if data.rows else ()
    trees: list[Tree] = []
    if is_spread(data):
        from meterlight.operators import spread_trees

        for row in materialize(spread_trees.planted(data, settings), "forest").orderBy("part").toLocalIterator():
            trees += unpacked(row)
    elif parts:
        grow = _plant(settings, len(data.features))
        # While all rows are drawn, the draws are one.
        pool = _pool(data, parts)
        copies = _copies(pool, {p: 0 if _all_rows(data) else p for p in parts}).repartition(len(parts), "part")
        grown = materialize(copies.groupBy("part").applyInPandas(grow, GROWN), "forest")
        for row in grown.orderBy("part").collect():
            trees += unpacked(row)
    base = 0.0 if trees else data.mean
    return TreeModel(data.features, settings, base, data.edges, trees)
