"""Isolation-tree kernels that run inside Spark tasks: growing one tree, scoring a batch."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value

# Executors get these functions with the job, so the package need not be installed there.
register_pickle_by_value(sys.modules[__name__])

NODE_COLUMNS = ["tree", "node", "feature", "threshold", "left", "right", "path"]
NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, path double"
)
AT_ONCE = 1 << 17
_LEFT, _RIGHT = NODE_COLUMNS.index("left"), NODE_COLUMNS.index("right")


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def depth_limit(sample_size: int) -> int:
    return math.ceil(math.log2(max(sample_size, 2)))


def grow_tree(rows: pd.DataFrame, inputs: list[str], limit: int, seed: int) -> pd.DataFrame:
    """Random axis-parallel splits of one tree's sample, as a table of nodes.

    A leaf points to itself, so that walking on from it stays there.
    """
    rows = rows.sort_values(["draw", *inputs])
    tree = int(rows["tree"].iloc[0])
    random = np.random.default_rng([seed, tree])
    points = rows[inputs].to_numpy(dtype="float64")
    nodes: list[list] = []
    waiting = [(np.arange(len(points)), 0, None, None)]
    while waiting:
        members, depth, parent, side = waiting.pop()
        here = len(nodes)
        if parent is not None:
            nodes[parent][side] = here
        part = points[members]
        low, high = part.min(axis=0), part.max(axis=0)
        choices = np.flatnonzero(high > low)
        if depth >= limit or len(choices) == 0:
            length = depth + average_path(len(members))
            nodes.append([tree, here, 0, math.inf, here, here, length])
            continue
        feature = int(random.choice(choices))
        threshold = float(random.uniform(low[feature], high[feature]))
        nodes.append([tree, here, feature, threshold, -1, -1, 0.0])
        is_left = part[:, feature] <= threshold
        waiting.append((members[~is_left], depth + 1, here, _RIGHT))
        waiting.append((members[is_left], depth + 1, here, _LEFT))
    return pd.DataFrame(nodes, columns=NODE_COLUMNS)


def flat_forest(table: pd.DataFrame, sample_size: int) -> dict:
    """All trees with their thresholds as ranks among those of the same feature.

    A tree is its inner nodes in an order with children first, as (feature, rank, leaves below the left child, left, right);
    a child is an inner node's place or -1 for a leaf. Leaves are numbered from left to right.
    """
    table = table.sort_values(["tree", "node"])
    inner = (table["left"] != table["node"]).to_numpy()
    feature, threshold = table["feature"].to_numpy(np.int64), table["threshold"].to_numpy()
    width = int(feature.max(initial=0)) + 1
    thresholds = [np.unique(threshold[inner & (feature == f)]) for f in range(width)]
    rank = np.zeros(len(table), np.int64)
    for f, known in enumerate(thresholds):
        of = inner & (feature == f)
        rank[of] = np.searchsorted(known, threshold[of])
    left, right, path = (table[c].tolist() for c in ("left", "right", "path"))
    starts = np.flatnonzero(table["node"].to_numpy() == 0).tolist()
    trees = [_program(i, feature, rank, left, right, path, inner) for i in starts]
    return {"thresholds": thresholds, "trees": trees, "scale": average_path(sample_size) or 1.0}


def _program(start: int, feature, rank, left, right, path, inner) -> tuple[list, np.ndarray]:
    """Inner nodes of the tree whose root is at ``start``, and the path length of each leaf."""
    nodes: list[tuple] = []
    leaves: list[float] = []

    def visit(node: int) -> tuple[int, int]:
        at = start + node
        if not inner[at]:
            leaves.append(path[at])
            return -1, 1
        first, below = visit(left[at])
        second, others = visit(right[at])
        nodes.append((int(feature[at]), int(rank[at]), below, first, second))
        return len(nodes) - 1, below + others

    visit(0)
    return nodes, np.array(leaves)


def _leaf_of(nodes: list[tuple], ranks: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Number of each point's leaf, from all nodes' comparisons, without a step from node to node for each point.

    A node's number is its left child's, or after a comparison that is true its right child's behind all on the left;
    numbers wrap around below zero in between.
    """
    kind, held = out.dtype.type, {}
    free: list[np.ndarray] = []
    beyond = np.empty(len(out), bool)
    factor = beyond.view(np.uint8)
    for place, (feature, rank, below, left, right) in enumerate(nodes):
        own = free.pop() if free else np.empty_like(out)
        np.greater(ranks[feature], rank, out=beyond)
        if left < 0 and right < 0:
            own[:] = factor
        else:
            if right >= 0:
                other = held.pop(right)
                np.add(other, kind(below), out=own)
                free.append(other)
            else:
                own.fill(below)
            if left >= 0:
                first = held.pop(left)
                np.subtract(own, first, out=own)
                np.multiply(own, factor, out=own)
                np.add(own, first, out=own)
                free.append(first)
            else:
                np.multiply(own, factor, out=own)
        held[place] = own
    return held[len(nodes) - 1] if nodes else np.zeros_like(out)


def score_points(forest: dict, points: np.ndarray) -> np.ndarray:
    """Raw score of every point: -2 ** -(mean path length / expected length)."""
    thresholds, trees = forest["thresholds"], forest["trees"]
    most = max((len(t) for t in thresholds), default=0)
    ranks = np.empty((len(thresholds), len(points)), np.uint16 if most < 1 << 16 else np.uint32)
    for f, known in enumerate(thresholds):
        values = points[:, f]
        ranks[f] = np.searchsorted(known, values)  # how many thresholds a value is beyond
        ranks[f][np.isnan(values)] = 0
    total = np.zeros(len(points))
    for nodes, path in trees:
        leaf = np.empty(len(points), np.uint8 if len(path) <= 256 else np.uint32)
        total += path.take(_leaf_of(nodes, ranks, leaf))
    return -np.exp2(-total / len(trees) / forest["scale"])


def score_batches(forest: dict, batches: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
    """Scores of each batch; AT_ONCE points are scored together, as a tree's nodes cost a call each."""
    waiting: list[np.ndarray] = []
    for points in batches:
        waiting.append(points)
        if sum(map(len, waiting)) >= AT_ONCE:
            yield from _apart(forest, waiting)
            waiting = []
    if waiting:
        yield from _apart(forest, waiting)


def _apart(forest: dict, batches: list[np.ndarray]) -> list[np.ndarray]:
    scores = score_points(forest, np.concatenate(batches))
    return np.split(scores, np.cumsum([len(b) for b in batches])[:-1])
