"""Scoring by comparisons of all nodes against walking down each tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from meterlight.functions import isolation


def forest_table(rng, trees: int, size: int, inputs: list[str]) -> pd.DataFrame:
    grown = []
    for tree in range(trees):
        rows = pd.DataFrame(rng.normal(size=(size, len(inputs))).round(1), columns=inputs)
        rows[inputs[-1]] = rng.integers(0, 2, size)
        rows = rows.assign(tree=tree, draw=rng.permutation(size))
        grown.append(isolation.grow_tree(rows, inputs, isolation.depth_limit(size), 7))
    return pd.concat(grown, ignore_index=True)


def walked(table: pd.DataFrame, sample_size: int, points: np.ndarray) -> np.ndarray:
    """Scores by following each point through each tree."""
    total = np.zeros(len(points))
    for _, tree in table.groupby("tree"):
        nodes = tree.sort_values("node").to_dict("records")
        for i, point in enumerate(points):
            at = nodes[0]
            while at["left"] != at["node"]:
                at = nodes[at["right"] if point[at["feature"]] > at["threshold"] else at["left"]]
            total[i] += at["path"]
    return -np.exp2(-total / table["tree"].nunique() / (isolation.average_path(sample_size) or 1.0))


@pytest.mark.parametrize("size", [1, 2, 40, 700])
def test_scores_equal_a_walk(size):
    """Also at a threshold, for NaN and infinities, for trees of one leaf and of more than 256."""
    rng = np.random.default_rng(size)
    table = forest_table(rng, 12, size, ["a", "b", "c"])
    points = np.vstack([rng.normal(size=(300, 3)), np.full((1, 3), np.nan), [[np.inf, -np.inf, 1]]])
    inner = table[table["left"] != table["node"]].head(200)
    for feature, threshold in zip(inner["feature"], inner["threshold"]):
        point = np.zeros(3)
        point[feature] = threshold
        points = np.vstack([points, point])
    got = isolation.score_points(isolation.flat_forest(table, size), points)
    assert np.array_equal(got, walked(table, size, points))


def test_batches_are_scored_together_and_come_back_apart(monkeypatch):
    rng = np.random.default_rng(1)
    forest = isolation.flat_forest(forest_table(rng, 5, 64, ["a", "b"]), 64)
    batches = [rng.normal(size=(n, 2)) for n in (30, 0, 50, 20, 7)]
    monkeypatch.setattr(isolation, "AT_ONCE", 80)
    score, calls = isolation.score_points, []
    monkeypatch.setattr(isolation, "score_points", lambda f, p: calls.append(len(p)) or score(f, p))
    got = list(isolation.score_batches(forest, iter(batches)))
    assert calls == [80, 27] and [len(g) for g in got] == [30, 0, 50, 20, 7]
    assert np.array_equal(np.concatenate(got), score(forest, np.concatenate(batches)))
    assert list(isolation.score_batches(forest, iter([]))) == []
