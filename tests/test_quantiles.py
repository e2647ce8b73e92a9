from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from meterlight.functions import quantiles
from meterlight.functions.quantiles import exact_median, exact_quantiles, grouped_median

PROBABILITIES = [0.0, 0.05, 0.25, 0.5, 0.75, 0.999, 1.0]


def frame(spark, values, groups=None):
    groups = [0] * len(values) if groups is None else groups
    rows = [(int(g), None if v is None else float(v)) for g, v in zip(groups, values)]
    return spark.createDataFrame(rows, "g int, v double")


CASES = {
    "uniform": np.random.default_rng(1).uniform(-5, 5, 3000),
    "skewed": np.random.default_rng(2).lognormal(0, 4, 3000),
    "outlier": np.append(np.random.default_rng(3).normal(0, 1e-3, 2000), [1e300, -1e300]),
    "hot value": np.append(np.full(2000, 3.25), np.arange(1000)),
    "adjacent": np.array([1.0, np.nextafter(1.0, 2.0)] * 50),
    "tiny": np.array([0.0, 5e-324] * 3),
    "single": np.array([42.0]),
}


@pytest.mark.parametrize("bins", [4, 64])
@pytest.mark.parametrize("name", CASES)
def test_refinement_equals_numpy(spark, name, bins):
    values = CASES[name]
    found = exact_quantiles(frame(spark, values), "v", PROBABILITIES, finish_rows=0, bins=bins)
    np.testing.assert_allclose(found[0], np.quantile(values, PROBABILITIES), rtol=1e-12, atol=1e-300)


def test_groups_and_nulls(spark):
    values = list(np.random.default_rng(4).normal(size=400)) + [None, float("nan")]
    groups = [i % 4 for i in range(402)]
    for finish in (0, 10**6):
        found = exact_quantiles(frame(spark, values, groups), "v", [0.5], "g", finish_rows=finish)
        for g in range(4):
            mine = [v for v, k in zip(values, groups) if k == g and v is not None and v == v]
            np.testing.assert_allclose(found[g], [np.median(mine)])


def test_many_groups_and_a_null_group(spark):
    table = frame(spark, range(300), range(300)).selectExpr("nullif(g, 7) as g", "v")
    found = exact_quantiles(table, "v", [0.5], "g")
    assert found == {None if g == 7 else g: [float(g)] for g in range(300)}


def test_number_of_passes_changes_no_bit(spark):
    """The same values, searched directly, over some passes and down to single values."""
    values = np.random.default_rng(9).lognormal(0, 2, 4000)
    table = frame(spark, values)
    found = [
        exact_quantiles(table, "v", PROBABILITIES, finish_rows=rows, bins=16)[0]
        for rows in (0, 40, 10**6)
    ]
    assert found[0] == found[1] == found[2]


def test_no_values(spark):
    assert exact_median(frame(spark, [None, None]), "v") is None


@pytest.mark.parametrize(("bounded", "bins"), [(10**6, 64), (50, 16), (0, 8)])
def test_grouped_median_equals_numpy(spark, bounded, bins):
    """Groups of one, two and many values, one of them with most of the rows."""
    rng = np.random.default_rng(6)
    parts = {
        0: rng.lognormal(0, 3, 2000),
        1: np.append(np.full(90, 2.5), [1e12, -1e12]),
        2: np.array([7.0]),
        3: np.array([1.0, 4.0]),
        4: rng.integers(0, 5, 301).astype(float),
    }
    values = [v for part in parts.values() for v in part] + [None]
    groups = [g for g, part in parts.items() for _ in part] + [9]
    table = frame(spark, values, groups)
    found = grouped_median(table, ["g"], "v", finish_rows=bounded, bins=bins).collect()
    assert {r.g: r["median"] for r in found} == pytest.approx(
        {g: np.median(part) for g, part in parts.items()}
    )


def counted_passes(monkeypatch):
    labels = []
    plain = quantiles.materialize
    monkeypatch.setattr(quantiles, "materialize", lambda df, label: labels.append(label) or plain(df, label))
    return labels


def test_a_large_group_takes_two_scans(spark, monkeypatch):
    """One for the sketch, one inside its brackets, where the histogram alone would take three."""
    labels = counted_passes(monkeypatch)
    values = np.random.default_rng(8).lognormal(0, 3, 300_000)
    table = spark.createDataFrame(pd.DataFrame({"v": values}))
    found = exact_quantiles(table, "v", PROBABILITIES)
    assert labels == ["group-sizes", "quantiles"]
    np.testing.assert_allclose(found[0], np.quantile(values, PROBABILITIES), rtol=1e-12)


@pytest.mark.parametrize("finish", [0, 500, 10**6])
def test_a_rank_outside_its_bracket_is_found(spark, monkeypatch, finish):
    """Brackets moved off their ranks, as a sketch far off would: the same values, by more passes."""
    values = np.random.default_rng(10).normal(size=30_000)
    table = spark.createDataFrame(pd.DataFrame({"v": values}))
    expected = np.quantile(values, PROBABILITIES)
    for reach in (-0.01, 0.0):
        monkeypatch.setattr(quantiles, "REACH", reach)
        found = exact_quantiles(table, "v", PROBABILITIES, finish_rows=finish, bins=64)
        np.testing.assert_allclose(found[0], expected, rtol=1e-12)
