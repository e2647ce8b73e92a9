"""Boosting in stages, forests, and tuning."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlight.operators import eda, forecast, trees
from meterlight.operators.trees import TreeSettings
from meterlight.schema import TARGET
from meterlight.sources import model_store

SETTINGS = TreeSettings(True, 6, 3, 5, 0.3)


def curve(n: int = 3000, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=n), rng.integers(0, 5, n).astype(float), rng.random(n)
    return {"a": a, "b": b, "c": c, TARGET: 3 * (a > 0.3) + b + 0.1 * rng.normal(size=n)}


def frame(spark, data: dict):
    names = list(data)
    rows = [tuple(float(v) for v in row) for row in zip(*data.values())]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(3)


@pytest.fixture(scope="module")
def table(spark):
    return frame(spark, curve())


@pytest.fixture(scope="module")
def binned(table):
    return trees.bin_table(table, ["a", "b", "c"])


def plain_tree(bins, residual, depth, least, l2):
    """Leaf values by exhaustive search, one row's path at a time."""
    out = np.zeros(bins.shape[1])

    def grow(rows, level):
        g, h = residual[rows].sum(), len(rows)
        best = (0.0, None)
        if level < depth:
            for f in range(len(bins)):
                for cut in range(trees.BINS - 1):
                    left = rows[bins[f, rows] <= cut]
                    if len(left) >= least and h - len(left) >= least:
                        gl = residual[left].sum()
                        gain = gl**2 / (len(left) + l2) + (g - gl) ** 2 / (h - len(left) + l2) - g**2 / (h + l2)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, cut))
        if best[1] is None:
            out[rows] = g / (h + l2)
            return
        f, cut = best[1]
        grow(rows[bins[f, rows] <= cut], level + 1)
        grow(rows[bins[f, rows] > cut], level + 1)

    grow(np.arange(bins.shape[1]), 0)
    return out


def test_one_tree_equals_an_exhaustive_search(monkeypatch):
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 12, (4, 300)).astype(np.uint8)
    residual = rng.normal(size=300) + (bins[1] > 5) - 0.5 * (bins[2] > 7)
    for depth, least, l2, chunk in ((1, 1, 0.0, 256), (3, 5, 1.0, 256), (4, 20, 0.0, 256), (5, 3, 0.0, 4)):
        monkeypatch.setattr(trees, "CHUNK", chunk)
        s = TreeSettings(True, 1, depth, least, 1.0, l2=l2)
        grower = trees.Grower(s, 0, bins, np.arange(300, dtype=np.uint64), residual)
        tree = grower.grow()
        got = tree.value[tree.leaf_of(bins)]
        assert np.allclose(got, plain_tree(bins, residual, depth, least, l2))


def test_best_first_growth_takes_the_greatest_gains():
    rng = np.random.default_rng(4)
    bins = rng.integers(0, 30, (5, 2000)).astype(np.uint8)
    residual = rng.normal(size=2000) + (bins[0] > 9)
    grown = {}
    for leaves in (None, 5, 64):
        s = TreeSettings(True, 1, 5, 10, 1.0, leaves=leaves)
        grown[leaves] = trees.Grower(s, 0, bins, np.arange(2000, dtype=np.uint64), residual).grow()
    whole, some = grown[None], grown[5]
    kept = np.flatnonzero(some.feature >= 0)
    assert len(kept) == 4 and (some.feature[kept] == whole.feature[kept]).all()
    open_nodes = {0}
    for _ in range(4):  # each kept split has the greatest gain of those open
        node = max(open_nodes, key=lambda n: whole.gain[n])
        assert node in kept
        open_nodes = (open_nodes - {node}) | {whole.left[node], whole.left[node] + 1}
    assert (grown[64].feature == whole.feature).all()


def test_forest_trees_take_bootstrap_samples(spark, table, binned, monkeypatch):
    settings = TreeSettings(False, 25, 8, 5, min_split=10)
    key = np.array([r["key"] for r in binned.table.collect()], np.int64).view(np.uint64)
    counts = np.bincount(trees.rows_of(key, 3, settings), minlength=len(key))
    assert abs(counts.mean() - 1) < 0.1 and abs((counts == 0).mean() - np.exp(-1)) < 0.04 and counts.max() < 12
    model = trees.fit_forest(binned, settings)
    assert len(model.trees) == 25 and len({len(t.feature) for t in model.trees}) > 1
    test = frame(spark, curve(500, seed=2))
    error = model.transform(test).agg(F.avg(F.abs(F.col(TARGET) - F.col("prediction")))).first()[0]
    assert error < 0.15
    monkeypatch.setattr(trees, "SAMPLE", 600)  # each task has a draw of its own
    small = trees.fit_forest(binned, settings)
    error = small.transform(test).agg(F.avg(F.abs(F.col(TARGET) - F.col("prediction")))).first()[0]
    assert error < 0.3 and max(len(t.feature) for t in small.trees) < max(len(t.feature) for t in model.trees)


def test_nodes_below_the_least_split_stay_whole():
    rng = np.random.default_rng(7)
    bins, y = rng.integers(0, 60, (3, 400)).astype(np.uint8), rng.normal(size=400)
    s = TreeSettings(True, 1, 14, 2, 1.0, min_split=10)
    tree = trees.Grower(s, 0, bins, np.arange(400, dtype=np.uint64), y).grow()
    leaf = np.bincount(tree.leaf_of(bins), minlength=len(tree.feature))
    total = leaf.copy()
    for node in range(len(tree.feature) - 1, -1, -1):  # children have greater numbers
        if tree.feature[node] >= 0:
            total[node] = total[tree.left[node]] + total[tree.left[node] + 1]
            assert total[node] >= 10
    assert leaf[tree.feature < 0].min() >= 2 and leaf[tree.feature < 0].min() < 5


def test_model_learns_and_predicts_alike_everywhere(spark, table, binned):
    settings = TreeSettings(True, 60, 4, 5, 0.1, 0.8, 0.7)
    model = trees.fit_boosted(binned, {"m": settings})["m"]
    test = frame(spark, curve(500, seed=2))
    error = model.transform(test).agg(F.avg(F.abs(F.col(TARGET) - F.col("prediction")))).first()[0]
    assert error < 0.2  # the mean errs by 1.8, the noise by 0.08
    assert model.importances()[2] < 0.02 and model.importances().sum() == pytest.approx(1)
    rows = test.collect()
    bins = trees.to_bins([np.array([r[c] for r in rows]) for c in "abc"], model.edges)
    want = trees.predicted(bins, model.base, 0.1, model.trees)
    got = {tuple(r[c] for c in "abc"): r["prediction"] for r in model.transform(test).collect()}
    assert all(got[tuple(r[c] for c in "abc")] == pytest.approx(w) for r, w in zip(rows, want))


def same(a, b) -> bool:
    return trees.packed(a.trees) == trees.packed(b.trees)


def test_stages_and_company_change_nothing(binned, monkeypatch):
    """A model is the same grown alone or beside others, and in one call or two; also if rows are drawn."""
    a, b = TreeSettings(True, 9, 3, 5, 0.2, 0.8, 0.7), TreeSettings(True, 5, 2, 20, 0.1, leaves=3)
    for sample in (trees.SAMPLE, 700):
        monkeypatch.setattr(trees, "SAMPLE", sample)
        together = trees.fit_boosted(binned, {"a": a, "b": b}, stage=4)
        alone = trees.fit_boosted(binned, {"a": a}, stage=4)["a"]
        assert same(together["a"], alone) and len(together["b"].trees) == 5
        part = trees.fit_boosted(binned, {"a": replace(a, trees=5)}, stage=4)["a"]
        assert same(trees.fit_boosted(binned, {"a": a}, stage=4, so_far={"a": part.trees})["a"], alone)
        assert same(alone.first(5), part)


def test_a_finished_stage_is_not_grown_again(spark, binned, tmp_path, monkeypatch):
    folder = str(tmp_path / "stages")
    first = trees.fit_boosted(binned, {"m": SETTINGS}, stage=2, folder=folder)["m"]
    monkeypatch.setattr(trees, "_boost", lambda *_: pytest.fail("grown again"))
    assert same(trees.fit_boosted(binned, {"m": SETTINGS}, stage=2, folder=folder)["m"], first)


def test_draws_are_bounded_and_differ(binned, monkeypatch):
    monkeypatch.setattr(trees, "SAMPLE", 500)
    draws = [{r["key"] for r in trees.drawn(binned, stage).collect()} for stage in (0, 1)]
    assert all(350 < len(d) < 650 for d in draws) and len(draws[0] & draws[1]) < 200


def test_nulls_constant_columns_and_few_rows(spark):
    kind = f"a double, b double, {TARGET} double"
    rows = [(None, 1.0, 1.0), (float("nan"), 1.0, 1.2), (2.0, 1.0, 5.0), (3.0, 1.0, 5.1), (4.0, 1.0, None)] * 20
    odd = spark.createDataFrame(rows, kind)
    data = trees.bin_table(odd, ["a", "b"])
    assert data.rows == 80
    model = trees.fit_boosted(data, {"m": TreeSettings(True, 20, 3, 2, 0.5)})["m"]
    got = {r["a"] if r["a"] == r["a"] else None: r["prediction"] for r in model.transform(odd).collect()}
    assert got[None] == pytest.approx(1.1, abs=0.02) and got[2.0] == pytest.approx(5.0, abs=0.02)
    assert got[3.0] == pytest.approx(5.1, abs=0.02) and model.importances()[1] == 0
    one = trees.fit_boosted(trees.bin_table(odd.limit(1), ["a", "b"]), {"m": SETTINGS})["m"]
    assert {r["prediction"] for r in one.transform(odd).collect()} == {1.0}
    none = trees.bin_table(odd.limit(0), ["a", "b"])
    assert none.rows == 0 and none.mean == 0


def test_saved_and_loaded(spark, binned, table, tmp_path):
    model = trees.fit_boosted(binned, {"m": replace(SETTINGS, leaves=4, l2=1.5)})["m"]
    path = model_store.save_forecaster(model, str(tmp_path / "model"))
    again = model_store.load_forecaster(path)
    assert same(model, again) and again.settings == model.settings and again.features == model.features
    before, after = (sorted(r["prediction"] for r in m.transform(table).collect()) for m in (model, again))
    assert before == after


def folds(spark):
    train, check = frame(spark, curve(1500, 5)), frame(spark, curve(600, 6))
    return eda.train_val_stack(train, check)


def test_tuning_equals_a_serial_search(spark):
    grids = {
        "gbt_a": {"trees": [4, 12, 40], "depth": [1, 3], "learning_rate": [0.05, 0.3]},
        "random_forest": {"trees": [2, 6], "depth": [2, 5], "min_leaf": [2, 40]},
    }
    stacked = folds(spark)
    got = {(r["Model"], r["parameters"]): r for r in forecast.tune_models(stacked, grids, picks=4).collect()}
    fit_part, check = stacked.where("fold = -1").drop("fold"), stacked.where("fold = 0").drop("fold")
    for name, grid in grids.items():
        errors = {}
        for point in forecast.grid_picks(grid, 4):
            model = forecast.train(fit_part, forecast.settings_for(name, **point))
            text = ", ".join(f"{k}={v}" for k, v in point.items())
            errors[text] = forecast.predict(model, check).agg(F.avg(F.abs(F.col(TARGET) - F.col("prediction")))).first()[0]
            assert got[name, text]["validation_mae"] == pytest.approx(errors[text], rel=1e-9)
        assert [t for (n, t), r in got.items() if n == name and r["best"]] == [min(errors, key=errors.get)]


def test_halving_finds_the_same_best_point(spark):
    """Where a point's lead shows early; where it comes late, halving may miss it, and so is off by default."""
    grids = {"gbt_a": {"trees": [24], "depth": [3], "learning_rate": [0.01, 0.03, 0.1, 0.3]}}
    stacked = folds(spark)
    whole = forecast.tune_models(stacked, grids, picks=4).where("best").first()
    early = forecast.tune_models(stacked, grids, picks=4, halving=True).where("best").collect()
    assert [r["parameters"] for r in early] == [whole["parameters"]]
    assert early[0]["validation_mae"] == pytest.approx(whole["validation_mae"])
