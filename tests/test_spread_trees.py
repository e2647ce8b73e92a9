"""Trees over more rows than one task holds: all rows count, however they are spread."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterlight.operators import spread_trees, trees
from meterlight.operators.trees import TreeSettings

SHARED = TreeSettings(True, 5, 4, 5, 0.3, 0.8, 0.7, l2=1.0)
FEW_LEAVES = TreeSettings(True, 3, 5, 20, 0.2, leaves=6)
FOREST = TreeSettings(False, 9, 5, 5, min_split=10)


@pytest.fixture(scope="module")
def large(spark):
    """More rows than the 2^17 that a task holds."""
    rows = spark.range(150_000).select(
        (F.col("id") % 2).cast("double").alias("a"), F.rand(2).alias("b"), F.rand(1).alias("energy_sum")
    )
    return trees.bin_table(rows, ["a", "b"])


@pytest.fixture(scope="module")
def binned(spark):
    rows = spark.range(40_000).select(
        F.rand(1).alias("a"), (F.col("id") % 7).cast("double").alias("b"), F.randn(2).alias("c")
    )
    target = 3 * F.col("a") + F.when(F.col("b") > 4, 2.0).otherwise(F.col("c")) + 0.1 * F.rand(3)
    return trees.bin_table(rows.withColumn("energy_sum", target), ["a", "b", "c"])


def alike(a, b) -> bool:
    """The same splits, and the same values but for rounding."""
    return len(a.trees) == len(b.trees) and all(
        np.array_equal(s.feature, t.feature) and np.array_equal(s.cut, t.cut) and np.allclose(s.value, t.value, atol=1e-5)
        for s, t in zip(a.trees, b.trees)
    )


def test_a_tree_sees_every_row_of_a_large_table(large):
    """A draw of 2^17 rows would miss its means by about a thousandth."""
    assert large.rows > 1 << 17
    model = trees.fit_boosted(large, {"m": TreeSettings(True, 1, 1, 5, 1.0, column_share=0.5)})["m"]
    column = int(trees.columns_of(0, 2, model.settings)[0])
    rows = large.table.toPandas()
    bins = np.array([r[column] for r in rows["bins"]])
    tree = model.trees[0]
    for leaf, those in ((1, bins <= tree.cut[0]), (2, bins > tree.cut[0])):
        assert tree.value[leaf] + model.base == pytest.approx(rows["y"][those].mean(), abs=1e-6)


def test_a_forest_s_tree_draws_from_every_row_of_a_large_table(large):
    settings = TreeSettings(False, 3, 0, 5)
    model = trees.fit_forest(large, settings)
    rows = large.table.toPandas()
    key, y = rows["key"].to_numpy().view(np.uint64), rows["y"].to_numpy()
    for number, tree in enumerate(model.trees):
        assert tree.value[0] == pytest.approx(y[trees.rows_of(key, number, settings)].mean(), abs=1e-6)


def test_spread_rows_grow_the_trees_of_one_task(binned, monkeypatch):
    plans = {"a": SHARED, "b": FEW_LEAVES}
    want, want_forest = trees.fit_boosted(binned, plans), trees.fit_forest(binned, FOREST)
    monkeypatch.setattr(trees, "ONE_TASK", 1000)
    got = trees.fit_boosted(binned, plans)
    assert alike(got["a"], want["a"]) and alike(got["b"], want["b"])
    assert alike(trees.fit_forest(binned, FOREST), want_forest)


def test_stages_and_messages_through_spark_change_nothing(binned, monkeypatch):
    monkeypatch.setattr(trees, "ONE_TASK", 1000)
    monkeypatch.setattr(trees, "SPREAD_STAGES", 1)
    plans = {"a": replace(SHARED, trees=2), "b": replace(FEW_LEAVES, trees=1)}
    one = trees.fit_boosted(binned, plans)
    two = trees.fit_boosted(binned, plans, stage=1)
    monkeypatch.setattr(spread_trees, "new_path", lambda *_: "elsewhere://store/messages")
    sent = trees.fit_boosted(binned, plans)
    for name in plans:
        assert trees.packed(one[name].trees) == trees.packed(two[name].trees) == trees.packed(sent[name].trees)


def batches(bins: np.ndarray, key: np.ndarray, y: np.ndarray, size: int):
    for i in range(0, len(key), size):
        part = slice(i, i + size)
        columns = {"key": pa.array(key[part].view(np.int64)), "bins": pa.array([r.tobytes() for r in bins[part]], pa.binary()), "y": y[part]}
        yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


@pytest.mark.parametrize("settings", [SHARED, replace(SHARED, row_share=1.0), FEW_LEAVES])
def test_blocks_tasks_and_order_change_no_bit(settings, monkeypatch):
    """Also with a task that got no rows, and nodes summed a few at a time."""
    rng = np.random.default_rng(5)
    n = 5000
    bins, key = rng.integers(0, 40, (n, 4)).astype(np.uint8), rng.integers(0, 2**62, n).astype(np.uint64)
    y = rng.normal(size=n) + (bins[:, 1] > 9)

    def grown(tasks: list[np.ndarray], block: int, chunk: int):
        monkeypatch.setattr(spread_trees, "BLOCK", block)
        monkeypatch.setattr(spread_trees.SpreadGrower, "chunk", chunk)
        parts = [spread_trees.Rows(batches(bins[t], key[t], y[t], 300), 4) for t in tasks]
        jobs = [spread_trees._boosting(p, settings, [], 0.3, settings.trees) for p in parts]
        value: list = [None] * len(jobs)
        while True:
            asked, ended = [], []
            for i, job in enumerate(jobs):
                try:
                    asked.append(job.send(value[i]))
                except StopIteration as end:
                    ended.append(end.value)
            if ended:
                assert len(ended) == len(jobs) and not asked
                return [trees.packed(e) for e in ended]
            merge = sum if asked[0][0] == "sum" else lambda all_: np.max(list(all_), axis=0)
            value = [merge(a for _, a in asked)] * len(jobs)

    whole = np.arange(n)
    want = grown([whole], 1 << 17, 1024)[0]
    dealt = rng.permutation(n)
    for got in grown([dealt[:1200], dealt[1200:1200], dealt[1200:]], 700, 3):
        assert got == want


def test_gains_are_not_sent_to_predict(spark, binned, monkeypatch):
    model = trees.fit_boosted(binned, {"m": SHARED})["m"]
    sent = []
    monkeypatch.setattr(trees.F, "pandas_udf", lambda kind: lambda f: sent.extend(f.__closure__) or (lambda *columns: F.lit(0)))
    trees.predictions([model], spark)
    (models,) = [c.cell_contents for c in sent if isinstance(c.cell_contents, list)]
    assert all(len(t.gain) == 0 for t in models[0].trees) and all(len(t.gain) for t in model.trees)
