"""K-means from many starts and silhouettes, against MLlib and brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from meterlight.operators import clusters, profiles


def blobs(n: int = 400, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 4)) * 3
    return centres[rng.integers(0, 5, n)] + rng.normal(size=(n, 4))


def vectors(spark, x: np.ndarray):
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(3)
    return rows.select(array_to_vector("x").alias("features"))


def plain_silhouette(x: np.ndarray, label: np.ndarray) -> float:
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    total = 0.0
    for i in range(len(x)):
        own = label == label[i]
        if own.sum() == 1 or own.all():
            continue
        a = gap[i, own].sum() / (own.sum() - 1)
        b = min(gap[i, label == c].mean() for c in set(label) - {label[i]})
        total += (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return total / len(x)


def test_inertia_is_not_above_mllib(spark):
    for x, ks in ((blobs(), (2, 6)), (np.random.default_rng(3).normal(size=(300, 3)), (4,))):
        table = vectors(spark, x).cache()
        found = profiles.fit_kmeans(table, ks, 10)
        for k, model in found.items():
            other = min(KMeans(k=k, seed=s, maxIter=50).fit(table).summary.trainingCost for s in range(42, 52))
            assert model.inertia <= other * 1.002
            own = ((x[:, None] - model.centres[None]) ** 2).sum(axis=2)
            assert model.inertia == pytest.approx(own.min(axis=1).sum())
            got = model.transform(table).select("features", "prediction").collect()
            for r in got:
                gaps = ((r["features"].toArray() - model.centres) ** 2).sum(axis=1)
                assert gaps[r["prediction"]] == pytest.approx(gaps.min())


def test_all_fits_share_the_scans(spark, monkeypatch):
    scans = []
    scan = clusters._scan
    monkeypatch.setattr(clusters, "_scan", lambda t, fits: scans.append(len(fits)) or scan(t, fits))
    fits = [(k, seed) for k in range(2, 9) for seed in range(10)]
    models = clusters.fit_all(vectors(spark, blobs()), fits)
    assert len(models) == 70 and len(scans) <= clusters.MOST_SCANS + 1
    assert scans[0] == 70 and scans[-2] < 70  # fits drop out as their centres stand still
    alone = clusters.fit_all(vectors(spark, blobs()), [(4, 3)])[0]
    assert alone.inertia == pytest.approx(models[fits.index((4, 3))].inertia)


def test_few_and_equal_rows(spark):
    one = clusters.fit_all(vectors(spark, np.ones((6, 2))), [(3, 1)])[0]
    assert one.inertia == 0 and one.centres.shape == (3, 2)
    with pytest.raises(ValueError, match="no rows"):
        clusters.fit_all(vectors(spark, np.ones((1, 2))).limit(0), [(2, 1)])


def labelled(spark, x, labels):
    rows = [(v.tolist(), [int(i) for i in own]) for v, own in zip(x, np.transpose(labels))]
    return spark.createDataFrame(rows, "x array<double>, labels array<int>").repartition(3)


def test_silhouettes_are_exact_for_few_rows_and_bounded_for_many(spark):
    x = np.concatenate([blobs(300), np.repeat(blobs(2, seed=9), 20, axis=0)])
    rng = np.random.default_rng(2)
    near = ((x[:, None] - blobs(4, seed=4)[None]) ** 2).sum(axis=2).argmin(axis=1)
    lone = np.where(np.arange(len(x)) == 5, 7, near)
    labels = [near, rng.integers(0, 3, len(x)), lone, np.zeros(len(x), int)]
    want = [plain_silhouette(x, own) for own in labels]
    table = labelled(spark, x, labels)
    for got, value in zip(clusters.silhouettes(table), want):
        assert got.value == pytest.approx(value, abs=1e-9) and got.bound < 1e-7
    last = None
    for seeds in (10, 60):
        found = clusters.silhouettes(table, most_seeds=seeds)
        for got, value in zip(found, want):
            assert abs(got.value - value) <= got.bound + 1e-9
        assert found[0].bound < 0.3 and (last is None or found[0].bound < last)
        last = found[0].bound
    assert clusters.silhouettes(table.limit(0)) == []


def test_saved_and_loaded(spark, tmp_path):
    model = clusters.fit_all(vectors(spark, blobs()), [(3, 1)])[0]
    again = clusters.ClusterModel.load(spark, model.save(spark, str(tmp_path / "m")))
    assert (again.centres == model.centres).all() and again.inertia == model.inertia
    table = vectors(spark, blobs(50, seed=7))
    both = model.transform(table).withColumnRenamed("prediction", "before")
    assert again.transform(both).where(F.col("before") != F.col("prediction")).count() == 0
