from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterlight.functions.moments import co_moments, correlations
from meterlight.operators import eda


def table(spark, frame):
    kind = ", ".join(f"{c} double" for c in frame.columns)
    rows = [tuple(None if v != v else float(v) for v in row) for row in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, kind).repartition(5)


def odd_frame():
    rng = np.random.default_rng(3)
    a = rng.normal(size=900)
    frame = pd.DataFrame(
        {
            "a": a,
            "b": -2 * a + rng.normal(size=900),
            "far": 1e9 + rng.normal(size=900),  # a small spread about a large mean
            "tiny": 1e-150 * rng.normal(size=900),
            "holes": np.where(rng.random(900) < 0.4, np.nan, a + rng.normal(size=900)),
            "rare": np.where(np.arange(900) % 300 == 0, a, np.nan),
            "constant": 0.1,
            "constant_with": np.where(np.isin(np.arange(900) % 300, [0]), 7.0, a),  # over the rows of "rare"
            "nothing": np.nan,
        }
    )
    return frame


def test_every_pair_equals_pandas(spark):
    frame = odd_frame()
    found = correlations(table(spark, frame), list(frame.columns))
    expected = frame.corr()
    assert len(found) == 45
    for (x, y), r in found.items():
        if {x, y} & {"constant", "nothing"} or {x, y} == {"rare", "constant_with"}:
            assert r is None, (x, y)
        elif x == y:
            assert r == 1.0
        else:
            # Doubles near 1e9 hold seven digits of a spread of one, on both sides.
            assert r == pytest.approx(expected.loc[x, y], abs=1e-6 if "far" in (x, y) else 1e-10), (x, y)


def test_one_scan_and_a_row_for_each_pair(spark, tmp_path):
    table(spark, odd_frame()).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    plan = co_moments(stored, ["a", "holes"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "corr(" not in text
    assert plan.count() == 3


def test_order_of_rows_and_a_far_shift_change_rounding_only(spark):
    """The first rows lie far from the others, so the shift does."""
    rng = np.random.default_rng(5)
    x = np.append(np.full(2000, 1e4), rng.normal(size=6000))
    frame = pd.DataFrame({"x": x, "y": x * 0.5 + rng.normal(size=8000)})
    df = spark.createDataFrame([tuple(map(float, r)) for r in frame.to_numpy()], "x double, y double").coalesce(1)
    assert correlations(df, ["x", "y"])["x", "y"] == pytest.approx(frame.corr().loc["x", "y"], abs=1e-10)


def test_no_rows_and_text_columns(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert set(correlations(empty, ["a", "b"]).values()) == {None}
    text = spark.createDataFrame([("1", 2.0), ("x", 5.0), ("3", 1.0), (None, 0.0)], "a string, b double")
    pairs = {(r.x, r.y): r.r for r in eda.correlation_pairs(text, ["a", "b"]).collect()}
    assert pairs["a", "b"] == pytest.approx(-1.0) and pairs["a", "a"] == 1.0
