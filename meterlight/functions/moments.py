"""Correlations of many columns from one mergeable matrix of co-moments.

A task holds a block of rows as a matrix X, nulls as zero, and the mask M of its values. Five products give all pairs'
sums over the rows that have both values: M'M the counts, X'M and (X * X)'M the sums and the squares, X'X the products.
The tasks' sums are added pair by pair, so the table is scanned once, with and without nulls, and no expression
is written for a pair. A task keeps five matrices of columns x columns and hands on a row for each pair.

Values are taken relative to a shift near them, so that a large mean doesn't swallow a small spread. It comes from the
table's first rows and changes a result by rounding only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.session import ship

SHIFT_ROWS = 1000
#: A variance below this share of the mean square (about the shift) is rounding: the values are constant.
ROUNDING = 1e-13
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
PAIR_SUMS = f"x int, y int, {', '.join(f'{s} double' for s in SUMS)}, low double, high double"


def co_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each unordered pair of places in ``columns``: the sums over rows with both values, and for a column
    with itself its least and greatest value."""
    ship(df.sparkSession)
    data = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    first = pd.DataFrame(data.limit(SHIFT_ROWS).collect(), columns=data.columns, dtype="float64")
    shift = first.mean().fillna(0.0).to_numpy()
    shift = np.where(np.isfinite(shift), shift, 0.0)
    pairs = np.array(list(combinations_with_replacement(range(len(columns)), 2)), int).reshape(-1, 2)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = len(shift)
        counts, plain, squares, products = (np.zeros((d, d)) for _ in range(4))
        low, high = np.full(d, np.inf), np.full(d, -np.inf)
        for batch in batches:
            values = batch.to_numpy("float64", na_value=np.nan)
            mask = (~np.isnan(values)).astype("float64")
            if len(values):
                low = np.fmin(low, np.fmin.reduce(values, axis=0))
                high = np.fmax(high, np.fmax.reduce(values, axis=0))
            x = np.where(mask > 0, values - shift, 0.0)
            counts += mask.T @ mask
            plain += x.T @ mask
            squares += (x * x).T @ mask
            products += x.T @ x
        i, j = pairs.T
        yield pd.DataFrame(
            {
                "x": i,
                "y": j,
                "n": counts[i, j],
                "sx": plain[i, j],
                "sy": plain[j, i],
                "sxx": squares[i, j],
                "syy": squares[j, i],
                "sxy": products[i, j],
                "low": np.where((i == j) & np.isfinite(low[i]), low[i], np.nan),
                "high": np.where((i == j) & np.isfinite(high[i]), high[i], np.nan),
            }
        )

    rows = data.mapInPandas(sums, PAIR_SUMS)
    ends = (F.min(F.nanvl("low", F.lit(None))).alias("low"), F.max(F.nanvl("high", F.lit(None))).alias("high"))
    return rows.groupBy("x", "y").agg(*[F.sum(s).alias(s) for s in SUMS], *ends)


def correlations(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float | None]:
    """Pearson correlation of every unordered pair over the rows that have both values, a column with itself included.

    None where either column is constant in the table or over those rows. Infinite values give NaN. The driver
    holds a row for each pair.
    """
    found = {(r.x, r.y): r for r in co_moments(df, columns).collect()}
    varies = {
        i for i in range(len(columns))
        if (r := found.get((i, i))) and r.low is not None and r.low < r.high
    }
    out: dict[tuple[str, str], float | None] = {}
    for x, y in combinations_with_replacement(range(len(columns)), 2):
        value = None
        if {x, y} <= varies:
            value = 1.0 if x == y else _pearson(found[x, y])
        out[columns[x], columns[y]] = value
    return out


def _pearson(r) -> float | None:
    if not r.n:
        return None
    of_x, of_y = r.sxx - r.sx * r.sx / r.n, r.syy - r.sy * r.sy / r.n
    if of_x <= ROUNDING * r.sxx or of_y <= ROUNDING * r.syy:
        return None
    return float((r.sxy - r.sx * r.sy / r.n) / np.sqrt(of_x) / np.sqrt(of_y))
