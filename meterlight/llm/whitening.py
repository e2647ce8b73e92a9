"""Whitening of embeddings by incremental eigendecomposition.

Components become integers x = floor(256 c). The fit list has each distinct x once; copies don't weigh.

1. The distinct vectors are stored. (Copies are merged before the shuffle, so a vector that a third of the rows hold is one
   row of each task.) They are dealt by a hash to tasks of some ROWS_OF_TASK, or more where that would be over four
   times the shuffle partitions.
2. Each task applies one centred rank-one update for each vector to a spectrum: count, exact sums, mean, eigenvalues and
   eigenvectors of the scatter. Updates solve secular equations with deflation (``secular``).
3. Spectra are merged in groups of FAN, each eigenpair being a rank-one update again, level by level until one is left.
   Every level is written to the shared folder; a task holds FAN matrices of size d x d.
4. Rayleigh-Ritz refinement: one more pass projects the exactly centred vectors (n x - S, in integers) on the
   approximate components and adds up their products, task by task and then in one aggregate of d (d + 1) / 2 numbers.
   The small eigenproblem of these sums turns the components by what the updates' rounding has left.
5. A last pass over the fit list measures how far the whitened components' covariance is from the identity.

The driver sees one spectrum and d (d + 1) / 2 sums, whatever the number of vectors. Each component's sign is such that its largest
entry is positive.

Rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are vectors that have not the
number of entries that most have (ties: the smaller number). Values of 256 c beyond the range of longs are cut to it. Repeated rows and
null ids are kept, each with its result. ``deviation`` is null where it doesn't fit a long. A component whose
eigenvalue is zero to working precision (one distinct vector, constant or dependent entries) has a null ``whitened`` and is left out of
``identity_error``, which is null if no component is left; ``explained`` is then null too, as the trace is 0. Vectors of
fewer than ``k`` entries have as many components as entries. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlight.llm.common import materialize, partitions, ship
from meterlight.llm.secular import EPS, Spectrum

SCALE = 256
ROWS_OF_TASK = 2048
FAN = 8
EXACT = 1 << 53
LONG = 1 << 63

SPECTRA = "part long, n long, sums array<string>, mean array<double>, values array<double>, vectors array<double>"


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def scaled(vector: Column) -> Column:
    """floor(256 c) of each entry, cut to the range of longs; never a negative zero."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + 0)


def _matrix(lists: pd.Series) -> np.ndarray:
    return np.stack(lists.to_numpy()).astype(np.int64)


def _sums(rows: np.ndarray) -> list[int]:
    """Exact sums of integer columns."""
    largest = max(abs(int(rows.max())), abs(int(rows.min())))
    if largest * len(rows) < LONG:
        return [int(s) for s in rows.sum(axis=0)]
    return [int(s) for s in rows.astype(object).sum(axis=0)]


def _row(part: int, spectrum: Spectrum, sums: list[int]) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "part": [part],
            "n": [spectrum.n],
            "sums": [[str(s) for s in sums]],
            "mean": [spectrum.mean],
            "values": [spectrum.values],
            "vectors": [spectrum.vectors.ravel()],
        }
    )


def _opened(row) -> tuple[Spectrum, list[int]]:
    size = len(row["mean"])
    out = Spectrum(size)
    out.n, out.mean = int(row["n"]), np.array(row["mean"], float)
    out.values = np.array(row["values"], float)
    out.vectors = np.array(row["vectors"], float).reshape(size, size)
    return out, [int(s) for s in row["sums"]]


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The spectrum of a task's vectors."""
    spectrum, sums = None, []
    for batch in batches:
        if not len(batch):
            continue
        rows = _matrix(batch["x"])
        spectrum = spectrum or Spectrum(rows.shape[1])
        own = _sums(rows)
        sums = [a + b for a, b in zip(sums, own)] if sums else own
        for row in rows.astype(float):
            spectrum.add(row)
    if spectrum:
        yield _row(TaskContext.get().partitionId(), spectrum, sums)


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """One spectrum for a group of at most FAN, in the order of their parts."""
    rows = rows.sort_values("part")
    total, sums = _opened(rows.iloc[0])
    for _, row in rows.iloc[1:].iterrows():
        other, more = _opened(row)
        total.merge(other)
        sums = [a + b for a, b in zip(sums, more)]
    total.tidy()
    return _row(int(rows["part"].iloc[0]) // FAN, total, sums)


def gather(fit_list: DataFrame, parts: int) -> tuple[Spectrum, list[int]] | None:
    """Spectrum and exact sums of all vectors ``x``, or None if there are none."""
    dealt = fit_list.repartition(parts, F.xxhash64("x"))
    spectra = materialize(dealt.mapInPandas(_gathered, SPECTRA), "spectra")
    while spectra.count() > 1:
        level = spectra.groupBy(F.floor(F.col("part") / FAN).alias("group")).applyInPandas(_merged, SPECTRA)
        spectra = materialize(level, "spectra")
    row = spectra.first()
    return _opened(row.asDict()) if row else None


def centred(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S in exact integers: longs, or Python's where longs don't hold them."""
    largest = max(abs(int(rows.max(initial=0))), abs(int(rows.min(initial=0))))
    if n * largest + max(map(abs, sums)) < LONG:
        return rows * n - np.array(sums, np.int64)
    return rows.astype(object) * n - np.array(sums, object)


def _deviations(away: np.ndarray) -> list[int | None]:
    """Sums of squares of the rows, exactly; None beyond a long."""
    if away.dtype != object and int(np.abs(away).max(initial=0)) ** 2 * away.shape[1] < LONG:
        return (away * away).sum(axis=1).tolist()
    near = (away.astype(float) ** 2).sum(axis=1)  # tells all but the closest to 2^63 by itself
    totals = [sum(int(v) * int(v) for v in row) if x < 1.01 * LONG else LONG for row, x in zip(away, near)]
    return [t if t < LONG else None for t in totals]


def _products(components: np.ndarray, n: int, sums: list[int]):
    """Sums of the products of the projections on ``components`` over a task's vectors."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((components.shape[1],) * 2)
        for batch in batches:
            if len(batch):
                own = centred(_matrix(batch["x"]), n, sums).astype(float) / n @ components
                total += own.T @ own
        i, j = np.triu_indices(len(total))
        yield pd.DataFrame({"i": i, "j": j, "value": total[i, j]})

    return add


def covariance(fit_list: DataFrame, components: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of the projections, from one pass."""
    parts = fit_list.mapInPandas(_products(components, n, sums), "i int, j int, value double")
    out = np.zeros((components.shape[1],) * 2)
    for r in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["value"] / n
    return out


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues of the covariance, falling
    vectors: np.ndarray  # a column for each
    trace: float
    error: float | None  # of the first `kept` components' whitened covariance
    kept: int

    @property
    def weighted(self) -> np.ndarray:
        """Which of the first components have an eigenvalue above zero."""
        return self.values[: self.kept] > len(self.values) * EPS * self.trace


def refine(fit_list: DataFrame, spectrum: Spectrum, sums: list[int], k: int) -> Whitening:
    """Rayleigh-Ritz refinement of all components of a spectrum."""
    basis = np.linalg.qr(spectrum.vectors[:, ::-1])[0]
    small = covariance(fit_list, basis, spectrum.n, sums)
    values, turn = np.linalg.eigh(small)
    values, vectors = values[::-1], basis @ turn[:, ::-1]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))]
    vectors = vectors * np.where(largest < 0, -1.0, 1.0)
    out = Whitening(spectrum.n, sums, values, vectors, float(values.sum()), None, min(k, len(values)))
    if out.weighted.any():
        some = np.flatnonzero(out.weighted)
        scaled_components = vectors[:, some] / np.sqrt(values[some])
        there = covariance(fit_list, scaled_components, out.n, sums)
        out.error = float(np.abs(there - np.eye(len(some))).max())
    return out


def fit(vectors: DataFrame, k: int = 4) -> Whitening | None:
    """Components of the distinct vectors ``x``."""
    ship(vectors.sparkSession)
    fit_list, seen = materialize(vectors.select("x").distinct(), "fit-list", {"n": F.count("*")})
    parts = max(1, min(-(-seen["n"] // ROWS_OF_TASK), 4 * partitions(vectors.sparkSession)))
    found = gather(fit_list, parts)
    return refine(fit_list, *found, k) if found else None


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whitened(model: Whitening):
    def whiten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, fine = model.kept, model.weighted
        scale = np.where(fine, np.sqrt(np.where(fine, model.values[:k], 1.0)), np.nan)
        explained = np.maximum(model.values[:k], 0) / model.trace if model.trace > 0 else np.full(k, np.nan)
        for batch in batches:
            if not len(batch):
                continue
            away = centred(_matrix(batch["x"]), model.n, model.sums)
            white = away.astype(float) / model.n @ model.vectors[:, :k] / scale
            out = pd.DataFrame(
                {
                    "vec_id": np.repeat(batch["vec_id"].astype("Int64").array, k),
                    "component": np.tile(np.arange(1, k + 1), len(batch)),
                    "n": model.n,
                    "deviation": pd.array(_deviations(away), "Int64").repeat(k),
                    "whitened": pd.array(white.ravel(), "Float64"),
                    "explained": pd.array(np.tile(explained, len(batch)), "Float64"),
                }
            )
            for name in ("whitened", "explained"):
                out.loc[out[name].isna() | np.isnan(out[name].astype(float)), name] = pd.NA
            out["identity_error"] = model.error
            yield out

    return whiten


def prepared(table: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id`` and the integer vector ``x`` of the rows that take part."""
    rows = table.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    rows = rows.where(usable(F.col("vector"))).select("vec_id", scaled(F.col("vector")).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("rows"))
    usual = sizes.orderBy(F.desc("rows"), "size").first()
    return rows.where(F.size("x") == (usual["size"] if usual else 0))


def whiten(table: DataFrame, k: int = 4, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each row's first ``k`` whitened components, with figures of the fit (``RESULT``)."""
    rows = prepared(table, id, vector)
    model = fit(rows, k)
    if model is None:
        return table.sparkSession.createDataFrame([], RESULT)
    return rows.mapInPandas(_whitened(model), RESULT)
