"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Nearness by inner product becomes Euclidean nearness by one more component: candidates are
scaled by the greatest norm and completed to norm 1, queries are scaled to norm 1. A table
hashes a vector with ``functions`` p-stable (Gaussian) projections, cut into cells of ``width``.
A query looks into its own bucket and into buckets reached by perturbing cells by one. The
chance that a near vector lies one cell further falls with the square of the distance to that
cell's edge, so perturbations are visited in order of their sum of squared distances, which
estimates how likely they are to succeed. Candidates of all tables are merged and ranked by
their exact inner products, in double precision.

How many perturbations are visited is fitted on a sample of at most SAMPLE rows: the fewest of
PROBES that find TARGET of the sample's neighbours. Neighbours are nearer in the whole table
than in the sample, so that is on the safe side. Every row is indexed, in every table. If all of
them are too few (uneven norms, far neighbours), every query meets every candidate instead, in
blocks, and the result is exact.

Candidates are dealt to tasks by a hash of the vector, queries to all tasks in blocks, and only
a query's best ``k`` leave a task. A bucket is thus split evenly over the tasks of its table,
so nearly equal vectors fill no task. Vectors that are equal to the last bit share one candidate with their
``k + 1`` smallest ids. No query can return more of them, so nothing is lost, and a vector that
many rows have fills no bucket.

A vector that is null, zero, or holds null or non-finite components takes no part, nor one that
has not as many components as most. Ties go to the smaller id. A query's own id is no candidate
for it, in repeated rows neither. An empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlight.llm.common import materialize, ship

TABLES = 4
FUNCTIONS = 8
WIDTH = 1.5
SAMPLE = 4096
SAMPLE_QUERIES = 256
TARGET = 0.95
PROBES = (50, 100, 200, 400, 800, 1200, 1600, 2200, 3000, 4000, 5200, 6561)
CANDIDATES_OF_TASK = 25_000
QUERIES_OF_BLOCK = 100_000
AT_ONCE = 512


def valid(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass
class Index:
    projections: np.ndarray  # table × function × component
    shifts: np.ndarray  # table × function
    norm: float
    probes: int | None = 1  # None: every query meets every candidate

    @property
    def tables(self) -> int:
        return 1 if self.probes is None else len(self.projections)

    def candidates(self, vectors: np.ndarray) -> np.ndarray:
        scaled = vectors / self.norm
        rest = np.sqrt(np.maximum(0.0, 1 - (scaled * scaled).sum(axis=1)))
        return np.hstack([scaled, rest[:, None]])

    @staticmethod
    def queries(vectors: np.ndarray) -> np.ndarray:
        scaled = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.hstack([scaled, np.zeros((len(vectors), 1))])

    def hashed(self, table: int, points: np.ndarray) -> np.ndarray:
        return points @ self.projections[table].T / WIDTH + self.shifts[table]


_TEMPLATE = np.array(list(product((0, -1, 1), repeat=FUNCTIONS)), np.int64)
_LOWER = (_TEMPLATE == -1).astype(float)
_UPPER = (_TEMPLATE == 1).astype(float)


def codes(cells: np.ndarray) -> np.ndarray:
    """One number for each row of cells; a cell is kept modulo 256."""
    out = np.zeros(len(cells), np.uint64)
    for f in range(cells.shape[1]):
        out = (out << np.uint64(8)) | (cells[:, f] & 255).astype(np.uint64)
    return out


def probed(hashed: np.ndarray, probes: int) -> np.ndarray:
    """Codes of the buckets that each query visits, the likeliest first."""
    cells = np.floor(hashed)
    low = hashed - cells
    cost = (low**2) @ _LOWER.T + ((1 - low) ** 2) @ _UPPER.T
    if probes < len(_TEMPLATE):
        some = np.argpartition(cost, probes - 1, axis=1)[:, :probes]
    else:
        some = np.tile(np.arange(len(_TEMPLATE)), (len(hashed), 1))
    order = np.argsort(np.take_along_axis(cost, some, axis=1), axis=1, kind="stable")
    visited = np.take_along_axis(some, order, axis=1)
    reached = cells.astype(np.int64)[:, None, :] + _TEMPLATE[visited]
    return codes(reached.reshape(-1, cells.shape[1])).reshape(len(hashed), -1)


def _recall(index: Index, vectors: np.ndarray, k: int, seed: int) -> int | None:
    """The fewest probes that find TARGET of the neighbours within the sample, if any do."""
    rng = np.random.default_rng(seed)
    chosen = rng.permutation(len(vectors))[:SAMPLE_QUERIES]
    exact = vectors[chosen] @ vectors.T
    exact[np.arange(len(chosen)), chosen] = -np.inf
    k = min(k, len(vectors) - 1)
    if k < 1:
        return PROBES[0]
    nearest = np.argpartition(-exact, k - 1, axis=1)[:, :k]
    place = np.full((len(chosen), k), len(_TEMPLATE) + 1)
    own, asking = index.candidates(vectors), index.queries(vectors[chosen])
    for t in range(len(index.projections)):
        there = codes(np.floor(index.hashed(t, own)).astype(np.int64))
        for at in range(0, len(chosen), 32):
            visits = probed(index.hashed(t, asking[at : at + 32]), len(_TEMPLATE))
            for i, row in enumerate(visits):
                order = np.argsort(row)
                wanted = there[nearest[at + i]]
                found = np.minimum(np.searchsorted(row[order], wanted), len(row) - 1)
                rank = np.where(row[order][found] == wanted, order[found], len(_TEMPLATE) + 1)
                place[at + i] = np.minimum(place[at + i], rank)
    for probes in PROBES:
        if (place < probes).mean() >= TARGET:
            return probes
    return None


def fit(vectors: DataFrame, k: int, seed: int = 42) -> Index:
    """Projections, and the number of probes, from the greatest norm and a sample."""
    norms = F.aggregate(
        "vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")
    )
    seen = vectors.agg(
        F.max(F.sqrt(norms)).alias("norm"), F.max(F.size("vector")).alias("size"), F.count("*").alias("n")
    ).first()
    rng = np.random.default_rng(seed)
    size = (seen["size"] or 1) + 1
    index = Index(
        rng.normal(size=(TABLES, FUNCTIONS, size)), rng.random((TABLES, FUNCTIONS)), seen["norm"] or 1.0
    )
    chance = F.pmod(F.xxhash64(F.lit(seed), "vector"), F.lit(1 << 30)) / float(1 << 30)
    sample = vectors.where(chance < SAMPLE / max(1, seen["n"])).select("vector").limit(2 * SAMPLE)
    rows = np.array([r["vector"] for r in sample.collect()], float)
    if len(rows):
        index.probes = _recall(index, np.unique(rows, axis=0)[:SAMPLE], k, seed)
    return index


def dealt(distinct: DataFrame, groups: int) -> DataFrame:
    """The part of a table's tasks that each vector goes to, evenly however alike they are."""
    return distinct.withColumn("part", F.pmod(F.xxhash64("vector"), F.lit(groups)).cast("int"))


def _entered(index: Index, groups: int, blocks: int):
    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            vectors = np.stack(batch["vector"].to_numpy()).astype(float)
            points = index.candidates(vectors)
            for t in range(index.tables):
                code = codes(np.floor(index.hashed(t, points)).astype(np.int64))
                task = t * groups + batch["part"]
                for block in range(blocks):
                    yield pd.DataFrame(
                        {
                            "task": task,
                            "block": block,
                            "code": code.view(np.int64),
                            "vector": batch["vector"],
                            "ids": batch["ids"],
                        }
                    )

    return enter


def _searched(index: Index, groups: int, k: int):
    def search(key, asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(asked) or not len(rows):
            return pd.DataFrame({c: [] for c in columns})
        table = int(key[0]) // groups
        rows = rows.iloc[np.argsort(rows["code"].to_numpy(np.int64).view(np.uint64), kind="stable")]
        code = rows["code"].to_numpy(np.int64).view(np.uint64)
        vectors = np.stack(rows["vector"].to_numpy()).astype(float)
        ids = rows["ids"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        ends = np.append(starts[1:], len(code))
        buckets = code[starts]
        queries = np.stack(asked["vector"].to_numpy()).astype(float)
        names = asked["query_id"].to_numpy(np.int64)
        out = []
        for at in range(0, len(queries), AT_ONCE):
            own = queries[at : at + AT_ONCE]
            if index.probes is None:
                near = own @ vectors.T
            else:
                near = np.full((len(own), len(vectors)), -np.inf)
                visits = probed(index.hashed(table, index.queries(own)), index.probes)
                slot = np.minimum(np.searchsorted(buckets, visits), len(buckets) - 1)
                who, which = np.nonzero(buckets[slot] == visits)
                bucket = slot[who, which]
                order = np.argsort(bucket, kind="stable")
                who, bucket = who[order], bucket[order]
                edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(who) else []
                for a, b in zip(edges, [*edges[1:], len(who)]):
                    s, e = starts[bucket[a]], ends[bucket[a]]
                    near[who[a:b], s:e] = own[who[a:b]] @ vectors[s:e].T
            most = min(k + 8, len(vectors))
            best = np.argpartition(-near, most - 1, axis=1)[:, :most]
            for i, some in enumerate(best):
                some = some[near[i, some] > -np.inf]
                score = (vectors[some] * own[i]).sum(axis=1)
                found = np.concatenate([ids[j] for j in some]) if len(some) else np.empty(0, np.int64)
                score = np.repeat(score, [len(ids[j]) for j in some])
                other = found != names[at + i]
                found, score = found[other], score[other]
                order = np.lexsort((found, -score))[:k]
                out.append((np.full(len(order), names[at + i]), found[order], score[order]))
        return pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*out)))))

    return search


def nearest(
    table: DataFrame, is_query: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of each query's ``k`` nearest found."""
    spark = table.sparkSession
    ship(spark)
    usable = table.select(
        F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"), is_query.alias("asks")
    ).where(F.col("id").isNotNull() & valid(F.col("vector")))
    sizes = usable.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"))
    usual = sizes.orderBy(F.desc("n"), "size").first()
    usable = usable.where(F.size("vector") == (usual["size"] if usual else 0))
    same = Window.partitionBy("vector").orderBy("id")
    smallest = usable.select("vector", "id").withColumn("n", F.row_number().over(same))
    distinct = smallest.where(F.col("n") <= k + 1).groupBy("vector")
    distinct = materialize(distinct.agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    index = fit(distinct, k)
    n, n_queries = distinct.count(), usable.where("asks").count()
    groups = max(2, -(-n // CANDIDATES_OF_TASK))
    blocks = max(1, -(-n_queries // QUERIES_OF_BLOCK))
    kind = distinct.schema["vector"].dataType.simpleString()
    rows = dealt(distinct, groups).mapInPandas(
        _entered(index, groups, blocks),
        f"task int, block int, code long, vector {kind}, ids array<long>",
    )
    asked = usable.where("asks").select(
        F.explode(F.sequence(F.lit(0), F.lit(index.tables * groups - 1))).alias("task"),
        F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"),
        F.col("id").alias("query_id"),
        "vector",
    )
    found = asked.groupBy("task", "block").cogroup(rows.groupBy("task", "block"))
    found = found.applyInPandas(
        _searched(index, groups, k), "query_id long, vec_id long, score double"
    )
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
