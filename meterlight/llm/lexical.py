"""Ranked lexical search by dense blocked matrix products with exact integer scores.

Every item of a query set is ranked against all documents. A document's score for an item is the sum, over the item's
distinct terms, of the term's weight times the term's impact in the document; both are integers.

1. The items are dealt into batches by a hash of their row, so that a batch has about TERMS_OF_BATCH terms; its
   vocabulary and its items' terms go to every task. Batches are searched one after the other, so a query set of any
   size needs no larger broadcast. (One item's own terms are never parted.)
2. One pass over the documents counts each text's terms, and the vocabulary's terms among them. These counts, a small
   part of the text, are stored. N, L and the terms' document counts are sums over them.
3. A second pass goes over the stored counts in tiles of TILE_DOCUMENTS documents. For each tile of items, the
   vocabulary is compacted to the terms these items have, and taken TILE_TERMS terms at a time: one BLAS product of
   the documents' impacts and the items' weights, in float64. Products and sums are integers. A tile of terms is made
   small enough for its sums to stay below 2^53, where float64 is exact (``terms_of_tile``); tiles add as 64-bit integers.
4. A task keeps each item's ``k`` best documents: all that reach the ``k``-th score of a tile stay until ties are cut by
   ``doc_id``. Only these leave the task; a window, with the limit pushed below the shuffle, merges them.

What a task holds: the batch's items, one tile of each matrix, and ``k`` rows for each item. Weights follow the definition in
doubles; a term that no document has weighs nothing, as no document scores by it.

Null texts and texts without a term count in neither N nor L and are never returned, nor are scores of 0. Items without
terms (null, empty) have no rows. Null ``doc_id`` come last among equal scores; repeated documents are ranked each,
in any order among themselves. Items are rows: repeated ``item_id`` (or null) are ranked each. Empty tables give an
empty result. Texts are read whole, whatever their length. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlight.llm.common import materialize, ship, slices, text_bytes

TERMS_OF_BATCH = 200_000
TILE_DOCUMENTS = 1024
TILE_ITEMS = 256
TILE_TERMS = 2048
EXACT = 1 << 53
#: Greatest impact of a term: 10^9 tf div (1000 tf + 8 m) is below 10^6, as m is at least 10.
TOP_IMPACT = 10**6

#: Bytes between terms, and capital letters, as the contract of the query has them.
_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes.maketrans(_SEPARATORS + bytes(range(0x41, 0x5B)), b" " * len(_SEPARATORS) + bytes(range(0x61, 0x7B)))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, lower-cased from A to Z only."""
    return text.translate(_FOLD).split()


COUNTS = "doc_id long, n long, term array<int>, tf array<long>"


def _counted(vocabulary: dict[bytes, int]):
    """Number of terms of each text, and how often it has those of the vocabulary."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, texts in slices(batch["text"]):
                rows = []
                for text in texts:
                    own = terms(text)
                    found = Counter(map(vocabulary.get, own))
                    found.pop(None, None)
                    term = np.fromiter(found, np.int32, len(found))
                    rows.append((len(own), term, np.fromiter(found.values(), np.int64, len(found))))
                out = pd.DataFrame(rows, columns=["n", "term", "tf"])
                out.insert(0, "doc_id", batch["doc_id"].iloc[first : first + len(texts)].astype("Int64").to_numpy())
                yield out

    return count


def weights(n_documents: int, held_by: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))), in doubles."""
    return np.array([math.floor(1000 * math.log((2 * n_documents + 2) / (2 * int(d) + 1))) for d in held_by], np.int64)


def terms_of_tile(top_weight: int, top_impact: int = TOP_IMPACT, most: int = TILE_TERMS) -> int:
    """So many terms that a sum of as many products stays below 2^53."""
    return max(1, min(most, (EXACT - 1) // max(1, top_weight * top_impact)))


def impacts(tf: np.ndarray, n: np.ndarray, n_documents: int, n_terms: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 8 m), m = 10 + (90 n N) div L; Python's integers where 64 bits might not do."""
    if int(n.max(initial=0)) * 90 * max(1, n_documents) < 1 << 63:
        m = 10 + 90 * n * n_documents // n_terms
    else:
        m = np.array([10 + 90 * int(x) * n_documents // n_terms for x in n], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class ItemTile:
    """Some items over the compact vocabulary of just their terms."""

    def __init__(self, items: np.ndarray, lists: list[np.ndarray], weight: np.ndarray):
        self.items = items
        sizes = np.array([len(x) for x in lists], np.int64)
        flat = np.concatenate(lists)
        self.vocabulary = np.unique(flat)
        self._at = np.repeat(np.arange(len(lists)), sizes), np.searchsorted(self.vocabulary, flat)
        self._weight = weight[flat].astype(np.float64)

    def matrix(self, first: int, after: int) -> np.ndarray:
        """Weights of the terms from ``first`` on: term × item."""
        row, column = self._at
        some = (column >= first) & (column < after)
        out = np.zeros((after - first, len(self.items)))
        out[column[some] - first, row[some]] = self._weight[some]
        return out

    def scores(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, step: int) -> np.ndarray:
        """Document × item, as 64-bit integers."""
        column = np.minimum(np.searchsorted(self.vocabulary, term), len(self.vocabulary) - 1)
        known = self.vocabulary[column] == term
        doc, column, impact = doc[known], column[known], impact[known].astype(np.float64)
        total = np.zeros((n_docs, len(self.items)), np.int64)
        for first in range(0, len(self.vocabulary), step):
            after = min(first + step, len(self.vocabulary))
            some = slice(None) if step >= len(self.vocabulary) else (column >= first) & (column < after)
            dense = np.zeros((n_docs, after - first))
            dense[doc[some], column[some] - first] = impact[some]
            total += (dense @ self.matrix(first, after)).astype(np.int64)
        return total


class Best:
    """The ``k`` best documents of each item of a tile: scores, and ids with nulls last."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.score = np.zeros((n_items, k), np.int64)
        self.id = np.zeros((n_items, k), np.int64)
        self.null = np.ones((n_items, k), bool)

    def add(self, score: np.ndarray, id: np.ndarray, null: np.ndarray) -> None:
        """Scores are document × item."""
        if len(score) > self.k:
            edge = np.partition(score, len(score) - self.k, axis=0)[-self.k]
        else:
            edge = np.zeros(score.shape[1], np.int64)
        edge = np.maximum(np.maximum(edge, self.score[:, -1]), 1)
        doc, item = np.nonzero(score >= edge)  # ties at the edge all come along
        order = np.argsort(item, kind="stable")
        doc, item = doc[order], item[order]
        for i, a, b in zip(*_runs(item)):
            some = doc[a:b]
            s = np.concatenate([self.score[i], score[some, i]])
            d = np.concatenate([self.id[i], id[some]])
            z = np.concatenate([self.null[i], null[some]])
            best = np.lexsort((d, z, -s))[: self.k]
            self.score[i], self.id[i], self.null[i] = s[best], d[best], z[best]


def _runs(values: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Each run of equal values: the value, where it begins and where it ends."""
    if not len(values):
        return [], [], []
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(values)]


FOUND = "item int, doc_id long, score long"


def _searched(lists: list[np.ndarray], weight: np.ndarray, n_documents: int, n_terms: int, k: int):
    """The best documents of each item, by number, among those of a task."""
    step = terms_of_tile(int(weight.max(initial=0)))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tiles = []
        for first in range(0, len(lists), TILE_ITEMS):
            some = lists[first : first + TILE_ITEMS]
            tile = ItemTile(np.arange(first, first + len(some)), some, weight)
            tiles.append((tile, Best(len(some), k)))
        for batch in batches:
            for first in range(0, len(batch), TILE_DOCUMENTS):
                part = batch.iloc[first : first + TILE_DOCUMENTS]
                sizes = part["term"].map(len).to_numpy(np.int64)
                if not sizes.sum():
                    continue
                term = np.concatenate(part["term"].to_list()).astype(np.int64)
                tf = np.concatenate(part["tf"].to_list()).astype(np.int64)
                doc = np.repeat(np.arange(len(part)), sizes)
                impact = impacts(tf, part["n"].to_numpy(np.int64)[doc], n_documents, n_terms)
                null = part["doc_id"].isna().to_numpy()
                id = part["doc_id"].fillna(0).to_numpy(np.int64)
                for tile, best in tiles:
                    best.add(tile.scores(doc, term, impact, len(part), step), id, null)
        for tile, best in tiles:
            row, column = np.nonzero(best.score > 0)
            ids = pd.array(best.id[row, column], "Int64")
            ids[best.null[row, column]] = pd.NA
            yield pd.DataFrame({"item": tile.items[row], "doc_id": ids, "score": best.score[row, column]})

    return search


def _item_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        own = [sorted(set(terms(text))) for text in batch["text"]]
        yield pd.DataFrame({"item_id": batch["item_id"].astype("Int64"), "terms": own})


def _batch(counts: DataFrame, lists: list[np.ndarray], held_by: np.ndarray, n: int, length: int, k: int) -> DataFrame:
    held = counts.where(F.size("term") > 0)
    found = held.mapInPandas(_searched(lists, weights(n, held_by), n, length, k), FOUND)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, batch_terms: int = TERMS_OF_BATCH) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of each item's ``k`` best documents."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("text"))
    asked = asked.mapInPandas(_item_terms, "item_id long, terms array<binary>").where(F.size("terms") > 0)
    asked, seen = materialize(asked, "item-terms", {"terms": F.sum(F.size("terms"))})
    batches = max(1, -(-(seen["terms"] or 0) // batch_terms))
    asked = asked.withColumn("batch", F.pmod(F.xxhash64("item_id", "terms"), F.lit(batches)))
    results = []
    for number in range(batches):
        rows = asked.where(F.col("batch") == number).select("item_id", "terms").collect()
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r["terms"]}))}
        lists = [np.array([vocabulary[bytes(t)] for t in r["terms"]], np.int64) for r in rows]
        measures = {"documents": F.count_if(F.col("n") > 0), "terms": F.sum("n")}
        counts, sums = materialize(texts.mapInPandas(_counted(vocabulary), COUNTS), "term-counts", measures)
        held_by = np.zeros(len(vocabulary), np.int64)
        held = counts.select(F.explode("term").alias("term")).groupBy("term").count()
        for r in held.collect():  # at most the vocabulary
            held_by[r["term"]] = r["count"]
        found = _batch(counts, lists, held_by, sums["documents"] or 0, sums["terms"] or 0, k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item int, item_id long")
        results.append(found.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out


# ---- the same in SQL --------------------------------------------------------------------


def sql(k: int = 10) -> str:
    """``rank_documents`` over ``documents`` and ``benchmark``, for DuckDB."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    split = f"regexp_extract_all(translate(text, '{upper}', '{lower}'), '{pattern}')"
    return f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS d, doc_id, {split} AS w FROM documents
), sums AS (
  SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM docs WHERE len(w) > 0
), tfs AS MATERIALIZED (
  SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(w) AS t FROM docs) AS words GROUP BY d, t
), dfs AS (
  SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM tfs, sums GROUP BY t, n_docs
), items AS MATERIALIZED (
  SELECT row_number() OVER () AS i, item_id, list_distinct({split}) AS w FROM benchmark
), asked AS (
  SELECT i, unnest(w) AS t FROM items
), scores AS (
  SELECT i, d, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(w) * n_docs) // n_terms)))) AS BIGINT)
    AS score
  FROM asked JOIN dfs USING (t) JOIN tfs USING (t) JOIN docs USING (d), sums GROUP BY i, d
), ranked AS (
  SELECT item_id, i, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM scores JOIN docs USING (d) JOIN items USING (i) WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {k}"""
