"""SimHash near-duplicates found through chains of segments (pigeonring filter).

A fingerprint has 64 bits: a bit is 1 if it is set in more than half of the XXH64 values
(seed 42) of a text's shingles. Lower case for A-Z, words of other characters than space and
9 to 13, joined by a space.

Two fingerprints at most ``distance`` bits apart are cut into ``segments`` equal segments, seen
as a ring. The pigeonring principle says that from some segment on, every chain of k consecutive
segments differs in at most k * distance / segments bits. While that bound is below one, the
chain's segments are equal; this leading chain is the join key. In a bucket of equal keys the
longer chains' budgets prune the pairs, and the whole Hamming distance is checked on the rest.

Fingerprints are joined once each, however many documents share them. A bucket of at most ``pairwise`` fingerprints is
worked through in one task and gives a spanning set of links, never all its pairs. The fingerprints of a larger one pass
through its task and are dealt anew: each is entered with every single bit outside the key flipped, and those at most
``distance`` apart meet in an entry, which has at most 41 members. Both ways link the same fingerprints. Distances above
2 have the first way only, so that there a bucket is one task however large it is.

Null and empty texts have fingerprint zero and are linked like any other. Repeated rows and
ties are members like others; a null ``doc_id`` is a member but never a class's smallest id
(unless there is no other). An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlight.llm.common import as_json, materialize, ship, slices, text_bytes
from meterlight.llm.components import components

SEED = 42
BITS = 64


def _printed(texts: list[bytes], shingle: int) -> np.ndarray:
    """Fingerprints of texts, as 64-bit numbers."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        n = max(1, len(words) - shingle + 1)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths) - 1
        starts = ends + 1 - lengths
        last = ends[min(shingle, len(words)) - 1 :].tolist()
        hashes = np.fromiter(
            (xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last)),
            np.uint64,
            n,
        )
        ones = np.zeros(BITS, np.int64)
        for at in range(0, n, 1 << 16):
            part = hashes[at : at + (1 << 16)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(
                axis=0, dtype=np.int64
            )
        out[i] = np.packbits(2 * ones > n).view(np.uint64)[0]
    return out


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The 64-bit fingerprint of UTF-8 bytes, as a long."""

    @F.pandas_udf("long")
    def printed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            parts = [_printed(texts, shingle).view(np.int64) for _, texts in slices(values)]
            yield pd.Series(np.concatenate(parts or [np.empty(0, np.int64)]))

    return printed(text)


# ---- links ------------------------------------------------------------------------------


def ring(segments: int) -> list[tuple[int, int]]:
    """First bit and width of each segment."""
    edges = [round(i * BITS / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _mask(segments: int, first: int, length: int) -> int:
    own = ring(segments)
    mask = 0
    for k in range(length):
        at, width = own[(first + k) % segments]
        mask |= ((1 << width) - 1) << at
    return mask


def leading(segments: int, distance: int) -> int:
    """Length of the longest chain whose budget is below one bit."""
    return max(k for k in range(1, segments + 1) if k * distance < segments)


def _budgets(segments: int, distance: int, first: int) -> list[tuple[np.uint64, int]]:
    """Masks and budgets of the chains from a segment on that prune more than the one before."""
    out = []
    for k in range(1, segments + 1):
        most, following = k * distance // segments, (k + 1) * distance // segments
        if k == segments or following > most:
            out.append((np.uint64(_mask(segments, first, k)), most))
    return [x for x in out if x[1] > 0]


def _near(a: np.ndarray, b: np.ndarray, chains) -> np.ndarray:
    """Which pairs keep all chains' budgets; the last chain is the whole ring."""
    at, differ = np.arange(len(a)), a ^ b
    for mask, most in chains:
        fits = np.bitwise_count(differ & mask) <= most
        at, differ = at[fits], differ[fits]
    return at


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if np.array_equal(root, before):
            break
    return root


def _bucket_links(prints: np.ndarray, chains):
    """A spanning set of links among the sorted distinct fingerprints of a bucket."""
    n = len(prints)
    left, right = [], []
    for step in range(1, n):
        at = _near(prints[:-step], prints[step:], chains)
        left.append(at)
        right.append(at + step)
    root = _roots(n, np.concatenate(left), np.concatenate(right))
    at = np.flatnonzero(root != np.arange(n))
    return prints[root[at]], prints[at]


LINKED = "first int, a long, b long"


def _links(segments: int, distance: int, pairwise: int):
    """Links of each bucket; of one with too many fingerprints, those themselves as ``a``, with a null ``b``."""
    chains = [_budgets(segments, distance, i) for i in range(segments)]
    most = pairwise if distance <= 2 else np.inf

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches are sorted by segment and key; a bucket may run on into the next batch."""
        held, passing = None, None  # rows of the last bucket so far, or the name of one that passes through
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            held = None
            names = rows["first"].to_numpy(np.int64), rows["key"].to_numpy(np.int64)
            if passing is not None:
                own = (names[0] == passing[0]) & (names[1] == passing[1])
                yield unlinked(rows[own])
                rows = rows[~own]
                if not len(rows):
                    continue
                passing = None
            name = rows["first"].iloc[-1], rows["key"].iloc[-1]
            last = (rows["first"] == name[0]) & (rows["key"] == name[1])
            if last.sum() > most:
                passing = name
                yield unlinked(rows[last])
            else:
                held = rows[last]
            yield found(rows[~last])
        if held is not None:
            yield found(held)

    def unlinked(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"first": rows["first"], "a": rows["print"], "b": pd.array([None] * len(rows), "Int64")})

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows["first"].to_numpy(np.int64)
        key = rows["key"].to_numpy(np.int64)
        prints = rows["print"].to_numpy(np.int64).view(np.uint64)
        new = np.ones(len(rows), bool)
        new[1:] = (first[1:] != first[:-1]) | (key[1:] != key[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(rows)))
        left, right = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        two = starts[sizes == 2]
        for i in range(segments):
            at = two[first[two] == i]
            near = at[_near(prints[at], prints[at + 1], chains[i])]
            left.append(prints[near])
            right.append(prints[near + 1])
        large = (sizes > 2) & (sizes <= most)
        for at, size in zip(starts[large].tolist(), sizes[large].tolist()):
            a, b = _bucket_links(np.unique(prints[at : at + size]), chains[int(first[at])])
            left.append(a)
            right.append(b)
        linked = pd.DataFrame(
            {
                "first": 0,
                "a": np.concatenate(left).view(np.int64),
                "b": pd.array(np.concatenate(right).view(np.int64), "Int64"),
            }
        )
        over = np.repeat(sizes > most, sizes)
        return pd.concat([linked, unlinked(rows[over])]) if over.any() else linked

    return link


def _links_by_flips(prints: DataFrame, distance: int, segments: int) -> DataFrame:
    """Links of buckets of any size, for distances 1 and 2, without pairs.

    A fingerprint is entered as it is and with each single bit outside the key flipped. Those 2 bits apart meet in an entry
    with a flip each, and all that share an entry are at most 2 apart; an entry has as many members as a
    fingerprint has free bits, and one. Those 1 bit apart meet where one of them is as it is.
    """
    flips = []
    for i in range(segments):
        key = _mask(segments, i, leading(segments, distance))
        free = [1 << j for j in range(BITS) if not key >> j & 1]
        flips.append(F.array(*[F.lit(f - (1 << 64) if f >> 63 else f).cast("long") for f in [0, *free]]))
    own = F.element_at(F.array(*flips), F.col("first") + 1)
    entered = prints.select("first", "a", F.explode(own).alias("flip"))
    entered = entered.select("first", "a", F.col("a").bitwiseXOR(F.col("flip")).alias("entry"))
    met = entered.groupBy("first", "entry").agg(F.collect_set("a").alias("members"))
    met = met.where(F.size("members") > 1)
    if distance == 1:
        met = met.where(F.array_contains("members", F.col("entry")))
        hub = F.col("entry")
    else:
        hub = F.array_min("members")
    return met.select(hub.alias("a"), F.explode("members").alias("b")).where("a <> b")


def links(prints: DataFrame, distance: int = 2, segments: int = 8, pairwise: int = 4096):
    """Links ``a``, ``b`` that connect the distinct fingerprints of column ``print``.

    More segments make longer keys and smaller buckets, at a row for each segment: 8 segments
    give keys of 24 bits, 16 give 28 bits.
    """
    ship(prints.sparkSession)
    if not 0 < distance < segments:
        raise ValueError("distance must lie between 1 and segments - 1")
    masks = [_mask(segments, i, leading(segments, distance)) for i in range(segments)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = prints.select(
        "print",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("first"), F.col("print").bitwiseAND(m).alias("key")
                    )
                    for i, m in enumerate(signed)
                ]
            )
        ).alias("k"),
    ).select("k.first", "k.key", "print")
    sorted_rows = keyed.repartition("first", "key").sortWithinPartitions("first", "key", "print")
    found = materialize(sorted_rows.mapInPandas(_links(segments, distance, pairwise), LINKED), "bucket-links")
    small = found.where("b IS NOT NULL").select("a", "b")
    return small.union(_links_by_flips(found.where("b IS NULL"), distance, segments)) if distance <= 2 else small


def _rooted(prints: DataFrame, smallest: Column, distance: int, segments: int) -> DataFrame:
    """Each fingerprint with its class, ``root``, and its own ``smallest``."""
    by_print = materialize(prints.groupBy("print").agg(smallest.alias("smallest")), "classes")
    found = materialize(links(by_print.select("print"), distance, segments), "links")
    linked = components(found)
    root = F.coalesce("root", "print")
    rooted = by_print.join(linked.withColumnRenamed("node", "print"), "print", "left").select(
        "print", root.alias("root"), "smallest"
    )
    return materialize(rooted, "roots")


def near_duplicates(
    docs: DataFrame, shingle: int = 3, distance: int = 2, segments: int = 8
) -> DataFrame:
    """``doc_id``, its ``print`` and ``component_id``, the smallest document of its class."""
    ship(docs.sparkSession)
    own = materialize(
        docs.select("doc_id", fingerprint(text_bytes(), shingle).alias("print")), "prints"
    )
    rooted = _rooted(own, F.min("doc_id"), distance, segments)
    smallest = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    classes = rooted.join(smallest, "root").select("print", "component_id")
    return own.join(classes, "print").select("doc_id", "print", "component_id")


def _row(docs: DataFrame) -> Column:
    """A hash of all of a row."""
    others = [c for c in docs.columns if c != "text"]
    rest = as_json(docs, others, F.col("text").isNull().alias("_no_text"))
    return F.md5(F.concat(rest.cast("binary"), text_bytes()))


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 2, segments: int = 8) -> DataFrame:
    """One row of each class, with all its columns: that with the smallest ``doc_id``.

    A null ``doc_id`` comes last; among rows with the same one, the smallest hash of the row
    decides. Classes are told by their texts, so different classes that share a ``doc_id``,
    or have none, keep a row each.
    """
    ship(docs.sparkSession)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", _row(docs).alias("row"))
    prints = docs.select(fingerprint(text_bytes(), shingle).alias("print"), order.alias("own"))
    rooted = _rooted(prints, F.min("own"), distance, segments)
    kept = rooted.groupBy("root").agg(F.min("smallest").alias("own")).select("own.row")
    marked = docs.withColumn("_row", _row(docs))
    mine = marked.join(kept, marked["_row"] == kept["row"], "left_semi")
    return mine.dropDuplicates(["_row"]).drop("_row")
