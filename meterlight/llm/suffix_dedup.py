"""Exact removal of passages that stand earlier in the corpus, by suffix sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document
with a smaller ``doc_id``, or earlier in the same one. Strings never cross documents.

1. Every window of LENGTH bytes picks its smallest hashed ``GRAM``-gram, so equal windows pick
   the same one at the same place. The windows that pick one place form a *passage*: about 35
   windows over 134 bytes. Of equal passages of a block only the earliest goes on, the others are repeats: a line that
   a document has a thousand times, or a megabyte of one byte, is one passage of its block. Only a hash
   of the gram and one of the passage are shuffled, dealt by the gram, in one packed row for each block of
   documents and bucket; the number of buckets follows the bytes of text.
2. Grams with one passage need no more: an occurrence after the first repeats the whole
   passage, and the first repeats nothing. Where different passages share a gram, the text of
   each (once, from its first occurrence) goes to the gram's task.
3. There the suffixes that begin a window are sorted in two stages (``suffix_sort``), and
   neighbours with a common prefix of LENGTH bytes form a run; all but its earliest window go.
4. Windows to remove return to the blocks, where they are merged to spans of bytes.

Blocks are stored once, compressed, in the shared folder; a hot passage has one entry (some 25 bytes) for each
block of a megabyte that holds it, all of which meet in one task, and its text is sent once. No window is left out: the result is exact up to
collisions of two 64-bit hashes at once.

Documents with the same ``doc_id`` are ordered by where they are stored; repeated rows are
copies like others. A null ``doc_id`` comes last. Null and empty texts, and texts under LENGTH
bytes, lose nothing. An empty table gives an empty result. Further columns are ignored, or kept
by ``cut_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.llm.common import (
    as_json,
    materialize,
    mixed,
    out_of_json,
    partitions,
    ranges,
    ship,
    text_bytes,
)
from meterlight.llm.suffix_sort import repeated_windows

LENGTH = 100
GRAM = 32
WINDOW = LENGTH - GRAM + 1
BLOCK = 1 << 20
STEP = 1 << 18  # windows hashed at a time
TOGETHER = 1 << 19  # bytes of passages sorted together
BYTES_OF_BUCKET = 8 << 20  # of text whose passages share a bucket
PLACE = np.uint64((1 << 21) - 1)
LAST = np.iinfo(np.int64).max

BLOCKS = "block long, data binary, ids array<long>, sizes array<long>, rest array<string>"


# ---- blocks -----------------------------------------------------------------------------


def _to_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents packed into compressed blocks of about BLOCK bytes; a long one has its own."""
    number = TaskContext.get().partitionId() << 32
    held: list[tuple] = []
    size = 0

    def block() -> pd.DataFrame:
        texts = [text for text, _, _ in held]
        return pd.DataFrame(
            {
                "block": [number],
                "data": [zstandard.compress(b"".join(texts), 3)],
                "ids": [[None if pd.isna(i) else int(i) for _, i, _ in held]],
                "sizes": [[len(t) for t in texts]],
                "rest": [[r for _, _, r in held]],
            }
        )

    for batch in batches:
        for text, doc, rest in zip(batch["text"], batch["doc_id"], batch["rest"]):
            held.append((bytes(text), doc, rest))
            size += len(held[-1][0])
            if size >= BLOCK:
                yield block()
                number, held, size = number + 1, [], 0
    if held:
        yield block()


class Block:
    def __init__(self, row):
        self.number = int(row["block"])
        self.sizes = np.asarray(row["sizes"], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        total = int(self.sizes.sum())
        self.bytes = zstandard.decompress(row["data"], max_output_size=max(1, total)) if total else b""
        ids = list(row["ids"])
        self.null = np.array([i is None or pd.isna(i) for i in ids], bool)
        self.ids = np.array([LAST if n else int(i) for i, n in zip(ids, self.null)], np.int64)
        self.raw_ids = [None if n else int(i) for i, n in zip(ids, self.null)]


# ---- passages ---------------------------------------------------------------------------


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    table = mixed(np.arange(1, 257))
    n = STEP + LENGTH + 1
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return table, np.cumprod(up), np.cumprod(down)


def passages(block: Block):
    """Gram hash, passage hash, first window (in the block) and number of windows of each."""
    table, up, down = _powers()
    data = np.frombuffer(block.bytes, np.uint8)
    n = len(data)
    valid = np.zeros(n + 1, np.int32)
    long = block.sizes >= LENGTH
    np.add.at(valid, block.starts[long], 1)
    np.add.at(valid, block.ends[long] - LENGTH + 1, -1)
    valid = np.cumsum(valid)[:n] > 0
    out = []
    with np.errstate(over="ignore"):
        for first in range(0, max(0, n - LENGTH + 1), STEP):
            part = table[data[first : first + STEP + LENGTH - 1]]
            windows = len(part) - LENGTH + 1
            gram, width, power = part, 1, np.uint64(0x9E3779B97F4A7C15)
            while width < GRAM:
                gram = gram[:-width] * power + gram[width:]
                width, power = 2 * width, power * power
            gram = mixed(gram)
            least = (gram & ~PLACE) | np.arange(len(gram), dtype=np.uint64)
            width = 1
            while 2 * width <= WINDOW:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            rest = WINDOW - width
            least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
            chosen = (least & PLACE).astype(np.int64)
            ok = valid[first : first + windows]
            new = np.ones(windows, bool)
            new[1:] = (chosen[1:] != chosen[:-1]) | (ok[1:] != ok[:-1])
            # Windows of two documents never share a gram: a window ends in its own document.
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], windows)
            starts, ends = starts[ok[starts]], ends[ok[starts]]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up[: len(part)], out=sums[1:])
            own = mixed((sums[ends - 1 + LENGTH] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
            out.append((gram[chosen[starts]], own, starts + first, ends - starts))
    if not out:
        nothing = np.empty(0, np.int64)
        return nothing.astype(np.uint64), nothing.astype(np.uint64), nothing, nothing
    return tuple(np.concatenate(x) for x in zip(*out))


def _packed(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


OFFERED = "bucket int, block long, n_docs int, n int, hashes binary, places binary, n_again int, again binary"
OFFERED_COLUMNS = [part.split()[0] for part in OFFERED.split(", ")]


def earliest(block: Block, gram, own, doc, first) -> np.ndarray:
    """Which passages of a block no equal one of it comes before."""
    rank = np.empty(len(block.ids), np.int64)
    rank[np.lexsort((np.arange(len(block.ids)), block.ids, block.null))] = np.arange(len(block.ids))
    order = np.lexsort((first, rank[doc], own, gram))
    out = np.ones(len(gram), bool)
    out[order[1:]] = (gram[order][1:] != gram[order][:-1]) | (own[order][1:] != own[order][:-1])
    return out


def joined(doc, start, count):
    """Runs of windows, those that follow each other in a document as one."""
    if not len(doc):
        return doc, start, count
    order = np.lexsort((start, doc))
    doc, start, count = doc[order], start[order], count[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + count[:-1])])
    at = np.flatnonzero(new)
    return doc[at], start[at], np.add.reduceat(count, at)


def _offer(buckets: int):
    """Packed rows of a block's distinct passages for each bucket of grams.

    Passages that an equal one of the same block comes before are repeats already; they ride along as a note.
    """

    def offer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                block = Block(row)
                gram, own, first, count = passages(block)
                doc = np.searchsorted(block.ends, first, side="right")
                new = earliest(block, gram, own, doc, first)
                again = joined(doc[~new], (first - block.starts[doc])[~new], count[~new])
                gram, own, first, count, doc = (x[new] for x in (gram, own, first, count, doc))
                bucket = (gram >> np.uint64(20)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = []
                for k in np.flatnonzero(np.diff(edges)):
                    at = order[edges[k] : edges[k + 1]]
                    docs, place = np.unique(doc[at], return_inverse=True)
                    start = first[at] - block.starts[doc[at]]
                    small = _packed(
                        block.ids[docs], docs.astype(np.uint32), block.null[docs],
                        place.astype(np.uint32), start.astype(np.uint32), count[at].astype(np.uint8),
                    )
                    # The note goes with the block's first row.
                    n_again, note = (len(again[0]), _note(*again)) if not rows else (0, None)
                    rows.append(
                        (int(k), block.number, len(docs), len(at), _packed(gram[at], own[at]),
                         zstandard.compress(small, 3), n_again, note)
                    )
                yield pd.DataFrame(rows, columns=OFFERED_COLUMNS)

    return offer


def _opened(rows: pd.DataFrame):
    """The columns of all passages of a bucket."""
    out = []
    for row in rows.itertuples(index=False):
        gram, own = np.frombuffer(row.hashes, np.uint64).reshape(2, -1)
        small, d, n = zstandard.decompress(row.places), row.n_docs, row.n
        ids = np.frombuffer(small, np.int64, d)
        docs = np.frombuffer(small, np.uint32, d, 8 * d)
        null = np.frombuffer(small, bool, d, 12 * d)
        place, start = np.frombuffer(small[13 * d : 13 * d + 8 * n], np.uint32).reshape(2, -1)
        count = np.frombuffer(small, np.uint8, n, 13 * d + 8 * n)
        block = np.full(n, row.block, np.int64)
        out.append((gram, own, ids[place], null[place], block, docs[place], start, count))
    return tuple(np.concatenate(x) for x in zip(*out))


def _by_block(kind: int, block, doc, start, count, gram) -> list[tuple]:
    """Rows for the blocks: windows to remove (kind 0), or passages to send (kind 1)."""
    order = np.argsort(block, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(block[order]) != 0])) if len(order) else []
    rows = []
    for a, b in zip(edges, [*edges[1:], len(order)]):
        at = order[a:b]
        payload = _note(doc[at], start[at], count[at], *([gram[at]] if kind else []))
        rows.append((kind, int(block[at[0]]), len(at), payload))
    return rows


def _note(doc, start, count, *more) -> bytes:
    return zstandard.compress(_packed(*(x.astype(np.uint32) for x in (doc, start, count)), *more), 3)


NOTES = "kind int, block long, n int, payload binary"


def _note_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "block", "n", "payload"])


def _read_notes(notes: pd.DataFrame, kind: int):
    doc, start, count, gram = [], [], [], []
    for n, payload in zip(notes["n"], notes["payload"]):
        raw = zstandard.decompress(payload)
        doc.append(np.frombuffer(raw, np.uint32, n))
        start.append(np.frombuffer(raw, np.uint32, n, 4 * n))
        count.append(np.frombuffer(raw, np.uint32, n, 8 * n))
        if kind:
            gram.append(np.frombuffer(raw[12 * n :], np.uint64, n))
    if not doc:
        return [np.empty(0, np.int64)] * 4
    joined = [np.concatenate(x).astype(np.int64) for x in (doc, start, count)]
    return [*joined, np.concatenate(gram) if kind else np.empty(0, np.uint64)]


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket's passages: which are whole repeats, and whose text must be sorted."""
    gram, own, ids, null, block, doc, start, count = _opened(rows)
    order = np.argsort(gram)
    sorted_gram = gram[order]
    again = np.zeros(len(gram), bool)
    same = sorted_gram[1:] == sorted_gram[:-1]
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    at = np.flatnonzero(again)
    at = at[np.lexsort((start[at], doc[at], block[at], ids[at], null[at], own[at], gram[at]))]
    g, o = gram[at], own[at]
    new_gram = np.concatenate([[True], g[1:] != g[:-1]]) if len(at) else np.empty(0, bool)
    first = new_gram.copy()
    first[1:] |= o[1:] != o[:-1]
    number = np.cumsum(new_gram) - 1
    several = (np.bincount(number[first], minlength=1) > 1)[number] if len(at) else first
    noted = rows[rows["n_again"] > 0]
    out = list(zip([0] * len(noted), noted["block"].tolist(), noted["n_again"].tolist(), noted["again"]))
    for kind, which in ((0, at[~first]), (1, at[first & several])):
        out += _by_block(kind, block[which], doc[which], start[which], count[which], gram[which])
    return _note_frame(out)


# ---- texts of passages, and their sorting ------------------------------------------------

TEXTS = "bucket int, block long, n int, places binary, texts binary"


def _send(buckets: int):
    """Texts of the passages asked for, packed for each bucket of grams."""

    def send(blocks: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(blocks) and len(notes):
            block = Block(blocks.iloc[0])
            doc, start, count, gram = _read_notes(notes, 1)
            bucket = (gram >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(edges)):
                at = order[edges[k] : edges[k + 1]]
                first = block.starts[doc[at]] + start[at]
                texts = b"".join(
                    block.bytes[a : a + c + LENGTH - 1]
                    for a, c in zip(first.tolist(), count[at].tolist())
                )
                places = _packed(
                    gram[at], block.ids[doc[at]], block.null[doc[at]].astype(np.int64),
                    doc[at], start[at], count[at],
                )
                rows.append((int(k), block.number, len(at), zstandard.compress(places, 3), zstandard.compress(texts, 3)))
        return pd.DataFrame(rows, columns=["bucket", "block", "n", "places", "texts"])

    return send


def _sort(rows: pd.DataFrame) -> pd.DataFrame:
    """Suffix sorting of a bucket's passages; windows that stand earlier elsewhere."""
    columns, texts = [], []
    for row in rows.itertuples(index=False):
        raw = zstandard.decompress(row.places)
        own = np.frombuffer(raw, np.int64).reshape(6, -1)
        columns.append(np.vstack([own, np.full(row.n, row.block, np.int64)]))
        data, at = zstandard.decompress(row.texts), 0
        for size in (own[5] + LENGTH - 1).tolist():
            texts.append(data[at : at + size])
            at += size
    gram, ids, null, doc, start, count, block = np.concatenate(columns, axis=1)
    ordered = np.lexsort((doc, block, ids, null))
    same = np.ones(len(ordered), bool)
    same[0] = False
    for x in (doc, block):
        same[1:] &= x[ordered][1:] == x[ordered][:-1]
    rank = np.empty(len(ordered), np.int64)
    rank[ordered] = np.cumsum(~same)
    # Groups of a gram are independent; some at a time, so that memory follows the largest.
    by_gram = np.argsort(gram, kind="stable")
    new = np.concatenate([[True], gram[by_gram][1:] != gram[by_gram][:-1]])
    group = np.cumsum(new) - 1
    size = np.cumsum(count[by_gram] + LENGTH)
    part = (size[new] - (count[by_gram] + LENGTH)[new])[group] // TOGETHER
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    found = []
    for a, b in zip(edges, [*edges[1:], len(by_gram)]):
        own = by_gram[a:b]
        marks = repeated_windows(
            [texts[i] for i in own], count[own], group[a:b], np.stack([rank[own], start[own]], axis=1), LENGTH
        )
        who = np.repeat(own, count[own])
        place = ranges(np.zeros(len(own), np.int64), count[own])
        begins = marks & ~(np.append(False, marks[:-1]) & (place > 0))
        ends = marks & ~(np.append(marks[1:], False) & (np.append(place[1:], 0) > 0))
        at = np.flatnonzero(begins)
        found.append((who[at], place[at], np.flatnonzero(ends) - at + 1))
    who, place, windows = (np.concatenate(x) for x in zip(*found))
    notes = (block[who], doc[who], start[who] + place, windows, gram[who])
    return _note_frame(_by_block(0, *notes))


# ---- results ----------------------------------------------------------------------------


def _spans(block: Block, notes: pd.DataFrame) -> np.ndarray:
    """Which bytes of the block go."""
    doc, start, count, _ = _read_notes(notes, 0)
    first = block.starts[doc] + start
    edge = np.zeros(len(block.bytes) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + count + LENGTH - 1, -1)
    return np.cumsum(edge)[:-1] > 0


def _whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Bytes to keep so that no character is cut: one that loses a byte goes whole."""
    lead = np.cumsum((data & 0xC0) != 0x80) if len(data) else np.empty(0, np.int64)
    hit = np.zeros((int(lead[-1]) if len(lead) else 0) + 1, bool)
    hit[lead[gone]] = True
    return ~hit[lead]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digest(blocks: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for _, row in blocks.iterrows():
        block = Block(row)
        gone = _spans(block, notes)
        data = np.frombuffer(block.bytes, np.uint8)
        for doc, a, b in zip(block.raw_ids, block.starts.tolist(), block.ends.tolist()):
            own = gone[a:b]
            spans = int(own[:1].sum()) + int((own[1:] & ~own[:-1]).sum())
            kept = data[a:b][~own].tobytes()
            rows.append((doc, b - a, int(own.sum()), spans, hashlib.sha256(kept).hexdigest()))
    out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return out.astype({"doc_id": "Int64"})


def _cut(blocks: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for _, row in blocks.iterrows():
        block = Block(row)
        data = np.frombuffer(block.bytes, np.uint8)
        keep = _whole_characters(data, _spans(block, notes))
        for rest, a, b in zip(row["rest"], block.starts.tolist(), block.ends.tolist()):
            rows.append((rest, data[a:b][keep[a:b]].tobytes().decode("utf-8", "replace")))
    return pd.DataFrame(rows, columns=["rest", "text"])


def _found(docs: DataFrame, rest) -> tuple[DataFrame, DataFrame]:
    """The stored blocks, and the notes on windows to remove."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), rest.alias("rest")
    )
    bytes = F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))
    blocks, seen = materialize(rows.mapInPandas(_to_blocks, BLOCKS), "blocks", {"bytes": bytes})
    buckets = max(4 * partitions(spark), -(-(seen["bytes"] or 0) // BYTES_OF_BUCKET))
    offered = blocks.select("block", "data", "ids", "sizes").mapInPandas(_offer(buckets), OFFERED)
    notes = materialize(offered.groupBy("bucket").applyInPandas(_compare, NOTES), "notes")
    asked = notes.where("kind = 1").groupBy("block")
    sent = blocks.drop("rest").groupBy("block").cogroup(asked).applyInPandas(_send(buckets), TEXTS)
    sorted_notes = materialize(sent.groupBy("bucket").applyInPandas(_sort, NOTES), "sorted")
    return blocks, notes.where("kind = 0").union(sorted_notes)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """What each document loses: ``RESULT``."""
    blocks, notes = _found(docs, F.lit(None).cast("string"))
    cogrouped = blocks.drop("rest").groupBy("block").cogroup(notes.groupBy("block"))
    return cogrouped.applyInPandas(_digest, RESULT)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, and ``n_chars`` set anew.

    A character of which a byte is covered goes as a whole. A null text becomes an empty one.
    """
    others = [c for c in docs.columns if c != "text"]
    blocks, notes = _found(docs, as_json(docs, others))
    cogrouped = blocks.groupBy("block").cogroup(notes.groupBy("block"))
    cut = cogrouped.applyInPandas(_cut, "rest string, text string")
    made = out_of_json(docs, others, F.col("rest")) | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cut.select(*[made[c].alias(c) for c in docs.columns])
