"""Token counts of whole texts; huge texts by overlapping chunks that are spliced.

A text of more than ``chunk`` characters is encoded in chunks that overlap by ``overlap``
characters, with the characters each token covers. Two neighbours are spliced at a common
boundary inside their overlap that is proven stable: a white-space character that no token of
either chunk covers, followed up to the next white space by the same tokens in both. The
vocabulary forms no token across white space, so both encodings are exact from there on, to
the left in the one and to the right in the other. Where an overlap holds no such place (a
long word, or signs without spaces), it is widened up to the next runs of white space, twice as many each
time, and the neighbour begins at the first of them: a chunk is then encoded again once for each widening, which
at least doubles what it takes in. A text without white space goes to the library whole, so the time
stays within a small multiple of the library's.

Null and empty texts have no tokens. Rows are counted each by itself, so repeated rows, ties
and further columns change nothing, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlight.llm.common import ship, slices, text_bytes
from meterlight.llm.encoders import JsonEncoder, encoder

CHUNK = 24_576
OVERLAP = 256
RUNS = 3  # of white space in a widened overlap
SPACE = re.compile(r"[ \t\n\x0b\x0c\r]+")


class Chunk:
    """One encoded chunk of a text: token ids and the text's characters they cover."""

    def __init__(self, first: int, end: int, spans):
        ids, starts, ends = spans
        self.first, self.end = first, end
        self.ids, self.starts, self.ends = ids, starts + first, ends + first

    def between(self, low: int, high: int) -> np.ndarray:
        return self.ids[np.searchsorted(self.starts, low) : np.searchsorted(self.starts, high)]

    def covers(self, at: int) -> bool:
        """Whether a token covers the character at ``at``."""
        i = np.searchsorted(self.starts, at, side="right") - 1
        return i >= 0 and self.ends[i] > at


def stable_boundary(text: str, left: Chunk, right: Chunk) -> int | None:
    """A place in the overlap of two chunks where both encodings can be spliced."""
    spaces = [m.start() for m in SPACE.finditer(text, right.first, left.end)]
    for here, following in zip(spaces, spaces[1:]):
        if left.covers(here) or right.covers(here):
            continue
        if np.array_equal(left.between(here, following), right.between(here, following)):
            return here
    return None


def spliced_ids(
    codec: JsonEncoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP
) -> Iterator[np.ndarray]:
    """The ids of ``text`` in order, chunk by chunk."""

    def encode(first: int, end: int) -> Chunk:
        return Chunk(first, end, codec.spans([text[first:end]])[0])

    size = len(text)
    left, spliced = encode(0, min(size, chunk + overlap)), 0
    first = chunk
    while left.end < size:
        right, runs = encode(first, min(size, first + chunk + overlap)), RUNS
        while (at := stable_boundary(text, left, right)) is None:
            # The overlap is widened to the next runs of white space, however far they are.
            first, end = next_runs(text, left.end, runs)
            left, runs = encode(left.first, end), 2 * runs
            if end == size:
                break
            right = encode(first, min(size, max(end, first + chunk) + overlap))
        if at is None:
            break
        yield left.between(spliced, at)
        left, spliced = right, at
        first = max(first + chunk, at + 1)
    yield left.between(spliced, size)


def next_runs(text: str, at: int, runs: int) -> tuple[int, int]:
    """From ``at`` on, where the first run of white space begins and the last of so many ends, or the text."""
    first, end = len(text), len(text)
    for i, run in enumerate(SPACE.finditer(text, at)):
        first = run.start() if i == 0 else first
        if i + 1 == runs:
            return first, run.end()
    return first, end


def _counter(path: str, chunk: int, overlap: int, limit: int):
    @F.pandas_udf("n_bytes long, n_tokens long, over_limit boolean, n_chunked long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = encoder(path)
        for values in batches:
            sizes = np.fromiter(map(len, values), np.int64, len(values))
            tokens = np.zeros(len(values), np.int64)
            huge = sizes > chunk  # characters are at most bytes
            for i in np.flatnonzero(huge):
                text = values.iloc[i].decode("utf-8", "replace")
                huge[i] = len(text) > chunk
                if huge[i]:
                    tokens[i] = sum(map(len, spliced_ids(codec, text, chunk, overlap)))
            small = np.flatnonzero(~huge)
            for at, texts in slices(values.iloc[small]):
                tokens[small[at : at + len(texts)]] = codec.counts(texts)
            yield pd.DataFrame(
                {
                    "n_bytes": sizes,
                    "n_tokens": tokens,
                    "over_limit": tokens > limit,
                    "n_chunked": huge.astype(np.int64),
                }
            )

    return count


def token_counts(
    text: Column, path: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP
) -> Column:
    """Struct of ``n_bytes``, ``n_tokens``, ``over_limit`` and ``n_chunked`` (1 if spliced).

    ``text`` holds UTF-8 bytes, ``path`` names a file of the ``tokenizers`` library.
    """
    return _counter(path, chunk, overlap, limit)(text)


def count_documents(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """``doc_id`` and the counts of each document's whole text."""
    ship(docs.sparkSession)
    counted = docs.select("doc_id", token_counts(text_bytes(), path, limit).alias("found"))
    return counted.select("doc_id", "found.*")
