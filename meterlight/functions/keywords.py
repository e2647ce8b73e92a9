"""Which keywords occur in which tokens, inside tasks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import functions as F

# Keywords and tokens meet on substrings of up to this many characters.
GRAM = 3
# Tokens a worker remembers, of at most so many characters.
REMEMBERED, LONGEST = 1 << 16, 64


def _grams(text: str, length: int) -> set[str]:
    return {text[i : i + length] for i in range(len(text) - length + 1)}


class KeywordIndex:
    """Looks up the keywords that occur in a text.

    A keyword has no white space, so it only ever occurs inside a token, and a token that contains it contains all its
    short substrings. Candidates are found by the one of these that the fewest keywords share, and are then counted.
    """

    def __init__(self, keywords: list[str]):
        self.keywords = keywords
        own = [_grams(k, min(len(k), GRAM)) for k in keywords]
        shared: dict[str, int] = {}
        for grams in own:
            for gram in grams:
                shared[gram] = shared.get(gram, 0) + 1
        self.by_gram: dict[str, list[int]] = {}
        for number, grams in enumerate(own):
            self.by_gram.setdefault(min(grams, key=lambda g: (shared[g], g)), []).append(number)
        self.seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def of_token(self, token: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the keywords in a token, and how often each occurs there without overlaps."""
        known = self.seen.get(token)
        if known is not None:
            return known
        grams = {token[i : i + size] for size in range(1, GRAM + 1) for i in range(len(token) - size + 1)}
        candidates = [n for gram in grams & self.by_gram.keys() for n in self.by_gram[gram]]
        counts = np.array([token.count(self.keywords[n]) for n in candidates], np.int32)
        held = counts > 0
        found = np.array(candidates, np.int32)[held], counts[held]
        if len(token) <= LONGEST:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[token] = found
        return found

    def of_text(self, text: str | None) -> tuple[list[str], np.ndarray]:
        """The keywords in a text and their occurrences; tokens lie between white space as ``text.SPACE`` lists it."""
        tokens = Counter((text or "").split())
        if not tokens or not self.keywords:
            return [], np.zeros(0, np.int64)
        found = [self.of_token(t) for t in tokens]
        repeats = np.repeat(list(tokens.values()), [len(numbers) for numbers, _ in found])
        numbers, counts = (np.concatenate(part) for part in zip(*found))
        # Sums of whole numbers below 2^53 are exact.
        hits = np.bincount(numbers, counts * repeats, len(self.keywords)).astype(np.int64)
        held = np.flatnonzero(hits)
        return [self.keywords[n] for n in held], hits[held]


@lru_cache(maxsize=1)
def _index(keywords: tuple[str, ...]) -> KeywordIndex:
    """A worker's index, which outlives a task."""
    return KeywordIndex(list(keywords))


def counter(keywords: Broadcast):
    """A function of a text: which of the broadcast keywords occur in it, and how often."""

    @F.pandas_udf("keyword array<string>, hits array<long>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = _index(keywords.value)
        for texts in batches:
            found = [index.of_text(t) for t in texts]
            yield pd.DataFrame({"keyword": [k for k, _ in found], "hits": [h for _, h in found]})

    return count
