"""Gap-weighted subsequence kernel of words, vectorised over pairs.

The kernel counts the subsequences of ``ORDER`` letters that two words have in common, each
weighted by DECAY to the power of the letters it spans in both. Inserted or missing letters
lessen it by some factors of DECAY only. It is normalised to 1 for a word with itself.
"""

from __future__ import annotations

import numpy as np

ORDER = 3
DECAY = np.float32(0.8)
WIDTH = 24  # letters of a word; longer words are seen in overlapping parts
TOGETHER = 1 << 14  # pairs
WORDS_AT_ONCE = 1 << 14


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, a row each, and the words' lengths."""
    out = np.zeros((len(words), WIDTH), np.uint32)
    lengths = np.fromiter((min(len(w), WIDTH) for w in words), np.int64, len(words))
    if len(words):
        flat = np.frombuffer("".join(w[:WIDTH] for w in words).encode("utf-32-le"), np.uint32)
        out[np.arange(WIDTH) < lengths[:, None]] = flat
    return out, lengths


def masks(codes: np.ndarray) -> np.ndarray:
    """A bit for each letter of a word, of 32 classes of letters."""
    bits = np.where(codes > 0, np.uint32(1) << (codes & np.uint32(31)), np.uint32(0))
    return np.bitwise_or.reduce(bits, axis=1)


def raw(left, n_left, right, n_right, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Kernel of word ``row`` of the left and word ``column`` of the right, not normalised."""
    out = np.zeros(len(row), np.float32)
    order = np.argsort(n_left[row], kind="stable")
    for first in range(0, len(row), TOGETHER):
        at = order[first : first + TOGETHER]
        i, j = row[at], column[at]
        out[at] = _raw(
            left[i, : n_left[i].max(initial=0)].T.copy(),
            right[j, : n_right[j].max(initial=0)].T.copy(),
        )
    return out


def _raw(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    pairs = s.shape[1]
    zero = np.zeros(pairs, np.float32)
    square = DECAY * DECAY
    total = zero.copy()
    # kept[l][j]: weight of common subsequences of l letters within s so far and t up to j,
    # decayed to the ends of both.
    kept = [[zero + 1] * (len(t) + 1)] + [[zero] * (len(t) + 1) for _ in range(ORDER - 1)]
    for i in range(len(s)):
        same = [((s[i] == t[j]) & (s[i] > 0)).astype(np.float32) for j in range(len(t))]
        for j in range(len(t)):
            total = total + square * same[j] * kept[ORDER - 1][j]
        for length in range(ORDER - 1, 0, -1):
            run, row = zero, [zero]
            for j in range(len(t)):
                run = DECAY * run + square * same[j] * kept[length - 1][j]
                row.append(DECAY * kept[length][j + 1] + run)
            kept[length] = row
    return total


class Landmarks:
    """Kernels of words with a fixed list of words."""

    #: Least share of a landmark's letters that a word must have for the pair to be looked at;
    #: with fewer the kernel counts as zero.
    COMMON = 0.6
    #: Kernels below this, after the power, count as zero: many faint likenesses are no insult.
    FLOOR = 0.05

    def __init__(self, words: list[str]):
        self.words = words
        self.codes, self.lengths = letters(words)
        self.masks = masks(self.codes)
        self.needed = np.ceil(self.COMMON * np.bitwise_count(self.masks)).astype(np.int64)
        every = np.arange(len(words))
        self.own = raw(self.codes, self.lengths, self.codes, self.lengths, every, every)

    def kernels(self, words: list[str], power: int) -> np.ndarray:
        """Normalised kernels to the given power: a row for each word, a column by landmark."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        for first in range(0, len(words), WORDS_AT_ONCE):
            row, column, value = self._some(words[first : first + WORDS_AT_ONCE], power)
            out[first + row, column] = value
        return out

    def sparse(self, words: list[str], power: int):
        """The kernels that aren't zero: word, landmark, value."""
        parts = []
        for first in range(0, len(words), WORDS_AT_ONCE):
            row, column, value = self._some(words[first : first + WORDS_AT_ONCE], power)
            parts.append((first + row, column, value))
        nothing = np.empty(0, np.int64)
        return tuple(
            np.concatenate(x) for x in zip((nothing, nothing, nothing.astype(np.float32)), *parts)
        )

    def _some(self, words: list[str], power: int):
        codes, lengths = letters(words)
        common = np.bitwise_count(masks(codes)[:, None] & self.masks[None, :])
        near = (common >= self.needed[None, :]) & (lengths >= ORDER)[:, None]
        row, column = np.nonzero(near)
        some = np.unique(row)
        own = np.zeros(len(words), np.float32)
        own[some] = raw(codes, lengths, codes, lengths, some, some)
        value = raw(codes, lengths, self.codes, self.lengths, row, column)
        norm = np.sqrt(own[row] * self.own[column])
        value = np.where(norm > 0, value / np.where(norm > 0, norm, 1), 0) ** power
        kept = (value >= self.FLOOR) & (value > 0)
        return row[kept], column[kept], value[kept]
