"""Quality rules by tokeniser fertility, with counting rules beside them.

A public vocabulary measures how a text breaks up: characters per token, the share of tokens
that are single bytes (byte fallback), and the entropy of the text's tokens, as a share of the
most that so many tokens could have. Text of a script is rejected outside its bands. Bands are
fixed parameters per script, so a row's verdict depends on that row alone.

Words are runs of other characters than space and 9 to 13; lines are split at ``\\n``. The
counting rules: too few words, or too many words inside repeated five-word windows.

Null and empty texts have no words and fail the counting rules. A text without letters belongs
to the script ``none``, whose only band is on byte tokens (signs the vocabulary lacks). The bands decide on every text,
however short: they give way by a few standard errors, so of ten words only what is far outside is
rejected (consonant jumbles are if the language is known). Repeated rows, ties and further columns
change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlight.llm.common import WHITE, mixed, ship, slices, text_bytes
from meterlight.llm.encoders import PieceEncoder, encoder

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

#: Bands: least and greatest characters per token, greatest share of byte tokens, least
#: relative entropy of the tokens. A language's band holds where the language is known, else
#: the script's. The vocabulary was made for Latin text, so the bands of other scripts are wide.
#: A mean over few tokens varies more, so every band gives way by its slack / sqrt(tokens): both
#: limits of characters by the first, the share of byte tokens by the second, entropy by the third.
BANDS = {
    "en": (2.11, 8.0, 0.10, 0.42),
    "de": (2.12, 8.0, 0.10, 0.42),
    "fr": (1.90, 8.0, 0.10, 0.42),
    "es": (1.85, 8.0, 0.10, 0.42),
    "latin": (1.45, 8.0, 0.10, 0.42),
    "cyrillic": (0.9, 8.0, 0.30, 0.40),
    "greek": (0.6, 8.0, 0.60, 0.40),
    "arabic": (0.5, 8.0, 0.60, 0.40),
    "han": (0.25, 4.0, 0.85, 0.35),
    "other": (0.1, 8.0, 1.00, 0.25),
    "none": (0.0, float("inf"), 0.50, 0.0),
}
SLACKS = (2.5, 0.5, 0.5)

# The scripts told apart, with the ranges of the leading UTF-8 byte of letters.
SCRIPTS = ["latin", "greek", "cyrillic", "arabic", "han", "other", "none"]

_IS_WHITE = np.isin(np.arange(256), list(WHITE))
_STARTS = (np.arange(256) & 0xC0) != 0x80
_WORD_CHAR = _STARTS & ~_IS_WHITE
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


def _script_of_bytes() -> np.ndarray:
    of = np.full(256, -1, np.int64)
    for b in range(256):
        if chr(b).isascii() and chr(b).isalpha() or 0xC3 <= b <= 0xC9:
            of[b] = 0
        elif 0xCD <= b <= 0xCF:
            of[b] = 1
        elif 0xD0 <= b <= 0xD4:
            of[b] = 2
        elif 0xD8 <= b <= 0xDB:
            of[b] = 3
        elif 0xE3 <= b <= 0xE9:
            of[b] = 4
        elif 0xCA <= b <= 0xDF or 0xE0 <= b <= 0xEF and b != 0xE2:
            of[b] = 5
    return of


_SCRIPT = _script_of_bytes()


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[ends] - total[starts]


def repeated_words(slots: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each text inside windows that the text has twice or more."""
    n = len(slots)
    if n < window:
        return np.zeros(len(counts), np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    key = mixed(text.astype(np.uint64) + np.uint64(1 << 40))[: n - window + 1]
    odd = mixed(np.arange(1, window + 1)) | np.uint64(1)
    spread = mixed(slots.astype(np.uint64) + np.uint64(1))
    with np.errstate(over="ignore"):
        for k in range(window):
            key = key + spread[k : n - window + 1 + k] * odd[k]
    inside = np.arange(n - window + 1) + window <= ends[text[: n - window + 1]]
    at = np.flatnonzero(inside)
    key = key[at]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + window, -1)
    return _sums(np.cumsum(edge)[:-1] > 0, ends - counts, ends)


def repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def entropies(ids: np.ndarray, counts: np.ndarray, vocabulary: int) -> np.ndarray:
    """Entropy of each text's tokens over the greatest that so many tokens can have."""
    text = np.repeat(np.arange(len(counts)), counts)
    keys = np.sort(text * vocabulary + ids)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
    often = np.diff(np.append(first, len(keys))).astype(float)
    owner = (keys[first] // vocabulary).astype(np.int64) if len(keys) else np.empty(0, np.int64)
    share = often / counts[owner]
    bits = np.bincount(owner, -share * np.log2(share), len(counts))
    most = np.log2(np.minimum(np.maximum(counts, 2), vocabulary))
    return bits / most


def measure(codec: PieceEncoder, texts: list[bytes]) -> pd.DataFrame:
    """All counts and measures of each text."""
    slots, n_words = codec.words(texts)
    lengths = codec.lengths[slots]
    ids, n_tokens = codec.encode(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    byte_tokens = _sums(codec.is_byte[ids], np.cumsum(n_tokens) - n_tokens, np.cumsum(n_tokens))
    script = _SCRIPT[data]
    text = np.repeat(np.arange(len(texts)), sizes)
    letters = np.bincount(
        text[script >= 0] * 6 + script[script >= 0], minlength=len(texts) * 6
    ).reshape(-1, 6)
    word_chars = _sums(_WORD_CHAR[data], ends - sizes, ends)
    return pd.DataFrame(
        {
            "n_words": n_words,
            "word_chars": word_chars,
            "n_symbols": _sums(_SYMBOL[data], ends - sizes, ends),
            "n_dup_lines": np.fromiter(map(repeated_lines, texts), np.int64, len(texts)),
            "n_repeat_words": repeated_words(slots, n_words),
            "n_tokens": n_tokens,
            "chars_per_token": word_chars / np.maximum(n_tokens, 1),
            "byte_share": byte_tokens / np.maximum(n_tokens, 1),
            "entropy": entropies(ids, n_tokens, len(codec.is_byte)),
            "script": np.where(
                letters.sum(axis=1) > 0, np.array(SCRIPTS)[letters.argmax(axis=1)], "none"
            ),
        }
    )


def verdicts(found: pd.DataFrame, languages, bands: dict = BANDS) -> pd.DataFrame:
    """Adds ``base_failed`` and ``kept``; ``languages`` may hold nulls."""
    words, repeats = found["n_words"], found["n_repeat_words"]
    base = (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)
    scripts = found["script"].to_list()
    names = [
        lang if script == "latin" and lang in bands else script
        for lang, script in zip(languages, scripts)
    ]
    limits = np.array([bands[name] for name in names], float).reshape(-1, 4)
    chars, byte, entropy = (s / np.sqrt(np.maximum(found["n_tokens"], 1)) for s in SLACKS)
    inside = found["chars_per_token"].between(limits[:, 0] - chars, limits[:, 1] + chars)
    inside &= (found["byte_share"] <= limits[:, 2] + byte) & (found["entropy"] >= limits[:, 3] - entropy)
    return found.assign(base_failed=base, kept=~base & inside)


RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, chars_per_token double, byte_share double, entropy double, script string, "
    "base_failed boolean, kept boolean"
)


def quality(text: Column, lang: Column, path: str, bands: dict = BANDS) -> Column:
    """Struct of ``RESULT``'s fields for UTF-8 bytes and a language, which may be null.

    ``path`` names a file of the ``sentencepiece`` library.
    """

    @F.pandas_udf(RESULT)
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        codec = encoder(path)
        for values, languages in batches:
            parts = [
                verdicts(measure(codec, texts), languages.iloc[at : at + len(texts)], bands)
                for at, texts in slices(values)
            ]
            yield pd.concat(parts or [verdicts(measure(codec, []), [], bands)], ignore_index=True)

    return judge(text, lang)


def _judged(path: str, bands: dict) -> Column:
    return quality(text_bytes(), F.col("lang").cast("string"), path, bands)


def judge_documents(docs: DataFrame, path: str, bands: dict = BANDS) -> DataFrame:
    """``doc_id`` and the measures and verdict of each document's whole text."""
    ship(docs.sparkSession)
    judged = docs.select("doc_id", _judged(path, bands).alias("found"))
    return judged.select("doc_id", "found.*")


def keep_good(docs: DataFrame, path: str, bands: dict = BANDS) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    ship(docs.sparkSession)
    return docs.where(_judged(path, bands)["kept"])
