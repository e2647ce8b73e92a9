"""Language identification by n-gram filters whose slots are bit masks of languages.

A Bloom filter is kept for each language, all of one size and with the same hash functions, and
stored bit-sliced: a slot holds one bit for each language. One lookup of an n-gram, the AND of
its slots, gives all languages that contain it. A text's n-grams are counted for each language,
counts are corrected for the filter's false positives (known from how full its bits are), and
the language with the greatest corrected count wins; its share of all corrected counts is the
score.

A language contains an n-gram (four bytes of the text, A-Z in lower case, other ASCII as a
space) if it uses it at least ``SHARE`` times as often as the language that uses it most.
Filters are learned from a sample of about ``SAMPLE`` labelled documents of each language,
chosen by a hash of ``doc_id``; held-out rows and rows without a language take no part.

Null texts and texts without a letter are ``und`` with score 0, and so is everything if no
language was learned. Ties go to the first language by code point. Repeated rows are judged
each, further columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.llm.common import held_out, mixed, ship, slices

SAMPLE = 3000
SHARE = 0.4
LEAST = 3
GRAM = 4
HASHES = 3
SLOTS_PER_GRAM = 8
ASCII_LETTER = re.compile(rb"[A-Za-z]")

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(128)]


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of all texts, and how many each has; blanks between words count once."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    data = _FOLD[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    owner = np.repeat(np.arange(len(texts)), sizes)
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32) | (owner[1:] != owner[:-1])
    data, owner = data[keep].astype(np.uint32), owner[keep]
    if len(data) < GRAM:
        return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
    found = np.zeros(len(data) - GRAM + 1, np.uint32)
    for k in range(GRAM):
        found = (found << np.uint32(8)) | data[k : k + len(found)]
    inside = owner[: len(found)] == owner[GRAM - 1 :]
    return found[inside], np.bincount(owner[: len(found)][inside], minlength=len(texts))


def _slots(found: np.ndarray, size: int) -> list[np.ndarray]:
    """The filter slots of n-grams; ``size`` is a power of two."""
    hashed = mixed(found)
    step = (hashed >> np.uint64(32)) | np.uint64(1)
    mask = np.uint64(size - 1)
    return [((hashed + np.uint64(k) * step) & mask).astype(np.int64) for k in range(HASHES)]


@dataclass
class Filters:
    languages: list[str]
    slices: np.ndarray  # words of masks × slots
    false_rate: np.ndarray  # by language


def build(languages: list[str], found: np.ndarray, member: np.ndarray) -> Filters:
    """Filters of n-grams ``found``; ``member`` has a row for each and a column by language."""
    size = 1 << max(10, int(np.ceil(np.log2(max(1, SLOTS_PER_GRAM * len(found))))))
    width = 8 if len(languages) <= 8 else 64
    kind = np.uint8 if width == 8 else np.uint64
    out = np.zeros((-(-max(1, len(languages)) // width), size), kind)
    places = _slots(found, size)
    for i in range(len(languages)):
        for at in places:
            out[i // width, at[member[:, i]]] |= kind(1 << i % width)
    full = [((out[i // width] >> kind(i % width)) & kind(1)).mean() for i in range(len(languages))]
    return Filters(languages, out, np.array(full) ** HASHES)


def counts(filters: Filters, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Corrected n-gram counts by text and language, and n-grams by text."""
    found, n = grams(texts)
    size = filters.slices.shape[1]
    width = 8 * filters.slices.itemsize
    owner = np.repeat(np.arange(len(texts)), n)
    places = _slots(found, size)
    hits = np.zeros((len(texts), len(filters.languages)))
    for w, own in enumerate(filters.slices):
        masks = own[places[0]]
        for at in places[1:]:
            masks = masks & own[at]
        for i in range(w * width, min(len(filters.languages), (w + 1) * width)):
            bits = (masks >> own.dtype.type(i % width)) & own.dtype.type(1)
            hits[:, i] = np.bincount(owner, bits, len(texts))
    rate = filters.false_rate
    return np.maximum(0.0, (hits - n[:, None] * rate) / (1 - rate)), n


def _sampled(labelled: DataFrame, sample: int) -> tuple[DataFrame, list[str]]:
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return labelled, languages
    rate = F.create_map(
        *[F.lit(x) for lang in languages for x in (lang, min(1.0, sample / sizes[lang]))]
    )[F.col("lang")]
    chance = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return labelled.where(chance < rate), languages


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, rows in batch.groupby("lang"):
            for _, texts in slices(rows["text"]):
                found, often = np.unique(grams(texts)[0], return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": found.astype(np.int64), "n": often})


def learn(docs: DataFrame, sample: int = SAMPLE) -> Filters:
    """Filters from labelled rows that aren't held out.

    The driver gets one row for each n-gram used ``LEAST`` times in the sample, whose size
    bounds their number.
    """
    ship(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    chosen, languages = _sampled(labelled, sample)
    if not languages:
        return build([], np.empty(0, np.int64), np.empty((0, 0), bool))
    often = chosen.select("lang", F.col("text").cast("binary").alias("text")).mapInPandas(
        _count_grams, "lang string, gram long, n long"
    )
    often = often.groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    table = often.toPandas()
    found, row = np.unique(table["gram"].to_numpy(np.int64), return_inverse=True)
    column = np.searchsorted(languages, table["lang"].to_numpy(str))
    uses = np.zeros((len(found), len(languages)))
    uses[row, column] = table["n"]
    uses /= np.maximum(1, uses.sum(axis=0))
    return build(languages, found, (uses > 0) & (uses >= SHARE * uses.max(axis=1, keepdims=True)))


def has_letter(text: bytes) -> bool:
    """Whether a text has a character of a Unicode letter category."""
    return bool(ASCII_LETTER.search(text)) or any(
        c.isalpha() for c in text.decode("utf-8", "ignore")
    )


def judge(filters: Filters, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    if not filters.languages:
        return ["und"] * len(texts), np.zeros(len(texts))
    found, _ = counts(filters, texts)
    letters = np.fromiter(map(has_letter, texts), bool, len(texts))
    best = found.argmax(axis=1)
    total = found.sum(axis=1)
    score = np.where(letters & (total > 0), found.max(axis=1) / np.maximum(total, 1e-9), 0.0)
    return [filters.languages[i] if ok else "und" for i, ok in zip(best, letters)], score


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of each whole text."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(filters)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for values in batches:
            names, scores = [], [np.empty(0)]
            for _, texts in slices(values):
                name, score = judge(shared.value, texts)
                names += name
                scores.append(score)
            yield pd.DataFrame({"lang_pred": names, "score": np.concatenate(scores)})

    found = docs.select(
        "doc_id",
        held_out().alias("held_out"),
        predicted(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("found"),
    )
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")
