"""Toxicity by a string-kernel support vector machine with Nyström landmarks.

A sentence is a set of words; the kernel of two sentences is the sum of their words' gap-weighted
subsequence kernels, to a power that leaves little of weak likenesses. Landmark words stand for
all sentences (Nyström): words that toxic documents of the sample have more often than clean
ones, each chosen for the documents that few before it are like, and those frequent clean words
that are most like them. A linear support vector machine is trained on sentences in that
space. Labels are given for documents, so the toxic sentence of a toxic document is the one that
scores highest, found anew in each round, and any with a toxic landmark; all sentences of clean documents are clean. Toxic
sentences are also shown with a letter put into their worst word.

Since the machine is linear, a word adds the same to every sentence; each distinct word is
scored once. A text's score is its highest sentence's, made a probability by a logistic curve
fitted on the sampled documents.

Before comparing, words lose what isn't a letter, digits and signs that stand for letters become
these, and letters set apart by blanks are joined. Labels are used of rows that aren't held out,
from a sample of at most about ``SAMPLE`` documents of each label, of at most LONGEST bytes,
chosen by a hash of ``doc_id``.

Null and empty texts get the score of no sentence. With no labelled document of either kind the
score is 0. Repeated rows are scored each; several labels of a document count as toxic if one
does. Further columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.llm.common import held_out, mixed, ship, slices, text_bytes
from meterlight.llm.string_kernel import WIDTH, Landmarks

SAMPLE = 1500
LONGEST = 16_384
TOXIC_LANDMARKS = 48
COVER = 8  # landmarks that a toxic document of the sample should have words like
CLEAN_LANDMARKS = 40
FEWEST = 0.005  # share of the toxic documents, 5 at least, to have a landmark not covered
RATIO = 10  # times as often in them as in clean ones
LIKE = 0.3  # kernel, to the power, from which a word is like a landmark
POWER = 3
ROUNDS = 3
SURE = 0.9
WORDS_KEPT = 500_000

# Digits and signs often put in place of letters.
STANDS_FOR = str.maketrans("0134578@$!", "oieastbasi")
SENTENCE = re.compile(rb"[.!?]+(?=\s|$)|\n")
SPACED = re.compile(rb"(?<!\S)(?:[A-Za-z][ \t]+){2,}[A-Za-z](?!\S)")
BLANK = re.compile(rb"[ \t]+")
NOT_LETTER = re.compile(r"[\W\d_]+")
MARK = b"\0"  # stands between sentences


def plain(word: bytes) -> str:
    """A word's letters, in lower case."""
    text = word.decode("utf-8", "replace").lower()
    if text.isalpha():
        return text
    text = text.strip(".,;:!?\"'()[]{}<>|*#%&$-_=+/\\`~")
    if text.isalpha():
        return text
    return NOT_LETTER.sub("", text.translate(STANDS_FOR)) if any(map(str.isalpha, text)) else ""


def marked_words(text: bytes) -> list[bytes]:
    """Words in order, with MARK between sentences; runs of single letters also as a word."""
    if SPACED.search(text):
        text = SPACED.sub(lambda m: m[0] + b" " + BLANK.sub(b"", m[0]), text)
    return SENTENCE.sub(b" \0 ", text).split()


def sentences(text: bytes) -> list[list[bytes]]:
    """Words of each sentence."""
    out: list[list[bytes]] = [[]]
    for word in marked_words(text):
        if word == MARK:
            out.append([])
        else:
            out[-1].append(word)
    return [words for words in out if words]


def parts(word: str) -> list[str]:
    """A word, or overlapping parts of a long one."""
    if len(word) <= WIDTH:
        return [word]
    return [word[i : i + WIDTH] for i in range(0, len(word) - WIDTH // 2, WIDTH // 2)]


@dataclass
class Model:
    landmarks: Landmarks | None
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def words(self, words: list[str]) -> np.ndarray:
        """What each word adds to a sentence's score; a long word's parts add up."""
        split = [parts(w) for w in words]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        flat = list(chain.from_iterable(split))
        row, column, value = self.landmarks.sparse(flat, POWER)
        owner = np.repeat(np.arange(len(words)), counts)
        return np.bincount(owner[row], value * self.weights[column], len(words))

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -40, 40)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1.0, steps: int = 60):
    """Linear machine with squared hinge loss, by Newton steps; the last column is the bias."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        margin = 1 - y * (x @ w)
        inside = margin > 0
        xi, wi = x[inside], weight[inside]
        gradient = w - 2 * cost * xi.T @ (wi * y[inside] * margin[inside])
        hessian = np.eye(len(w)) + 2 * cost * (xi * wi[:, None]).T @ xi
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability, both kinds weighing the same."""
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    w = np.array([1.0, 0.0])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (weight * (p - (y > 0))) + 1e-3 * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _with_letter(word: str, number: int) -> str:
    """``word`` with a letter put in at a place and of a kind that ``number`` decides."""
    spread = int(mixed(np.array([number]))[0])
    at = 1 + spread % max(1, len(word) - 1)
    return word[:at] + chr(97 + (spread >> 20) % 26) + word[at:]


def landmarks(
    names: list[str], word: np.ndarray, doc: np.ndarray, toxic: np.ndarray
) -> tuple[list[str], int]:
    """Landmark words, toxic ones first, and how many of them are toxic.

    ``word`` and ``doc`` hold each document's distinct words. Each toxic landmark has the
    greatest gain (share of the toxic documents with words like fewer than COVER earlier
    landmarks, less share of the clean ones, times their ratio). The clean ones are the words
    of clean documents that come nearest to them, weighed by how many documents have them.
    """
    fits = np.fromiter((3 <= len(w) <= WIDTH for w in names), bool, len(names))[word]
    word, doc = word[fits], doc[fits]
    bad = toxic[doc]
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    good_docs = np.bincount(word[~bad], minlength=len(names))
    in_good = good_docs / n_good
    word, doc = word[bad], doc[bad]
    listed = np.unique(word)
    texts = [names[i] for i in listed]
    covered = np.where(toxic, 0, COVER)
    chosen: list[str] = []
    while len(chosen) < TOXIC_LANDMARKS:
        open_docs = covered < COVER
        in_bad = np.bincount(word[open_docs[doc]], minlength=len(names)) / n_bad
        gain = (in_bad - in_good) * np.abs(in_bad - in_good) / np.maximum(in_bad + in_good, 1e-12)
        fit = (in_bad * n_bad >= max(5, FEWEST * n_bad)) & (in_bad >= RATIO * in_good)
        if not fit.any():
            break
        best = int(np.where(fit, gain, -np.inf).argmax())
        chosen.append(names[best])
        in_good[best] = 1.0  # chosen once
        row, _, value = Landmarks([names[best]]).sparse(texts, POWER)
        near = np.zeros(len(names), bool)
        near[listed[row[value >= LIKE]]] = True
        covered[np.unique(doc[near[word]])] += 1
    if not chosen:
        return [], 0
    clean = np.flatnonzero(good_docs)
    row, _, value = Landmarks(chosen).sparse([names[i] for i in clean], POWER)
    likeness = np.zeros(len(clean), np.float32)
    np.maximum.at(likeness, row, value)
    worth = likeness * good_docs[clean]
    order = [i for i in np.argsort(-worth, kind="stable")[: 2 * CLEAN_LANDMARKS] if worth[i] > 0]
    near_misses = [names[clean[i]] for i in order if names[clean[i]] not in chosen]
    return chosen + near_misses[:CLEAN_LANDMARKS], len(chosen)


class Sentences:
    """Sentences of documents as runs of word numbers."""

    def __init__(self, texts: list[bytes]):
        known: dict[bytes, int] = {}
        self.names: dict[str, int] = {}
        slots, sizes, doc = [], [], []
        for d, text in enumerate(texts):
            for words in sentences(text):
                for word in words:
                    if word not in known:
                        known[word] = self.names.setdefault(plain(word), len(self.names))
                slots.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                sizes.append(len(words))
                doc.append(d)
        self.slots = np.concatenate([np.empty(0, np.int32), *slots])
        self.sizes = np.array(sizes, np.int64)
        self.doc = np.array(doc, np.int64)

    def words_of_docs(self) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.unique(np.repeat(self.doc, self.sizes) * len(self.names) + self.slots)
        return pairs % len(self.names), pairs // len(self.names)


def fit(texts: list[bytes], labels: list[int]) -> Model:
    """A model from labelled documents."""
    toxic = np.array(labels, bool)
    nothing = Model(None, np.empty(0), 0.0, 0.0, -40.0)
    if not toxic.any() or toxic.all():
        return nothing
    found = Sentences(texts)
    names, doc = list(found.names), found.doc
    chosen, n_toxic = landmarks(names, *found.words_of_docs(), toxic)
    if not chosen:
        return nothing
    marks = Landmarks(chosen)
    square = marks.kernels(marks.words, POWER).astype(float)
    square = np.maximum(square, square.T)
    values, vectors = np.linalg.eigh(square)
    good = values > 1e-6
    root = vectors[:, good] / np.sqrt(values[good])  # rows of a sentence's kernels to its space

    pieces = [parts(w) for w in names]
    owner = np.repeat(np.arange(len(names)), np.fromiter(map(len, pieces), np.int64, len(pieces)))
    row, column, value = marks.sparse(list(chain.from_iterable(pieces)), POWER)
    like = np.unique(owner[row])  # words like a landmark; the others add nothing
    place = np.full(len(names), -1)
    place[like] = np.arange(len(like))
    of_word = np.zeros((len(like), len(chosen)), np.float32)
    np.add.at(of_word, (place[owner[row]], column), value)

    sentence = np.repeat(np.arange(len(doc)), found.sizes)
    at = place[found.slots]
    some = np.unique(sentence[at >= 0])  # the other sentences all lie at the origin
    of_sentence = np.full(len(doc), len(some))
    of_sentence[some] = np.arange(len(some))
    rows = np.zeros((len(some) + 1, len(chosen)), np.float32)
    np.add.at(rows, of_sentence[sentence[at >= 0]], of_word[at[at >= 0]])
    space = np.hstack([rows @ root, np.ones((len(rows), 1))])
    best_word = np.full(len(rows), -1)
    worth = of_word[:, :n_toxic].sum(axis=1)
    hit = np.flatnonzero(at >= 0)
    hit = hit[np.argsort(worth[at[hit]], kind="stable")]
    best_word[of_sentence[sentence[hit]]] = found.slots[hit]  # the last one stays: the worst

    score = rows[:, :n_toxic].sum(axis=1)[of_sentence]
    clean = np.flatnonzero(~toxic[doc])
    at_origin = of_sentence[clean] == len(some)
    origin, clean = int(at_origin.sum()), clean[~at_origin]
    # Sentences of toxic documents with a word that all but is a toxic landmark are toxic too.
    sure = rows[:, :n_toxic].max(axis=1, initial=0)[of_sentence] >= SURE
    sure = np.flatnonzero(toxic[doc] & sure)
    for _ in range(ROUNDS):
        worst = np.union1d(_highest(score, doc, np.flatnonzero(toxic)), sure)
        words = [names[best_word[i]] if best_word[i] >= 0 else "" for i in of_sentence[worst]]
        shown = [_with_letter(w, k) for k, w in enumerate(words) if len(w) > 3]
        changed = marks.kernels(shown, POWER) @ root
        changed = np.hstack([changed, np.ones((len(changed), 1))])
        x = np.vstack([space[of_sentence[worst]], changed, space[of_sentence[clean]], space[-1:]])
        y = np.ones(len(x))
        y[len(worst) + len(changed) :] = -1
        often = np.ones(len(x))
        often[-1] = origin
        weight = often * np.where(y > 0, 0.5 / often[y > 0].sum(), 0.5 / max(1, often[y < 0].sum()))
        w = _svm(x, y, weight * often.sum())
        score = (space @ w)[of_sentence]
    margins = np.full(len(texts), w[-1])
    np.maximum.at(margins, doc, score)
    slope, shift = _logistic(margins, np.where(toxic, 1, -1))
    return Model(marks, root @ w[:-1], float(w[-1]), slope, shift)


def _highest(score: np.ndarray, doc: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The highest sentence of each of ``docs`` that has one."""
    order = np.lexsort((-score, doc))
    first = np.concatenate([[True], doc[order][1:] != doc[order][:-1]]) if len(doc) else []
    best = order[np.asarray(first, bool)]
    return best[np.isin(doc[best], docs)]


class Scorer:
    """Scores texts; keeps the words it has met, at most WORDS_KEPT."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.model.landmarks is None:
            return np.zeros(len(texts))
        split = [marked_words(t) for t in texts]
        words = list(chain.from_iterable(split))
        if len(self.slots) > WORDS_KEPT:
            self.clear()
        new = list(set(words).difference(self.slots))
        if new:
            self.slots.update(zip(new, range(len(self.slots), len(self.slots) + len(new))))
            names = [plain(w) for w in new]
            place = {w: i for i, w in enumerate(dict.fromkeys(names))}
            values = self.model.words(list(place))
            at = np.fromiter(map(place.__getitem__, names), np.int64, len(names))
            self.values = np.concatenate([self.values, values[at]])
        slots = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        doc = np.repeat(np.arange(len(texts)), counts)
        # A sentence ends at its mark (slot 0) or with its text.
        ends = (slots == 0) | np.concatenate([doc[1:] != doc[:-1], [True]])[: len(doc)]
        sentence = np.cumsum(ends) - ends
        margin = self.model.bias + np.bincount(sentence, self.values[slots])
        out = np.full(len(texts), self.model.bias)
        np.maximum.at(out, doc[ends], margin[sentence[ends]] if len(doc) else margin)
        return self.model.probability(out)

    def clear(self) -> None:
        self.slots, self.values = {MARK: 0}, np.zeros(1)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """A model from a bounded sample of labelled documents that aren't held out."""
    marked = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id")
    marked = marked.agg(F.max("toxic").alias("toxic")).where(F.col("toxic").isin(0, 1))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rate = F.when(F.col("toxic") == 1, min(1.0, sample / max(1, sizes.get(1, 0)))).otherwise(
        min(1.0, sample / max(1, sizes.get(0, 0)))
    )
    chance = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = marked.where(chance < rate)
    texts = docs.where(F.length(text_bytes()) <= longest).select("doc_id", text_bytes().alias("text"))
    # The sample has at most about 2 * SAMPLE rows of at most ``longest`` bytes.
    rows = texts.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").toPandas()
    return fit([bytes(t) for t in rows["text"]], rows["toxic"].to_list())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of each whole text."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for values in batches:
            yield pd.Series(
                np.concatenate([np.empty(0), *(scorer.scores(t) for _, t in slices(values))])
            )

    found = docs.select("doc_id", held_out().alias("held_out"), scored(text_bytes()).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
