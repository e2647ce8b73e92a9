from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from meterlight.functions import text as T
from meterlight.operators import retrieval


def plain_score(question, content):
    asked, body = question.lower(), content.lower()
    words = set(asked.split())
    words = words - set(T.STOPWORDS) or words
    found = [body.count(w) for w in words]
    return sum(found) + 2 * sum(n > 0 for n in found) + (10 if asked in body else 0)


def documents(spark, texts):
    rows = [(i, f"s{i}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def random_text(rng):
    words = ["meter", "Énergie", "a", "peak", "day", "##", "x" * 30, "week-end", " "]
    marks = [" ", " ", " ", "\n", "\n\n", "\n\n", "\n## "]
    return "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 900)))


def blocks(letters, size=300):
    return "\n\n".join(c * size for c in letters)


# Texts with their chunks worked out by hand. A chunk is closed when the next paragraph
# would take it past 800 characters; the next one starts with its last 100.
WORKED = {
    "empty": ("", [""]),
    "stripped": (" \u00a0 x\u2003\n", ["x"]),
    "exactly full": ("s" * 800, ["s" * 800]),
    "sections": ("\n## one\n## two", ["", "## one", "## two"]),
    "packed": (
        blocks("abcde"),
        [
            blocks("ab"),
            "b" * 100 + "\n\n" + blocks("cd"),
            "d" * 100 + "\n\n" + blocks("e"),
        ],
    ),
    "accents count once": (
        blocks("éüî"),
        [blocks("éü"), "ü" * 100 + "\n\n" + blocks("î")],
    ),
    "section mark counts": (
        "x\n## " + "t" * 798,
        ["x", "## " + "t" * 798],
    ),
    "long paragraph between short ones": (
        "a\n\n" + "L" * 1000 + "\n\nz",
        ["a", "a\n\n" + "L" * 1000, "L" * 100 + "\n\nz"],
    ),
    "only blank lines": ("\n\n" * 500, [""]),
}


def folded(text, size, overlap):
    """Chunks by growing strings, one paragraph after another."""
    out = []
    for i, section in enumerate(text.split("\n## ")):
        whole = ("## " if i else "") + section
        if len(whole) <= size:
            out.append(whole.strip())
            continue
        current = ""
        for paragraph in whole.split("\n\n"):
            if len(current) + len(paragraph) > size and current != "":
                out.append(current.strip())
                current = current[-overlap:] if overlap else ""
            current += "\n\n" + paragraph
        if current.strip():
            out.append(current.strip())
    return out


@pytest.mark.parametrize(("size", "overlap"), [(800, 100), (50, 10), (30, 0), (20, 25)])
def test_offsets_give_the_chunks_of_the_growing_strings(spark, size, overlap):
    rng = random.Random(size)
    texts = [random_text(rng) for _ in range(40)] + ["\n\n".join("ab" for _ in range(2000)), "\n\n" * 700]
    rows = documents(spark, texts).select(T.chunk_array(F.col("text"), size, overlap).alias("chunks"), "doc_id")
    assert {r.doc_id: r.chunks for r in rows.collect()} == {
        i: folded(t, size, overlap) for i, t in enumerate(texts)
    }


def test_time_of_chunking_is_linear(spark):
    """Eight times the paragraphs take at most some sixteen times as long."""

    def seconds(paragraphs):
        numbers = F.sequence(F.lit(1), F.lit(paragraphs))
        text = F.array_join(F.transform(numbers, lambda i: F.repeat(F.lit("word "), 20)), "\n\n")
        started = time.monotonic()
        row = spark.range(1).select(F.size(T.chunk_array(text)).alias("n")).first()
        assert row.n == -(-paragraphs // 6)
        return time.monotonic() - started

    seconds(2_000)
    assert seconds(80_000) < 16 * seconds(10_000) + 2


def test_worked_chunks(spark):
    texts = [text for text, _ in WORKED.values()]
    rows = retrieval.chunk_text(documents(spark, texts)).orderBy("doc_id", "chunk_ord").collect()
    for number, (name, (_, expected)) in enumerate(WORKED.items()):
        mine = [(r.chunk_ord, r.content) for r in rows if r.doc_id == number]
        assert mine == list(enumerate(expected)), name


def test_long_paragraph_is_never_cut(spark):
    chunks = retrieval.chunk_text(documents(spark, ["q" * 5000])).collect()
    assert [len(r.content) for r in chunks] == [5000]


QUESTIONS = [
    "What is the peak day?",
    "the of and",
    "énergie week-end",
    "a",
    "peak day",
    "nothing-matches-this zzzzzz",
    "aa aaa",
    " ",
    "",
]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    texts = [random_text(rng) for _ in range(12)] + ["aaaa aaaaa", "The PEAK day?", "peak day"]
    return retrieval.chunk_text(documents(spark, texts)).cache()


@pytest.mark.parametrize("question", QUESTIONS)
def test_one_question(spark, corpus, question):
    rows = retrieval.keyword_score(corpus, question).collect()
    assert all(r.score == plain_score(question, r.content) for r in rows)
    ranked = sorted(rows, key=lambda r: (-r.score, r.doc_id, r.chunk_ord))
    expected = [r for r in ranked[:4] if r.score > 0]
    if not expected:
        expected = sorted(rows, key=lambda r: (r.doc_id, r.chunk_ord))[:3]
    found = retrieval.retrieve_top_k(corpus, question).collect()
    key = [(r.doc_id, r.chunk_ord) for r in sorted(found, key=lambda r: (-r.score, r.doc_id, r.chunk_ord))]
    assert key == [(r.doc_id, r.chunk_ord) for r in expected]


def test_question_table_equals_brute_force(spark, corpus):
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "question_id long, question string")
    found = {
        (r.question_id, r.doc_id, r.chunk_ord): r.score
        for r in retrieval.keyword_scores(corpus, asked).collect()
    }
    expected = {}
    for r in corpus.collect():
        for number, question in enumerate(QUESTIONS):
            score = plain_score(question, r.content)
            if score:
                expected[(number, r.doc_id, r.chunk_ord)] = score
    assert found == expected
    best = retrieval.retrieve(corpus, asked)
    assert best.groupBy("question_id").count().count() == len(QUESTIONS)
    fallback = best.filter("question_id = 5").orderBy("rank").collect()
    assert [(r.rank, r.score) for r in fallback] == [(1, 0), (2, 0), (3, 0)]


def test_no_cross_join_in_batch_scoring(spark, corpus):
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "question_id long, question string")
    plan = retrieval.retrieve(corpus, asked)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_context_and_messages(spark):
    found = spark.createDataFrame(
        [(1, 2, "s2", "two"), (1, 1, "s1", "one")],
        "question_id long, rank int, source string, content string",
    )
    context = retrieval.build_context(found)
    assert context.first().context == "[Source: s1]\none\n\n---\n\n[Source: s2]\ntwo"
    past = spark.createDataFrame(
        [(7, t, "user", f"m{t}") for t in range(9)], "conv_id long, turn long, role string, text string"
    )
    asked = spark.createDataFrame([(1, "why?", 7)], "question_id long, question string, conv_id long")
    rows = retrieval.chat_messages(past, asked, context).orderBy("position").collect()
    assert [r.content for r in rows[1:-1]] == [f"m{t}" for t in range(3, 9)]
    assert rows[0].role == "system" and rows[-1].content.endswith("User question: why?")
    assert rows[-1].content.startswith("Context from knowledge base:\n\n[Source: s1]")


def test_keywords_fall_back_to_stopwords(spark):
    frame = spark.createDataFrame([("Is it The the",), ("Why peak PEAK?",)], "q string")
    rows = [sorted(r[0]) for r in frame.select(T.keywords(F.col("q"))).collect()]
    assert rows == [["is", "it", "the"], ["peak", "peak?"]]
