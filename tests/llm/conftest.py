from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, found string, kept int, block long, p string, rest string, size int"
LONG = "word and another " * 40_000

ROWS = [
    (1, "Hello there, this is a plain text of some more than ten words in all.", "en", "a"),
    (1, "Hello there, this is a plain text of some more than ten words in all.", "en", "a"),
    (2, "Hello there, this is a plain text of some more than ten words in all.", "en", None),
    (3, None, None, None),
    (4, "", "de", "b"),
    (5, LONG, "en", "a"),
    (6, "  \t\n  ", None, "b"),
    (None, "A row without an id, but with quite enough words to be a real text of its own.", "fr", "c"),
    (7, "x" * 70_000, "es", "c"),
    (8, "日本語 текст ελληνικά ́ é !? <|endoftext|> 1234", None, "b"),
    (9, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", "en", ""),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns that operators also use."""
    rows = [(*r, None if r[1] is None else len(r[1]), "x", 1, 2, "y", "z", 3) for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    rows = documents.orderBy(F.col("doc_id")).collect()
    return [(r["doc_id"], (r["text"] or "").encode()) for r in rows]
