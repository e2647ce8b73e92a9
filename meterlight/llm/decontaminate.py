"""Benchmark decontamination: documents' words that stand in windows of benchmark items.

Only DataFrame functions run on the tables. A text is lower-cased (A to Z) and split into words; a window is ``length``
consecutive words of an item, and an item with fewer words, but not none, is one window.

1. The distinct windows of the benchmark are stored with their items. Windows with the same items share a class, so a
   prompt that thousands of items begin with is looked up once for a document, not once for each window.
2. A hash set of the windows, one bit for each hash, goes to every task as a scalar subquery. It has 32 bits a window,
   and MOST_LONGS longs (half a megabyte) at most, however large the benchmark is.
3. One scan of the documents hashes their token windows and keeps the places whose bit is set, with the window's words.
   These narrow rows are stored; nothing else of a clean document is shuffled.
4. Kept places are verified: their words are joined with the stored windows (broadcast up to BROADCAST_BYTES, which is
   checked, else shuffled, where adaptive execution splits windows that many documents hold). Hits meet by document,
   where they are at most as many as its own words.

Beyond 2 million windows the set has fewer bits for each, so more places reach the join; the result is the same.

A null or empty text has no words: zero hits, as has a text of separators. A null item text has no windows; a null item id
counts as an item with an empty name. Repeated documents are each judged, also if their ids agree or are null; repeated
items with one id count once. An empty benchmark hits nothing, an empty table gives an empty result. Texts may be of any
length. Further columns, whatever their names, are ignored by ``judge`` and kept by ``remove_spans`` and ``drop_hit``.
"""

from __future__ import annotations

import string
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlight.llm.common import materialize

LENGTH = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MOST_LONGS = 1 << 16
WINDOWS_OF_LONG = 2
BROADCAST_BYTES = 64 << 20


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def _places(n: Column, length: int | Column) -> Column:
    """The first words, from 1, of all windows among ``n`` words."""
    return F.when(n >= length, F.sequence(F.lit(1), n - length + 1)).otherwise(F.array().cast("array<int>"))


def _hash(words: Column, first: Column, length: int | Column) -> Column:
    return F.xxhash64(F.slice(words, first, length))


def _gram(words: Column, first: Column, length: int | Column) -> Column:
    return F.array_join(F.slice(words, first, length), " ")


def item_windows(items: DataFrame, length: int, id: str, text: str) -> DataFrame:
    """``item`` and the ``gram``, ``hash`` and ``size`` of each of its windows."""
    name = F.coalesce(F.col(id).cast("string"), F.lit("")).alias("item")
    split = items.select(name, words(F.col(text)).alias("words")).where(F.size("words") > 0)
    split = split.withColumn("size", F.least(F.lit(length), F.size("words")))
    placed = split.withColumn("first", F.explode(_places(F.size("words"), F.col("size"))))
    w, first, size = F.col("words"), F.col("first"), F.col("size")
    return placed.select("item", "size", _gram(w, first, size).alias("gram"), _hash(w, first, size).alias("hash"))


class Windows:
    """The stored windows of a benchmark, and their hash set."""

    def __init__(self, items: DataFrame, length: int = LENGTH, id: str = "item_id", text: str = "text"):
        listed = item_windows(items, length, id, text)
        with_items = listed.groupBy("gram", "hash", "size").agg(F.sort_array(F.collect_set("item")).alias("items"))
        named = with_items.withColumn("class", F.sha2(F.to_json("items"), 256))
        bytes = F.octet_length("gram") + F.octet_length(F.to_json("items")) + 128
        measures = {"n": F.count("*"), "bytes": F.sum(bytes)}
        table, seen = materialize(named, "windows", measures)
        self.grams = table.select("gram", "class")
        self.small = (seen["bytes"] or 0) <= BROADCAST_BYTES
        self.classes = table.groupBy("class").agg(F.min("items").alias("items"))
        self.sizes = sorted(r["size"] for r in table.select("size").distinct().collect())  # at most `length`
        self.longs = 64
        while self.longs < MOST_LONGS and self.longs * WINDOWS_OF_LONG < seen["n"]:
            self.longs *= 2
        self._hashes = table.select("hash")

    def slot(self, hash: Column) -> tuple[Column, Column]:
        """Which long of the set, and which bit of it."""
        long = F.shiftright(hash, 6).bitwiseAND(F.lit(self.longs - 1))
        return long.cast("int"), hash.bitwiseAND(F.lit(63)).cast("int")

    def bits(self) -> Column:
        """The hash set as a scalar array of longs."""
        long, bit = self.slot(F.col("hash"))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
        filled = self._hashes.select(long.alias("long"), one.alias("bit"))
        spark = self._hashes.sparkSession
        none = spark.range(self.longs).select(F.col("id").cast("int").alias("long"), F.lit(0).cast("long").alias("bit"))
        longs = filled.union(none).groupBy("long").agg(F.bit_or("bit").alias("bits"))
        ordered = F.sort_array(F.collect_list(F.struct("long", "bits")))
        return longs.agg(ordered.alias("all")).select(F.col("all.bits")).scalar()


def _known(windows: Windows, hashes: Column, first: Column) -> Column:
    long, bit = windows.slot(F.get(hashes, first - 1))
    return F.getbit(F.get(F.col("_bits"), long), bit) == 1


def _place(size: int, first: Column) -> Column:
    gram = _gram(F.col("_words"), first, F.lit(size))
    return F.struct(first.alias("first"), F.lit(size).alias("size"), gram.alias("gram"))


def _scanned(docs: DataFrame, windows: Windows, text: str, keep: list[Column]) -> DataFrame:
    """The stored scan: a key, the kept columns, ``n_words`` and the places that the hash set lets through."""
    now = docs.select(*keep, words(F.col(text)).alias("_words")).withColumn("_bits", windows.bits())
    found = [F.array().cast("array<struct<first:int,size:int,gram:string>>")]
    for size in windows.sizes:
        places = _places(F.size("_words"), size)
        now = now.withColumn(f"_h{size}", F.transform(places, lambda i: _hash(F.col("_words"), i, F.lit(size))))
        passed = F.filter(places, partial(_known, windows, F.col(f"_h{size}")))
        found.append(F.transform(passed, partial(_place, size)))
    kept = [c for c in now.columns if not c.startswith(("_h", "_words", "_bits"))]
    scanned = now.select(
        F.monotonically_increasing_id().alias("_key"),
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.flatten(F.array(*found)).alias("places"),
    )
    return materialize(scanned, "scanned")


def _hits(scanned: DataFrame, windows: Windows, keep: list[str]) -> DataFrame:
    """Of documents with places: the verified words, in order, and the items."""
    grams, classes = windows.grams, windows.classes
    if windows.small:
        grams, classes = F.broadcast(grams), F.broadcast(classes)
    placed = scanned.where(F.size("places") > 0).select("_key", *keep, "n_words", F.explode("places").alias("place"))
    placed = placed.select("_key", *keep, "n_words", "place.*").join(grams, "gram", "left")
    real = F.col("class").isNotNull()
    by_doc = placed.groupBy("_key", *keep, "n_words").agg(
        F.collect_set(F.when(real, F.struct("first", "size"))).alias("runs"),
        F.collect_set("class").alias("classes"),
    )
    every = F.transform("runs", lambda r: F.sequence(r["first"], r["first"] + r["size"] - 1))
    by_doc = by_doc.withColumn("hit", F.sort_array(F.array_distinct(F.flatten(every)))).drop("runs")
    named = by_doc.withColumn("class", F.explode_outer("classes")).join(classes, "class", "left")
    return named.groupBy("_key", *keep, "n_words").agg(
        F.first("hit").alias("hit"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )


def judge(
    docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, words, hit words, items with occurring windows and their digest, and whether any word is hit."""
    windows = Windows(benchmark, length)
    scanned = _scanned(docs, windows, text, [F.col(id).alias("doc_id")])

    def result(hit: Column, items: Column) -> list[Column]:
        return [
            F.col("doc_id"),
            F.col("n_words"),
            hit.cast("long").alias("n_hit"),
            F.size(items).cast("long").alias("n_items"),
            F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
            (hit > 0).alias("contaminated"),
        ]

    clean = scanned.where(F.size("places") == 0)
    clean = clean.select(*result(F.lit(0), F.array().cast("array<string>")))
    return clean.union(_hits(scanned, windows, ["doc_id"]).select(*result(F.size("hit"), F.col("items"))))


def _with_hits(docs: DataFrame, benchmark: DataFrame, length: int, text: str) -> tuple[DataFrame, DataFrame]:
    """Clean documents, and documents that have hit words, with these in ``hit``."""
    windows = Windows(benchmark, length)
    scanned = _scanned(docs, windows, text, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")])
    hits = _hits(scanned, windows, []).where(F.size("hit") > 0).select("_key", "hit")
    suspects = scanned.where(F.size("places") > 0).join(hits, "_key", "left")
    clean = scanned.where(F.size("places") == 0).select("doc.*")
    return clean.union(suspects.where("hit IS NULL").select("doc.*")), suspects.where("hit IS NOT NULL")


def drop_hit(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """``docs`` without those that hold a window of the benchmark."""
    return _with_hits(docs, benchmark, length, text)[0]


def remove_spans(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """``docs`` with hit words, and what follows each of them up to the next word, cut out of the text.

    Words before a hit one keep what separates them; the rest of the text stays as it was, letter case included.
    """
    clean, hit = _with_hits(docs, benchmark, length, text)
    original = F.col(f"doc.{text}")
    # Capital letters are word characters of the text as it stands.
    word = WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    no_word = "[" + word[2:-1] + "*"
    lead = F.regexp_extract(original, f"^{no_word}", 0)
    tokens = F.regexp_extract_all(original, F.lit(f"{word}{no_word}"), F.lit(0))
    cut = hit.select("doc", "hit", lead.alias("lead"), tokens.alias("tokens"))
    h = F.col("hit")
    ends = F.filter(h, lambda p, i: (i + 1 == F.size(h)) | (F.get(h, i + 1) != p + 1))
    starts = F.filter(h, lambda p, i: (i == 0) | (F.get(h, i - 1) != p - 1))
    none = F.array().cast("array<int>")
    gaps = F.zip_with(
        F.concat(F.array(F.lit(0)), F.coalesce(ends, none)),
        F.concat(F.coalesce(starts, none), F.array(F.size("tokens") + 1)),
        lambda end, start: F.struct((end + 1).alias("first"), (start - end - 1).alias("n")),
    )
    cut = cut.withColumn("gaps", gaps)
    parts = F.transform("gaps", lambda g: F.array_join(F.slice("tokens", g["first"], g["n"]), ""))
    kept = F.concat("lead", F.array_join(parts, ""))
    columns = [kept.alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    return clean.union(cut.select(*columns))


# ---- the same in SQL --------------------------------------------------------------------


def sql() -> str:
    """``judge`` over ``documents`` and ``benchmark``, for DuckDB."""
    lower = f"translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    split = f"coalesce(regexp_extract_all({lower.format('text')}, '{WORD}'), CAST([] AS VARCHAR[]))"
    return f"""
WITH item_words AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {split} AS w FROM benchmark
), grams AS (
  SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS gram FROM (
    SELECT item, w, least({LENGTH}, len(w)) AS size, unnest(range(1, len(w) - least({LENGTH}, len(w)) + 2)) AS i
    FROM item_words WHERE len(w) > 0)
), docs AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id, {split} AS w FROM documents
), windows AS (
  SELECT k, size, i, array_to_string(w[i : i + size - 1], ' ') AS gram FROM (
    SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS i
    FROM docs, (SELECT DISTINCT size FROM grams) AS sizes WHERE len(w) >= size)
), hits AS MATERIALIZED (
  SELECT k, i, windows.size AS size, item FROM windows JOIN grams ON windows.gram = grams.gram
), covered AS (
  SELECT k, count(DISTINCT p) AS n_hit FROM (
    SELECT DISTINCT k, unnest(range(i, i + size)) AS p FROM hits) AS places GROUP BY k
), named AS (
  SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT k, item FROM hits) AS pairs GROUP BY k
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered ON docs.k = covered.k LEFT JOIN named ON docs.k = named.k"""
