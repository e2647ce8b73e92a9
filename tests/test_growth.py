"""What a task holds, and how often a table is read, as tables grow."""

from __future__ import annotations

import random
import re
import statistics
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from meterlight.functions.keywords import KeywordIndex
from meterlight.operators import retrieval, trees
from meterlight.operators.trees import TreeSettings
from meterlight.plans.panel import build_panel
from meterlight.schema import DAY, HOUSEHOLD
from meterlight.session import PARTITIONS_SETTING, shuffle_partitions
from meterlight.sources import bucketed, testbed


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_partitions_are_raised_inside_only(spark):
    before = spark.conf.get(PARTITIONS_SETTING)
    with pytest.raises(ValueError):
        with shuffle_partitions(spark, 9):
            assert spark.conf.get(PARTITIONS_SETTING) == "9"
            raise ValueError
    with shuffle_partitions(spark, 1):
        assert spark.conf.get(PARTITIONS_SETTING) == before
    assert spark.conf.get(PARTITIONS_SETTING) == before


def test_buckets_of_the_panel_follow_the_readings(spark, work, monkeypatch):
    tables = (work.readings, work.households, work.weather, work.holidays)
    few = build_panel(*tables).features
    monkeypatch.setattr(bucketed, "ROWS_OF_BUCKET", 500)
    many = build_panel(*tables).features
    enough = -(-work.readings.count() // 500)
    sizes = [int(plan(t.groupBy(HOUSEHOLD).count()).split("SelectedBucketsCount: ")[1].split()[0]) for t in (few, many)]
    assert sizes == [int(spark.conf.get(PARTITIONS_SETTING)), enough] and enough > sizes[0]
    columns = ["household_id", DAY, "energy_sum", "energy_sum_lag_7"]
    assert sorted(few.select(*columns).collect()) == sorted(many.select(*columns).collect())


def test_medians_of_readings_carry_no_maps(spark, tmp_path):
    """Days of none to five known quantities, with ties and nulls, against plain medians."""
    rng = random.Random(3)
    days = {(k, d): [rng.choice([None, 1.0, 2.0, 2.5, 7.0]) for _ in range(rng.randint(1, 5))]
            for k in (1, 2, None) for d in range(1, 29)}
    rows = [(k, datetime(2001, 2, d), v) for (k, d), values in days.items() for v in values]
    kind = "l_suppkey long, l_shipdate timestamp, l_quantity double"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/lineitem.parquet")
    readings = testbed.readings(spark, str(tmp_path))
    assert "ObjectHashAggregate" not in plan(readings) and "SortAggregate" not in plan(readings)
    got = {(r.household_id, r.day.day): r for r in readings.where("ingest_ordinal = 1").collect()}
    assert len(got) == len(days)
    for (k, d), values in days.items():
        known = [v for v in values if v is not None]
        row = got[None if k is None else f"MAC{k:06d}", d]
        assert row.energy_median == (statistics.median(known) if known else None)
        assert row.energy_count == len(values) and row.energy_max == max(known, default=None)


@pytest.fixture(scope="module")
def binned(spark):
    rows = spark.range(4000).select((F.col("id") % 50).cast("double").alias("a"), F.rand(1).alias("energy_sum"))
    return trees.bin_table(rows, ["a"])


def test_all_draws_come_from_one_scan(binned, monkeypatch):
    monkeypatch.setattr(trees, "SAMPLE", 300)
    draws = {0: 0, 1: 0, 2: 1, 3: 2}
    copies = trees._copies(binned, draws)
    assert plan(copies).count("FileScan") == 1
    by_part = {p: sorted(r["key"] for r in copies.where(F.col("part") == p).collect()) for p in draws}
    assert by_part == {p: sorted(r["key"] for r in trees.drawn(binned, d).collect()) for p, d in draws.items()}
    pool = trees._pool(binned, [0, 1, 2])
    assert pool.table.count() < 1000 and pool.rows == binned.rows
    for d in (0, 1, 2):
        assert sorted(trees.drawn(pool, d).collect()) == sorted(trees.drawn(binned, d).collect())


def test_stages_and_forests_read_the_whole_table_once(binned, monkeypatch):
    monkeypatch.setattr(trees, "SAMPLE", 300)
    pools = []
    pool_of = trees._pool
    monkeypatch.setattr(trees, "_pool", lambda data, draws: pools.append(list(draws)) or pool_of(data, draws))
    trees.fit_boosted(binned, {"a": TreeSettings(True, 5, 2, 5), "b": TreeSettings(True, 3, 2, 5)}, stage=2)
    trees.fit_forest(binned, TreeSettings(False, 25, 2, 5))
    assert pools == [[0, 1, 2], [0, 1, 2]]


def test_keyword_index_equals_counting():
    rng = random.Random(1)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    keywords = sorted(set(words[:60]))
    index = KeywordIndex(keywords)
    for text in (" ".join(words[60:]), "aaaa aa\x85a", "", "  ", None, "zz"):
        found, hits = index.of_text(text)
        expected = {k: sum(t.count(k) for t in (text or "").split()) for k in keywords}
        assert dict(zip(found, hits.tolist())) == {k: n for k, n in expected.items() if n}
    assert KeywordIndex([]).of_text("a b") [0] == []


def test_scores_do_not_depend_on_passes_and_partitions(spark, monkeypatch):
    """Also with a repeated chunk and a chunk without text."""
    chunks = spark.createDataFrame(
        [(i, "s", 0, f"Ab{i % 3} cab ab the Bc{i % 5} abab") for i in range(20)] + [(3, "s", 0, "ab x"), (40, "s", 0, None)],
        "doc_id long, source string, chunk_ord int, content string",
    )
    asked = spark.createDataFrame([(1, "ab bc1 bc2"), (2, "the"), (3, "cab x"), (4, " ")], "question_id long, question string")
    whole = sorted(retrieval.keyword_scores(chunks, asked).collect())
    monkeypatch.setattr(retrieval, "KEYWORDS_AT_ONCE", 2)
    monkeypatch.setattr(retrieval, "CHUNKS_OF_TASK", 2)
    split = retrieval.keyword_scores(chunks, asked)
    assert "hashpartitioning(doc_id" in plan(split) and ", 11)" in plan(split)
    assert sorted(split.collect()) == whole
    # Chunks are shuffled with the keywords they hold, not with a row for each word or pair.
    assert not re.search(r"hashpartitioning\([^)]*(token|keyword)#", plan(split))
    assert not re.search(r"hashpartitioning\(question_id#\w+, doc_id", plan(split))
    # A repeated chunk's occurrences add up, and each of its rows gets the score.
    assert [s for q, d, _, s in whole if (q, d) == (3, 3)] == [1 + 2 + 1 + 2] * 2
