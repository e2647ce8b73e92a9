"""The layout along a space-filling curve: results as of the whole table, from few files."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from meterlight.operators import eda
from meterlight.sources import layout

START = date(2012, 1, 1)
DAYS, HOUSEHOLDS, FILES = 800, 96, 1024


@pytest.fixture(scope="module")
def panel(spark):
    days = spark.range(DAYS).select(F.date_add(F.lit(START), F.col("id").cast("int")).alias("day"))
    households = spark.range(HOUSEHOLDS).select(F.format_string("MAC%06d", "id").alias("household_id"))
    rows = days.crossJoin(households)  # a made-up panel
    return rows.withColumn("energy_sum", (F.xxhash64("day", "household_id") % 1000).cast("double")).cache()


@pytest.fixture(scope="module")
def laid_out(panel, tmp_path_factory):
    return layout.write_layout(panel, str(tmp_path_factory.mktemp("layout") / "panel"), 4, 6)


def read_files(df) -> int:
    return len(df.inputFiles())


def same(a, b) -> bool:
    columns = sorted(a.columns)
    return sorted(map(tuple, a.select(columns).collect())) == sorted(map(tuple, b.select(columns).collect()))


def test_both_filters_read_less_than_a_tenth_of_the_files(panel, laid_out):
    every = laid_out.manifest.count()
    assert every == FILES and laid_out.manifest.agg(F.sum("rows")).first()[0] == DAYS * HOUSEHOLDS
    last = START + timedelta(days=DAYS - 1)
    for start in (last - timedelta(days=59), START + timedelta(days=333)):
        end = start + timedelta(days=59)
        part = laid_out.scan(start, end)
        assert read_files(part) < 0.1 * every  # 60 of 800 days are 7.5 %
        assert same(part, eda.eda_filter(panel, start, end))
    for household in ("MAC000000", "MAC000041", "MAC000089"):
        part = laid_out.scan(households=[household])
        assert read_files(part) < 0.1 * every
        assert same(part, eda.household_slice(panel, household))
    both = laid_out.scan(START, START + timedelta(days=59), ["MAC000007"])
    assert read_files(both) == 5 and both.count() == 60  # blocks of 12.5 days, one range of households


def test_the_last_rows_come_from_the_last_files(panel, laid_out):
    part = laid_out.since(30)
    assert read_files(part) < 0.1 * laid_out.manifest.count()
    assert eda.recent_rows(part).collect() == eda.recent_rows(panel.select(*part.columns)).collect()
    assert laid_out.since(10**9).count() == DAYS * HOUSEHOLDS
    assert laid_out.last_day() == START + timedelta(days=DAYS - 1)


def test_nulls_and_empty(spark, tmp_path):
    kind = "household_id string, day date, energy_sum double"
    rows = [("a", START, 1.0), (None, START, 2.0), ("b", None, 3.0), ("b", START + timedelta(days=9), 4.0)]
    odd = layout.write_layout(spark.createDataFrame(rows, kind), str(tmp_path / "odd"), 1, 1)
    assert odd.scan().count() == 4
    assert [r[2] for r in odd.scan(START, START).orderBy("energy_sum").collect()] == [1.0, 2.0]
    assert sorted(r[2] for r in odd.scan(households=["b"]).collect()) == [3.0, 4.0]
    assert odd.scan(households=["zzz"]).collect() == []
    empty = layout.write_layout(spark.createDataFrame([], kind), str(tmp_path / "empty"))
    assert empty.scan(START).collect() == [] and empty.since(5).count() == 0


def test_morton_interleaves_bits(spark):
    even, more = layout.morton(F.lit(0b101), F.lit(0b011), 3, 3), layout.morton(F.lit(0b1), F.lit(0b110), 1, 3)
    row = spark.range(1).select(even, more).first()
    assert row[0] == 0b100111 and row[1] == 0b1110
