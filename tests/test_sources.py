from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from meterlight.plans.panel import unfinished_panel
from meterlight.session import new_path, shared_folder
from meterlight.sources import readers, sinks


def write(path, name, text, encoding="utf-8"):
    target = path / name
    target.write_bytes(text.encode(encoding) if isinstance(text, str) else text)
    return str(target)


def test_readings_layouts_and_bad_numbers(spark, tmp_path):
    path = write(
        tmp_path,
        "daily.csv",
        "LCLid,day,energy_median,energy_mean,energy_max,energy_count,energy_std,energy_sum,energy_min\n"
        "MAC1,2012-10-12,0.1,0.2,0.3,48,0.05,7.1,0.01\n"
        "MAC1,10/13/2012,0.1,0.2,0.3,48,,Null,0.01\n"
        "MAC2,\"Oct 14, 2012\",0.1,0.2,0.3,48,NaN,1e1,0.01\n"
        "MAC2,2012-10-15 00:00:00,x,0.2,0.3,48,0.05, 3 ,0.01\n",
    )
    rows = readers.scan_readings(spark, path).orderBy("day").collect()
    assert [r.day.day for r in rows] == [12, 13, 14, 15]
    assert [r.energy_sum for r in rows] == [7.1, None, 10.0, 3.0]
    assert [r.energy_std for r in rows] == [0.05, None, None, 0.05]
    assert rows[3].energy_median is None
    assert len({r.ingest_ordinal for r in rows}) == 4


def test_weather_keeps_first_row_of_a_day(spark, tmp_path):
    path = write(
        tmp_path,
        "weather.csv",
        "time,temperatureMax,icon,humidity\n2012-01-02 00:00:00,5.5,a,0.9\n"
        "2012-01-01 00:00:00,4,b,bad\n2012-01-02 12:00:00,9,c,0.1\n",
    )
    rows = readers.scan_weather(spark, path).collect()
    assert [(r.day, r.temperature_max, r.humidity) for r in rows] == [
        (date(2012, 1, 1), 4.0, None),
        (date(2012, 1, 2), 5.5, 0.9),
    ]


def test_file_order_spans_files(spark, tmp_path):
    for i in range(4):
        size = 5 if i % 2 else 400
        lines = "".join(f"2012-01-01,{i * 1000 + n}\n" for n in range(size))
        write(tmp_path, f"part-{i}.csv", "time,humidity\n" + lines)
    assert readers.scan_weather(spark, str(tmp_path)).collect()[0].humidity == 0.0


def test_holidays_are_distinct(spark, tmp_path):
    path = write(tmp_path, "h.csv", "Bank holidays,Type\n2012-12-26,Boxing\n12/26/2012,Boxing\n2013-01-01,New\n")
    assert sorted(r.day for r in readers.scan_holidays(spark, path).collect()) == [
        date(2012, 12, 26),
        date(2013, 1, 1),
    ]


def test_latin1(spark, tmp_path):
    path = write(tmp_path, "acorn.csv", "MAIN CATEGORIES,ACORN-A\ncafé,1\n", "latin1")
    assert readers.scan_acorn_details(spark, path).first()[0] == "café"


def test_documents_skip_missing_and_drop_bad_bytes(spark, tmp_path):
    path = write(tmp_path, "a.md", b"one\n\ntw\xffo\n")
    table = readers.scan_documents(spark, {path: "Guide", str(tmp_path / "none.md"): "None"})
    assert [(r.source, r.text) for r in table.collect()] == [("Guide", "one\n\ntwo\n")]
    assert readers.scan_documents(spark, {}).isEmpty()


def test_documents_of_several_files_in_one_scan(spark, tmp_path):
    paths = {write(tmp_path, f"part {i}.md", f"text {i}\n".encode()): f"label {i}" for i in range(5)}
    table = readers.scan_documents(spark, paths)
    assert sorted(tuple(r) for r in table.collect()) == [
        (i, f"label {i}", f"text {i}\n") for i in range(5)
    ]
    assert table._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_first_household_row_counts(spark, tmp_path):
    path = write(tmp_path, "h.csv", "LCLid,stdorToU,Acorn,Acorn_grouped,file\nA,ToU,z,z,f\nA,Std,a,a,f\n")
    households = readers.scan_households(spark, path, keep_order=True)
    readings = spark.createDataFrame(
        [("A", date(2013, 1, d), 1.0) for d in range(1, 20)],
        "household_id string, day date, energy_sum double",
    ).withColumn("ingest_ordinal", F.lit(1))
    weather = readings.select("day").withColumn("humidity", F.lit(1.0))
    panel = unfinished_panel(readings, households, weather, None)
    assert "_file_order" not in panel.columns
    assert {r.tariff for r in panel.select("tariff").distinct().collect()} == {"ToU"}


@pytest.mark.parametrize(
    "text", ["2013-02-03", "2/3/2013", "Feb 3, 2013", "3 February 2013", "2013/2/3", "20130203",
             "2013-02-03 10:30:00", "2013-02-03T00:00:00"],
)
def test_date_layouts(spark, text):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(readers.parse_date(F.col("t"))).first()[0] == date(2013, 2, 3)


def test_missing_dates_stay_missing(spark):
    frame = spark.createDataFrame([(None,)], "t string")
    assert frame.select(readers.parse_date(F.col("t"))).first()[0] is None


def test_month_folders_are_pruned(spark, work):
    path = sinks.write_by_month(work.features, new_path(spark, "months"))
    part = spark.read.parquet(path).filter("year_month = '1998-03'")
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year_month" in plan
    months = work.features.select(F.date_format("day", "yyyy-MM")).distinct().count()
    assert len(spark.read.parquet(path).inputFiles()) <= months + 4  # by size, not by buckets
    assert part.count() == work.features.filter("date_format(day, 'yyyy-MM') = '1998-03'").count()


def test_text_line(spark):
    path = sinks.write_text_line(spark, "gbt_a", new_path(spark, "line"))
    assert sinks.read_text_line(spark, path) == "gbt_a"


def test_shared_folder_comes_from_the_session(spark):
    setting = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == setting or setting is None
