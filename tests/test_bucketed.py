"""Tables in buckets by household: no exchange by household, results as of the plain table."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from meterlight.operators import features, joins, profiles
from meterlight.operators.clean import fill_forward_backward
from meterlight.plans.panel import unfinished_panel
from meterlight.schema import DAY, HOUSEHOLD, TARGET
from meterlight.session import new_path
from meterlight.sources import bucketed


@pytest.fixture(scope="module")
def stored(work):
    return bucketed.store_bucketed(work.features, "stored")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges_by_household(df) -> int:
    return plan(df).count(f"hashpartitioning({HOUSEHOLD}")


def same(a, b) -> bool:
    def rows(df):
        rounded = [F.round(f.name, 6) if f.dataType.typeName() == "double" else F.col(f.name) for f in a.schema]
        return sorted(map(str, df.select(*rounded).collect()))

    return rows(a) == rows(b)


def test_profiles_of_stored_panel_shuffle_nothing_by_household(work, stored):
    assert exchanges_by_household(profiles.household_profile(work.features.repartition(3))) == 1
    assert exchanges_by_household(profiles.household_profile(stored)) == 0
    assert exchanges_by_household(profiles.weekend_weekday(stored)) == 0
    assert same(profiles.household_profile(stored), profiles.household_profile(work.features.repartition(3)))


def test_the_panel_is_stored_in_buckets_by_its_one_shuffle(work):
    tables = (work.readings, work.households, work.weather, work.holidays)
    # By (household, day) and by household; the household table's own first rows.
    assert exchanges_by_household(unfinished_panel(*tables, 5)) == 3 == exchanges_by_household(unfinished_panel(*tables))
    assert exchanges_by_household(profiles.household_profile(work.features)) == 0
    assert exchanges_by_household(profiles.weekend_weekday(work.cleaned)) == 0


def test_windows_of_stored_panel_shuffle_nothing(work, stored):
    base = [c for c in stored.columns if "lag" not in c and "rolling" not in c]
    for step in (
        features.lag_features,
        features.rolling_features,
        lambda df: fill_forward_backward(df, ["energy_max"]),
        features.drop_short_history,
    ):
        kept = stored.columns if step is features.drop_short_history else base
        assert "Exchange" not in plan(step(stored.select(*kept)))
    lagged = features.lag_features(stored.select(*base))
    assert same(lagged, features.lag_features(work.features.repartition(3).select(*base)))


def test_joins_of_two_stored_tables_meet_bucket_by_bucket(spark, work, stored):
    attributes = work.households.select(HOUSEHOLD, F.length(HOUSEHOLD).alias("size"))
    of_each = bucketed.store_bucketed(attributes, "attributes")
    panel = stored.select(HOUSEHOLD, DAY, TARGET)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = joins.join_households(panel, of_each)
        assert "SortMergeJoin" in plan(joined) and "Exchange" not in plan(joined)
        rows = joined.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows == joins.join_households(panel, attributes).count()


def test_one_file_a_bucket_and_opened_anew(spark, work, stored):
    path = new_path(spark, "again")
    written, seen = bucketed.write_bucketed(
        bucketed.by_household(work.features, 7), path, 7, {"rows": F.count("*"), "nulls": F.count_if(F.col(DAY).isNull())}
    )
    assert seen == {"rows": work.features.count(), "nulls": 0}
    households = work.features.select(HOUSEHOLD).distinct().count()
    assert 1 <= len(spark.read.parquet(path).inputFiles()) <= min(7, households)
    again = bucketed.open_bucketed(spark, path)
    assert exchanges_by_household(profiles.household_profile(again)) == 0
    assert same(again, written) and same(again, work.features)


def test_nulls_and_empty(spark):
    kind = f"{HOUSEHOLD} string, {DAY} date, {TARGET} double"
    rows = [("a", date(2012, 1, 1), 1.0), (None, date(2012, 1, 1), 2.0), (None, None, 3.0)]
    odd = bucketed.store_bucketed(spark.createDataFrame(rows, kind), "odd", 3)
    assert sorted(r[2] for r in odd.collect()) == [1.0, 2.0, 3.0]
    assert {r[0]: r[1] for r in odd.groupBy(HOUSEHOLD).count().collect()} == {"a": 1, None: 2}
    empty = bucketed.store_bucketed(spark.createDataFrame([], kind), "empty", 3)
    assert empty.groupBy(HOUSEHOLD).count().collect() == []


def test_number_of_buckets_follows_the_rows(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert bucketed.buckets_for(spark) == least == bucketed.buckets_for(spark, 10)
    assert bucketed.buckets_for(spark, 100 * bucketed.ROWS_OF_BUCKET) == max(least, 100)
