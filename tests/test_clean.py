from __future__ import annotations

from datetime import date, timedelta

import pandas as pd
import pytest

from meterlight.operators import clean, features, joins
from meterlight.plans.panel import build_panel
from meterlight.schema import LAGS, READINGS_SCHEMA, ROLLING_WINDOWS, lag_column, rolling_column

START = date(2013, 1, 1)


def panel(spark, rows):
    """rows: (household, day offset, value)."""
    data = [(h, START + timedelta(days=d), v) for h, d, v in rows]
    return spark.createDataFrame(data, "household_id string, day date, energy_sum double")


def test_fill_takes_last_then_first_value(spark):
    rows = [("a", 0, None), ("a", 1, 2.0), ("a", 2, None), ("a", 5, 3.0), ("a", 6, None), ("b", 0, None)]
    out = clean.fill_forward_backward(panel(spark, rows)).orderBy("household_id", "day")
    assert [r.energy_sum for r in out.collect()] == [2.0, 2.0, 2.0, 3.0, 3.0, None]


def test_fill_matches_pandas(spark):
    import random

    rng = random.Random(7)
    rows = [
        (h, d, rng.choice([None, None, float(rng.randint(0, 9))])) for h in "abcd" for d in range(40)
    ]
    ours = clean.fill_forward_backward(panel(spark, rows)).toPandas()
    ours = ours.sort_values(["household_id", "day"])["energy_sum"].to_list()
    theirs = pd.DataFrame(rows, columns=["h", "d", "v"]).sort_values(["h", "d"])
    expected = theirs.groupby("h")["v"].transform(lambda g: g.ffill().bfill()).to_list()
    assert pd.Series(ours).equals(pd.Series(expected))


def test_median_fills_what_no_household_could(spark):
    rows = [("a", 0, None), ("b", 0, 1.0), ("b", 1, 4.0), ("c", 0, 10.0)]
    out = clean.fill_median(panel(spark, rows)).orderBy("household_id").collect()
    assert out[0].energy_sum == 4.0


def test_column_of_nulls_stays_null_until_zero_filled(spark):
    frame = panel(spark, [("a", d, float(d)) for d in range(20)]).selectExpr(
        "*", "CAST(NULL AS DOUBLE) AS visibility"
    )
    filled = clean.fill_median(clean.fill_forward_backward(frame))
    assert filled.filter("visibility IS NOT NULL").isEmpty()
    kept = features.drop_short_history(features.lag_features(filled))
    assert {r.visibility for r in kept.collect()} == {0.0}


def test_first_row_in_ingest_order_wins_even_with_null_target(spark):
    rows = [("a", START, 5.0, 2), ("a", START, None, 1), ("b", START, 1.0, 1)]
    frame = spark.createDataFrame(
        rows, "household_id string, day date, energy_sum double, ingest_ordinal int"
    )
    kept = clean.dedup_readings(frame).transform(clean.drop_null_target).collect()
    assert [(r.household_id, r.energy_sum) for r in kept] == [("b", 1.0)]


def test_dedup_without_keys_drops_equal_rows(spark):
    frame = spark.createDataFrame([(1, 2), (1, 2), (1, 3)], "x int, y int")
    assert clean.dedup_readings(frame).count() == 2


def test_dedup_limits_rows_before_the_shuffle(spark, work):
    plan = clean.dedup_readings(work.readings)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange") == 1


def test_features_share_one_household_shuffle(spark, work):
    from meterlight.plans.panel import unfinished_panel

    plan = unfinished_panel(work.readings, work.households, work.weather, work.holidays)
    text = plan._jdf.queryExecution().executedPlan().toString()
    by_household = [
        line
        for line in text.splitlines()
        if "Exchange hashpartitioning(household_id" in line and ", day#" not in line
    ]
    # One for the panel, one for the household table's own deduplication.
    assert len(by_household) == 2


def test_lags_count_rows_not_days(spark):
    rows = [("a", d, float(i)) for i, d in enumerate([0, 1, 2, 10, 11, 40])]
    out = features.lag_features(panel(spark, rows)).orderBy("day").collect()
    assert [r.energy_sum_lag_2 for r in out] == [None, None, 0.0, 1.0, 2.0, 3.0]


def test_rolling_matches_pandas(spark):
    rows = [("a", d, float((d * 37) % 11)) for d in range(60)]
    out = features.rolling_features(panel(spark, rows)).orderBy("day").toPandas()
    series = pd.Series([v for _, _, v in rows]).shift(1)
    for n in ROLLING_WINDOWS:
        window = series.rolling(n, min_periods=1)
        for stat, expected in (("mean", window.mean()), ("std", window.std())):
            ours = out[rolling_column(stat, n)].astype("float64")
            pd.testing.assert_series_equal(ours, expected, check_names=False)


def test_last_target_does_not_leak_into_its_features(spark):
    rows = [("a", d, float(d % 5)) for d in range(40)]
    other = rows[:-1] + [("a", 39, 1000.0)]

    def last(data):
        frame = features.build_features(panel(spark, data), None)
        return frame.drop("energy_sum").orderBy("day").collect()[-1]

    assert last(rows) == last(other)


def test_holiday_flag_without_table_is_zero(spark):
    out = joins.holiday_flag(panel(spark, [("a", 0, 1.0)]), None)
    assert out.first().is_bank_holiday == 0


def test_top_households_breaks_ties_by_id(spark):
    rows = [("b", 0, 1.0), ("a", 0, 1.0), ("c", 0, 1.0), ("c", 1, 1.0)]
    kept = joins.top_households(panel(spark, rows), 2)
    assert {r.household_id for r in kept.collect()} == {"a", "c"}


def test_load_and_merge_uses_a_ready_sample(spark):
    whole = panel(spark, [("a", 0, 1.0), ("b", 0, 2.0)])
    ready = panel(spark, [("b", 0, 2.0)])
    dim = spark.createDataFrame([("a", "Std")], "household_id string, tariff string")
    sky = spark.createDataFrame([(START, 1.0)], "day date, humidity double")
    out = joins.load_and_merge(whole, dim, sky, sample=True, n_households=5, presorted_sample=ready)
    assert [(r.household_id, r.tariff, r.humidity) for r in out.collect()] == [("b", None, 1.0)]


def test_hot_household_and_copies(spark):
    """One household with many copies of every day gives the same panel as without copies."""
    base = [
        (h, START + timedelta(days=d), *[float(d % 7 + 1)] * 7, 0) for h in "abc" for d in range(40)
    ]
    copies = [r[:-1] + (n,) for r in base if r[0] == "a" for n in range(1, 30)]
    dim = spark.createDataFrame(
        [(h, "Std", "x", "y", "f") for h in "abc"],
        "household_id string, tariff string, acorn string, acorn_grouped string, file string",
    )
    sky = spark.createDataFrame([(START, 1.0)], "day date, humidity double")
    plain, hot = (
        build_panel(spark.createDataFrame(rows, READINGS_SCHEMA), dim, sky, None).features
        for rows in (base, base + copies)
    )
    assert plain.count() == 3 * (40 - max(LAGS))
    assert plain.exceptAll(hot).isEmpty() and hot.exceptAll(plain).isEmpty()
    assert hot.filter(f"{lag_column(14)} IS NULL").isEmpty()


@pytest.mark.parametrize("text", ["x", "2013-13-40"])
def test_bad_day_fails(spark, text):
    frame = spark.createDataFrame([("a", text)], "household_id string, day string")
    with pytest.raises(Exception, match="not a date"):
        clean.coerce_types(frame).collect()
