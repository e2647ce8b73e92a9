from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from meterlight.functions.isolation import average_path
from meterlight.operators import anomaly, audit, eda, forecast, insights, metrics, profiles
from meterlight.plans import reports, training
from meterlight.schema import PROFILE_COLUMNS

START = date(2013, 1, 7)  # a Monday


def daily(spark, rows):
    data = [(h, START + timedelta(days=d), float(v)) for h, d, v in rows]
    return spark.createDataFrame(data, "household_id string, day date, energy_sum double")


# Profiles


def test_weekday_only_household_has_ratio_one(spark):
    frame = daily(spark, [("a", d, 5) for d in range(5)] + [("b", d, 2) for d in range(7)])
    rows = {r.household_id: r for r in profiles.household_profile(frame).collect()}
    assert rows["a"].weekend_ratio == 1.0 and rows["b"].weekend_ratio == 1.0


def test_zero_weekday_mean_has_ratio_one(spark):
    frame = daily(spark, [("a", d, 0 if d < 5 else 9) for d in range(7)])
    assert profiles.household_profile(frame).first().weekend_ratio == 1.0


def test_seasons_seen_anywhere_count_as_zero(spark):
    summer = 180
    frame = daily(
        spark, [("a", 0, 4), ("a", 1, 4), ("b", 0, 2), ("b", summer, 6), ("b", summer + 1, 6)]
    )
    rows = {r.household_id: r for r in profiles.household_profile(frame).collect()}
    assert rows["a"].seasonal_variation == pytest.approx(8**0.5)  # of 4 and 0
    assert rows["b"].seasonal_variation == pytest.approx(8**0.5)  # of 2 and 6
    assert rows["a"].peak_season_energy == 4 and rows["b"].peak_month_energy == 6
    only = profiles.household_profile(daily(spark, [("a", 0, 4)])).first()
    assert only.seasonal_variation == 0 and only.std_energy == 0


def clustered(spark, rows):
    data = [
        (f"h{i}", c, *[float(m if n == "mean_energy" else w) for n in PROFILE_COLUMNS])
        for i, (c, m, w) in enumerate(rows)
    ]
    schema = "household_id string, cluster int, " + ", ".join(f"{c} double" for c in PROFILE_COLUMNS)
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([(0, 5, 1)], {0: "Low Consumers"}),
        ([(0, 5, 1), (1, 6, 1)], {0: "Low Consumers", 1: "High Consumers"}),
        (
            [(0, 5, 1), (1, 9, 9), (2, 6, 2), (3, 7, 3)],
            {0: "Low Consumers", 1: "High Consumers", 2: "Balanced", 3: "Weekend-Heavy"},
        ),
        (
            [(0, 5, 1), (1, 9, 9), (2, 7, 2), (3, 6, 2)],
            {0: "Low Consumers", 1: "High Consumers", 2: "Balanced", 3: "Weekend-Heavy"},
        ),
    ],
)
def test_labels(spark, rows, expected):
    labelled = profiles.label_clusters(clustered(spark, rows))
    assert {r.cluster: r.cluster_label for r in labelled.collect()} == expected


def test_standardize_constant_column_is_zero(spark):
    frame = clustered(spark, [(0, 5, 1), (0, 7, 1)])
    rows = profiles.standardize(frame).collect()
    assert {r.weekend_ratio for r in rows} == {0.0}
    assert sorted(r.mean_energy for r in rows) == [-1.0, 1.0]


def test_kmeans_and_elbow(spark, work):
    vectors = profiles.profile_vectors(work.profiles)
    table = profiles.elbow(vectors, range(2, 6), restarts=3).orderBy("k").collect()
    inertias = [r.inertia for r in table]
    assert inertias == sorted(inertias, reverse=True)
    assert all(-1 <= r.silhouette <= 1 for r in table)
    labels = {r.cluster_label for r in work.trained.clusterer.labelled.collect()}
    assert labels == {"High Consumers", "Low Consumers", "Weekend-Heavy", "Balanced"}


# Metrics


def pairs(spark, rows):
    return spark.createDataFrame(rows, "energy_sum double, prediction double")


def test_metrics_with_zero_actuals(spark):
    row = metrics.regression_metrics(pairs(spark, [(0.0, 1.0), (0.0, 3.0)])).first()
    assert (row.MAE, row.MAPE, row.R2) == (2.0, 0.0, 0.0)
    assert row.RMSE >= row.MAE


def test_constant_target_has_r2_zero(spark):
    assert metrics.regression_metrics(pairs(spark, [(0.1, 1.0)] * 7)).first().R2 == 0.0


def test_trimmed_mape_falls_back(spark):
    small = metrics.trimmed_mape(pairs(spark, [(0.5, 1.0), (1.0, 1.0)])).first()
    assert small.trimmed_mape == small.MAPE == 50.0
    mixed = metrics.trimmed_mape(pairs(spark, [(0.5, 1.0), (2.0, 1.0)])).first()
    assert mixed.trimmed_mape == 50.0 and mixed.MAPE == 75.0


# Forecasting


def test_unknown_model():
    with pytest.raises(ValueError, match="unknown model"):
        forecast.settings_for("prophet")


def test_untrained_model(spark):
    with pytest.raises(RuntimeError, match="not been trained"):
        forecast.predict(None, spark.range(1))


def test_models_beat_the_mean(spark, work):
    board = {r.Model: r for r in work.trained.leaderboard.collect()}
    assert set(board) == set(forecast.MODELS)
    assert all(r.RMSE >= r.MAE > 0 for r in board.values())
    assert work.trained.best in board


def test_importances_sum_to_one(spark, work):
    table = forecast.feature_importance(work.trained.models["gbt_a"], spark)
    assert table.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    assert forecast.top_feature_importance(table, 5).count() == 5


def test_grid_picks_repeat():
    grid = forecast.TUNING_GRIDS["gbt_a"]
    assert forecast.grid_picks(grid, 3) == forecast.grid_picks(grid, 3)
    assert len({str(p) for p in forecast.grid_picks(grid, 3)}) == 3


def test_too_little_history(spark):
    frame = daily(spark, [("a", d, 1) for d in range(50)])
    with pytest.raises(ValueError, match="too few days"):
        reports.forecast_rows(frame, "a")


# Anomalies


@pytest.fixture(scope="module")
def spiky(spark):
    rows = [(f"h{h}", d, 10 + (d * 7 + h) % 5) for h in range(8) for d in range(90)]
    rows += [("h0", 200 + i, 500 + i) for i in range(6)]
    return daily(spark, rows)


def test_forest_finds_spikes(spark, spiky):
    forest, detected = anomaly.fit_detect(spiky, 0.05, trees=60, sample_size=64)
    rows = detected.collect()
    flagged = [r for r in rows if r.is_anomaly]
    # The offset lies after place 0.05 * (n - 1), so up to that place and one more are below it.
    assert 0 < len(flagged) <= int(0.05 * (len(rows) - 1)) + 1
    assert all(r.anomaly_score < 0 for r in flagged)
    assert {r.energy_sum for r in flagged} >= {500.0, 505.0}
    assert forest.nodes.count() <= 60 * (2 * 64 - 1)
    again = anomaly.fit_detect(spiky.repartition(7), 0.05, trees=60, sample_size=64)[1]
    assert sorted(r.anomaly_score for r in again.collect()) == sorted(r.anomaly_score for r in rows)


def test_scores_follow_the_node_table(spark, spiky):
    """A plain walk down each tree gives the score of the vectorised one."""
    forest, detected = anomaly.fit_detect(spiky, 0.05, trees=12, sample_size=32)
    nodes = {(n.tree, n.node): n for n in forest.nodes.collect()}
    inputs = anomaly.anomaly_features(spiky, ["household_id", "day"])
    scores = {(r.household_id, r.day): r.anomaly_score for r in detected.collect()}
    for row in inputs.limit(25).collect():
        point = [(row[c] - m) / s for c, (m, s) in forest.scaling.items()]
        total = 0.0
        for tree in range(12):
            node = nodes[(tree, 0)]
            while node.left != node.node:
                side = node.left if point[node.feature] <= node.threshold else node.right
                node = nodes[(tree, side)]
            total += node.path
        raw = -(2 ** (-total / 12 / average_path(32)))
        assert scores[(row.household_id, row.day)] == pytest.approx(raw - forest.offset)


def test_households_join_the_nearest_centre(spark, work):
    clusterer = work.trained.clusterer
    centres = clusterer.model.centres
    vectors = profiles.profile_vectors(work.profiles).collect()
    found = {r.household_id: r.cluster for r in clusterer.labelled.collect()}
    for r in vectors:
        gaps = [((r.features.toArray() - c) ** 2).sum() for c in centres]
        assert gaps[found[r.household_id]] == pytest.approx(min(gaps))


@pytest.mark.parametrize("sample", [16, 256])
def test_trees_get_at_most_the_sample(spark, spiky, sample):
    """A thinned table (16) and one offered to every tree (256)."""
    data = anomaly.anomaly_features(spiky, ["household_id", "day"])
    inputs = [c for c in data.columns if c not in ("household_id", "day")]
    drawn = anomaly.tree_samples(data, inputs, 726, 20, sample, 1)
    sizes = [r["count"] for r in drawn.groupBy("tree").count().collect()]
    assert len(sizes) == 20 and max(sizes) <= sample


def test_detection_keeps_its_input(spark, spiky):
    """Nulls count as zero in the score and stay nulls in the table."""
    holes = spiky.withColumn("energy_std", F.lit(None).cast("double"))
    forest = anomaly.fit_forest(spiky, trees=10, sample_size=32)
    scored = anomaly.with_raw_score(forest, holes)
    assert scored.columns == [*holes.columns, "raw_score"]
    assert scored.filter("energy_std is null").count() == holes.count()
    zeros = anomaly.with_raw_score(forest, holes.na.fill(0, ["energy_std"]))
    key = ["household_id", "day"]
    both = scored.join(zeros.withColumnRenamed("raw_score", "again").select(*key, "again"), key)
    assert both.filter("raw_score <> again or raw_score is null").isEmpty()


def test_constant_rows_are_not_flagged(spark):
    frame = daily(spark, [("a", 7 * d, 3) for d in range(4)]).withColumn("day", F.lit(START))
    detected = anomaly.fit_detect(frame, 0.05, trees=10)[1]
    assert detected.filter("is_anomaly").isEmpty()


def test_forest_round_trip(spark, spiky, tmp_path):
    forest, detected = anomaly.fit_detect(spiky, 0.05, trees=20, sample_size=32)
    loaded = anomaly.load_forest(spark, anomaly.save_forest(forest, str(tmp_path / "f")))
    now = anomaly.detect(loaded, spiky).collect()
    assert sorted(r.anomaly_score for r in now) == sorted(r.anomaly_score for r in detected.collect())


def test_sensitivity_uses_the_stored_forest(spark, spiky):
    forest, detected = anomaly.fit_detect(spiky, 0.05, trees=20, sample_size=32)
    same = anomaly.sensitivity_refit(spiky, 5, forest)
    assert same.filter("is_anomaly").count() == detected.filter("is_anomaly").count()
    wide = spiky.withColumns({c: F.col("energy_sum") for c in ("energy_mean", "energy_max")})
    more = anomaly.sensitivity_refit(wide, 15, forest, trees=20, sample_size=32)
    assert more.filter("is_anomaly").count() > detected.filter("is_anomaly").count()


def test_report_without_anomalies(spark):
    frame = daily(spark, [("a", d, 1) for d in range(3)]).selectExpr(
        "*", "false AS is_anomaly", "0.1D AS anomaly_score"
    )
    summary = anomaly.anomaly_summary(frame).first()
    assert summary.total_anomalies == 0 and summary.top_anomaly_household is None
    assert anomaly.anomaly_metrics(frame).first().avg_anomaly_energy == 0


# Exploration, insights and audits


def test_empty_slice_has_counts_only(spark, work):
    report = reports.eda_report(work.features, start="2050-01-01")
    assert list(report) == ["counts"] and report["counts"].first().record_count == 0


def test_eda_report_parts(spark, work):
    report = reports.eda_report(work.features, tariff="ToU", compare="MAC000004,MAC000008")
    charts = "daily monthly seasonal weather acorn day_type correlation comparison"
    assert set(charts.split()) <= set(report)
    assert report["correlation"].count() == 144


def test_correlation_with_nulls_is_pairwise(spark):
    rows = [(1.0, 2.0, 1.0), (2.0, None, 1.0), (3.0, 6.0, 1.0), (4.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "a double, b double, c double")
    found = {(r.x, r.y): r.r for r in eda.correlation_matrix(frame, ["a", "b", "c"]).collect()}
    expected = frame.toPandas().corr()
    assert found[("a", "b")] == pytest.approx(expected.loc["a", "b"])
    assert found[("a", "a")] == 1.0 and found[("c", "c")] is None and found[("a", "c")] is None


def test_ties_go_to_the_first_weekday(spark):
    frame = daily(spark, [("a", d, 4) for d in range(7)])
    row = eda.peak_insights(frame).first()
    assert (row.peak_day, row.lowest_day) == ("Monday", "Monday")


def test_filter_is_pushed_into_the_scan(spark, work):
    part = eda.eda_filter(work.features, "1998-01-01", "1998-12-31", "ASIA", "Std")
    plan = eda.daily_mean(part)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert all(c in pushed for c in ("day", "acorn_grouped", "tariff"))
    read = plan[plan.index("ReadSchema") :].splitlines()[0]
    assert "humidity" not in read


def test_recommendations_follow_the_rules(spark):
    facts = spark.createDataFrame(
        [
            ("Sunday", "Friday", "Winter", "Summer", 3.5, 20.0),
            ("Monday", "Friday", "Summer", "Winter", 3.0, None),
        ],
        "peak_day string, lowest_day string, peak_season string, lowest_season string, "
        "weekend_pct_diff double, pct_saving double",
    ).withColumn("segment", F.monotonically_increasing_id())
    rows = insights.recommendations(facts, segment=["segment"]).collect()
    by_segment = {}
    for r in rows:
        by_segment.setdefault(r.segment, []).append(r.position)
    assert sorted(map(len, by_segment.values())) == [2, 5]


def test_low_cardinality_counts(spark):
    rows = [(float(i % 2), 7.0, float(i)) for i in range(50)]
    frame = spark.createDataFrame(rows, "flag double, same double, many double")
    rows = audit.audit_low_cardinality(frame).collect()
    found = {r.feature: (r.distinct_values, r.flag) for r in rows}
    assert found == {"flag": (2, "low"), "same": (1, "constant")}


def test_silhouette_bands():
    assert [audit.silhouette_flag(s) for s in (0.19, 0.2, 0.4)] == [
        "low separation",
        "moderate separation",
        "good separation",
    ]


def test_reports_over_trained_models(spark, work):
    trained = work.trained
    forecasting = reports.forecasting_report(
        work.features, trained.models["gbt_a"], leaderboard=trained.leaderboard
    )
    assert forecasting["metrics"].columns == ["MAE", "RMSE", "MAPE", "R2", "trimmed_mape"]
    assert forecasting["importance"].count() == 15
    clustering = reports.clustering_report(
        trained.clusterer, household="MAC000005", elbow=trained.elbow
    )
    assert clustering["lookup"].count() == 1 and clustering["radar"].count() == 4
    found = reports.anomalies_report(work.features, trained.forest, "MAC000007", sensitivity=5)
    assert found["timeline"].count() == work.features.filter("household_id = 'MAC000007'").count()
    advice = reports.insights_report(
        work.features, trained.models[trained.best], trained.best, trained.clusterer
    )
    assert advice["recommendations"].count() >= 2
    assert set(reports.overview_report(work.features)) == {"kpis", "filters"}
    chat = reports.chat_report("What is the ther ing of ment?", work.chunks)
    assert chat["messages"].count() == 2 and chat["sources"].count() == 4


def test_audit_report(spark, work):
    report = training.audit_all(work.features, work.trained)
    may_be_empty = {"low_cardinality", "high_correlation", "zero_share"}
    assert all(not report[name].isEmpty() for name in set(report) - may_be_empty)
