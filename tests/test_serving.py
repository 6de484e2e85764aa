"""Star tables, model, operational queries, quality checks, sinks and jobs."""

import json
import random
from datetime import timedelta

import pytest

from cellwatch.operators import alerts, anomaly, cleaning, features, guards, model, ops, quality, rollup, star
from cellwatch.plans import batch
from cellwatch.schemas import MEASURES, MODEL_FEATURES, RAW_COLUMNS
from cellwatch.sources import reference, sinks
from helpers import hour, hourly, rows_of
from pyspark.sql import functions as F

STATUS = "run_id string, run_timestamp timestamp_ntz, status string, per_task_status map<string,string>"
SCORES = "grid_id int, timestamp timestamp_ntz, risk_score double, risk_level string, model_version string"


def full_hours(spark, rows):
    """Hourly rows with all measures."""
    zero = [F.lit(0.0).alias(m) for m in MEASURES if m != "internet_activity"]
    return hourly(spark, rows).select(
        "*", *zero, F.lit(0.0).alias("total_sms"), F.lit(0.0).alias("total_calls"), F.lit(0.5).alias("internet_share")
    )


# ------------------------------------------------------------------ star


def test_time_keys_run_in_time_order_across_days(spark):
    times = star.dim_time(hourly(spark, [(g, h, 1) for g in (1, 2) for h in (0, 5, 24, 49)]))
    assert rows_of(times, "time_key", "timestamp", "day_of_week") == [
        (1, hour(0), 2), (2, hour(5), 2), (3, hour(24), 3), (4, hour(49), 4)
    ]


def test_fact_keys_and_unknown_keys(spark):
    rows = full_hours(spark, [(1, 0, 3), (2, 0, 4), (2, 1, 5)])
    times = star.dim_time(rows.where("hour = 0"))
    grids = spark.createDataFrame([(1, "2", 45.0, 9.0, "g")], "grid_key int, grid_id string, centroid_latitude double, centroid_longitude double, geometry_reference string")
    fact = star.fact_network_activity(rows, times, grids)
    assert rows_of(fact, "time_key", "grid_key", "total_activity") == [(1, 1, 4.0)]
    assert rows_of(star.unknown_keys(rows, times, grids), "key", "value", "rows") == [
        ("grid_id", "1", 1), ("timestamp", "2024-01-01 01:00:00", 1)
    ]
    extra = spark.createDataFrame([(9, 1)], "time_key int, grid_key int")
    checks = quality.dq_foreign_keys(fact.select("time_key", "grid_key").unionByName(extra), times, grids, rows).collect()[0]
    assert (checks.orphan_time_keys, checks.orphan_grid_keys, checks.duplicate_grids) == (1, 0, 0)
    star_rows = star.star_activity(fact, times, grids)
    assert rows_of(star_rows, "grid_id", "timestamp", "total_activity") == [("2", hour(0), 4.0)]


def test_control_totals_show_a_lost_row(spark):
    rows = full_hours(spark, [(1, 0, 3), (2, 0, 4)])
    found = {r.column_name: r.matches for r in rollup.control_totals(rows, rows.where("grid_id = 1")).collect()}
    assert found["total_activity"] is False and found["sms_in"] is True


# ----------------------------------------------------------------- model


def dataset(spark, hours=40, cells=3):
    rng = random.Random(2)
    rows = [(g, hour(h), *[rng.random() for _ in MODEL_FEATURES], int(rng.random() < 0.3)) for g in range(1, cells + 1) for h in range(hours)]
    schema = "grid_id int, feature_timestamp timestamp_ntz, " + ", ".join(f"{f} double" for f in MODEL_FEATURES) + ", target int"
    return spark.createDataFrame(rows, schema)


def test_split_follows_time(spark):
    split = model.chronological_split(dataset(spark, hours=11))
    ends = {r.split: (r.lo, r.hi) for r in split.groupBy("split").agg(F.min("feature_timestamp").alias("lo"), F.max("feature_timestamp").alias("hi")).collect()}
    # int(11 * 0.6) = 6 and int(11 * 0.8) = 8 distinct hours.
    assert ends == {"train": (hour(0), hour(5)), "validation": (hour(6), hour(7)), "test": (hour(8), hour(10))}


def test_class_weights_are_balanced(spark):
    split = spark.createDataFrame([(0, "train")] * 6 + [(1, "validation")] * 2 + [(1, "test")] * 9, "target int, split string")
    assert rows_of(model.class_weights(split), "target", "rows", "weight") == [(0, 6, 8 / 12), (1, 2, 2.0)]


def test_model_learns_a_threshold_and_scores_every_row(spark, tmp_path):
    rows = dataset(spark, hours=200).withColumn("target", (F.col("peak_ratio") > 0.7).cast("int"))
    split = model.chronological_split(rows)
    fitted = model.train_risk_model(split)
    scores = model.risk_scores(fitted, split)
    assert scores.count() == split.count()
    checks = quality.dq_risk_scores(scores, split.agg(F.count("*")).scalar()).collect()[0]
    assert (checks.duplicate_rows, checks.score_out_of_range, checks.unknown_levels, checks.single_version) == (0, 0, 0, True)
    assert model.feature_importance(fitted, spark).collect()[0].feature == "peak_ratio"
    held_out = model.serving_predictions(fitted, split.where("split = 'test'"))
    assert model.risk_model_metrics(held_out).collect()[0].f1 > 0.95
    assert fitted.stages[-1].depth <= 7


def test_metrics_are_zero_where_undefined(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "target int, prediction int")
    row = model.risk_model_metrics(df).collect()[0]
    assert (row.accuracy, row.precision, row.recall, row.f1, row.true_negative) == (1.0, 0.0, 0.0, 0.0, 2)


def test_rule_agreement_drops_hours_without_a_flag(spark):
    evaluated = spark.createDataFrame([(1, hour(h), p) for h, p in enumerate([0.9, 0.85, 0.1, 0.9])], "grid_id int, feature_timestamp timestamp_ntz, risk_probability double")
    flags = spark.createDataFrame([(1, hour(0), 1), (1, hour(1), 0), (1, hour(2), 0), (1, hour(3), None)], "grid_id int, timestamp timestamp_ntz, np3_high_activity int")
    assert tuple(model.model_rule_agreement(evaluated, flags).collect()[0]) == (2, 1, 2, 3, 2 / 3)


def test_levels_and_sensitivity(spark):
    scores = spark.createDataFrame([(g, hour(0), s) for g, s in enumerate([0.8, 0.4, 0.39, 0.7, 0.65], start=1)], "grid_id int, timestamp timestamp_ntz, risk_score double")
    assert rows_of(model.risk_levels(scores), "grid_id", "risk_level") == [(1, "HIGH"), (2, "MEDIUM"), (3, "LOW"), (4, "MEDIUM"), (5, "MEDIUM")]
    found = rows_of(model.risk_threshold_sensitivity(scores, top=2), "setting", "flagged_volume", "top_cells", "growth_pct")
    assert found == [("baseline", 3, "1,4", 0.0), ("trial", 5, "1,4", pytest.approx(200 / 3))]


# ------------------------------------------------------------------- ops


def test_three_way_outcomes_are_exclusive(spark):
    def keyed(schema, rows):
        return spark.createDataFrame([(1, hour(h), *rest) for h, *rest in rows], f"grid_id int, timestamp timestamp_ntz, {schema}")

    flags = [(r, m, a) for r in (0, 1) for m in (0, 1) for a in (0, 1)]
    anomalies = keyed("anomaly_score double, percentage_deviation double, direction string", [(i, 1.0, 1.0, "high" if a else "low") for i, (_, _, a) in enumerate(flags)])
    rules = keyed("alert_type string", [(i, "HIGH_ACTIVITY") for i, (r, _, _) in enumerate(flags) if r] + [(0, "ACTIVITY_SPIKE")])
    scored = keyed("risk_probability double, prediction int", [(i, 0.9, 1) for i, (_, m, _) in enumerate(flags) if m] + [(7, 0.1, 0)])
    found = anomaly.three_way_comparison(anomalies, rules, scored, ["ml3_risk"])
    counts = anomaly.signal_overlap_metrics(anomaly.three_way_comparison(anomalies, rules, scored.where("prediction = 1"))).collect()[0]
    assert found.count() == 8
    assert all(counts[name] == 1 for name in anomaly.OUTCOMES)
    assert (counts.total_records, counts.ml3_ml4_agreement) == (8, 0.5)
    reported = {r.category for r in anomaly.disagreement_summary(anomaly.signal_overlap_metrics(found)).collect()}
    assert reported <= set(anomaly.EXPLANATIONS) and "np3_only" in reported


def test_latest_prediction_carries_its_anomaly(spark):
    predictions = spark.createDataFrame([(1, hour(0), 0.9), (1, hour(1), 0.5), (2, hour(0), 0.1)], "grid_id int, timestamp timestamp_ntz, risk_probability double")
    anomalies = spark.createDataFrame([(1, hour(1), "high", "ANOMALY"), (2, hour(0), "normal", "NORMAL")], "grid_id int, timestamp timestamp_ntz, direction string, reason string")
    found = {r.grid_id: r for r in ops.risk_lookup(predictions, anomalies).collect()}
    assert (found[1].risk_level, found[1].feature_timestamp) == ("MEDIUM", hour(1))
    assert found[1].explanation_note.endswith("consider investigation. ML4 anomaly context: ANOMALY")
    assert found[2].explanation_note == "Low future high-activity risk based on the ML3 prediction."
    earlier = ops.risk_lookup(predictions, anomalies, F.lit(hour(0)).cast("timestamp_ntz"))
    assert rows_of(earlier, "grid_id", "risk_level") == [(1, "HIGH"), (2, "LOW")]


def test_health_reasons_and_freshness(spark):
    now = F.lit(hour(48)).cast("timestamp_ntz")
    runs = [
        ("a", hour(48) - timedelta(seconds=3599), "success", {"x": "SUCCESS", "y": "skipped"}),
        ("b", hour(47), "SUCCESS", {"x": "SUCCESS"}),
        ("c", hour(24), "FAILED", {"x": "FAILED", "w": "running"}),
        ("d", hour(48), None, None),
    ]
    found = {r.run_id: r for r in ops.run_health(spark.createDataFrame(runs, STATUS), now).collect()}
    assert (found["a"].healthy, found["a"].freshness, found["a"].reasons) == (True, "FRESH", [])
    assert (found["b"].healthy, found["b"].reasons) == (False, ["Analytics status record is STALE."])
    assert found["c"].reasons == [
        "Pipeline status is FAILED.", "Task 'w' status is running.", "Task 'x' status is FAILED.", "Analytics status record is VERY_STALE.",
    ]
    assert found["d"].reasons == ["Pipeline status is UNKNOWN."] and not found["d"].trustworthy


def test_severity_presets(spark):
    rows = spark.createDataFrame(
        [(1, 1.0, 1.0, 0.68, 0.0, True), (2, 1.0, 1.0, 0.2, 1.6, False), (3, 1.0, None, 0.9, 0.0, True), (4, 1.0, 1.0, 0.4, 0.6, True)],
        "grid_id int, current_activity double, baseline_activity double, anomaly_score double, activity_growth double, trustworthy boolean",
    )
    found = {r.grid_id: tuple(r[f"severity_{p}"] for p in ops.PRESETS) for r in ops.severity_assessment(rows).collect()}
    assert found == {
        1: ("HIGH", "HIGH", "HIGH", "ATTENTION"),
        2: ("ATTENTION", "ATTENTION", "HIGH", "NORMAL"),
        3: ("HIGH", "HIGH", "HIGH", "INSUFFICIENT EVIDENCE"),
        4: ("NORMAL", "ATTENTION", "ATTENTION", "NORMAL"),
    }


def test_reconciliation_and_priority(spark):
    risk = spark.createDataFrame([(1, 0.6), (2, 0.5), (3, 0.6), (4, 0.1)], "grid_id int, risk_score double")
    raised = spark.createDataFrame([(1, "ACTIVITY_DROP"), (2, "ACTIVITY_DROP"), (2, "ACTIVITY_SPIKE")], "grid_id int, alert_type string")
    assert rows_of(ops.anomaly_reconciliation(risk, raised), "grid_id", "agreement_status") == [
        (1, "FULL_AGREEMENT"), (2, "RULE_ONLY_DIVERGENCE"), (3, "ML_ONLY_DIVERGENCE"), (4, "BASELINE_NORMAL")
    ]
    hotspots = spark.createDataFrame([(1, 1), (8, 2), (9, 1)], "grid_id int, rank int")
    assert rows_of(alerts.display_priority(raised, hotspots), "grid_id", "priority") == [
        (1, "ATTENTION"), (2, "HIGH"), (8, "ATTENTION"), (9, "HIGH")
    ]


def test_alert_feed_order_and_limits(spark):
    raised = spark.createDataFrame([(g, hour(h), t) for g, h, t in [(9, 1, "A"), (10, 1, "A"), (9, 1, "B"), (1, 0, "A"), (1, 2, "A")]], "grid_id int, timestamp timestamp_ntz, alert_type string")
    feed = alerts.alert_feed(raised, F.lit(hour(1)).cast("timestamp_ntz"), limit=3).collect()
    assert [(r.grid_id, r.alert_type) for r in feed] == [(9, "B"), (9, "A"), (10, "A")]
    with pytest.raises(ValueError):
        alerts.alert_feed(raised, F.lit(None), limit=10001)


def test_activity_of_one_cell(spark):
    rows = full_hours(spark, [(1, h, h) for h in range(40)] + [(2, 39, 1)])
    as_of = rollup.resolve_as_of(rows)
    assert [r.timestamp for r in ops.grid_activity_24h(rows, as_of, 1).collect()] == [hour(h) for h in range(16, 40)]
    assert ops.grid_activity_24h(rows, as_of, 1, "2024-01-02", 3).count() == 1
    with pytest.raises(ValueError):
        ops.grid_activity_24h(rows, as_of, 1, hour=24)


def test_top_attention_keeps_rows_without_anomaly(spark):
    scores = spark.createDataFrame([(g, hour(1), s, "LOW", "v") for g, s in [(1, 0.2), (2, 0.9), (3, 0.9)]] + [(4, hour(0), 1.0, "HIGH", "v")], SCORES)
    anomalies = spark.createDataFrame([(2, hour(1), "high")], "grid_id int, timestamp timestamp_ntz, direction string")
    assert rows_of(ops.top_attention(scores, anomalies, 2), "grid_id", "direction") == [(2, "high"), (3, None)]


def test_surging_needs_a_baseline(spark):
    rows = spark.createDataFrame([(1, hour(0), 49.0, 9.0), (2, hour(0), 50.0, 0.5), (3, hour(0), 80.0, 0.25), (2, hour(1), 99.0, 1.0)], "grid_id int, feature_timestamp timestamp_ntz, avg_activity double, activity_growth double")
    cells = spark.createDataFrame([(2, 45.0, 9.0)], "grid_id int, centroid_latitude double, centroid_longitude double")
    found = rows_of(ops.surging_grids(rows, cells, F.lit(hour(0)).cast("timestamp_ntz")), "rank", "grid_id", "current_activity", "growth_percentage", "centroid_latitude")
    assert found == [(1, 2, 75.0, "50.0%", 45.0), (2, 3, 100.0, "25.0%", None)]


# --------------------------------------------------------------- quality


def test_source_and_grain_checks(spark):
    rows = hourly(spark, [(1, 0, 1), (1, 0, 2), (2, 0, -1)])
    checks = quality.dq_source(rows).collect()[0]
    assert (checks.row_count, checks.duplicate_rows, checks.negative_total, checks.negative_internet) == (3, 1, 1, 1)
    grain = quality.dq_grain(rows, rows).collect()[0]
    assert (grain.duplicate_groups, grain.unique_grain) == (1, False)
    assert rows_of(quality.grain_violations(rows), "grid_id", "rows") == [(1, 2)]


def test_alert_and_feature_checks(spark):
    rows = hourly(spark, [(1, 0, 1)])
    raised = spark.createDataFrame([(1, "x", 1.0, 1.0), (9, "", 1.0, None)], "grid_id int, reason string, current_activity double, baseline_activity double")
    assert quality.dq_alerts(raised, rows).collect()[0].asDict() == {"alerts": 2, "without_reason": 1, "missing_values": 1, "unknown_grids": 1}
    bad = spark.createDataFrame([(1, hour(0), 1.0, 1.0, 25, 1.0, 1.0, 1.1), (1, hour(0), float("nan"), 1.0, 2, 1.0, 1.0, 0.5)], "grid_id int, feature_timestamp timestamp_ntz, avg_activity double, activity_growth double, active_hours int, peak_ratio double, variability double, internet_share double")
    assert tuple(quality.dq_features(bad).collect()[0]) == (2, 1, 1, 1, 1)


def test_round_trip_sees_a_changed_value(spark, tmp_path):
    rows = hourly(spark, [(1, 0, 1), (2, 0, 2)])
    path = str(tmp_path / "t")
    sinks.write_table(rows, path)
    same = quality.dq_round_trip(rows, spark.read.parquet(path)).collect()[0]
    assert (same.rows_read, same.schema_matches, same.content_matches, same.geometry_free) == (2, True, True, True)
    altered = rows.withColumn("total_activity", F.col("total_activity") + 1)
    assert quality.dq_round_trip(altered, spark.read.parquet(path)).collect()[0].content_matches is False


def test_rerun_replaces_only_its_dates(spark, tmp_path):
    rows = hourly(spark, [(1, 0, 1), (1, 24, 1)])
    path = str(tmp_path / "t")
    sinks.write_activity_partitioned(rows, path)
    sinks.write_activity_partitioned(cleaning.filter_date_window(rows, "2024-01-02").unionByName(hourly(spark, [(2, 24, 5)])), path)
    back = spark.read.parquet(path)
    assert sorted((str(r.date), r.rows) for r in quality.dq_partitions(back).collect()) == [("2024-01-01", 1), ("2024-01-02", 2)]
    plan = cleaning.filter_date_window(back, "2024-01-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_bucketed_hours_need_no_shuffle(spark, tmp_path):
    from cellwatch.operators import baselines

    rows = full_hours(spark, [(g, h, g + h) for g in range(1, 9) for h in range(50)])
    out = batch.Layout(str(tmp_path), "hours_by_cell", 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out.write(rows, "hourly")
        hours = out.read(spark, "hourly")
        for job in (features.network_features(hours), features.model_dataset(hours), baselines.hour_bucket_baseline(hours)):
            plan = job._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan
        assert features.network_features(hours).count() == features.network_features(rows).count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE IF EXISTS hours_by_cell")


def test_guards_raise(spark):
    rows = hourly(spark, [(1, 0, 1), (1, 0, 2)])
    assert spark.range(1).select(guards.require_as_of(rows)).first()[0] == hour(0)
    with pytest.raises(ValueError, match="not represented"):
        guards.require_as_of(rows, "2031-01-01 00:00:00")
    with pytest.raises(RuntimeError, match="no timestamps"):
        guards.require_as_of(rows.where("grid_id = 2"))
    cells = spark.createDataFrame([("1", 45.0, 9.0), ("2", None, None)], "grid_id string, centroid_latitude double, centroid_longitude double")
    assert guards.require_grid(cells, 1) == 1
    for unknown in (0, 3, 10001):
        with pytest.raises(LookupError):
            guards.require_grid(cells, unknown)
    with pytest.raises(RuntimeError, match="centroid"):
        guards.require_grid(cells, 2)
    with pytest.raises(AssertionError, match="duplicate_rows=1"):
        guards.require_passed(quality.dq_source(rows), zero=("rows_with_nulls", "duplicate_rows"))
    with pytest.raises(AssertionError, match="doubled"):
        guards.require_none(quality.grain_violations(rows), "doubled")


def test_star_load_stops_on_a_cell_without_reference(spark, tmp_path):
    out = batch.Layout(str(tmp_path))
    out.write(full_hours(spark, [(1, 0, 1), (2, 0, 1)]), "hourly")
    square = json.dumps([[[0, 0], [1, 0], [1, 1], [0, 0]]])
    found = spark.createDataFrame([("f", 0, 1, "Polygon", square)], "source_file string, position int, grid_id int, geometry_type string, coordinates string")
    with pytest.raises(AssertionError, match="one side only: \\(2, 'source'\\)"):
        batch.load_star(spark, out, reference.grid_reference(found), "g")


# ------------------------------------------------------------------ jobs


def test_raw_files_to_published_run(spark, tmp_path):
    rng = random.Random(4)
    raw = tmp_path / "raw"
    raw.mkdir()
    for day in range(3):
        lines = [",".join(RAW_COLUMNS)]
        for h in range(24):
            stamp = (hour(0) + timedelta(days=day, hours=h)).strftime("%Y-%m-%d %H:%M:%S")
            for cell in (1, 2):
                for country in (39, 40):
                    lines.append(f"{stamp},{cell},{country},{rng.random():.4f},1,,{rng.choice([1, 9])},{rng.random() * 50:.4f}")
        lines.append(f"{hour(day * 24).strftime('%Y-%m-%d %H:%M:%S')},,39,1,1,1,1,1")
        lines.append(f"{hour(day * 24).strftime('%Y-%m-%d %H:%M:%S')},1,39,1,1,1,1,-1")
        (raw / f"sms-call-internet-mi-2024-01-0{day + 1}.csv").write_text("\n".join(lines) + "\n")
    square = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]
    cells = [{"type": "Feature", "properties": {"cellId": c}, "geometry": {"type": "Polygon", "coordinates": [square]}} for c in (1, 2)]
    (tmp_path / "grid.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": cells}))
    record = batch.run_day(spark, str(raw), str(tmp_path / "grid.geojson"), str(tmp_path / "out"), "run-7").collect()[0]
    assert (record.run_id, record.status, record.rows_in, record.rows_rejected, record.nulls_handled) == ("run-7", "SUCCESS", 294, 6, 288)
    assert (record.rows_published, record.AS_OF) == (144, hour(71))
    out = batch.Layout(str(tmp_path / "out"))
    assert out.read(spark, "features").count() == 2 * (72 - 24)
    assert out.read(spark, "risk_scores").count() == out.read(spark, "model_dataset").count() == 2 * (72 - 24)
    assert out.read(spark, "fact_network_activity").count() == 144
    assert reference.read_status(spark, out.path("status"), multiline=False).count() == 1
    assert features.network_features(out.read(spark, "hourly")).count() == 96
    assert out.read(spark, "rejects").groupBy("reject_reason").count().count() == 2
    scores = sorted(map(str, out.read(spark, "risk_scores").collect()))
    batch.score_saved(spark, out)
    assert sorted(map(str, out.read(spark, "risk_scores").collect())) == scores
    # As landed files each of these days has a bad row, so the gate leaves nothing to load.
    with pytest.raises(Exception):
        batch.run_landed(spark, str(raw), str(tmp_path / "grid.geojson"), str(tmp_path / "landed"), "run-8")
    landed = batch.Layout(str(tmp_path / "landed"))
    assert landed.read(spark, "verdicts").where("valid").count() == 0
    failed = reference.read_status(spark, landed.path("status"), multiline=False).collect()[0]
    assert (failed.run_id, failed.status, failed.rows_published) == ("run-8", "FAILED", 0)
    assert "FAILED" in failed.per_task_status.values() and failed.per_task_status["quality_check"] == "NOT_RUN"
    day = raw / "sms-call-internet-mi-2024-01-01.csv"
    day.write_text("\n".join(day.read_text().splitlines()[:-2]) + "\n")
    kept = batch.accept_landed(spark, str(raw), landed)
    assert kept.count() == 96 and kept.select("source_file").distinct().count() == 1
