import random
import statistics

import numpy as np
import pytest

from cellwatch.operators import alerts, anomaly, baselines, ops, rollup
from cellwatch.operators.quantile import exact_group_percentile
from helpers import hour, hourly, rows_of
from pyspark.sql import functions as F


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.9, 1.0])
@pytest.mark.parametrize("size", [1, 2, 3, 10, 90, 4000])
def test_exact_percentile_of_large_and_small_groups(spark, q, size):
    rng = random.Random(size)
    data = {k: [rng.choice([5.0, rng.gauss(k, 3), float(rng.randint(0, 9))]) for _ in range(size)] for k in (1, 2)}
    df = spark.createDataFrame([(k, x) for k, xs in data.items() for x in xs], "k int, x double")
    got = {r.k: r.p for r in exact_group_percentile(df, ["k"], "x", q, "p", accuracy=100).collect()}
    for k, xs in data.items():
        assert got[k] == pytest.approx(np.percentile(xs, q * 100), abs=1e-9)


def test_percentile_when_one_value_holds_most_rows(spark):
    xs = [1.0] * 5000 + [float(i) for i in range(2, 200)]
    df = spark.createDataFrame([(1, x) for x in xs], "k int, x double")
    assert exact_group_percentile(df, ["k"], "x", 0.99, "p", accuracy=50).collect()[0].p == np.percentile(xs, 99)


def test_leave_one_out_median_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(g, h, rng.choice([3, 3, rng.random() * 10])) for g in (1, 2) for h in range(72) if rng.random() < 0.7]
    got = {(r.grid_id, r.timestamp): r.baseline_activity for r in baselines.loo_baseline(hourly(spark, rows)).collect()}
    for g, h, _ in rows:
        others = [t for g2, h2, t in rows if g2 == g and h2 // 24 == h // 24 and h2 != h]
        assert got[(g, hour(h))] == (pytest.approx(statistics.median(others)) if others else None)


def test_single_hour_day_has_no_baseline_and_only_spikes(spark):
    found = alerts.network_alerts(hourly(spark, [(1, 23, 1), (1, 24, 5)]))
    rows = found.collect()
    assert [(r.alert_type, r.timestamp, r.baseline_activity) for r in rows] == [("ACTIVITY_SPIKE", hour(24), None)]
    assert rows[0].reason == (
        "ACTIVITY_SPIKE: current activity 5.00 is more than 2.0x the previous-hour activity 1.00; baseline activity is nan"
    )


def test_rules_floor_and_zero_previous(spark):
    busy = [(1, h, t) for h, t in enumerate([10, 10, 0, 25, 10, 4])]
    idle = [(2, h, t) for h, t in enumerate([0, 0, 0, 1, 0, 0])]
    found = rows_of(alerts.network_alerts(hourly(spark, busy + idle)), "grid_id", "timestamp", "alert_type")
    # The idle cell lies below the floor; after a zero hour there is no spike.
    assert found == [(1, hour(2), "ACTIVITY_DROP"), (1, hour(3), "HIGH_ACTIVITY"), (1, hour(5), "ACTIVITY_DROP")]


def test_thresholds_are_strict(spark):
    rows = [(1, h, t) for h, t in enumerate([10, 10, 15, 5, 10])]
    assert alerts.network_alerts(hourly(spark, rows)).count() == 0


def test_alert_summary_counts_hours_once(spark):
    rows = hourly(spark, [(1, h, t) for h, t in enumerate([10, 10, 10, 40, 10])])
    summary = alerts.alert_summary(alerts.network_alerts(rows), rows).collect()[0]
    assert (summary.total_alerts, summary.alerted_grid_hours, summary.total_grid_hours) == (2, 1, 5)
    assert summary.alert_proportion == 0.2


def test_alert_summary_without_alerts(spark):
    rows = hourly(spark, [(1, 0, 1), (1, 1, 1)])
    summary = alerts.alert_summary(alerts.network_alerts(rows), rows).collect()[0]
    assert (summary.total_alerts, summary.alert_proportion) == (0, 0.0)


def test_gaps_and_densified_hours(spark):
    rows = hourly(spark, [(1, 0, 1), (1, 1, 1), (1, 4, 1), (2, 7, 1)])
    assert rows_of(baselines.timestamp_gaps(rows), "grid_id", "timestamp", "gap_hours") == [(1, hour(4), 3)]
    dense = baselines.densify_hours(rows)
    assert dense.count() == 6
    assert dense.where("total_activity is null").count() == 2


def test_target_needs_the_next_hour_and_a_baseline(spark):
    values = [1.0] * 24 + [10.0, 1.0]
    rows = [(1, h, t) for h, t in enumerate(values)] + [(2, h + (h > 23), t) for h, t in enumerate(values)]
    hot = baselines.risk_target(hourly(spark, rows)).where("target = 1")
    assert rows_of(hot, "grid_id", "feature_timestamp") == [(1, hour(23))]
    flags = baselines.trailing_high_activity(hourly(spark, rows))
    assert flags.where("np3_high_activity is null").count() == 46
    assert flags.where("np3_high_activity = 1").count() == 2


def test_zero_baseline_is_normal(spark):
    rows = hourly(spark, [(1, 0, 0), (1, 24, 0), (1, 48, 9)])
    scores = anomaly.anomaly_scores(baselines.hour_bucket_baseline(rows)).collect()
    assert {r.direction for r in scores} == {"normal"}
    assert {r.anomaly_score for r in scores} == {0.0}


def test_anomaly_bounds_are_strict_and_reasons_readable(spark):
    rows = hourly(spark, [(1, 24 * d, t) for d, t in enumerate([10, 10, 10, 15, 15.5, 4, 5])])
    found = {r.total_activity: (r.direction, r.reason) for r in anomaly.anomaly_scores(baselines.hour_bucket_baseline(rows)).collect()}
    assert found[15.0][0] == "normal" and found[5.0][0] == "normal"
    assert found[15.5] == ("high", "ANOMALY_HIGH: Current activity 15.50 is 55.0% above the historical hour-of-day baseline of 10.00.")
    assert found[4.0] == ("low", "ANOMALY_LOW: Current activity 4.00 is 60.0% below the historical hour-of-day baseline of 10.00.")


def test_baseline_groups_across_cells(spark):
    rows = hourly(spark, [(1, 0, 1), (2, 0, 3), (3, 0, 8), (1, 1, 7)])
    got = rows_of(baselines.hour_bucket_baseline(rows, ("hour_of_day",)), "grid_id", "timestamp", "baseline_activity")
    assert got == [(1, hour(0), 3.0), (1, hour(1), 7.0), (2, hour(0), 3.0), (3, hour(0), 3.0)]


def test_history_of_a_cell_with_one_point(spark):
    rows = hourly(spark, [(1, 0, 4), (1, 1, 10), (1, 2, 4), (1, 3, 9), (2, 3, 7), (3, 90, 1)])
    found = {r.grid_id: r for r in baselines.history_summary(rows, F.lit(hour(3)).cast("timestamp_ntz")).collect()}
    assert set(found) == {1, 2}
    assert (found[1].observation_window_hours, found[1].historical_mean_activity, found[1].intervals_exceeding_30pct_surge) == (3, 6.0, 1)
    assert (found[2].historical_mean_activity, found[2].historical_max_activity) == (0.0, 0.0)


def test_cadence(spark):
    rows = hourly(spark, [(1, 0, 1), (2, 1, 1), (1, 3, 1)])
    assert tuple(baselines.hourly_cadence(rows, F.lit(2)).collect()[0]) == (3, 1, 48)


def test_top_k_ties_fall_by_cell(spark):
    rows = hourly(spark, [(g, 0, 5) for g in (9, 3, 7)]).withColumns({"total_sms": F.lit(0.0), "total_calls": F.lit(0.0)})
    top = ops.hotspots_as_of(rows, rollup.resolve_as_of(rows), 2).collect()
    assert [(r.rank, r.grid_id) for r in top] == [(1, 3), (2, 7)]
    with pytest.raises(ValueError):
        ops.hotspots_as_of(rows, F.lit(None), 0)


def test_unknown_as_of_is_null(spark):
    rows = hourly(spark, [(1, 0, 5), (1, 1, 5)])
    found = spark.range(1).select(
        rollup.resolve_as_of(rows).alias("a"),
        rollup.resolve_as_of(rows, hour(0)).alias("b"),
        rollup.resolve_as_of(rows, hour(9)).alias("c"),
    ).collect()[0]
    assert tuple(found) == (hour(1), hour(0), None)
