import math
import random

import numpy as np
import pandas as pd
import pytest

from cellwatch.operators import features
from cellwatch.schemas import FEATURES_24H, FEATURES_EXTRA
from helpers import START, hour, hourly, rows_of
from pyspark.sql import functions as F


def dense_rolling(rows):
    """The same features by rolling over gap-filled hours in pandas."""
    frames = []
    df = pd.DataFrame(rows, columns=["grid_id", "h", "total", "internet"])
    for grid_id, group in df.groupby("grid_id"):
        s = group.set_index("h").reindex(range(group.h.min(), group.h.max() + 1))
        t = s.total
        day = t.rolling(24, min_periods=24)
        out = pd.DataFrame({"grid_id": grid_id, "h": s.index}).set_index("h")
        out["avg_activity"] = day.mean()
        out["peak_ratio"] = np.where(out.avg_activity > 0, day.max() / out.avg_activity, 0.0)
        out["active_hours"] = t.gt(0).rolling(24, min_periods=24).sum()
        out["variability"] = day.std(ddof=0)
        total = day.sum()
        out["internet_share"] = np.where(total > 0, s.internet.rolling(24, min_periods=24).sum() / total, 0.0)
        recent, prior = t.rolling(6, min_periods=6).mean(), day.mean().shift(6)
        out["activity_growth"] = np.where(prior > 0, (recent - prior) / prior, 0.0)
        frames.append(out[out.index < out.index.max()].dropna().reset_index())
    return pd.concat(frames)


@pytest.mark.parametrize("keep", [1.0, 0.97])
def test_features_match_rolling_over_filled_hours(spark, keep):
    rng = random.Random(7)
    rows = [(g, h, float(rng.choice([0, rng.randint(1, 90)])), 1.0) for g in (1, 2, 3) for h in range(150) if rng.random() < keep]
    want = {(int(r.grid_id), hour(int(r.h))): r for r in dense_rolling(rows).itertuples()}
    got = {(r.grid_id, r.feature_timestamp): r for r in features.network_features(hourly(spark, rows)).collect()}
    assert set(got) == set(want) and len(got) > 50
    for key, row in got.items():
        for name in FEATURES_24H:
            assert row[name] == pytest.approx(getattr(want[key], name), abs=1e-9), (key, name)


def test_a_missing_hour_empties_the_day_after_it(spark):
    rows = [(1, h, 5) for h in range(80) if h != 40]
    found = {r.feature_timestamp for r in features.network_features(hourly(spark, rows)).collect()}
    assert found == {hour(h) for h in list(range(23, 40)) + list(range(64, 79))}


def test_missing_next_hour_keeps_the_row_but_last_hour_goes(spark):
    rows = [(1, h, 5) for h in list(range(24)) + [30]]
    assert rows_of(features.network_features(hourly(spark, rows)), "feature_timestamp") == [(hour(23),)]


def test_growth_is_zero_until_the_prior_day_is_full(spark):
    rows = [(1, h, h + 1) for h in range(40)]
    growth = {r.feature_timestamp: r.activity_growth for r in features.network_features(hourly(spark, rows)).collect()}
    assert all(growth[hour(h)] == 0.0 for h in range(23, 29))
    assert growth[hour(29)] == pytest.approx((27.5 - 12.5) / 12.5)


def test_idle_day_has_zero_ratios(spark):
    row = features.network_features(hourly(spark, [(1, h, 0, 0) for h in range(25)])).collect()[0]
    assert (row.avg_activity, row.peak_ratio, row.active_hours, row.internet_share, row.activity_growth) == (0, 0, 0, 0, 0)


def test_recent_features_count_rows_not_hours(spark):
    rows = hourly(spark, [(1, h, t) for h, t in zip((0, 1, 2, 10, 50, 90), (1, 2, 3, 4, 5, 9))])
    last = features.recent_features(rows).where("recent_6h_mean is not null").collect()
    assert [(r.timestamp, r.recent_6h_mean) for r in last] == [(hour(90), 4.0)]
    assert last[0].recent_6h_std == pytest.approx(np.std([1, 2, 3, 4, 5, 9]))
    assert last[0].recent_6h_peak_ratio == 2.25


def test_cyclic_time_counts_from_monday(spark):
    # The first hour of the fixture is a Monday.
    rows = hourly(spark, [(1, 0, 1), (1, 30, 1)])
    found = {r.timestamp: r for r in features.extra_features(rows).collect()}
    assert START.weekday() == 0
    assert (found[hour(0)].hour_sin, found[hour(0)].day_cos) == (0.0, 1.0)
    assert found[hour(30)].hour_sin == pytest.approx(math.sin(2 * math.pi * 6 / 24))
    assert found[hour(30)].day_sin == pytest.approx(math.sin(2 * math.pi / 7))


def test_later_hours_never_change_a_feature(spark):
    rows = [(4821, h, 100 + (h % 12) * 10, 0.6 * (100 + (h % 12) * 10)) for h in range(72)]
    changed = [(g, h, 1e9 if h > 50 else t, 9e8 if h > 50 else i) for g, h, t, i in rows]
    at = F.col("feature_timestamp") == F.lit(hour(50)).cast("timestamp_ntz")
    before, after = (features.network_features(hourly(spark, r)).where(at).collect() for r in (rows, changed))
    assert before == after and len(before) == 1


def test_leakage_report_finds_no_change(spark):
    rng = random.Random(3)
    rows = hourly(spark, [(g, h, rng.random() * 50) for g in (1, 2) for h in range(100) if rng.random() < 0.95])
    found = features.leakage_compare(rows, F.lit(hour(70)).cast("timestamp_ntz")).collect()
    assert {r.feature for r in found} == set(FEATURES_24H + FEATURES_EXTRA)
    assert all(r.mismatches == 0 and r.compared_rows > 100 for r in found)


def test_model_dataset_equals_joined_parts(spark):
    from cellwatch.operators import baselines

    rng = random.Random(5)
    rows = hourly(spark, [(g, h, rng.random() * 50) for g in (1, 2) for h in range(120) if rng.random() < 0.98])
    keys = ["grid_id", "feature_timestamp"]
    extra = features.extra_features(rows).withColumnRenamed("timestamp", "feature_timestamp")
    joined = features.network_features(rows).join(extra, keys).join(baselines.risk_target(rows), keys).dropna()
    got = features.model_dataset(rows)
    assert got.count() > 40
    assert got.exceptAll(joined.select(*got.columns)).count() == 0
    assert joined.select(*got.columns).exceptAll(got).count() == 0
    assert got.where("target = 1").count() > 0


def test_results_do_not_depend_on_the_session_zone(spark):
    # The clock of New York skips an hour on 2024-03-10.
    from datetime import timedelta

    shift = int((timedelta(days=69)).total_seconds() // 3600)
    rows = [(1, shift + h, 5 + h % 7) for h in range(60)]

    def found():
        return sorted(map(tuple, features.network_features(hourly(spark, rows)).collect()))

    want = found()
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert found() == want and len(want) == 36
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
