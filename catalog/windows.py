"""Window-function queries: ranks, baselines, features, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from catalog.core import query, rounded
from cellwatch.operators import alerts, anomaly, baselines, features, ops, rollup
from cellwatch.schemas import FEATURES_24H, MEASURES

H = v.hourly_sql()
HD = v.hourly_sql(v.DENSE)
GT = "grid_id, timestamp"


@query(
    "hotspot_ranking",
    rounded(
        f"""SELECT *, row_number() OVER (ORDER BY round(total_activity, 6) DESC, grid_id) AS rank FROM (
              SELECT grid_id, sum(total_activity) AS total_activity, sum(total_sms) AS total_sms, sum(total_calls) AS total_calls,
                sum(internet_activity) AS internet_activity
              FROM ({H}) WHERE date BETWEEN DATE '2024-01-08' AND DATE '2024-01-21' GROUP BY grid_id
              ORDER BY round(sum(total_activity), 6) DESC, grid_id LIMIT 10)""",
        "total_activity total_sms total_calls internet_activity",
        "grid_id, rank",
    ),
)
def _(spark, sf):
    return ops.hotspot_ranking(v.hourly(spark, sf), "2024-01-08", "2024-01-21")


@query(
    "hotspots_as_of",
    rounded(
        f"""WITH h AS ({H}) SELECT *, row_number() OVER (ORDER BY total_activity DESC, grid_id) AS rank, 'HOTSPOT' AS status,
              'Grid is among the highest activity areas for the effective reporting hour.' AS reason
            FROM h WHERE timestamp = (SELECT max(timestamp) FROM h) ORDER BY total_activity DESC, grid_id LIMIT 10""",
        "total_activity total_sms total_calls internet_activity",
        f"{GT}, rank, status, reason",
    ),
)
def _(spark, sf):
    return ops.hotspots_as_of(*v.latest_hours(spark, sf))


@query(
    "previous_activity",
    rounded(
        f"SELECT grid_id, timestamp, total_activity, lag(total_activity) OVER (PARTITION BY grid_id ORDER BY timestamp) AS previous_activity FROM ({H})",
        "total_activity previous_activity",
        GT,
    ),
)
def _(spark, sf):
    return baselines.previous_activity(v.hourly(spark, sf).select("grid_id", "timestamp", "total_activity"))


@query(
    "loo_baseline",
    rounded(f"WITH h AS MATERIALIZED ({H}) {v.loo_sql('SELECT * FROM h')}", "total_activity baseline_activity", GT),
)
def _(spark, sf):
    rows = v.hourly(spark, sf).select("grid_id", "timestamp", "date", "total_activity")
    return baselines.loo_baseline(rows).drop("date")


@query(
    "timestamp_gaps",
    f"""SELECT grid_id, timestamp, previous_timestamp, date_diff('hour', previous_timestamp, timestamp) AS gap_hours FROM (
          SELECT grid_id, timestamp, lag(timestamp) OVER (PARTITION BY grid_id ORDER BY timestamp) AS previous_timestamp FROM ({H}))
        WHERE timestamp <> previous_timestamp + INTERVAL 1 HOUR""",
)
def _(spark, sf):
    return baselines.timestamp_gaps(v.hourly(spark, sf))


@query(
    "densify_hours",
    rounded(
        f"""WITH h AS MATERIALIZED ({H}) SELECT f.grid_id, f.timestamp, h.total_activity, h.internet_activity FROM (
              SELECT grid_id, unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 1 HOUR)) AS timestamp FROM h GROUP BY grid_id) f
            LEFT JOIN h ON f.grid_id = h.grid_id AND f.timestamp = h.timestamp""",
        "total_activity internet_activity",
        GT,
    ),
)
def _(spark, sf):
    return baselines.densify_hours(v.stored_hourly(spark, sf).select("grid_id", "timestamp", "total_activity", "internet_activity"))


def _feature_query(key: str, name: str, column: str) -> None:
    exact = name == "active_hours"
    sql = f"SELECT grid_id, timestamp AS feature_timestamp, {column} AS {name} FROM ({v.windows_sql(HD)})"

    @query(key, rounded(sql, "" if exact else name, "grid_id, feature_timestamp" + (f", {name}" if exact else "")))
    def _(spark, sf):
        return features.feature(v.hourly(spark, sf, v.DENSE), name)


for _key, _name, _column in [
    ("feat_avg_activity", "avg_activity", "avg_activity"),
    ("feat_peak_ratio", "peak_ratio", "peak_ratio"),
    ("feat_active_hours", "active_hours", "active_hours"),
    ("feat_variability", "variability", "variability"),
    ("feat_internet_share", "internet_share", "internet_share_24h"),
    ("feat_activity_growth", "activity_growth", "activity_growth"),
]:
    _feature_query(_key, _name, _column)


@query(
    "network_features",
    rounded(
        v.features_sql(HD),
        " ".join(n for n in FEATURES_24H if n != "active_hours"),
        "grid_id, feature_timestamp, active_hours",
    ),
)
def _(spark, sf):
    return features.network_features(v.hourly(spark, sf, v.DENSE))


_RECENT = "recent_6h_mean recent_6h_std recent_6h_peak_ratio"


@query("feat_recent_6", rounded(v.windows_sql(H), _RECENT, GT))
def _(spark, sf):
    return features.recent_features(v.hourly(spark, sf))


@query("feat_cyclic_time", rounded(v.windows_sql(H), "hour_sin hour_cos day_sin day_cos", GT))
def _(spark, sf):
    rows = v.hourly(spark, sf)
    return rows.select("grid_id", "timestamp", *[c.alias(n) for n, c in features.cyclic_time(F.col("timestamp")).items()])


@query("risk_target", f"SELECT grid_id, timestamp AS feature_timestamp, target FROM ({v.windows_sql(HD)})")
def _(spark, sf):
    return baselines.risk_target(v.hourly(spark, sf, v.DENSE))


@query(
    "trailing_high_activity",
    f"SELECT grid_id, timestamp, CAST(total_activity > 1.5::DOUBLE * trailing_median AS INTEGER) AS np3_high_activity FROM ({v.windows_sql(H)})",
)
def _(spark, sf):
    return baselines.trailing_high_activity(v.hourly(spark, sf))


@query(
    "hour_bucket_baseline",
    rounded(v.baseline_sql(H), "total_activity baseline_activity", f"{GT}, hour_of_day"),
)
def _(spark, sf):
    rows = v.hourly(spark, sf).select("grid_id", "timestamp", "total_activity")
    return baselines.hour_bucket_baseline(rows)


@query(
    "weekday_hour_baseline",
    rounded(
        f"""WITH h AS MATERIALIZED ({H}) SELECT h.*, b.baseline_activity FROM h JOIN (
              SELECT day_of_week, hour, median(total_activity) AS baseline_activity FROM h GROUP BY 1, 2) b
            ON h.day_of_week = b.day_of_week AND h.hour = b.hour""",
        "total_activity baseline_activity",
        f"{GT}, day_of_week, hour",
    ),
)
def _(spark, sf):
    rows = v.stored_hourly(spark, sf).select("grid_id", "timestamp", "total_activity", "day_of_week", "hour")
    return baselines.hour_bucket_baseline(rows, ("day_of_week", "hour")).drop("hour_of_day")


@query(
    "latest_features",
    rounded(
        f"""SELECT *, 'GOOD' AS data_quality, 'CURRENT' AS freshness FROM (
              SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY feature_timestamp DESC) AS n FROM ({v.features_sql(HD)})) WHERE n = 1""",
        " ".join(n for n in FEATURES_24H if n != "active_hours"),
        "grid_id, feature_timestamp, active_hours, data_quality, freshness",
    ),
)
def _(spark, sf):
    return ops.latest_features(features.network_features(v.hourly(spark, sf, v.DENSE)))


def history_sql(source: str) -> str:
    return f"""
  WITH h AS MATERIALIZED ({source}), w AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY timestamp DESC) AS n FROM h
    WHERE timestamp BETWEEN (SELECT max(timestamp) FROM h) - INTERVAL 23 HOUR AND (SELECT max(timestamp) FROM h)),
  p AS (SELECT grid_id, count(*) AS cnt, avg(total_activity) AS mean, max(total_activity) AS hi, min(total_activity) AS lo FROM w WHERE n > 1 GROUP BY 1),
  s AS (SELECT w.grid_id, count(*) AS surges FROM w JOIN p ON w.grid_id = p.grid_id WHERE n > 1 AND total_activity > mean * 1.3::DOUBLE GROUP BY 1)
  SELECT w.grid_id, w.timestamp, w.total_activity, CAST(coalesce(cnt, 0) AS INTEGER) AS observation_window_hours,
    coalesce(mean, 0) AS historical_mean_activity, coalesce(hi, 0) AS historical_max_activity, coalesce(lo, 0) AS historical_min_activity,
    CAST(coalesce(surges, 0) AS INTEGER) AS intervals_exceeding_30pct_surge
  FROM w LEFT JOIN p ON w.grid_id = p.grid_id LEFT JOIN s ON w.grid_id = s.grid_id WHERE n = 1"""


@query(
    "history_summary",
    rounded(
        history_sql(H),
        "total_activity historical_mean_activity historical_max_activity historical_min_activity",
        f"{GT}, observation_window_hours, intervals_exceeding_30pct_surge",
    ),
)
def _(spark, sf):
    hours = v.stored_hourly(spark, sf)
    return baselines.history_summary(hours, rollup.resolve_as_of(hours))


@query(
    "hourly_cadence",
    f"""SELECT count(*) AS timestamp_count, count(*) FILTER (WHERE timestamp <> p + INTERVAL 1 HOUR) AS irregular_steps,
          (SELECT count(DISTINCT date) FROM ({H})) * 24 AS expected_timestamp_count
        FROM (SELECT timestamp, lag(timestamp) OVER (ORDER BY timestamp) AS p FROM (SELECT DISTINCT timestamp FROM ({H})))""",
)
def _(spark, sf):
    hours = v.stored_hourly(spark, sf)
    return baselines.hourly_cadence(hours, hours.agg(F.countDistinct("date")).scalar())


@query(
    "network_alerts",
    rounded(v.alerts_sql(HD), "current_activity baseline_activity", f"{GT}, alert_type, reason"),
)
def _(spark, sf):
    return alerts.network_alerts(v.stored_hourly(spark, sf, v.DENSE))


@query(
    "anomaly_scores",
    rounded(
        v.anomaly_sql(H),
        "total_activity baseline_activity percentage_deviation anomaly_score",
        f"{GT}, direction, reason",
    ),
)
def _(spark, sf):
    rows = v.hourly(spark, sf).select("grid_id", "timestamp", "total_activity")
    return anomaly.anomaly_scores(baselines.hour_bucket_baseline(rows))
