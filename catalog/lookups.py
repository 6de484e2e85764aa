"""Operational look-ups, evidence and health queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from catalog.core import query, rounded
from catalog.sources import STATUS_SQL, stored_status
from catalog.windows import history_sql
from cellwatch.operators import alerts, anomaly, baselines, features, geo, ops, rollup
from cellwatch.schemas import MEASURES

H = v.hourly_sql()
HD = v.hourly_sql(v.DENSE)
C = v.cells_sql()
GT = "grid_id, timestamp"
M = " ".join(MEASURES)
T = "total_sms total_calls total_activity internet_share"


@query(
    "top_activity_grids",
    rounded(
        f"""SELECT t.grid_id, total_activity, area_lon AS centroid_longitude, area_lat AS centroid_latitude, 1 AS polygons FROM (
              SELECT grid_id, sum(total_activity) AS total_activity FROM ({H}) WHERE date BETWEEN DATE '2024-01-08' AND DATE '2024-01-21'
              GROUP BY grid_id ORDER BY round(sum(total_activity), 6) DESC, grid_id LIMIT 10) t LEFT JOIN ({C}) c ON t.grid_id = c.grid_id""",
        "total_activity centroid_longitude centroid_latitude",
        "grid_id, polygons",
    ),
)
def _(spark, sf):
    cells = geo.area_centroids(v.grid_cells(spark, sf))
    top = geo.top_activity_grids(v.hourly(spark, sf), cells, "2024-01-08", "2024-01-21")
    return top.withColumn("polygons", F.size("geometry")).drop("geometry")


def _feed_sql(where: str, limit: int) -> str:
    return f"""SELECT * FROM ({v.alerts_sql(HD)}) WHERE {where}
        ORDER BY timestamp DESC, CAST(grid_id AS VARCHAR) DESC, alert_type DESC LIMIT {limit}"""


@query(
    "alert_feed",
    rounded(_feed_sql("timestamp <= (SELECT max(timestamp) FROM hh)".replace("hh", f"({HD})"), 100), "current_activity baseline_activity", f"{GT}, alert_type, reason"),
)
def _(spark, sf):
    hours = v.stored_hourly(spark, sf, v.DENSE)
    return alerts.alert_feed(alerts.network_alerts(hours), rollup.resolve_as_of(hours), limit=100)


@query(
    "alert_feed_by_type",
    rounded(
        _feed_sql("timestamp <= TIMESTAMP '2024-01-20 12:00:00' AND alert_type = 'ACTIVITY_DROP'", 100),
        "current_activity baseline_activity",
        f"{GT}, alert_type, reason",
    ),
)
def _(spark, sf):
    hours = v.stored_hourly(spark, sf, v.DENSE)
    as_of = rollup.resolve_as_of(hours, "2024-01-20 12:00:00")
    return alerts.alert_feed(alerts.network_alerts(hours), as_of, "ACTIVITY_DROP", 100)


@query(
    "grid_activity_24h",
    rounded(
        f"""WITH h AS ({H}) SELECT * FROM h
            WHERE timestamp BETWEEN (SELECT max(timestamp) FROM h) - INTERVAL 23 HOUR AND (SELECT max(timestamp) FROM h)""",
        f"{M} {T}",
        GT,
    ),
)
def _(spark, sf):
    return ops.grid_activity_24h(*v.latest_hours(spark, sf, 24))


@query(
    "grid_location",
    rounded(
        f"SELECT grid_id, mean_lat AS centroid_latitude, mean_lon AS centroid_longitude, 'milano-grid.geojson' AS geometry_reference FROM ({C})",
        "centroid_latitude centroid_longitude",
        "grid_id, geometry_reference",
    ),
)
def _(spark, sf):
    return geo.grid_location(v.located_cells(spark, sf))


LOOKUP = f"""
  WITH hx AS MATERIALIZED ({HD}), p AS ({v.predicted_sql('SELECT * FROM hx')}),
  l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY timestamp DESC) AS n FROM p) WHERE n = 1)
  SELECT l.grid_id, l.timestamp AS feature_timestamp, l.risk_probability AS risk_score, {v.level_sql('l.risk_probability')} AS risk_level,
    'ML3-v1' AS model_version,
    CASE WHEN l.risk_probability >= 0.8 THEN 'High future high-activity risk. Investigate the grid.'
      WHEN l.risk_probability >= 0.4 THEN 'Medium future high-activity risk. Monitor the grid and consider investigation.'
      ELSE 'Low future high-activity risk based on the ML3 prediction.' END
    || CASE WHEN a.direction <> 'normal' THEN ' ML4 anomaly context: ' || a.reason ELSE '' END AS explanation_note
  FROM l LEFT JOIN ({v.anomaly_sql('SELECT * FROM hx')}) a ON l.grid_id = a.grid_id AND l.timestamp = a.timestamp"""


def _lookup(spark, sf):
    hours = v.stored_hourly(spark, sf, v.DENSE)
    scores = anomaly.anomaly_scores(baselines.hour_bucket_baseline(hours))
    return hours, ops.risk_lookup(v.predicted(hours), scores)


@query("risk_lookup", rounded(LOOKUP, "risk_score", "grid_id, feature_timestamp, risk_level, model_version, explanation_note"))
def _(spark, sf):
    return _lookup(spark, sf)[1]


@query(
    "resolve_as_of",
    f"""WITH h AS ({H}) SELECT (SELECT max(timestamp) FROM h) AS latest,
          (SELECT max(timestamp) FROM h WHERE timestamp = TIMESTAMP '2024-01-20 12:00:00') AS requested,
          (SELECT max(timestamp) FROM h WHERE timestamp = TIMESTAMP '2031-01-01 00:00:00') AS unknown""",
)
def _(spark, sf):
    hours = v.stored_hourly(spark, sf)
    return spark.range(1).select(
        rollup.resolve_as_of(hours).alias("latest"),
        rollup.resolve_as_of(hours, "2024-01-20 12:00:00").alias("requested"),
        rollup.resolve_as_of(hours, "2031-01-01 00:00:00").alias("unknown"),
    )


def _dec(expr: str, digits: int) -> str:
    return f"CAST(round(CAST(round({expr}, {digits + 6}) AS DECIMAL(30,{digits + 6})), {digits}) AS DOUBLE)"


EVIDENCE = f"""
  WITH hd AS MATERIALIZED ({HD}), r AS MATERIALIZED ({LOOKUP}),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY feature_timestamp DESC) AS n
        FROM ({v.features_sql('SELECT * FROM hd')})) WHERE n = 1),
  c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY timestamp DESC) AS n FROM hd
        WHERE timestamp >= (SELECT max(timestamp) FROM hd) - INTERVAL 23 HOUR) WHERE n = 1)
  SELECT f.grid_id, f.feature_timestamp, {_dec('coalesce(c.total_activity, 0)', 2)} AS current_activity, {_dec('f.avg_activity', 2)} AS baseline_activity,
    {_dec('f.activity_growth', 4)} AS activity_growth, {_dec('f.peak_ratio', 4)} AS peak_ratio, {_dec('f.variability', 4)} AS variability,
    {_dec('f.internet_share', 4)} AS internet_share, {_dec('r.risk_score', 4)} AS anomaly_score, lower(r.risk_level) AS anomaly_direction
  FROM f JOIN r ON f.grid_id = r.grid_id LEFT JOIN c ON f.grid_id = c.grid_id"""
EVIDENCE_DOUBLES = "current_activity baseline_activity activity_growth peak_ratio variability internet_share anomaly_score"


def _evidence(spark, sf):
    hours, risk = _lookup(spark, sf)
    return ops.evidence_package(hours, features.network_features(hours), risk, rollup.resolve_as_of(hours))


@query("evidence_package", rounded(EVIDENCE, EVIDENCE_DOUBLES, "grid_id, feature_timestamp, anomaly_direction"))
def _(spark, sf):
    return _evidence(spark, sf)


_DOCUMENT = ", ".join(
    f"""'"{n}":' || CAST({n} AS VARCHAR)""" for n in ["current_activity", "baseline_activity", "activity_growth", "peak_ratio", "variability", "internet_share", "anomaly_score"]
).replace(", ", " || ',' || ")


@query(
    "evidence_document",
    f"""SELECT grid_id, '{{"feature_timestamp":"' || strftime(feature_timestamp, '%Y-%m-%dT%H:%M:%S.000') || '",' || {_DOCUMENT}
          || ',"anomaly_direction":"' || anomaly_direction || '"}}' AS evidence FROM ({EVIDENCE})""",
)
def _(spark, sf):
    return ops.evidence_document(_evidence(spark, sf))


NOW_SQL = f"(SELECT max(run_timestamp) FROM ({STATUS_SQL})) + INTERVAL 30 MINUTE"
HEALTH = f"""
  SELECT *, CASE WHEN failed THEN 'Pipeline status is FAILED.;Task ''clean'' status is FAILED.' || CASE WHEN freshness <> 'FRESH' THEN ';' ELSE '' END ELSE '' END
      || CASE WHEN freshness <> 'FRESH' THEN 'Analytics status record is ' || freshness || '.' ELSE '' END AS reasons,
    NOT failed AND freshness = 'FRESH' AS healthy, NOT failed AND freshness = 'FRESH' AS trustworthy
  FROM (SELECT *, CASE WHEN age < 3600 THEN 'FRESH' WHEN age < 86400 THEN 'STALE' ELSE 'VERY_STALE' END AS freshness
        FROM (SELECT *, date_diff('second', run_timestamp, {NOW_SQL}) AS age FROM ({STATUS_SQL})))"""


def _health(spark, sf):
    status = stored_status(spark, sf)
    now = status.agg(F.max("run_timestamp")).scalar() + F.make_dt_interval(mins=F.lit(30))
    return ops.run_health(status, now)


@query("pipeline_health", f"SELECT run_id, run_timestamp, status, freshness, reasons, healthy, trustworthy, rows_published FROM ({HEALTH})")
def _(spark, sf):
    return _health(spark, sf).select(
        "run_id", "run_timestamp", "status", "freshness", F.array_join("reasons", ";").alias("reasons"), "healthy", "trustworthy", "rows_published"
    )


_SEVERITY = f"""
  SELECT *, CASE WHEN NOT trustworthy THEN 'ATTENTION' WHEN anomaly_score > 0.6 THEN 'HIGH' ELSE 'NORMAL' END AS severity_supervisor,
    CASE WHEN NOT trustworthy THEN 'ATTENTION' WHEN anomaly_score > 0.65 THEN 'HIGH' WHEN anomaly_score > 0.35 THEN 'ATTENTION' ELSE 'NORMAL' END AS severity_investigator,
    CASE WHEN anomaly_score > 0.6 OR activity_growth > 1.5 THEN 'HIGH' WHEN anomaly_score > 0.3 OR activity_growth > 0.5 THEN 'ATTENTION' ELSE 'NORMAL' END AS severity_explain,
    CASE WHEN anomaly_score > 0.7 THEN 'HIGH' WHEN anomaly_score > 0.4 THEN 'ATTENTION' ELSE 'NORMAL' END AS severity_skill
  FROM (SELECT e.*, h.trustworthy FROM ({EVIDENCE}) e, (SELECT trustworthy FROM ({HEALTH}) ORDER BY run_timestamp DESC LIMIT 1) h)"""


@query(
    "severity_assessment",
    rounded(
        _SEVERITY,
        "current_activity anomaly_score activity_growth",
        "grid_id, trustworthy, severity_supervisor, severity_investigator, severity_explain, severity_skill",
    ),
)
def _(spark, sf):
    latest = _health(spark, sf).agg(F.max_by("trustworthy", "run_timestamp")).scalar()
    return ops.severity_assessment(_evidence(spark, sf).withColumn("trustworthy", latest)).select(
        "grid_id", "current_activity", "anomaly_score", "activity_growth", "trustworthy", *[f"severity_{p}" for p in ops.PRESETS]
    )


@query(
    "anomaly_reconciliation",
    rounded(
        f"""WITH a AS (SELECT DISTINCT grid_id FROM ({v.alerts_sql(HD)}))
            SELECT r.grid_id, risk_score, a.grid_id IS NOT NULL AS has_alert,
              CASE WHEN a.grid_id IS NOT NULL AND risk_score > 0.5 THEN 'FULL_AGREEMENT' WHEN a.grid_id IS NOT NULL THEN 'RULE_ONLY_DIVERGENCE'
                WHEN risk_score > 0.5 THEN 'ML_ONLY_DIVERGENCE' ELSE 'BASELINE_NORMAL' END AS agreement_status
            FROM ({LOOKUP}) r LEFT JOIN a ON r.grid_id = a.grid_id""",
        "risk_score",
        "grid_id, has_alert, agreement_status",
    ),
)
def _(spark, sf):
    hours, risk = _lookup(spark, sf)
    return ops.anomaly_reconciliation(risk, alerts.network_alerts(hours))


@query(
    "display_priority",
    f"""WITH hq AS MATERIALIZED ({HD}), al AS (SELECT grid_id, bool_or(alert_type <> 'ACTIVITY_DROP') AS urgent
          FROM ({v.alerts_sql('SELECT * FROM hq')}) WHERE timestamp = (SELECT max(timestamp) FROM hq) GROUP BY 1),
        s AS (SELECT grid_id, row_number() OVER (ORDER BY total_activity DESC, grid_id) AS rank FROM hq
          WHERE timestamp = (SELECT max(timestamp) FROM hq) ORDER BY 2 LIMIT 10)
        SELECT coalesce(al.grid_id, s.grid_id) AS grid_id, CASE WHEN urgent THEN 'HIGH' WHEN al.grid_id IS NOT NULL THEN 'ATTENTION'
          WHEN rank = 1 THEN 'HIGH' ELSE 'ATTENTION' END AS priority
        FROM al FULL JOIN s ON al.grid_id = s.grid_id""",
)
def _(spark, sf):
    hours = v.stored_hourly(spark, sf, v.DENSE)
    as_of = rollup.resolve_as_of(hours)
    current = alerts.network_alerts(hours).where(F.col("timestamp") == as_of)
    return alerts.display_priority(current, ops.hotspots_as_of(hours, as_of))


@query(
    "investigation_package",
    rounded(
        f"""WITH s AS ({history_sql(HD)}), r AS ({LOOKUP}),
              f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY feature_timestamp DESC) AS n FROM ({v.features_sql(HD)})) WHERE n = 1)
            SELECT s.*, f.activity_growth, f.peak_ratio, f.variability, c.mean_lat AS centroid_latitude, c.mean_lon AS centroid_longitude,
              r.risk_score, r.risk_level, r.explanation_note
            FROM s LEFT JOIN f ON s.grid_id = f.grid_id LEFT JOIN ({v.cells_sql(v.DENSE)}) c ON s.grid_id = c.grid_id LEFT JOIN r ON s.grid_id = r.grid_id""",
        "total_activity historical_mean_activity historical_max_activity historical_min_activity activity_growth peak_ratio variability "
        "centroid_latitude centroid_longitude risk_score",
        f"{GT}, observation_window_hours, intervals_exceeding_30pct_surge, risk_level, explanation_note",
    ),
)
def _(spark, sf):
    hours, risk = _lookup(spark, sf)
    cells = v.located_cells(spark, sf, v.DENSE)
    return ops.investigation_package(hours, features.network_features(hours), risk, cells, rollup.resolve_as_of(hours))
