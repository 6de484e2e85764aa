"""Dimension, geography and comparison joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from catalog.core import query, rounded
from cellwatch import runtime
from cellwatch.operators import alerts, anomaly, baselines, features, geo, ops, rollup, star
from cellwatch.schemas import FEATURES_24H, FEATURES_EXTRA, MEASURES, MODEL_FEATURES

H = v.hourly_sql()
HD = v.hourly_sql(v.DENSE)
C = v.cells_sql()
CD = v.cells_sql(v.DENSE)
M = " ".join(MEASURES)
T = "total_sms total_calls total_activity internet_share"
DATE = "CAST(date AS VARCHAR) AS date"
FILE = "milano-grid.geojson"

TIMES = f"""
  SELECT row_number() OVER (ORDER BY timestamp) AS time_key, timestamp, CAST(timestamp AS DATE) AS date, hour(timestamp) AS hour,
    dayofweek(timestamp) + 1 AS day_of_week FROM (SELECT DISTINCT timestamp FROM ({H}))"""
GRIDS = f"""
  SELECT row_number() OVER (ORDER BY grid_id) AS grid_key, CAST(grid_id AS VARCHAR) AS grid_id, mean_lat AS centroid_latitude,
    mean_lon AS centroid_longitude, '{FILE}' AS geometry_reference FROM ({C})"""


def star_tables(spark, sf):
    """Stored hourly rows and dimensions, as a warehouse load leaves them."""
    hours = v.stored_hourly(spark, sf)
    times = runtime.materialize(star.dim_time(hours), "dim-time")
    grids = runtime.materialize(star.dim_grid(v.grid_cells(spark, sf), FILE), "dim-grid")
    return hours, times, grids


@query("dim_time", f"SELECT time_key, timestamp, {DATE}, hour, day_of_week FROM ({TIMES})")
def _(spark, sf):
    return star.dim_time(v.stored_hourly(spark, sf))


@query("dim_grid", rounded(GRIDS, "centroid_latitude centroid_longitude", "grid_key, grid_id, geometry_reference"))
def _(spark, sf):
    return star.dim_grid(v.grid_cells(spark, sf), FILE)


@query(
    "fact_network_activity",
    rounded(
        f"SELECT t.time_key, g.grid_key, h.* FROM ({H}) h JOIN ({TIMES}) t USING (timestamp) JOIN ({GRIDS}) g ON g.grid_id = CAST(h.grid_id AS VARCHAR)",
        f"{M} {T}",
        "time_key, grid_key",
    ),
)
def _(spark, sf):
    hours, times, grids = star_tables(spark, sf)
    return star.fact_network_activity(hours, times, grids)


@query(
    "unknown_keys",
    f"""SELECT 'grid_id' AS key, CAST(grid_id AS VARCHAR) AS value, count(*) AS rows FROM ({H})
        WHERE grid_id NOT IN (SELECT grid_id FROM ({CD})) GROUP BY 2""",
)
def _(spark, sf):
    hours = v.stored_hourly(spark, sf)
    return star.unknown_keys(hours, star.dim_time(hours), star.dim_grid(v.grid_cells(spark, sf, v.DENSE), FILE))


@query(
    "star_activity",
    rounded(
        f"""SELECT h.timestamp, CAST(h.grid_id AS VARCHAR) AS grid_id, h.date, h.hour, c.mean_lat AS centroid_latitude,
              c.mean_lon AS centroid_longitude, {', '.join('h.' + n for n in (M + ' ' + T).split())}
            FROM ({H}) h JOIN ({C}) c ON h.grid_id = c.grid_id""",
        f"centroid_latitude centroid_longitude {M} {T}",
        f"timestamp, grid_id, {DATE}, hour",
    ),
)
def _(spark, sf):
    hours, times, grids = star_tables(spark, sf)
    return star.star_activity(star.fact_network_activity(hours, times, grids), times, grids)


# The same star shape over the largest table and its given dimensions.
@query(
    "supplier_star",
    rounded(
        """SELECT r_name AS region, n_name AS nation, CAST(l_shipdate AS DATE) AS date, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total_activity, count(*) AS records
           FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
           GROUP BY 1, 2, 3""",
        "total_activity",
        f"region, nation, records, {DATE}",
    ),
)
def _(spark, sf):
    # Facts reduce to one row per cell and day before they meet a dimension.
    daily = (
        v.table(spark, sf, "lineitem")
        .groupBy("l_suppkey", F.to_date("l_shipdate").alias("date"))
        .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"), F.count("*").alias("n"))
    )
    suppliers = v.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nations, regions = v.table(spark, sf, "nation"), v.table(spark, sf, "region")
    return (
        daily.join(suppliers, daily.l_suppkey == suppliers.s_suppkey)
        .join(nations, F.col("s_nationkey") == nations.n_nationkey)
        .join(regions, F.col("n_regionkey") == regions.r_regionkey)
        .groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), "date")
        .agg(F.sum("amount").cast("double").alias("total_activity"), F.sum("n").alias("records"))
    )


@query(
    "grid_centroid",
    rounded(
        f"SELECT grid_id, area_lon, area_lat, mean_lon, mean_lat FROM ({C})", "area_lon area_lat mean_lon mean_lat", "grid_id"
    ),
)
def _(spark, sf):
    area = geo.area_centroids(v.grid_cells(spark, sf)).withColumnsRenamed(
        {"centroid_longitude": "area_lon", "centroid_latitude": "area_lat"}
    )
    both = geo.vertex_centroids(area).withColumnsRenamed({"centroid_longitude": "mean_lon", "centroid_latitude": "mean_lat"})
    return both.select("grid_id", "area_lon", "area_lat", "mean_lon", "mean_lat")


@query(
    "enrich_geo",
    rounded(
        f"""SELECT h.timestamp, h.grid_id, h.total_activity, c.area_lon AS centroid_longitude, c.area_lat AS centroid_latitude, c.grid_id IS NOT NULL AS located
            FROM ({H}) h LEFT JOIN ({v.cells_sql(64)}) c ON h.grid_id = c.grid_id""",
        "total_activity centroid_longitude centroid_latitude",
        "timestamp, grid_id, located",
    ),
)
def _(spark, sf):
    cells = geo.area_centroids(v.grid_cells(spark, sf, 64))
    rows = v.hourly(spark, sf).select("timestamp", "grid_id", "total_activity")
    return geo.enrich_geo(rows, cells).withColumn("located", F.col("geometry").isNotNull()).drop("geometry")


@query(
    "reference_coverage",
    rounded(
        f"""WITH s AS (SELECT DISTINCT grid_id FROM ({H})), r AS (SELECT DISTINCT grid_id FROM ({v.cells_sql(64)}))
            SELECT (SELECT count(*) FROM s) AS source_grids, (SELECT count(*) FROM r) AS reference_grids,
              (SELECT count(*) FROM s ANTI JOIN r USING (grid_id)) AS missing_in_reference,
              (SELECT count(*) FROM r ANTI JOIN s USING (grid_id)) AS missing_in_source,
              round(100.0::DOUBLE * (SELECT count(*) FROM s SEMI JOIN r USING (grid_id)) / (SELECT count(*) FROM s), 4) AS coverage_pct""",
        "coverage_pct",
        "source_grids, reference_grids, missing_in_reference, missing_in_source",
    ),
)
def _(spark, sf):
    return geo.reference_coverage(v.telemetry(spark, sf), v.grid_cells(spark, sf, 64))


@query(
    "eligible_grids",
    rounded(
        f"""SELECT h.grid_id, h.timestamp, h.total_activity, d.daily_activity, f.activity_floor, d.daily_activity >= f.activity_floor AS eligible
            FROM ({H}) h JOIN (SELECT date, grid_id, round(sum(total_activity), 6) AS daily_activity FROM ({H}) GROUP BY 1, 2) d
              ON h.date = d.date AND h.grid_id = d.grid_id JOIN ({v.floor_sql(H)}) f ON h.date = f.date""",
        "total_activity daily_activity activity_floor",
        "grid_id, timestamp, eligible",
    ),
)
def _(spark, sf):
    return alerts.eligible_grids(v.stored_hourly(spark, sf)).select(
        "grid_id", "timestamp", "total_activity", "daily_activity", "activity_floor", "eligible"
    )


@query(
    "model_dataset",
    rounded(
        f"SELECT * FROM ({v.features_sql(HD)}) WHERE recent_6h_mean IS NOT NULL AND recent_6h_std IS NOT NULL",
        " ".join(n for n in MODEL_FEATURES if n != "active_hours"),
        "grid_id, feature_timestamp, active_hours, target",
    ),
)
def _(spark, sf):
    return features.model_dataset(v.hourly(spark, sf, v.DENSE))


# Contract of the outcomes, spelled out apart from the code under test.
OUTCOME_TESTS = {
    "all_three": "np3_flag = 1 AND ml3_risk = 1 AND ml4_high = 1",
    "np3_ml3_only": "np3_flag = 1 AND ml3_risk = 1 AND ml4_high = 0",
    "np3_ml4_only": "np3_flag = 1 AND ml3_risk = 0 AND ml4_high = 1",
    "ml3_ml4_only": "np3_flag = 0 AND ml3_risk = 1 AND ml4_high = 1",
    "np3_only": "np3_flag = 1 AND ml3_risk = 0 AND ml4_high = 0",
    "ml3_only": "np3_flag = 0 AND ml3_risk = 1 AND ml4_high = 0",
    "ml4_only": "np3_flag = 0 AND ml3_risk = 0 AND ml4_high = 1",
    "none_flagged": "np3_flag = 0 AND ml3_risk = 0 AND ml4_high = 0",
}
COMPARISON = f"""
  WITH hx AS MATERIALIZED ({HD}),
  an AS ({v.anomaly_sql('SELECT * FROM hx')}),
  al AS (SELECT DISTINCT grid_id, timestamp FROM ({v.alerts_sql('SELECT * FROM hx')}) WHERE alert_type = 'HIGH_ACTIVITY'),
  pr AS ({v.predicted_sql('SELECT * FROM hx')}),
  j AS (SELECT an.grid_id, an.timestamp, an.anomaly_score, an.percentage_deviation, an.direction,
          CAST(an.direction = 'high' AS INTEGER) AS ml4_high, CAST(an.direction = 'low' AS INTEGER) AS ml4_low,
          CAST(an.direction <> 'normal' AS INTEGER) AS ml4_anomaly,
          CAST(al.grid_id IS NOT NULL AS INTEGER) AS np3_flag, coalesce(pr.prediction, 0) AS ml3_risk,
          coalesce(pr.risk_probability, 0.0::DOUBLE) AS ml3_probability
        FROM an LEFT JOIN al ON an.grid_id = al.grid_id AND an.timestamp = al.timestamp
          LEFT JOIN pr ON an.grid_id = pr.grid_id AND an.timestamp = pr.timestamp)
  SELECT *, {", ".join(f"CAST({test} AS INTEGER) AS {n}" for n, test in OUTCOME_TESTS.items())} FROM j"""


def comparison(spark, sf):
    return anomaly.signals(v.stored_hourly(spark, sf, v.DENSE), v.stand_in())


_COMPARED = (
    "anomaly_score percentage_deviation ml3_probability",
    "grid_id, timestamp, direction, ml4_high, ml4_low, ml4_anomaly, np3_flag, ml3_risk, " + ", ".join(OUTCOME_TESTS),
)


@query("joined_signals", rounded(COMPARISON, *_COMPARED))
def _(spark, sf):
    """The comparison from the three signals' own tables."""
    hours = v.stored_hourly(spark, sf, v.DENSE)
    scores = anomaly.anomaly_scores(baselines.hour_bucket_baseline(hours))
    return anomaly.three_way_comparison(scores, alerts.network_alerts(hours), v.predicted(hours), ["ml3_probability"])


@query(
    "three_way_comparison",
    rounded(
        COMPARISON,
        "anomaly_score percentage_deviation ml3_probability",
        "grid_id, timestamp, direction, ml4_high, ml4_low, ml4_anomaly, np3_flag, ml3_risk, " + ", ".join(OUTCOME_TESTS),
    ),
)
def _(spark, sf):
    return comparison(spark, sf)


_OVERLAP = f"""
  SELECT count(*) AS total_records, sum(np3_flag) AS np3_alerts, sum(ml3_risk) AS ml3_risks, sum(ml4_high) AS ml4_high_anomalies,
    {', '.join(f'sum({n}) AS {n}' for n in OUTCOME_TESTS)},
    avg(CAST(ml3_risk = ml4_high AS INTEGER)) AS ml3_ml4_agreement, avg(CAST(np3_flag = ml4_high AS INTEGER)) AS np3_ml4_agreement
  FROM ({COMPARISON})"""


@query(
    "signal_overlap_metrics",
    rounded(
        _OVERLAP,
        "ml3_ml4_agreement np3_ml4_agreement",
        ", ".join(
            f"CAST({n} AS BIGINT) AS {n}" for n in ["total_records", "np3_alerts", "ml3_risks", "ml4_high_anomalies", *OUTCOME_TESTS]
        ),
    ),
)
def _(spark, sf):
    return anomaly.signal_overlap_metrics(comparison(spark, sf))


@query(
    "disagreement_summary",
    f"""WITH m AS ({_OVERLAP})
        SELECT 'np3_only' AS category, CAST(np3_only AS BIGINT) AS cases, 'NP3-only cases indicate activity that satisfies the current-day high-activity rule but is not identified as an ML3 future risk or ML4 historical high anomaly.' AS explanation FROM m WHERE np3_only > 0
        UNION ALL SELECT 'ml3_only', CAST(ml3_only AS BIGINT), 'ML3-only cases indicate future high-activity risk without a current NP3 alert or current ML4 high historical anomaly.' FROM m WHERE ml3_only > 0
        UNION ALL SELECT 'ml4_only', CAST(ml4_only AS BIGINT), 'ML4-only cases indicate current activity that is unusual for the grid''s historical hour-of-day behaviour without a current NP3 alert or ML3 future-risk prediction.' FROM m WHERE ml4_only > 0
        UNION ALL SELECT 'all_three', CAST(all_three AS BIGINT), 'Cases flagged by all three mechanisms represent the strongest multi-signal operational attention cases because current rules, future risk, and historical deviation agree.' FROM m WHERE all_three > 0""",
)
def _(spark, sf):
    return anomaly.disagreement_summary(anomaly.signal_overlap_metrics(comparison(spark, sf)))


@query(
    "top20_attention",
    rounded(
        f"""WITH h AS MATERIALIZED ({H}), top AS (
              SELECT grid_id, timestamp, {v.stand_in_sql()} AS risk_score FROM h WHERE timestamp = (SELECT max(timestamp) FROM h)
              ORDER BY risk_score DESC, grid_id LIMIT 20)
            SELECT t.grid_id, t.timestamp, risk_score, {v.level_sql('risk_score')} AS risk_level, 'ML3-v1' AS model_version,
              a.total_activity, baseline_activity, percentage_deviation, anomaly_score, direction, reason
            FROM top t LEFT JOIN ({v.anomaly_sql('SELECT * FROM h')}) a ON t.grid_id = a.grid_id AND t.timestamp = a.timestamp""",
        "risk_score total_activity baseline_activity percentage_deviation anomaly_score",
        "grid_id, timestamp, risk_level, model_version, direction, reason",
    ),
)
def _(spark, sf):
    hours = v.stored_hourly(spark, sf)
    return ops.top_attention(v.scored_hours(hours), anomaly.anomaly_scores(baselines.hour_bucket_baseline(hours)))


def _neighbours_sql(cells: str, k: int) -> str:
    return f"""
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY round(distance, 12), neighbour_id) AS rank FROM (
        SELECT a.grid_id, b.grid_id AS neighbour_id, b.mean_lat AS centroid_latitude, b.mean_lon AS centroid_longitude,
          (b.mean_lat - a.mean_lat) * (b.mean_lat - a.mean_lat) + (b.mean_lon - a.mean_lon) * (b.mean_lon - a.mean_lon) AS distance
        FROM ({cells}) a JOIN ({cells}) b ON a.grid_id <> b.grid_id)) WHERE rank <= {k}"""


@query(
    "grid_neighbours",
    rounded(
        f"SELECT grid_id, neighbour_id, rank, centroid_latitude, centroid_longitude, distance * 1000000 AS distance_e6 FROM ({_neighbours_sql(C, 8)})",
        "centroid_latitude centroid_longitude distance_e6",
        "grid_id, neighbour_id, rank",
    ),
)
def _(spark, sf):
    near = geo.grid_neighbours(v.located_cells(spark, sf), 8)
    return near.withColumn("distance_e6", F.col("distance") * 1000000).drop("distance")


@query(
    "neighbour_activity",
    rounded(
        f"""WITH h AS MATERIALIZED ({H}), n AS MATERIALIZED ({_neighbours_sql(C, 6)}), m AS (
              SELECT n.grid_id, h.timestamp, avg(h.total_activity) AS neighbour_mean, count(*) AS seen
              FROM h JOIN n ON h.grid_id = n.neighbour_id GROUP BY 1, 2)
            SELECT h.grid_id, h.timestamp, h.total_activity, neighbour_mean, coalesce(seen, 0) AS neighbours_seen,
              h.total_activity / nullif(neighbour_mean, 0) AS ratio_to_neighbours
            FROM h LEFT JOIN m ON h.grid_id = m.grid_id AND h.timestamp = m.timestamp""",
        "total_activity neighbour_mean ratio_to_neighbours",
        "grid_id, timestamp, neighbours_seen",
    ),
)
def _(spark, sf):
    return geo.neighbour_activity(v.stored_hourly(spark, sf), geo.grid_neighbours(v.located_cells(spark, sf), 6))


def _dec(expr: str, digits: int) -> str:
    return f"CAST(round(CAST(round({expr}, {digits + 6}) AS DECIMAL(30,{digits + 6})), {digits}) AS DOUBLE)"


@query(
    "surging_grids",
    rounded(
        f"""WITH f AS MATERIALIZED ({v.features_sql(HD)}), top AS (
              SELECT * FROM f WHERE feature_timestamp = (SELECT max(feature_timestamp) FROM f) AND avg_activity >= 50
              ORDER BY round(activity_growth, 9) DESC, grid_id LIMIT 10)
            SELECT row_number() OVER (ORDER BY round(activity_growth, 9) DESC, t.grid_id) AS rank, t.grid_id, feature_timestamp,
              {_dec('avg_activity * (1 + activity_growth)', 2)} AS current_activity, {_dec('avg_activity', 2)} AS baseline_activity,
              {_dec('activity_growth', 4)} AS growth_ratio, printf('%.1f', round(activity_growth * 100, 9)) || '%' AS growth_percentage,
              mean_lat AS centroid_latitude, mean_lon AS centroid_longitude
            FROM top t LEFT JOIN ({CD}) c ON t.grid_id = c.grid_id""",
        "current_activity baseline_activity growth_ratio centroid_latitude centroid_longitude",
        "rank, grid_id, feature_timestamp, growth_percentage",
    ),
)
def _(spark, sf):
    rows = features.network_features(v.stored_hourly(spark, sf, v.DENSE))
    as_of = rows.agg(F.max("feature_timestamp")).scalar()
    return ops.surging_grids(rows, v.located_cells(spark, sf, v.DENSE), as_of)


@query(
    "leakage_compare",
    f"""SELECT feature, CAST(0 AS BIGINT) AS mismatches, n AS compared_rows
        FROM (SELECT unnest({FEATURES_24H + FEATURES_EXTRA}) AS feature),
          (WITH h AS ({HD}) SELECT count(*) AS n FROM h WHERE timestamp <= (SELECT max(timestamp) FROM h) - INTERVAL 24 HOUR)""",
)
def _(spark, sf):
    from cellwatch.functions.columns import hours as hour_count

    hours = v.stored_hourly(spark, sf, v.DENSE)
    return features.leakage_compare(hours, rollup.resolve_as_of(hours) - hour_count(24))
