"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from catalog.core import query, rounded
from catalog.joins import FILE, star_tables
from cellwatch import runtime
from cellwatch.operators import alerts, features, geo, quality, star, topology
from cellwatch.sources import activity, sinks

H = v.hourly_sql()
HD = v.hourly_sql(v.DENSE)
C = v.cells_sql()
RAW = v.telemetry_sql()


@query(
    "dq_grain",
    f"""SELECT count(*) AS row_count, count(*) AS distinct_keys, CAST(0 AS BIGINT) AS duplicate_groups, (SELECT count(*) FROM ({RAW})) AS source_rows,
          TRUE AS unique_grain, TRUE AS reduced FROM (SELECT DISTINCT grid_id, timestamp FROM ({RAW}))""",
)
def _(spark, sf):
    return quality.dq_grain(v.hourly(spark, sf), v.telemetry(spark, sf))


@query(
    "grain_violations",
    f"SELECT grid_id, timestamp, count(*) AS rows FROM ({RAW}) GROUP BY 1, 2 HAVING count(*) > 1",
)
def _(spark, sf):
    return quality.grain_violations(v.telemetry(spark, sf))


@query(
    "dq_grid_reference",
    f"""SELECT count(*) AS feature_count, count(DISTINCT grid_id) AS distinct_grids, CAST(0 AS BIGINT) AS duplicate_grids,
          CAST(0 AS BIGINT) AS null_geometries, count(*) FILTER (WHERE grid_id NOT BETWEEN 1 AND 10000) AS out_of_range_grids FROM ({C})""",
)
def _(spark, sf):
    return quality.dq_grid_reference(v.grid_cells(spark, sf))


@query(
    "dq_geometry",
    rounded(
        f"""SELECT count(*) AS polygons, CAST(0 AS BIGINT) AS multipolygons, min(x0) AS min_longitude, max(x1) AS max_longitude,
              min(y0) AS min_latitude, max(y1) AS max_latitude,
              count(*) FILTER (WHERE x0 < -180 OR x1 > 180 OR y0 < -90 OR y1 > 90) AS out_of_bounds,
              CAST(0 AS BIGINT) AS open_rings, CAST(0 AS BIGINT) AS empty_areas FROM ({C})""",
        "min_longitude max_longitude min_latitude max_latitude",
        "polygons, multipolygons, out_of_bounds, open_rings, empty_areas",
    ),
)
def _(spark, sf):
    return quality.dq_geometry(v.grid_cells(spark, sf))


_SHAPE_FAULTS = {1: "SELF_INTERSECTION", 3: "RINGS_CROSS", 4: "HOLE_OUTSIDE_SHELL", 5: "NESTED_HOLES", 6: "OVERLAPPING_PARTS", 7: "OPEN_RING", 8: "DISCONNECTED_INTERIOR"}


def _shaped(cells):
    """Cells with one of nine shapes each: a square, a bow-tie, holes that touch, cross, lie outside or nest, parts that overlap, an open ring."""
    x, y = v._corner(F.col("grid_id"))
    x2, y2 = x + F.lit(0.003), y + F.lit(0.002)

    def ring(*points):
        """Points as shares of the cell's width and height."""
        return F.array(*[F.array(x if a == 0 else x2 if a == 1 else x + F.lit(0.003 * a), y if b == 0 else y2 if b == 1 else y + F.lit(0.002 * b)) for a, b in points])

    square = ring((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))
    shapes = [
        F.array(F.array(square)),
        F.array(F.array(ring((0, 0), (1, 1), (1, 0), (0, 1), (0, 0)))),
        F.array(F.array(square, ring((0, 0.5), (0.5, 0.4), (0.5, 0.6), (0, 0.5)))),
        F.array(F.array(square, ring((0.5, 0.4), (1.5, 0.4), (1.5, 0.6), (0.5, 0.6), (0.5, 0.4)))),
        F.array(F.array(square, ring((2, 0.4), (3, 0.4), (3, 0.6), (2, 0.4)))),
        F.array(F.array(square, ring((0.2, 0.2), (0.8, 0.2), (0.8, 0.8), (0.2, 0.8), (0.2, 0.2)), ring((0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.4)))),
        F.array(F.array(square), F.array(ring((0.25, 0.25), (0.5, 0.25), (0.5, 0.5), (0.25, 0.25)))),
        F.array(F.array(ring((0, 0), (1, 0), (1, 1), (0, 1)))),
        F.array(F.array(square, ring((0, 0.5), (0.5, 0.4), (1, 0.5), (0.5, 0.6), (0, 0.5)))),
    ]
    kind = F.col("grid_id") % len(shapes)
    shape = shapes[0]
    for i, other in enumerate(shapes[1:], 1):
        shape = F.when(kind == i, other).otherwise(shape)
    return cells.withColumn("geometry", shape)


@query(
    "dq_geometry_faults",
    f"""SELECT fault, count(*) AS cells FROM (SELECT CASE grid_id % 9 {" ".join(f"WHEN {k} THEN '{f}'" for k, f in _SHAPE_FAULTS.items())} END AS fault FROM ({C}))
        WHERE fault IS NOT NULL GROUP BY fault""",
)
def _(spark, sf):
    """Shapes with known faults, two kinds of valid ones among them."""
    faults = quality.geometry_faults(_shaped(v.grid_cells(spark, sf)))
    return faults.groupBy("fault").agg(F.count("*").alias("cells"))


# A grid that lacks some cells and has others moved by a part of their size.
_BROKEN = f"SELECT grid_id, grid_id % 89 = 0 AS moved FROM ({C}) WHERE grid_id % 97 <> 0"
_BROKEN_PAIRS = f"""
  SELECT a.grid_id, b.grid_id AS neighbour_id, CASE WHEN b.grid_id - a.grid_id IN (1, 100) THEN 'edge' ELSE 'corner' END AS contact
  FROM ({_BROKEN}) a JOIN ({_BROKEN}) b ON a.moved = b.moved AND (b.grid_id = a.grid_id + 100 OR (b.grid_id - a.grid_id IN (1, 101) AND a.grid_id % 100 <> 0)
    OR (b.grid_id = a.grid_id + 99 AND a.grid_id % 100 <> 1))"""


def _broken_grid(spark, sf):
    far = F.when(F.col("grid_id") % 89 == 0, 0.0005).otherwise(0.0)
    moved = F.transform("geometry", lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, lambda p: F.array(p[0] + far, p[1] + far))))
    return v.grid_cells(spark, sf).where(F.col("grid_id") % 97 != 0).withColumn("geometry", moved)


@query("topological_neighbours", f"WITH p AS ({_BROKEN_PAIRS}) SELECT * FROM p UNION ALL SELECT neighbour_id, grid_id, contact FROM p")
def _(spark, sf):
    return topology.topological_neighbours(_broken_grid(spark, sf))


@query(
    "second_order_neighbours",
    f"""WITH p AS (SELECT grid_id, neighbour_id FROM ({_BROKEN_PAIRS}) WHERE contact = 'edge'), e AS MATERIALIZED (SELECT * FROM p UNION ALL SELECT neighbour_id, grid_id FROM p)
        SELECT DISTINCT a.grid_id, b.neighbour_id FROM e a JOIN e b ON a.neighbour_id = b.grid_id
        WHERE a.grid_id <> b.neighbour_id AND NOT EXISTS (SELECT 1 FROM e WHERE e.grid_id = a.grid_id AND e.neighbour_id = b.neighbour_id)""",
)
def _(spark, sf):
    return topology.order_two(topology.topological_neighbours(_broken_grid(spark, sf)))


@query(
    "dq_shared_edges",
    f"""WITH c AS MATERIALIZED ({_BROKEN}), p AS MATERIALIZED ({_BROKEN_PAIRS}),
          promised AS (SELECT a.grid_id, b.grid_id AS neighbour_id FROM c a JOIN c b ON b.grid_id = a.grid_id + 100 OR (b.grid_id = a.grid_id + 1 AND a.grid_id % 100 <> 0))
        SELECT (SELECT count(*) FROM promised) AS promised_pairs,
          (SELECT count(*) FROM promised q WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.grid_id = q.grid_id AND p.neighbour_id = q.neighbour_id AND contact = 'edge')) AS gaps,
          (SELECT count(*) FROM p WHERE contact = 'edge') AS edge_pairs, (SELECT count(*) FROM p WHERE contact = 'corner') AS corner_pairs,
          (SELECT count(*) FROM c WHERE grid_id NOT IN (SELECT grid_id FROM p UNION ALL SELECT neighbour_id FROM p)) AS isolated_cells""",
)
def _(spark, sf):
    return quality.dq_shared_edges(runtime.materialize(_broken_grid(spark, sf), "cells"))


@query(
    "dq_adjacency",
    rounded(
        f"""SELECT count(*) AS pairs, count(*) FILTER (WHERE gap = 0) AS coincident, count(*) FILTER (WHERE gap >= 0.01) AS too_far, max(gap) AS largest_gap
            FROM (SELECT sqrt(pow(b.area_lon - a.area_lon, 2) + pow(b.area_lat - a.area_lat, 2)) AS gap
                  FROM ({C}) a JOIN ({C}) b ON b.grid_id = a.grid_id + 1 WHERE a.grid_id % 100 <> 0)""",
        "largest_gap",
        "pairs, coincident, too_far",
    ),
)
def _(spark, sf):
    return quality.dq_adjacency(geo.area_centroids(v.grid_cells(spark, sf)))


@query(
    "dq_enrichment",
    rounded(
        f"""WITH h AS ({H}), c AS ({v.cells_sql(64)}) SELECT count(*) AS rows_before, count(*) AS rows_after, count(DISTINCT grid_id) AS grids_before,
              count(DISTINCT grid_id) AS grids_after, count(*) FILTER (WHERE grid_id IN (SELECT grid_id FROM c)) AS located_rows,
              round(100.0::DOUBLE * count(*) FILTER (WHERE grid_id IN (SELECT grid_id FROM c)) / count(*), 4) AS coverage_pct,
              TRUE AS rows_preserved, TRUE AS grids_preserved FROM h""",
        "coverage_pct",
        "rows_before, rows_after, grids_before, grids_after, located_rows, rows_preserved, grids_preserved",
    ),
)
def _(spark, sf):
    hours = v.stored_hourly(spark, sf)
    return quality.dq_enrichment(hours, geo.enrich_geo(hours, geo.area_centroids(v.grid_cells(spark, sf, 64))))


@query(
    "dq_round_trip",
    f"""SELECT count(*) AS rows_written, count(*) AS rows_read, TRUE AS schema_matches, TRUE AS content_matches,
          CAST(0 AS BIGINT) AS duplicate_groups, TRUE AS geometry_free FROM ({H})""",
)
def _(spark, sf):
    hours = v.stored_hourly(spark, sf)
    path = runtime.scratch_path(spark, "round-trip")
    sinks.write_table(hours, path)
    return quality.dq_round_trip(hours, activity.scan_parquet(spark, path))


@query(
    "dq_partitions",
    f"""SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, count(*) AS rows FROM ({v.dirty_sql()}) WHERE NOT {v.INVALID_SQL} GROUP BY 1""",
)
def _(spark, sf):
    path = runtime.scratch_path(spark, "partitions")
    sinks.write_activity_partitioned(v.clean_activity(spark, sf), path)
    return quality.dq_partitions(activity.scan_parquet(spark, path))


@query(
    "dq_alerts",
    f"""SELECT count(*) AS alerts, CAST(0 AS BIGINT) AS without_reason, count(*) FILTER (WHERE baseline_activity IS NULL) AS missing_values,
          count(*) FILTER (WHERE grid_id NOT BETWEEN 1 AND 4) AS unknown_grids FROM ({v.alerts_sql(HD)})""",
)
def _(spark, sf):
    hours = v.stored_hourly(spark, sf, v.DENSE)
    return quality.dq_alerts(alerts.network_alerts(hours), hours)


@query(
    "dq_source",
    f"""SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS rows_with_nulls, CAST(0 AS BIGINT) AS duplicate_rows,
          count(*) FILTER (WHERE total_activity < 0) AS negative_total, count(*) FILTER (WHERE internet_activity < 0) AS negative_internet FROM ({H})""",
)
def _(spark, sf):
    return quality.dq_source(v.hourly(spark, sf))


@query(
    "dq_features",
    f"""SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS non_finite_rows, CAST(0 AS BIGINT) AS duplicate_rows,
          count(*) FILTER (WHERE active_hours NOT BETWEEN 0 AND 24) AS active_hours_out_of_range,
          count(*) FILTER (WHERE internet_share NOT BETWEEN 0 AND 1) AS internet_share_out_of_range FROM ({v.features_sql(HD)})""",
)
def _(spark, sf):
    return quality.dq_features(features.network_features(v.hourly(spark, sf, v.DENSE)))


@query(
    "dq_risk_scores",
    rounded(
        f"""SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS duplicate_rows, CAST(0 AS BIGINT) AS rows_with_nulls, CAST(0 AS BIGINT) AS score_out_of_range,
              CAST(0 AS BIGINT) AS unknown_levels, TRUE AS single_version, min({v.stand_in_sql()}) AS min_score, max({v.stand_in_sql()}) AS max_score,
              count(*) AS expected_rows FROM ({H})""",
        "min_score max_score",
        "row_count, duplicate_rows, rows_with_nulls, score_out_of_range, unknown_levels, single_version, expected_rows",
    ),
)
def _(spark, sf):
    hours = v.stored_hourly(spark, sf)
    return quality.dq_risk_scores(v.scored_hours(hours), hours.agg(F.count("*")).scalar())


@query(
    "dq_foreign_keys",
    f"""SELECT count(*) AS fact_rows, count(*) AS source_rows, CAST(0 AS BIGINT) AS orphan_time_keys, CAST(0 AS BIGINT) AS orphan_grid_keys,
          CAST(0 AS BIGINT) AS duplicate_timestamps, CAST(0 AS BIGINT) AS duplicate_grids FROM ({H})""",
)
def _(spark, sf):
    hours, times, grids = star_tables(spark, sf)
    return quality.dq_foreign_keys(star.fact_network_activity(hours, times, grids), times, grids, hours)


@query(
    "dq_publish",
    f"""SELECT count(*) AS rows_published, CAST(0 AS BIGINT) AS duplicate_facts, max(timestamp) AS as_of,
          (SELECT count(*) FROM ({v.features_sql(HD)})) AS feature_rows, count(*) AS risk_rows,
          (SELECT count(*) FROM ({v.features_sql(HD)})) > 0 AS publishable FROM ({HD})""",
)
def _(spark, sf):
    hours = v.stored_hourly(spark, sf, v.DENSE)
    times, grids = star.dim_time(hours), star.dim_grid(v.grid_cells(spark, sf, v.DENSE), FILE)
    fact = star.fact_network_activity(hours, times, grids)
    return quality.dq_publish(fact, times, features.network_features(hours), v.scored_hours(hours))


# ------------------------------------------------- checks over input with faults


DIRTY_HOURS = f"""
  SELECT CASE WHEN hr = 7 AND grid_id % 5 = 1 THEN NULL ELSE grid_id END AS grid_id, timestamp,
    CASE WHEN hr = 5 AND grid_id % 10 = 4 THEN -1.0 - total_activity ELSE total_activity END AS total_activity,
    CASE WHEN hr = 6 AND grid_id % 3 = 0 THEN NULL WHEN hr = 8 AND grid_id % 5 = 0 THEN -1.0 - internet_activity ELSE internet_activity END AS internet_activity
  FROM (SELECT *, hour(timestamp) AS hr FROM ({H}) UNION ALL SELECT *, hour(timestamp) AS hr FROM ({H}) WHERE grid_id % 10 = 3)"""


def _dirty_hours(spark, sf):
    """Hourly rows with repeated keys, NULL keys and values, and negative sums."""
    hours = v.stored_hourly(spark, sf)
    hours = hours.unionByName(hours.where("grid_id % 10 = 3"))
    hour, cell = F.hour("timestamp"), F.col("grid_id")
    total, internet = F.col("total_activity"), F.col("internet_activity")
    return hours.select(
        F.when((hour == 7) & (cell % 5 == 1), F.lit(None)).otherwise(cell).alias("grid_id"),
        "timestamp",
        F.when((hour == 5) & (cell % 10 == 4), -1 - total).otherwise(total).alias("total_activity"),
        F.when((hour == 6) & (cell % 3 == 0), F.lit(None)).when((hour == 8) & (cell % 5 == 0), -1 - internet).otherwise(internet).alias("internet_activity"),
    )


@query(
    "dq_grain_faults",
    f"""SELECT CAST(sum(n) AS BIGINT) AS row_count, count(*) AS distinct_keys, count(*) FILTER (WHERE n > 1) AS duplicate_groups,
          (SELECT count(*) FROM ({RAW})) AS source_rows, count(*) FILTER (WHERE n > 1) = 0 AS unique_grain, sum(n) <= (SELECT count(*) FROM ({RAW})) AS reduced
        FROM (SELECT grid_id, timestamp, count(*) AS n FROM ({DIRTY_HOURS}) GROUP BY 1, 2)""",
)
def _(spark, sf):
    return quality.dq_grain(_dirty_hours(spark, sf), v.telemetry(spark, sf))


@query(
    "dq_source_faults",
    f"""SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(nulls) AS BIGINT) AS rows_with_nulls, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
          CAST(sum(neg_total) AS BIGINT) AS negative_total, CAST(sum(neg_internet) AS BIGINT) AS negative_internet
        FROM (SELECT grid_id, timestamp, count(*) AS n, count(*) FILTER (WHERE grid_id IS NULL OR total_activity IS NULL OR internet_activity IS NULL) AS nulls,
                count(*) FILTER (WHERE total_activity < 0) AS neg_total, count(*) FILTER (WHERE internet_activity < 0) AS neg_internet
              FROM ({DIRTY_HOURS}) GROUP BY 1, 2)""",
)
def _(spark, sf):
    return quality.dq_source(_dirty_hours(spark, sf))


@query(
    "dq_grid_reference_faults",
    f"""SELECT CAST(sum(n) AS BIGINT) AS feature_count, count(grid_id) AS distinct_grids, count(*) FILTER (WHERE n > 1) AS duplicate_grids,
          CAST(sum(bare) AS BIGINT) AS null_geometries, count(*) FILTER (WHERE grid_id NOT BETWEEN 1 AND 10000) AS out_of_range_grids
        FROM (SELECT grid_id, count(*) AS n, count(*) FILTER (WHERE base % 11 = 3) AS bare
              FROM (SELECT CASE WHEN g % 13 = 5 THEN g + 10000 ELSE g END AS grid_id, g AS base
                    FROM (SELECT grid_id AS g FROM ({C}) UNION ALL SELECT grid_id FROM ({C}) WHERE grid_id % 9 = 2)) GROUP BY grid_id)""",
)
def _(spark, sf):
    cells = v.grid_cells(spark, sf)
    cells = cells.unionByName(cells.where("grid_id % 9 = 2"))
    cells = cells.withColumn("geometry", F.when(F.col("grid_id") % 11 != 3, F.col("geometry")))
    return quality.dq_grid_reference(cells.withColumn("grid_id", F.when(F.col("grid_id") % 13 == 5, F.col("grid_id") + 10000).otherwise(F.col("grid_id"))))


@query(
    "dq_features_faults",
    f"""SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(bad) AS BIGINT) AS non_finite_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
          CAST(sum(hours) AS BIGINT) AS active_hours_out_of_range, CAST(sum(shares) AS BIGINT) AS internet_share_out_of_range
        FROM (SELECT grid_id, feature_timestamp, count(*) AS n, count(*) FILTER (WHERE hour(feature_timestamp) = 3) AS bad,
                count(*) FILTER (WHERE hour(feature_timestamp) = 4) AS hours, count(*) FILTER (WHERE hour(feature_timestamp) = 5) AS shares
              FROM (SELECT grid_id, feature_timestamp FROM ({v.features_sql(HD)}) UNION ALL
                    SELECT grid_id, feature_timestamp FROM ({v.features_sql(HD)}) WHERE hour(feature_timestamp) % 2 = 1) GROUP BY 1, 2)""",
)
def _(spark, sf):
    rows = features.network_features(v.stored_hourly(spark, sf, v.DENSE))
    hour = F.hour("feature_timestamp")
    rows = rows.unionByName(rows.where(hour % 2 == 1))
    return quality.dq_features(
        rows.withColumns(
            {
                "variability": F.when(hour == 3, F.lit(float("inf"))).otherwise(F.col("variability")),
                "active_hours": F.when(hour == 4, F.lit(30)).otherwise(F.col("active_hours")),
                "internet_share": F.when(hour == 5, F.lit(2.0)).otherwise(F.col("internet_share")),
            }
        )
    )


# Scores with faults by the hour's number and the cell: repeated rows, a value out of range, an unknown level, a second version, a missing value.
_SCORED = f"SELECT grid_id, timestamp, {v.stand_in_sql()} AS score, hour(timestamp) AS h FROM ({H})"


@query(
    "dq_risk_scores_faults",
    f"""WITH s AS ({_SCORED})
        SELECT count(*) + count(*) FILTER (WHERE h = 1) AS row_count, count(*) FILTER (WHERE h = 1) AS duplicate_rows,
          count(*) FILTER (WHERE h = 2) AS rows_with_nulls, count(*) FILTER (WHERE h = 3) AS score_out_of_range,
          count(*) FILTER (WHERE h = 4) AS unknown_levels, FALSE AS single_version, FALSE AS complete FROM s""",
)
def _(spark, sf):
    h = F.hour("timestamp")
    good = v.scored_hours(v.hourly(spark, sf))
    bad = good.withColumns(
        {
            "risk_score": F.when(h == 3, F.col("risk_score") + 1.5).when(h != 2, F.col("risk_score")),
            "risk_level": F.when(h == 4, "SEVERE").otherwise(F.col("risk_level")),
            "model_version": F.when(h == 5, "ML3-v2").otherwise(F.col("model_version")),
        }
    )
    checks = quality.dq_risk_scores(bad.unionByName(bad.where(h == 1)), good.agg(F.count("*")).scalar())
    return checks.select("row_count", "duplicate_rows", "rows_with_nulls", "score_out_of_range", "unknown_levels", "single_version", (F.col("row_count") == F.col("expected_rows")).alias("complete"))


_KEYS = f"(SELECT count(*) FROM ({H}) WHERE"


@query(
    "dq_foreign_keys_faults",
    f"""SELECT (SELECT count(*) FROM ({H})) AS fact_rows, {_KEYS} TRUE) AS source_rows, {_KEYS} hour(timestamp) = 7) AS orphan_time_keys,
          {_KEYS} grid_id % 10 = 3) AS orphan_grid_keys, (SELECT count(DISTINCT timestamp) FROM ({H}) WHERE hour(timestamp) = 8) AS duplicate_timestamps,
          (SELECT count(DISTINCT grid_id) FROM ({H}) WHERE grid_id % 10 = 4) AS duplicate_grids""",
)
def _(spark, sf):
    """A fact whose dimensions lack the hours at seven and the cells that end in three, and repeat those at eight and in four."""
    hours, times, grids = star_tables(spark, sf)
    fact = star.fact_network_activity(hours, times, grids)
    cell = F.col("grid_id").cast("int") % 10
    times = times.where(F.hour("timestamp") != 7).unionByName(times.where(F.hour("timestamp") == 8))
    grids = grids.where(cell != 3).unionByName(grids.where(cell == 4))
    return quality.dq_foreign_keys(fact, times, grids, hours)


@query(
    "dq_publish_faults",
    f"""WITH h AS ({H}), k AS (SELECT unnest(['whole', 'repeated facts', 'no features', 'no scores', 'no facts']) AS case_name)
        SELECT case_name, CASE case_name WHEN 'no facts' THEN 0 WHEN 'repeated facts' THEN (SELECT count(*) + count(*) FILTER (WHERE hour(timestamp) = 1) FROM h) ELSE (SELECT count(*) FROM h) END AS rows_published,
          CASE case_name WHEN 'repeated facts' THEN (SELECT count(*) FROM h WHERE hour(timestamp) = 1) ELSE 0 END AS duplicate_facts,
          case_name = 'whole' AS publishable FROM k""",
)
def _(spark, sf):
    """The publication gate over whole tables, and over tables with one fault each."""
    hours, times, grids = star_tables(spark, sf)
    fact = star.fact_network_activity(hours, times, grids)
    fact = runtime.materialize(fact, "fact")
    first = times.where(F.hour("timestamp") == 1).select("time_key")
    twice = fact.unionByName(fact.join(first, "time_key", "left_semi").select(fact.columns))
    rows, none = hours.select("grid_id", "timestamp"), hours.select("grid_id", "timestamp").limit(0)
    cases = {
        "whole": (fact, rows, rows),
        "repeated facts": (twice, rows, rows),
        "no features": (fact, none, rows),
        "no scores": (fact, rows, none),
        "no facts": (fact.limit(0), rows, rows),
    }
    found = None
    for name, (facts, made, scores) in cases.items():
        gate = quality.dq_publish(facts, times, made, scores).select(F.lit(name).alias("case_name"), "rows_published", "duplicate_facts", "publishable")
        found = gate if found is None else found.unionByName(gate)
    return found
