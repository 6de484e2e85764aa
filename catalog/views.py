"""Telemetry derived from the given tables, in Spark and as check SQL.

`events` is the source: hour of `ts`, a cell from `user_id`, a country code
from `props`, and `value` as the measure its event type stands for. Amounts are
decimals before they are summed, so sums are exact in both engines.

Two cell views: dense folds users onto few cells so that 24-hour windows fill,
four for each 10,000 events; sparse gives each user a cell. Both grow with the
data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwatch import runtime
from cellwatch.functions.columns import hour_floor, hour_number
from cellwatch.operators import cleaning, features, guards, rollup, star
from cellwatch.schemas import MEASURES
from cellwatch.sources import reference

DENSE = 4
# A dense view has its number of cells once for so many events, which fill most hours of a month.
EVENTS_PER_VIEW = 10_000
# The measure each event type stands for.
EVENT_MEASURE = {
    "sms_in": "click",
    "sms_out": "view",
    "call_in": "purchase",
    "call_out": "signup",
    "internet_activity": "error",
}
TOTAL_SQL = "sms_in + sms_out + call_in + call_out + internet_activity"


# ---------------------------------------------------------------- telemetry


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def grid_size(spark: SparkSession, sf: str, cells: int) -> int:
    """Cells of a dense view, numbered from 1; the count of rows is read from file footers."""
    return cells * max(1, table(spark, sf, "events").count() // EVENTS_PER_VIEW)


def _events(spark: SparkSession, sf: str, cells: int | None, since: Column | None = None) -> DataFrame:
    events = table(spark, sf, "events")
    if cells:
        cell = F.col("user_id") % grid_size(spark, sf, cells) + 1
    else:
        cell = F.col("user_id") + 1
    if since is not None:
        events = events.where(F.col("ts") >= since)
    return events.select(
        "event_id",
        hour_floor(F.col("ts")).alias("timestamp"),
        cell.cast("int").alias("grid_id"),
        F.get_json_object("props", "$.k").cast("int").alias("country_code"),
        "event_type",
        F.col("value").cast("decimal(18,2)").alias("v"),
    )


def _spread(events: DataFrame) -> DataFrame:
    measures = [
        F.when(F.col("event_type") == kind, F.col("v")).otherwise(F.lit(0).cast("decimal(18,2)")).alias(name)
        for name, kind in EVENT_MEASURE.items()
    ]
    return events.select("event_id", "timestamp", "grid_id", "country_code", *measures)


def telemetry(spark: SparkSession, sf: str, cells: int | None = None) -> DataFrame:
    return _spread(_events(spark, sf, cells)).drop("event_id")


def dirty_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse telemetry with NULL and negative measures and NULL keys."""
    k = F.col("country_code")
    return (
        _spread(
            _events(spark, sf, None).withColumn(
                "v",
                F.when(k % 20 == 7, F.lit(None)).when(k % 50 == 13, -F.col("v")).otherwise(F.col("v")).cast("decimal(18,2)"),
            )
        )
        .withColumn("grid_id", F.when(k % 50 != 31, F.col("grid_id")))
        .withColumn("timestamp", F.when(k % 50 != 41, F.col("timestamp")))
    )


def hourly(spark: SparkSession, sf: str, cells: int | None = None) -> DataFrame:
    return rollup.hourly_grid_summary(telemetry(spark, sf, cells))


def stored_hourly(spark: SparkSession, sf: str, cells: int | None = None) -> DataFrame:
    """Hourly rows written once, for queries that read them more than once."""
    return runtime.materialize(hourly(spark, sf, cells), "hourly")


def latest_hours(spark: SparkSession, sf: str, count: int = 1) -> tuple[DataFrame, Column]:
    """Hourly rows of the last hours alone, and the last hour: earlier events are not rolled up.

    The hour is a literal, so the scan skips row groups before it.
    """
    as_of = guards.require_as_of(table(spark, sf, "events").select(hour_floor(F.col("ts")).alias("timestamp")))
    events = _events(spark, sf, None, as_of - F.make_dt_interval(hours=F.lit(count - 1)))
    return rollup.hourly_grid_summary(_spread(events).drop("event_id")), as_of


def clean_activity(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean(dirty_telemetry(spark, sf))


def _events_sql(cells: int | None) -> str:
    views = f"(SELECT greatest(1, count(*) // {EVENTS_PER_VIEW}) FROM events)"
    cell = f"user_id % ({cells} * {views}) + 1" if cells else "user_id + 1"
    return f"""
      SELECT event_id, date_trunc('hour', ts) AS timestamp, CAST({cell} AS INTEGER) AS grid_id,
             CAST(json_extract_string(props, '$.k') AS INTEGER) AS country_code, event_type,
             CAST(value AS DECIMAL(18,2)) AS v
      FROM events"""


def _spread_sql(source: str) -> str:
    measures = ", ".join(
        f"CASE WHEN event_type = '{kind}' THEN v ELSE CAST(0 AS DECIMAL(18,2)) END AS {name}"
        for name, kind in EVENT_MEASURE.items()
    )
    return f"SELECT event_id, timestamp, grid_id, country_code, {measures} FROM ({source})"


def telemetry_sql(cells: int | None = None) -> str:
    return _spread_sql(_events_sql(cells))


def dirty_sql() -> str:
    dirt = f"""
      SELECT event_id,
             CASE WHEN country_code % 50 <> 41 THEN timestamp END AS timestamp,
             CASE WHEN country_code % 50 <> 31 THEN grid_id END AS grid_id,
             country_code, event_type,
             CASE WHEN country_code % 20 = 7 THEN NULL WHEN country_code % 50 = 13 THEN -v ELSE v END AS v
      FROM ({_events_sql(None)})"""
    return _spread_sql(dirt)


NEGATIVE_SQL = " OR ".join(f"coalesce({m} < 0, FALSE)" for m in MEASURES)
INVALID_SQL = f"(grid_id IS NULL OR timestamp IS NULL OR {NEGATIVE_SQL})"


def hourly_sql(cells: int | None = None, source: str | None = None) -> str:
    sums = ", ".join(f"CAST(sum({m}) AS DOUBLE) AS {m}" for m in MEASURES)
    return f"""
      SELECT *, sms_in + sms_out AS total_sms, call_in + call_out AS total_calls, {TOTAL_SQL} AS total_activity,
             CAST(timestamp AS DATE) AS date, hour(timestamp) AS hour, dayname(timestamp) AS day_of_week,
             CASE WHEN {TOTAL_SQL} = 0 THEN 0.0 ELSE round(internet_activity / ({TOTAL_SQL}), 4) END AS internet_share
      FROM (SELECT timestamp, grid_id, {sums} FROM ({source or telemetry_sql(cells)}) GROUP BY timestamp, grid_id)"""


# ------------------------------------------------------------------ geometry


def _corner(grid_id: Column) -> tuple[Column, Column]:
    at = (grid_id - 1).cast("int")
    return F.lit(9.0) + F.lit(0.003) * F.pmod(at, F.lit(100)), F.lit(45.35) + F.lit(0.002) * F.floor(at / 100)


def _feature(grid_id: Column) -> Column:
    x, y = _corner(grid_id)
    x2, y2 = x + F.lit(0.003), y + F.lit(0.002)
    ring = F.array(F.array(x, y), F.array(x2, y), F.array(x2, y2), F.array(x, y2), F.array(x, y))
    return F.struct(
        F.lit("Feature").alias("type"),
        F.struct(grid_id.alias("cellId")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )


def feature_documents(cells: DataFrame) -> DataFrame:
    """FeatureCollection documents, one per hundred cells."""
    return (
        cells.withColumn("feature", _feature(F.col("grid_id")))
        .groupBy(F.floor((F.col("grid_id") - 1) / 100).alias("band"))
        .agg(F.collect_list("feature").alias("features"))
        .select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value"))
    )


def one_document(cells: DataFrame) -> DataFrame:
    """A FeatureCollection of all cells as one document."""
    body = F.array_join(F.collect_list(F.to_json(_feature(F.col("grid_id")))), ", ")
    return cells.agg(F.concat(F.lit('{"type": "FeatureCollection", "name": "grid", "features": [ '), body, F.lit(" ]}")).alias("value"))


def grid_features(spark: SparkSession, sf: str, cells: int | None = None) -> DataFrame:
    """GeoJSON of the cells seen in the events, written and read back."""
    seen = telemetry(spark, sf, cells).select("grid_id").distinct()
    path = runtime.scratch_path(spark, "geojson")
    feature_documents(seen).write.text(path)
    return reference.read_features(spark, path, multiline=False)


def grid_cells(spark: SparkSession, sf: str, cells: int | None = None) -> DataFrame:
    return reference.grid_reference(grid_features(spark, sf, cells))


def located_cells(spark: SparkSession, sf: str, cells: int | None = None) -> DataFrame:
    """Stored cell dimension with a numeric id."""
    grids = star.dim_grid(grid_cells(spark, sf, cells), "milano-grid.geojson")
    return runtime.materialize(grids.withColumn("grid_id", F.col("grid_id").cast("int")), "cells")


def cells_sql(cells: int | None = None) -> str:
    """Cells with corner and both centroids; the two differ on these rings."""
    return f"""
      SELECT *, (x0 + x1 + x1 + x0 + x0) / 5 AS mean_lon, (y0 + y0 + y1 + y1 + y0) / 5 AS mean_lat,
             (x0 + x1) / 2 AS area_lon, (y0 + y1) / 2 AS area_lat
      FROM (SELECT *, x0 + 0.003::DOUBLE AS x1, y0 + 0.002::DOUBLE AS y1
            FROM (SELECT grid_id, 9.0::DOUBLE + 0.003::DOUBLE * ((grid_id - 1) % 100) AS x0,
                         45.35::DOUBLE + 0.002::DOUBLE * ((grid_id - 1) // 100) AS y0
                  FROM (SELECT DISTINCT grid_id FROM ({telemetry_sql(cells)}))))"""


# -------------------------------------------------------------- model stand-in


def stand_in(ts: str = "timestamp") -> Column:
    """Deterministic score in place of a model's, the same in both engines."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    hour_index = hour_number(F.col(ts)) - hour_number(start)
    mixed = F.col("grid_id").cast("bigint") * 7919 + hour_index.cast("bigint") * 104729
    return F.pmod(mixed, F.lit(1000)) / F.lit(1000.0)


def stand_in_sql(ts: str = "timestamp") -> str:
    hours = f"date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', {ts})"
    return f"(((CAST(grid_id AS BIGINT) * 7919 + {hours} * 104729) % 1000) / 1000.0::DOUBLE)"


def scored_hours(hours: DataFrame) -> DataFrame:
    """Risk scores of hourly rows from the stand-in."""
    from cellwatch.operators.model import risk_level

    return hours.select("grid_id", "timestamp", stand_in().alias("risk_score")).withColumns(
        {"risk_level": risk_level(F.col("risk_score")), "model_version": F.lit("ML3-v1")}
    )


def predicted(hours: DataFrame) -> DataFrame:
    """Predictions of the model dataset's rows from the stand-in."""
    from cellwatch.operators.model import predictions

    rows = features.model_dataset(hours).select("grid_id", F.col("feature_timestamp").alias("timestamp"), "target")
    return predictions(rows.withColumn("risk_probability", stand_in()))


# ---------------------------------------------------------- shared check SQL


def baseline_sql(source: str) -> str:
    """Hourly rows with hour-of-day median."""
    return f"""
      SELECT h.*, hour(h.timestamp) AS hour_of_day, b.baseline_activity FROM ({source}) h JOIN (
        SELECT grid_id, hour(timestamp) AS hod, median(total_activity) AS baseline_activity
        FROM ({source}) GROUP BY 1, 2) b ON h.grid_id = b.grid_id AND hour(h.timestamp) = b.hod"""


def anomaly_sql(source: str) -> str:
    return f"""
      SELECT *, abs(percentage_deviation) AS anomaly_score,
        CASE WHEN percentage_deviation > 0.5 THEN 'high' WHEN percentage_deviation < -0.5 THEN 'low' ELSE 'normal' END AS direction,
        CASE WHEN percentage_deviation > 0.5 THEN
            'ANOMALY_HIGH: Current activity ' || printf('%.2f', total_activity) || ' is ' || printf('%.1f', abs(percentage_deviation) * 100)
            || '% above the historical hour-of-day baseline of ' || printf('%.2f', baseline_activity) || '.'
          WHEN percentage_deviation < -0.5 THEN
            'ANOMALY_LOW: Current activity ' || printf('%.2f', total_activity) || ' is ' || printf('%.1f', abs(percentage_deviation) * 100)
            || '% below the historical hour-of-day baseline of ' || printf('%.2f', baseline_activity) || '.'
          ELSE 'NORMAL: Activity within expected historical bounds.' END AS reason
      FROM (SELECT grid_id, timestamp, total_activity, baseline_activity,
              CASE WHEN baseline_activity > 0 THEN (total_activity - baseline_activity) / baseline_activity ELSE 0.0::DOUBLE END AS percentage_deviation
            FROM ({baseline_sql(source)}))"""


def floor_sql(source: str) -> str:
    return f"""
      SELECT date, quantile_cont(daily_activity, 0.1) AS activity_floor FROM (
        SELECT date, grid_id, round(sum(total_activity), 6) AS daily_activity FROM ({source}) GROUP BY 1, 2) GROUP BY date"""


def loo_sql(source: str) -> str:
    """Hourly rows with the median of the cell's other hours of the day."""
    return f"""
      SELECT a.*, (SELECT median(b.total_activity) FROM ({source}) b
                   WHERE b.grid_id = a.grid_id AND b.date = a.date AND b.timestamp <> a.timestamp) AS baseline_activity
      FROM ({source}) a"""


def alerts_sql(source: str) -> str:
    return f"""
      WITH hh AS MATERIALIZED ({source}),
      ready AS MATERIALIZED (
        SELECT l.*, lag(total_activity) OVER (PARTITION BY grid_id ORDER BY timestamp) AS previous_activity,
               round(sum(total_activity) OVER (PARTITION BY grid_id, date), 6) AS daily_activity
        FROM ({loo_sql('SELECT * FROM hh')}) l),
      ok AS MATERIALIZED (SELECT r.* FROM ready r JOIN ({floor_sql('SELECT * FROM hh')}) f ON r.date = f.date WHERE daily_activity >= activity_floor)
      SELECT grid_id, timestamp, 'HIGH_ACTIVITY' AS alert_type, total_activity AS current_activity, baseline_activity,
        'HIGH_ACTIVITY: current activity ' || printf('%.2f', total_activity) || ' is above 1.5x baseline activity ' || printf('%.2f', baseline_activity) AS reason
      FROM ok WHERE total_activity > baseline_activity * 1.5::DOUBLE
      UNION ALL
      SELECT grid_id, timestamp, 'ACTIVITY_DROP', total_activity, baseline_activity,
        'ACTIVITY_DROP: current activity ' || printf('%.2f', total_activity) || ' is below 0.5x baseline activity ' || printf('%.2f', baseline_activity)
      FROM ok WHERE total_activity < baseline_activity * 0.5::DOUBLE
      UNION ALL
      SELECT grid_id, timestamp, 'ACTIVITY_SPIKE', total_activity, baseline_activity,
        'ACTIVITY_SPIKE: current activity ' || printf('%.2f', total_activity) || ' is more than 2.0x the previous-hour activity ' || printf('%.2f', previous_activity)
        || '; baseline activity is ' || coalesce(printf('%.2f', baseline_activity), 'nan')
      FROM ok WHERE previous_activity > 0 AND total_activity > previous_activity * 2.0::DOUBLE"""


DAY_FRAME = "PARTITION BY grid_id ORDER BY timestamp RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW"


def windows_sql(source: str) -> str:
    """Every hourly row with all features, extras, label and next hour."""
    return f"""
      SELECT *, CASE WHEN n24 = 24 THEN a24 END AS avg_activity,
        CASE WHEN n24 = 24 AND a24 > 0 THEN m24 / a24 ELSE 0.0 END AS peak_ratio,
        CASE WHEN date_diff('hour', first_ts, timestamp) >= 23 THEN act24 END AS active_hours,
        CASE WHEN n24 = 24 THEN s24 END AS variability,
        CASE WHEN n24 = 24 AND t24 > 0 THEN i24 / t24 ELSE 0.0 END AS internet_share_24h,
        CASE WHEN np = 24 AND ap > 0 THEN CASE WHEN n6 = 6 THEN (a6 - ap) / ap END ELSE 0.0 END AS activity_growth,
        CASE WHEN nr = 6 THEN ar END AS recent_6h_mean,
        CASE WHEN nr = 6 THEN sr END AS recent_6h_std,
        CASE WHEN nr = 6 AND ar > 0 THEN mr / ar ELSE 0.0 END AS recent_6h_peak_ratio,
        sin(2 * pi() * hour(timestamp) / 24) AS hour_sin, cos(2 * pi() * hour(timestamp) / 24) AS hour_cos,
        sin(2 * pi() * (isodow(timestamp) - 1) / 7) AS day_sin, cos(2 * pi() * (isodow(timestamp) - 1) / 7) AS day_cos,
        CASE WHEN nm = 24 THEN med END AS trailing_median,
        CASE WHEN next_ts = timestamp + INTERVAL 1 HOUR AND nm = 24 AND next_total > 1.5::DOUBLE * med THEN 1 ELSE 0 END AS target
      FROM (
        SELECT grid_id, timestamp, date, hour, total_activity, internet_activity,
          count(*) OVER d AS n24, avg(total_activity) OVER d AS a24, max(total_activity) OVER d AS m24, stddev_pop(total_activity) OVER d AS s24,
          sum(internet_activity) OVER d AS i24, sum(total_activity) OVER d AS t24,
          sum(CASE WHEN total_activity > 0 THEN 1 ELSE 0 END) OVER d AS act24,
          count(*) OVER p AS np, avg(total_activity) OVER p AS ap, count(*) OVER s AS n6, avg(total_activity) OVER s AS a6,
          count(*) OVER r AS nr, avg(total_activity) OVER r AS ar, stddev_pop(total_activity) OVER r AS sr, max(total_activity) OVER r AS mr,
          count(*) OVER m AS nm, quantile_cont(total_activity, 0.5) OVER m AS med,
          min(timestamp) OVER (PARTITION BY grid_id) AS first_ts, max(timestamp) OVER (PARTITION BY grid_id) AS last_ts,
          lead(timestamp) OVER o AS next_ts, lead(total_activity) OVER o AS next_total
        FROM ({source})
        WINDOW d AS ({DAY_FRAME}),
          p AS (PARTITION BY grid_id ORDER BY timestamp RANGE BETWEEN INTERVAL 29 HOUR PRECEDING AND INTERVAL 6 HOUR PRECEDING),
          s AS (PARTITION BY grid_id ORDER BY timestamp RANGE BETWEEN INTERVAL 5 HOUR PRECEDING AND CURRENT ROW),
          r AS (PARTITION BY grid_id ORDER BY timestamp ROWS BETWEEN 5 PRECEDING AND CURRENT ROW),
          m AS (PARTITION BY grid_id ORDER BY timestamp ROWS BETWEEN 23 PRECEDING AND CURRENT ROW),
          o AS (PARTITION BY grid_id ORDER BY timestamp))"""


def features_sql(source: str) -> str:
    return f"""
      SELECT grid_id, timestamp AS feature_timestamp, avg_activity, activity_growth, active_hours, peak_ratio, variability,
             internet_share_24h AS internet_share, target, recent_6h_mean, recent_6h_std, recent_6h_peak_ratio,
             hour_sin, hour_cos, day_sin, day_cos, trailing_median
      FROM ({windows_sql(source)})
      WHERE timestamp < last_ts AND avg_activity IS NOT NULL AND activity_growth IS NOT NULL AND active_hours IS NOT NULL
        AND variability IS NOT NULL"""


def predicted_sql(source: str) -> str:
    return f"""
      SELECT grid_id, feature_timestamp AS timestamp, target, score AS risk_probability, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction
      FROM (SELECT *, {stand_in_sql('feature_timestamp')} AS score FROM ({features_sql(source)}))"""


def level_sql(score: str) -> str:
    return f"CASE WHEN {score} >= 0.8 THEN 'HIGH' WHEN {score} >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END"
