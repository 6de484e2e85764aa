"""Projection, filter, cleaning, set and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from catalog.core import query, rounded
from cellwatch.functions import columns as fn
from cellwatch.operators import cleaning, geo, rollup
from cellwatch.schemas import MEASURES

D = v.dirty_sql()
H = v.hourly_sql()
M = " ".join(MEASURES)
KEYS = "timestamp, grid_id, country_code"
FILLED = ", ".join(f"coalesce({m}, 0) AS {m}" for m in MEASURES)
CLEAN = f"""SELECT *, sms_in + sms_out AS total_sms, call_in + call_out AS total_calls, {v.TOTAL_SQL} AS total_activity
    FROM (SELECT timestamp, grid_id, country_code, {FILLED} FROM ({D}) WHERE NOT {v.INVALID_SQL})"""
REASON = "CASE WHEN grid_id IS NULL OR timestamp IS NULL THEN 'NULL_KEY' ELSE 'NEGATIVE_MEASURE' END AS reject_reason"


def _dirty(spark, sf):
    return v.dirty_telemetry(spark, sf).drop("event_id")


def _as_double(df):
    """Exact decimals shown as doubles."""
    return df.withColumns({n: F.col(n).cast("double") for n, t in df.dtypes if t.startswith("decimal")})


def _as_text(df):
    """Raw text as a landing file holds it, with cells that do not parse."""
    text = df.select([F.col(c).cast("string").alias(c) for c in df.columns])
    k = F.col("country_code").cast("int")
    return text.withColumns(
        {
            "grid_id": F.when(k == 2, F.concat("grid_id", F.lit("x"))).otherwise(F.col("grid_id")),
            "timestamp": F.when(k == 3, "not a time").otherwise(F.col("timestamp")),
            "sms_in": F.when(k == 4, "n/a").otherwise(F.col("sms_in")),
        }
    )


@query(
    "standardize_types",
    rounded(
        f"""SELECT CASE WHEN country_code = 3 THEN NULL ELSE timestamp END AS timestamp,
              CASE WHEN country_code = 2 THEN NULL ELSE grid_id END AS grid_id, country_code,
              CASE WHEN country_code = 4 THEN NULL ELSE sms_in END AS sms_in, {', '.join(MEASURES[1:])} FROM ({D})""",
        M,
        KEYS,
    ),
)
def _(spark, sf):
    return cleaning.standardize_types(_as_text(_dirty(spark, sf)))


@query("clean_valid", rounded(f"SELECT * FROM ({D}) WHERE NOT {v.INVALID_SQL}", M, KEYS))
def _(spark, sf):
    return _as_double(cleaning.clean_valid(_dirty(spark, sf)))


@query("clean_rejected", rounded(f"SELECT *, {REASON} FROM ({D}) WHERE {v.INVALID_SQL}", M, f"{KEYS}, reject_reason"))
def _(spark, sf):
    return _as_double(cleaning.clean_rejected(_dirty(spark, sf)))


@query(
    "reject_union",
    rounded(
        f"""SELECT *, 'NULL_KEY' AS reject_reason FROM ({D}) WHERE grid_id IS NULL OR timestamp IS NULL
            UNION ALL SELECT *, 'NEGATIVE_MEASURE' FROM ({D})
            WHERE NOT (grid_id IS NULL OR timestamp IS NULL) AND ({v.NEGATIVE_SQL})""",
        M,
        f"{KEYS}, reject_reason",
    ),
)
def _(spark, sf):
    return _as_double(cleaning.reject_union(_dirty(spark, sf)))


@query("fill_measures", rounded(f"SELECT {KEYS}, {FILLED} FROM ({D}) WHERE NOT {v.INVALID_SQL}", M, KEYS))
def _(spark, sf):
    return _as_double(cleaning.fill_measures(cleaning.clean_valid(_dirty(spark, sf))))


@query("derive_measures", rounded(CLEAN, M + " total_sms total_calls total_activity", KEYS))
def _(spark, sf):
    return _as_double(cleaning.derive_measures(cleaning.fill_measures(cleaning.clean_valid(_dirty(spark, sf)))))


@query(
    "derive_calendar",
    f"""SELECT timestamp, grid_id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, hour(timestamp) AS hour,
          dayname(timestamp) AS day_of_week, dayofweek(timestamp) + 1 AS day_number, isodow(timestamp) - 1 AS weekday_number
        FROM ({v.telemetry_sql()})""",
)
def _(spark, sf):
    return cleaning.derive_calendar(v.telemetry(spark, sf).select("timestamp", "grid_id"))


@query(
    "internet_share_rounded",
    rounded(f"SELECT timestamp, grid_id, total_activity, internet_share FROM ({H})", "total_activity internet_share", "timestamp, grid_id"),
)
def _(spark, sf):
    hours = v.hourly(spark, sf).drop("internet_share")
    return rollup.internet_share_rounded(hours).select("timestamp", "grid_id", "total_activity", "internet_share")


@query(
    "internet_share_exact",
    rounded(
        f"""SELECT timestamp, grid_id, total_activity,
              CASE WHEN total_activity > 0 THEN internet_activity / total_activity ELSE 0.0 END AS internet_share FROM ({H})""",
        "total_activity internet_share",
        "timestamp, grid_id",
    ),
)
def _(spark, sf):
    return rollup.internet_share_exact(v.hourly(spark, sf)).select("timestamp", "grid_id", "total_activity", "internet_share")


def _null_counts_sql(where: str) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE {m} IS NULL) AS {m}" for m in MEASURES)
    return f"SELECT *, {' + '.join(MEASURES)} AS total FROM (SELECT {counts} FROM ({D}) WHERE {where})"


@query("null_counts", _null_counts_sql("TRUE"))
def _(spark, sf):
    return cleaning.null_counts(_dirty(spark, sf))


@query("null_counts_after_rejects", _null_counts_sql(f"NOT {v.INVALID_SQL}"))
def _(spark, sf):
    return cleaning.null_counts(_dirty(spark, sf), after_rejects=True)


@query(
    "cleaning_report",
    f"""SELECT count(*) AS records_before, count(*) FILTER (WHERE NOT {v.INVALID_SQL}) AS records_after,
          count(*) FILTER (WHERE {v.INVALID_SQL}) AS rejected_records,
          CAST(sum({' + '.join(f'CAST({m} IS NULL AS INTEGER)' for m in MEASURES)}) AS BIGINT) AS activity_null_values_handled
        FROM ({D})""",
)
def _(spark, sf):
    return cleaning.cleaning_report(_dirty(spark, sf))


@query(
    "normalize_grid_id",
    f"SELECT CAST(grid_id AS VARCHAR) AS grid_id, count(*) AS records FROM ({D}) GROUP BY 1",
)
def _(spark, sf):
    # Cell ids as a float column prints them, padded.
    shown = F.concat(F.lit("  "), F.col("grid_id").cast("double").cast("string"), F.lit(" "))
    return _dirty(spark, sf).groupBy(fn.grid_text(shown).alias("grid_id")).agg(F.count("*").alias("records"))


@query(
    "drop_geometry",
    rounded(f"SELECT timestamp, grid_id, total_activity FROM ({H})", "total_activity", "timestamp, grid_id"),
)
def _(spark, sf):
    hours = v.hourly(spark, sf).select("timestamp", "grid_id", "total_activity")
    enriched = geo.enrich_geo(hours, geo.area_centroids(v.grid_cells(spark, sf))).withColumnRenamed("geometry", "Geometry")
    return cleaning.fact_projection(enriched)


_WINDOW = "date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'"


@query(
    "filter_date_window",
    rounded(f"SELECT timestamp, grid_id, total_activity FROM ({H}) WHERE {_WINDOW}", "total_activity", "timestamp, grid_id"),
)
def _(spark, sf):
    rows = cleaning.filter_date_window(v.hourly(spark, sf), "2024-01-08", "2024-01-14")
    return rows.select("timestamp", "grid_id", "total_activity")


@query(
    "ensure_date",
    f"""SELECT timestamp, grid_id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, count(*) AS records
        FROM ({v.telemetry_sql()}) GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return cleaning.ensure_date(v.telemetry(spark, sf)).groupBy("timestamp", "grid_id", "date").agg(F.count("*").alias("records"))


@query(
    "dedupe_keys",
    rounded(
        f"""SELECT timestamp, grid_id, country_code, {M.replace(' ', ', ')} FROM (
              SELECT *, row_number() OVER (PARTITION BY timestamp, grid_id ORDER BY event_id) AS n FROM ({v.telemetry_sql()})) WHERE n = 1""",
        M,
        KEYS,
    ),
)
def _(spark, sf):
    rows = v._spread(v._events(spark, sf, None))
    return _as_double(cleaning.dedupe_keys(rows, ["timestamp", "grid_id"], ["event_id"]).drop("event_id"))


@query(
    "grid_set_difference",
    f"""WITH s AS (SELECT DISTINCT user_id + 1 AS grid_id FROM events),
          r AS (SELECT DISTINCT grid_id FROM ({v.telemetry_sql(v.DENSE * 8)}))
        SELECT CAST(grid_id AS INTEGER) AS grid_id, 'source' AS found_in FROM (SELECT grid_id FROM s EXCEPT SELECT grid_id FROM r)
        UNION ALL SELECT CAST(grid_id AS INTEGER), 'reference' FROM (SELECT grid_id FROM r EXCEPT SELECT grid_id FROM s)""",
)
def _(spark, sf):
    source = v._events(spark, sf, None)
    return geo.grid_set_difference(source, v.grid_cells(spark, sf, v.DENSE * 8))


@query(
    "scalar_catalog",
    f"""SELECT timestamp, grid_id, CASE WHEN total_activity > 100 THEN 'busy' ELSE 'calm' END AS label,
          coalesce(nullif(internet_activity, 0), -1.0::DOUBLE) AS internet_or_minus_one,
          round(sms_in / nullif(total_activity, 0) + 3e-10, 6) + 0.0 AS rounded_ratio, round(abs(sms_in - sms_out) + 3e-10, 6) AS gap,
          round(sin(2 * pi() * hour(timestamp) / 24) + 3e-10, 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hour(timestamp) / 24) + 3e-10, 6) + 0.0 AS hour_cos,
          isfinite(total_activity) AS is_finite, hour(timestamp) AS hour, dayname(timestamp) AS day_name,
          CAST(epoch(timestamp) AS BIGINT) AS unix_seconds, timestamp + INTERVAL 1 HOUR AS next_hour,
          strptime(strftime(timestamp, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS parsed,
          CAST(grid_id AS VARCHAR) AS grid_text, 'at ' || printf('%.2f', total_activity) || ', ' || printf('%.1f', 100 * internet_activity / nullif(total_activity, 0)) || '%' AS reason,
          length('at ' || printf('%.2f', total_activity)) AS reason_length, TRY_CAST(day_of_week AS INTEGER) AS bad_cast
        FROM ({H})""",
)
def _(spark, sf):
    total, internet = F.col("total_activity"), F.col("internet_activity")
    angle = F.hour("timestamp") * (2 * F.pi() / 24)
    text = F.concat(F.lit("at "), fn.fixed(total, 2))
    return v.hourly(spark, sf).select(
        "timestamp",
        "grid_id",
        F.when(total > 100, "busy").otherwise("calm").alias("label"),
        F.coalesce(F.nullif(internet, F.lit(0.0)), F.lit(-1.0)).alias("internet_or_minus_one"),
        fn.ratio_or_null(F.col("sms_in"), total).alias("rounded_ratio"),
        F.abs(F.col("sms_in") - F.col("sms_out")).alias("gap"),
        F.sin(angle).alias("hour_sin"),
        F.cos(angle).alias("hour_cos"),
        fn.finite(total).alias("is_finite"),
        F.hour("timestamp").alias("hour"),
        F.date_format("timestamp", "EEEE").alias("day_name"),
        F.unix_seconds(F.col("timestamp").cast("timestamp")).alias("unix_seconds"),
        (F.col("timestamp") + fn.hours(1)).alias("next_hour"),
        F.try_to_timestamp(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("parsed"),
        fn.grid_text(F.col("grid_id")).alias("grid_text"),
        F.concat(text, F.lit(", "), fn.fixed(100 * internet / F.nullif(total, F.lit(0.0)), 1), F.lit("%")).alias("reason"),
        F.length(text).alias("reason_length"),
        F.col("day_of_week").try_cast("int").alias("bad_cast"),
    )
