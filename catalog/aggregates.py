"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from catalog.core import query, rounded
from cellwatch import runtime
from cellwatch.operators import alerts, rollup, star
from cellwatch.schemas import MEASURES
from cellwatch.sources import sinks

H = v.hourly_sql()
HD = v.hourly_sql(v.DENSE)
HOURLY_DOUBLES = " ".join(MEASURES) + " total_sms total_calls total_activity internet_share"
SUMS = "total_sms total_calls internet_activity total_activity"
SUM_SQL = ", ".join(f"sum({n}) AS {n}" for n in SUMS.split())
DATE = "CAST(date AS VARCHAR) AS date"


@query("hourly_grid_summary", rounded(H, HOURLY_DOUBLES, f"timestamp, grid_id, hour, day_of_week, {DATE}"))
def _(spark, sf):
    return v.hourly(spark, sf)


@query(
    "daily_traffic_summary",
    rounded(
        f"SELECT date, grid_id, {SUM_SQL}, avg(total_activity) AS avg_hourly_activity FROM ({H}) GROUP BY date, grid_id",
        SUMS + " avg_hourly_activity",
        f"grid_id, {DATE}",
    ),
)
def _(spark, sf):
    return rollup.daily_traffic_summary(v.hourly(spark, sf))


@query(
    "daily_kpi",
    rounded(
        f"SELECT date, {SUM_SQL}, count(DISTINCT grid_id) AS active_grids FROM ({H}) GROUP BY date",
        SUMS,
        f"active_grids, {DATE}",
    ),
)
def _(spark, sf):
    return rollup.daily_kpi(v.hourly(spark, sf))


@query("grid_kpi", rounded(f"SELECT grid_id, {SUM_SQL} FROM ({H}) GROUP BY grid_id", SUMS, "grid_id"))
def _(spark, sf):
    return rollup.grid_kpi(v.hourly(spark, sf))


@query(
    "peak_activity_hour",
    rounded(
        f"""SELECT hour, sum(total_activity) AS total_activity, avg(total_activity) AS average_grid_activity
            FROM ({H}) GROUP BY hour ORDER BY round(sum(total_activity), 6) DESC, hour LIMIT 1""",
        "total_activity average_grid_activity",
        "hour",
    ),
)
def _(spark, sf):
    return rollup.peak_activity_hour(v.hourly(spark, sf))


@query(
    "global_internet_share",
    rounded(
        f"""SELECT *, round(total_internet_activity / total_network_activity, 4) AS internet_share FROM (
            SELECT sum(internet_activity) AS total_internet_activity, sum(total_activity) AS total_network_activity FROM ({H}))""",
        "total_internet_activity total_network_activity internet_share",
    ),
)
def _(spark, sf):
    return rollup.global_internet_share(v.hourly(spark, sf))


@query(
    "network_summary",
    rounded(
        f"""WITH h AS ({H}), t AS (SELECT grid_id, sum(total_activity) AS total FROM h GROUP BY 1),
              p AS (SELECT timestamp, sum(total_activity) AS total FROM h GROUP BY 1)
            SELECT (SELECT sum(total) FROM t) AS total_activity, (SELECT count(*) FROM t WHERE total > 0) AS active_grids,
              (SELECT timestamp FROM p ORDER BY round(total, 6) DESC, timestamp LIMIT 1) AS peak_hour,
              (SELECT grid_id FROM t ORDER BY round(total, 6) DESC, grid_id LIMIT 1) AS top_grid,
              (SELECT max(timestamp) FROM h) AS as_of""",
        "total_activity",
        "active_grids, peak_hour, top_grid, as_of",
    ),
)
def _(spark, sf):
    hours = v.stored_hourly(spark, sf)
    return rollup.network_summary(hours, rollup.resolve_as_of(hours))


_CONTROL = MEASURES + ["total_sms", "total_calls", "total_activity"]


@query(
    "control_totals",
    rounded(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, (SELECT sum({c}) FROM ({H})) AS source_total,
                (SELECT sum({c}) FROM ({H})) AS loaded_total, TRUE AS matches"""
            for c in _CONTROL
        ),
        "source_total loaded_total",
        "column_name, matches",
    ),
)
def _(spark, sf):
    from catalog.joins import star_tables

    hours, times, grids = star_tables(spark, sf)
    return rollup.control_totals(hours, star.fact_network_activity(hours, times, grids))


@query(
    "network_hourly_trend",
    rounded(
        f"SELECT timestamp, sum(total_activity) AS total_activity FROM ({H}) GROUP BY timestamp", "total_activity", "timestamp"
    ),
)
def _(spark, sf):
    return rollup.network_hourly_trend(v.hourly(spark, sf))


@query(
    "top_internet_hours",
    rounded(
        f"""SELECT timestamp, sum(internet_activity) AS internet_activity FROM ({H}) GROUP BY timestamp
            ORDER BY round(sum(internet_activity), 6) DESC, timestamp LIMIT 10""",
        "internet_activity",
        "timestamp",
    ),
)
def _(spark, sf):
    return rollup.top_internet_hours(v.hourly(spark, sf))


@query("activity_floor", rounded(v.floor_sql(H), "activity_floor", DATE))
def _(spark, sf):
    return alerts.activity_floor(v.stored_hourly(spark, sf))


@query("activity_floor_bracket", rounded(v.floor_sql(H), "activity_floor", DATE))
def _(spark, sf):
    """The floor by a sketch so coarse that even small groups are bracketed."""
    return alerts.activity_floor(v.stored_hourly(spark, sf), accuracy=50)


@query(
    "bucket_history",
    rounded(
        f"""SELECT min(n) AS minimum_observations, max(n) AS maximum_observations, avg(n) AS average_observations, count(*) AS bucket_count
            FROM (SELECT grid_id, hour(timestamp) AS hod, count(*) AS n FROM ({H}) GROUP BY 1, 2)""",
        "average_observations",
        "minimum_observations, maximum_observations, bucket_count",
    ),
)
def _(spark, sf):
    return rollup.bucket_history(v.hourly(spark, sf))


@query(
    "alert_summary",
    rounded(
        f"""WITH a AS MATERIALIZED ({v.alerts_sql(HD)}), h AS ({HD}),
              d AS (SELECT DISTINCT grid_id, timestamp FROM a)
            SELECT (SELECT count(*) FROM a) AS total_alerts, (SELECT count(*) FROM d) AS alerted_grid_hours,
              (SELECT count(*) FROM a WHERE alert_type = 'HIGH_ACTIVITY') AS high_activity,
              (SELECT count(*) FROM a WHERE alert_type = 'ACTIVITY_DROP') AS activity_drop,
              (SELECT count(*) FROM a WHERE alert_type = 'ACTIVITY_SPIKE') AS activity_spike,
              (SELECT count(*) FROM h) AS total_grid_hours,
              (SELECT count(*) FROM d) / (SELECT count(*) FROM h)::DOUBLE AS alert_proportion""",
        "alert_proportion",
        "total_alerts, alerted_grid_hours, high_activity, activity_drop, activity_spike, total_grid_hours",
    ),
)
def _(spark, sf):
    hours = v.stored_hourly(spark, sf, v.DENSE)
    return alerts.alert_summary(alerts.network_alerts(hours), hours)


@query(
    "top_alert_grids",
    f"SELECT grid_id, count(*) AS alerts FROM ({v.alerts_sql(HD)}) GROUP BY grid_id ORDER BY alerts DESC, grid_id LIMIT 10",
)
def _(spark, sf):
    return alerts.top_alert_grids(alerts.network_alerts(v.stored_hourly(spark, sf, v.DENSE)))


@query(
    "dashboard_summary",
    rounded(
        f"""SELECT grid_id, sum(total_activity) AS total_activity FROM ({H}) GROUP BY grid_id
            ORDER BY round(sum(total_activity), 6) DESC, grid_id LIMIT 10""",
        "total_activity",
        "grid_id",
    ),
)
def _(spark, sf):
    return rollup.dashboard_summary(v.hourly(spark, sf))


# A second series with one row per supplier cell and shipping day, and the
# dimension join of its cells, over the largest table.
@query(
    "supplier_daily_summary",
    rounded(
        """SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey + 1 AS grid_id, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total_activity,
             avg(CAST(l_quantity AS DECIMAL(18,2))) AS avg_quantity, count(*) AS records FROM lineitem GROUP BY 1, 2""",
        "total_activity avg_quantity",
        f"grid_id, records, {DATE}",
    ),
)
def _(spark, sf):
    items = v.table(spark, sf, "lineitem")
    return items.groupBy(F.to_date("l_shipdate").alias("date"), (F.col("l_suppkey") + 1).alias("grid_id")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total_activity"),
        F.avg(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("avg_quantity"),
        F.count("*").alias("records"),
    )


_KPI = "records, active_grids_fit, country_codes_fit, timestamps_fit"


def _fits(found, exact):
    """Sketched counts lie within their error of the exact ones, which come from their own aggregates."""
    bound = rollup.sketch_error()
    near = lambda c: (F.abs(F.col(c) - F.col(f"{c}_exact")) <= F.greatest(F.lit(0.5), bound * F.col(f"{c}_exact"))).alias(f"{c}_fit")
    exact = exact.withColumnsRenamed({c: f"{c}_exact" for c in ("active_grids", "country_codes", "timestamps")})
    return found.join(exact, "week").select("week", "records", "total_activity", *map(near, ("active_grids", "country_codes", "timestamps")))


@query(
    "sketched_kpi",
    rounded(
        f"""SELECT CAST(dayofyear(timestamp) // 7 AS INTEGER) AS week, count(*) AS records, sum({v.TOTAL_SQL}) AS total_activity,
              TRUE AS active_grids_fit, TRUE AS country_codes_fit, TRUE AS timestamps_fit FROM ({v.telemetry_sql()}) GROUP BY 1""",
        "total_activity",
        "week, " + _KPI,
    ),
)
def _(spark, sf):
    """Weeks from stored daily states of two loads, and whether the estimates keep to their error."""
    rows = v._spread(v._events(spark, sf, None))
    path = runtime.scratch_path(spark, "sketches")
    for load in (0, 1):
        state = rollup.daily_sketches(rows.where(F.col("event_id") % 2 == load)).withColumn("load", F.lit(load))
        sinks.write_parts(state, path, ["date", "load"])
    week = F.floor(F.dayofyear("date") / 7).cast("int").alias("week")
    found = rollup.sketched_kpi(spark.read.parquet(path).withColumn("week", week), ["week"])
    stamps = rows.withColumn("week", F.floor(F.dayofyear("timestamp") / 7).cast("int"))
    exact = stamps.groupBy("week").agg(
        F.count_distinct("grid_id").alias("active_grids"), F.count_distinct("country_code").alias("country_codes"), F.count_distinct("timestamp").alias("timestamps")
    )
    return _fits(found, exact)
