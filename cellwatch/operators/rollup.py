"""Hash aggregates over clean and hourly activity.

Every grouping here uses functions that combine on the map side, so a cell or
source holding a large share of the raw rows reaches the shuffle already
reduced to one row per map task and group.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwatch.functions.columns import calendar, hour_number, share_exact, share_rounded, totals
from cellwatch.schemas import GRID_ID_MAX, GRID_ID_MIN, MEASURES

# Logarithm of the registers of a sketch: 4,096, for a standard error of 1.6 % in at most 4 KB.
SKETCH_PRECISION = 12
DAY_SUMS = ["total_sms", "total_calls", "internet_activity", "total_activity"]


def _sums(names: list[str]) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


def hourly_grid_summary(activity: DataFrame, rounded_share: bool = True) -> DataFrame:
    """One row per (timestamp, grid_id): summed measures, totals, share, calendar."""
    share = share_rounded if rounded_share else share_exact
    columns = {k: v for k, v in calendar(F.col("timestamp")).items() if k in ("date", "hour", "day_of_week")}
    return (
        activity.groupBy("timestamp", "grid_id")
        .agg(*[F.sum(m).cast("double").alias(m) for m in MEASURES])
        .withColumns(totals())
        .withColumns({**columns, "internet_share": share(F.col("internet_activity"), F.col("total_activity"))})
    )


def hourly_partials(activity: DataFrame) -> DataFrame:
    """Mergeable state of the roll-up: summed measures and records per (timestamp, grid_id), by date.

    `hourly_grid_summary` of several such states together is that of all their
    rows.
    """
    sums = [F.sum(m).alias(m) for m in MEASURES]
    return activity.groupBy("timestamp", "grid_id").agg(*sums, F.count("*").alias("records")).withColumn("date", F.to_date("timestamp"))


def internet_share_rounded(hourly: DataFrame) -> DataFrame:
    return hourly.withColumn("internet_share", share_rounded(F.col("internet_activity"), F.col("total_activity")))


def internet_share_exact(hourly: DataFrame) -> DataFrame:
    return hourly.withColumn("internet_share", share_exact(F.col("internet_activity"), F.col("total_activity")))


def daily_traffic_summary(hourly: DataFrame) -> DataFrame:
    """Per (date, cell) sums and mean hourly activity; order it when showing it."""
    return hourly.groupBy("date", "grid_id").agg(
        *_sums(DAY_SUMS), F.avg("total_activity").alias("avg_hourly_activity")
    )


def daily_kpi(hourly: DataFrame, approximate: bool = False) -> DataFrame:
    """Per date sums and distinct cells.

    The exact count pre-aggregates to (date, cell) first, so no task holds a
    set of cells.
    """
    if approximate:
        return hourly.groupBy("date").agg(*_sums(DAY_SUMS), F.approx_count_distinct("grid_id").alias("active_grids"))
    per_cell = hourly.groupBy("date", "grid_id").agg(*_sums(DAY_SUMS))
    return per_cell.groupBy("date").agg(*_sums(DAY_SUMS), F.count("*").alias("active_grids"))


def daily_sketches(activity: DataFrame, precision: int = SKETCH_PRECISION) -> DataFrame:
    """Mergeable state of the KPIs and the ingestion profile per date: sums, records, and sketches of distinct cells, countries and hours.

    States of several dates, or of several loads of one date, together give
    those of all their rows; see `sketched_kpi`.
    """
    total = sum((F.coalesce(m, F.lit(0)) for m in MEASURES[1:]), F.coalesce(MEASURES[0], F.lit(0)))
    return activity.groupBy(F.to_date("timestamp").alias("date")).agg(
        F.count("*").alias("records"),
        F.sum(total).cast("double").alias("total_activity"),
        F.hll_sketch_agg("grid_id", precision).alias("grids"),
        F.hll_sketch_agg("country_code", precision).alias("countries"),
        F.hll_sketch_agg(hour_number(F.col("timestamp")).cast("bigint"), precision).alias("hours"),
    )


def sketched_kpi(states: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sums and estimated distinct counts of a window of states, whole or by `keys`; no raw row is read."""
    counts = {"active_grids": "grids", "country_codes": "countries", "timestamps": "hours"}
    return states.groupBy(*(keys or [])).agg(
        F.sum("records").alias("records"),
        F.sum("total_activity").alias("total_activity"),
        *[F.hll_sketch_estimate(F.hll_union_agg(sketch)).alias(name) for name, sketch in counts.items()],
    )


def sketch_error(precision: int = SKETCH_PRECISION, deviations: float = 4.0) -> float:
    """Relative error of an estimate that so many standard deviations allow."""
    return deviations * 1.04 / 2 ** (precision / 2)


def grid_kpi(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("grid_id").agg(*_sums(DAY_SUMS))


def peak_activity_hour(hourly: DataFrame) -> DataFrame:
    """Hour of day with the highest activity over all cells."""
    return (
        hourly.groupBy("hour")
        .agg(F.sum("total_activity").alias("total_activity"), F.avg("total_activity").alias("average_grid_activity"))
        .orderBy(F.round("total_activity", 6).desc(), "hour")
        .limit(1)
    )


def global_internet_share(hourly: DataFrame) -> DataFrame:
    return hourly.agg(
        F.sum("internet_activity").alias("total_internet_activity"),
        F.sum("total_activity").alias("total_network_activity"),
    ).withColumn(
        "internet_share",
        share_rounded(F.col("total_internet_activity"), F.col("total_network_activity")),
    )


def network_summary(hourly: DataFrame, as_of: Column) -> DataFrame:
    """Totals, active cells, peak hour and top cell of all hours up to `as_of`.

    Ties go to the earlier hour and the smaller cell id.
    """
    seen = hourly.where(F.col("timestamp") <= as_of)
    hours = seen.groupBy("timestamp").agg(F.sum("total_activity").alias("total"))
    cells = seen.groupBy("grid_id").agg(F.sum("total_activity").alias("total"))
    earliest = -hour_number(F.col("timestamp"))
    peak = hours.agg(F.max_by("timestamp", F.struct(F.round("total", 6), earliest)).alias("v"))
    top = cells.agg(
        F.struct(
            F.sum("total").alias("total_activity"),
            F.count_if(F.col("total") > 0).alias("active_grids"),
            F.max_by("grid_id", F.struct(F.round("total", 6), -F.col("grid_id"))).alias("top_grid"),
        ).alias("v")
    )
    return (
        hourly.sparkSession.range(1)
        .select(top.scalar().alias("t"), peak.scalar().alias("peak_hour"), as_of.alias("as_of"))
        .select("t.total_activity", "t.active_grids", "peak_hour", "t.top_grid", "as_of")
    )


def control_totals(source: DataFrame, loaded: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Column sums of source and loaded rows side by side, one row per column."""
    names = MEASURES + ["total_sms", "total_calls", "total_activity"]

    def long(df: DataFrame, label: str) -> DataFrame:
        sums = df.agg(*[F.sum(n).alias(n) for n in names])
        return sums.unpivot([], names, "column_name", label)

    return (
        long(source, "source_total")
        .join(long(loaded, "loaded_total"), "column_name")
        .withColumn("matches", F.abs(F.col("source_total") - F.col("loaded_total")) <= tolerance)
    )


def network_hourly_trend(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("timestamp").agg(F.sum("total_activity").alias("total_activity"))


def top_internet_hours(hourly: DataFrame, limit: int = 10) -> DataFrame:
    return (
        hourly.groupBy("timestamp")
        .agg(F.sum("internet_activity").alias("internet_activity"))
        .orderBy(F.round("internet_activity", 6).desc(), "timestamp")
        .limit(limit)
    )


def bucket_history(hourly: DataFrame) -> DataFrame:
    """Observations per (cell, hour of day): smallest, largest, mean, buckets."""
    buckets = hourly.groupBy("grid_id", F.hour("timestamp").alias("hour_of_day")).agg(F.count("*").alias("n"))
    return buckets.agg(
        F.min("n").alias("minimum_observations"),
        F.max("n").alias("maximum_observations"),
        F.avg("n").alias("average_observations"),
        F.count("*").alias("bucket_count"),
    )


def ingestion_profile(raw: DataFrame, source_file: str = "source_file", grid_id_max: int = GRID_ID_MAX) -> DataFrame:
    """Rows, files, distinct keys, out-of-range cells and expected hours.

    One scan. Rows first reduce to their distinct key combinations per map
    task, so the distinct counts work on that small set.
    """
    combos = raw.groupBy(source_file, "grid_id", "country_code", "timestamp").agg(F.count("*").alias("n"))
    out_of_range = F.coalesce(~F.col("grid_id").between(GRID_ID_MIN, grid_id_max), F.lit(False))
    return combos.agg(
        F.sum("n").alias("row_count"),
        F.countDistinct(source_file).alias("file_count"),
        F.countDistinct("grid_id").alias("grid_count"),
        F.countDistinct("country_code").alias("country_code_count"),
        F.countDistinct("timestamp").alias("timestamp_count"),
        F.coalesce(F.sum(F.when(out_of_range, F.col("n"))), F.lit(0)).alias("invalid_grid_count"),
        F.coalesce(F.sum(F.when(F.col(source_file).isNull(), F.col("n"))), F.lit(0)).alias("null_filename_count"),
    ).withColumn("expected_timestamp_count", F.col("file_count") * 24)


def dashboard_summary(hourly: DataFrame, limit: int = 10) -> DataFrame:
    """Cells with the highest total activity."""
    return (
        hourly.groupBy("grid_id")
        .agg(F.sum("total_activity").alias("total_activity"))
        .orderBy(F.round("total_activity", 6).desc(), "grid_id")
        .limit(limit)
    )


def resolve_as_of(hourly: DataFrame, requested: datetime | str | None = None) -> Column:
    """Latest hour, or the requested hour when the data holds it, else NULL."""
    rows = hourly
    if requested is not None:
        rows = rows.where(F.col("timestamp") == F.lit(requested).cast("timestamp_ntz"))
    return rows.agg(F.max("timestamp")).scalar()
