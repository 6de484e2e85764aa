"""Baselines over hourly rows.

Input is the hourly grain, one row per (grid_id, timestamp), so a cell holds at
most one row per hour of history (87,600 in ten years) and a (cell, date) group
at most 24. That bound is what makes windows by cell safe; `quality.dq_grain`
checks it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellwatch.functions.columns import hour_number, hours
from cellwatch.operators.quantile import exact_group_percentile

SURGE_FACTOR = 1.5
TREND_ROWS = 24
# Columns of the calendar: their groups number at most the hours of the history.
CALENDAR_KEYS = {"hour_of_day", "hour", "day_of_week", "date", "day_number", "weekday_number", "timestamp"}


def by_cell() -> W:
    return W.partitionBy("grid_id").orderBy("timestamp")


def by_whole_cell(hourly: DataFrame, *columns: str) -> DataFrame:
    """The columns of all hours, shuffled once by cell.

    A cell's hours travel as one array, whose fields no reader prunes apart, so
    windows by cell and aggregates by cell and day share the one shuffle.
    """
    held = hourly.groupBy("grid_id").agg(F.collect_list(F.struct(*columns)).alias("_hours"))
    return held.select("grid_id", F.inline("_hours"))


def previous_activity(hourly: DataFrame) -> DataFrame:
    """Activity of the previous row of the cell, however long ago it was."""
    return hourly.withColumn("previous_activity", F.lag("total_activity").over(by_cell()))


def leave_one_out_median(values: Column, own: Column) -> Column:
    """Median of a sorted array without one occurrence of `own`; NULL if none is left."""
    rest = F.size(values) - 1
    own_place = F.array_position(values, own) - 1

    def other(i: Column) -> Column:
        return F.get(values, F.when(i < own_place, i).otherwise(i + 1).cast("int"))

    upper = F.floor(rest / 2)
    lower = F.floor((rest - 1) / 2)
    return F.when(rest > 0, F.when(rest % 2 == 1, other(upper)).otherwise((other(lower) + other(upper)) / 2))


def loo_baseline(hourly: DataFrame) -> DataFrame:
    """Median of the cell's other hours of the day."""
    day = W.partitionBy("grid_id", "date")
    values = F.sort_array(F.collect_list("total_activity").over(day))
    return (
        hourly.withColumn("_values", values)
        .withColumn("baseline_activity", leave_one_out_median(F.col("_values"), F.col("total_activity")))
        .drop("_values")
    )


def timestamp_gaps(hourly: DataFrame) -> DataFrame:
    """Consecutive rows of a cell that are not one hour apart."""
    return (
        hourly.select("grid_id", "timestamp", F.lag("timestamp").over(by_cell()).alias("previous_timestamp"))
        .where(F.col("timestamp") != F.col("previous_timestamp") + hours(1))
        .withColumn("gap_hours", hour_number(F.col("timestamp")) - hour_number(F.col("previous_timestamp")))
    )


def densify_hours(hourly: DataFrame) -> DataFrame:
    """Every hour between a cell's first and last; missing measures are NULL."""
    spans = hourly.groupBy("grid_id").agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    frame = spans.select("grid_id", F.explode(F.sequence("lo", "hi", hours(1))).alias("timestamp"))
    return frame.join(hourly, ["grid_id", "timestamp"], "left")


def sorted_median(values: Column, rows: int) -> Column:
    """Median of a sorted array of `rows` values, NULL when it holds fewer.

    For short sliding frames this beats a percentile aggregate, which builds a
    hash map per row.
    """
    middle = (F.get(values, F.lit((rows - 1) // 2)) + F.get(values, F.lit(rows // 2))) / 2
    return F.when(F.size(values) == rows, middle)


def trailing_values(frame: W) -> Column:
    return F.sort_array(F.collect_list("total_activity").over(frame))


def with_trailing_median(hourly: DataFrame, rows: int = TREND_ROWS) -> DataFrame:
    """Median of the last `rows` rows as `_median`, NULL before that many exist."""
    values = trailing_values(by_cell().rowsBetween(1 - rows, 0))
    return hourly.withColumn("_values", values).withColumn("_median", sorted_median(F.col("_values"), rows)).drop("_values")


def risk_label(median: Column) -> Column:
    """1 when the next row is the next hour and surges over the trailing median."""
    next_hour = F.lead("timestamp").over(by_cell()) == F.col("timestamp") + hours(1)
    surges = F.lead("total_activity").over(by_cell()) > F.lit(SURGE_FACTOR) * median
    return F.coalesce((next_hour & surges).cast("int"), F.lit(0))


def risk_target(hourly: DataFrame) -> DataFrame:
    """Label of every row; a row without a usable baseline or next hour is 0."""
    return (
        with_trailing_median(hourly)
        .withColumn("target", risk_label(F.col("_median")))
        .select("grid_id", F.col("timestamp").alias("feature_timestamp"), "target")
    )


def trailing_high_activity(hourly: DataFrame) -> DataFrame:
    """Current hour over 1.5x the trailing median; NULL before 24 rows."""
    return with_trailing_median(hourly).select(
        "grid_id",
        "timestamp",
        (F.col("total_activity") > F.lit(SURGE_FACTOR) * F.col("_median")).cast("int").alias("np3_high_activity"),
    )


def hour_bucket_baseline(hourly: DataFrame, keys: tuple[str, ...] = ("grid_id", "hour_of_day")) -> DataFrame:
    """Median of the row's group, whole-cell median where that is NULL.

    Groups within a cell share one shuffle by cell and one sort with the cell
    median. Groups across cells have no size bound and take the bracketed
    percentile instead.
    """
    rows = hourly.withColumn("hour_of_day", F.hour("timestamp"))
    median = F.percentile("total_activity", 0.5)
    if "grid_id" in keys:
        within = [k for k in keys if k != "grid_id"]
        # The order matters to neither median; it lets both windows use one sort.
        cell = W.partitionBy("grid_id").orderBy(*within).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        return (
            rows.withColumn("_cell", median.over(cell))
            .withColumn("_group", median.over(W.partitionBy("grid_id", *within)))
            .withColumn("baseline_activity", F.coalesce("_group", "_cell"))
            .drop("_cell", "_group")
        )
    few = set(keys) <= CALENDAR_KEYS
    groups = exact_group_percentile(rows, list(keys), "total_activity", 0.5, "_group", few_groups=few)
    return (
        rows.withColumn("_cell", median.over(W.partitionBy("grid_id")))
        .join(F.broadcast(groups) if few else groups, list(keys), "left")
        .withColumn("baseline_activity", F.coalesce("_group", "_cell"))
        .drop("_cell", "_group")
    )


def history_summary(hourly: DataFrame, as_of: Column) -> DataFrame:
    """Per cell: the latest point of the last 24 hours against the hours before it."""
    recent = hourly.where((F.col("timestamp") <= as_of) & (F.col("timestamp") >= as_of - hours(23)))
    points = F.array_sort(F.collect_list(F.struct("timestamp", "total_activity")))
    past = F.transform(F.slice("points", 1, F.size("points") - 1), lambda p: p["total_activity"])
    mean = F.aggregate("past", F.lit(0.0), lambda total, x: total + x) / F.nullif(F.size("past"), F.lit(0))
    return (
        recent.groupBy("grid_id")
        .agg(points.alias("points"))
        .withColumn("past", past)
        .withColumn("mean", F.coalesce(mean, F.lit(0.0)))
        .select(
            "grid_id",
            F.element_at("points", -1)["timestamp"].alias("timestamp"),
            F.element_at("points", -1)["total_activity"].alias("total_activity"),
            F.size("past").alias("observation_window_hours"),
            F.col("mean").alias("historical_mean_activity"),
            F.coalesce(F.array_max("past"), F.lit(0.0)).alias("historical_max_activity"),
            F.coalesce(F.array_min("past"), F.lit(0.0)).alias("historical_min_activity"),
            F.size(F.filter("past", lambda x: x > F.col("mean") * 1.3)).alias("intervals_exceeding_30pct_surge"),
        )
    )


def hourly_cadence(hourly: DataFrame, files: Column) -> DataFrame:
    """Distinct hours, steps other than one hour, and the hours the files promise.

    Only the distinct hours of the history are ordered together.
    """
    stamps = hourly.select("timestamp").distinct()
    steps = stamps.withColumn("previous", F.lag("timestamp").over(W.orderBy("timestamp")))
    return steps.agg(
        F.count("*").alias("timestamp_count"),
        F.count_if(F.col("timestamp") != F.col("previous") + hours(1)).alias("irregular_steps"),
    ).withColumn("expected_timestamp_count", files * 24)
