"""Rule alerts and their views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellwatch.functions.columns import fixed
from cellwatch.operators.baselines import by_whole_cell, leave_one_out_median
from cellwatch.operators.quantile import exact_group_percentile

HIGH_THRESHOLD = 1.5
DROP_THRESHOLD = 0.5
SPIKE_THRESHOLD = 2.0
ACTIVITY_FLOOR_PERCENTILE = 0.10


def activity_floor(hourly: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Per date: 10th percentile of the cells' daily totals.

    The number of cells has no bound, so the percentile is the bracketed one.
    """
    daily = hourly.groupBy("grid_id", "date").agg(F.sum("total_activity").alias("daily_activity"))
    daily = daily.withColumn("daily_activity", F.round("daily_activity", 6))
    return exact_group_percentile(daily, ["date"], "daily_activity", ACTIVITY_FLOOR_PERCENTILE, "activity_floor", accuracy, few_groups=True)


def eligible_grids(hourly: DataFrame) -> DataFrame:
    """Daily total of the cell on each hour and whether it reaches the floor."""
    day = W.partitionBy("grid_id", "date")
    return (
        hourly.withColumn("daily_activity", F.round(F.sum("total_activity").over(day), 6))
        .join(F.broadcast(activity_floor(hourly)), "date")
        .withColumn("eligible", F.col("daily_activity") >= F.col("activity_floor"))
    )


def _alert(kind: str, hit: Column, reason: Column) -> Column:
    return F.when(hit, F.struct(F.lit(kind).alias("alert_type"), reason.alias("reason")))


def with_rule_inputs(hourly: DataFrame, floor: DataFrame) -> DataFrame:
    """Hourly rows with previous hour, leave-one-out baseline, daily total and whether it reaches the floor.

    One sort by (date, time) within a cell serves the previous hour and the day
    groups of baseline and daily total. The floor has one row per date, so it
    is broadcast.
    """
    in_order = W.partitionBy("grid_id").orderBy("date", "timestamp")
    day = W.partitionBy("grid_id", "date")
    return (
        hourly.withColumn("previous_activity", F.lag("total_activity").over(in_order))
        .withColumn("_values", F.sort_array(F.collect_list("total_activity").over(day)))
        .withColumn("daily_activity", F.round(F.sum("total_activity").over(day), 6))
        .join(F.broadcast(floor), "date", "left")
        .withColumn("eligible", F.coalesce(F.col("daily_activity") >= F.col("activity_floor"), F.lit(False)))
        .withColumn("baseline_activity", leave_one_out_median(F.col("_values"), F.col("total_activity")))
        .drop("_values")
    )


def network_alerts(hourly: DataFrame) -> DataFrame:
    """One row per rule hit of every eligible hour.

    The hours are shuffled once, by cell; the floor's own shuffles carry one
    row per date, or a few values next to it.
    """
    now, base, prev = F.col("total_activity"), F.col("baseline_activity"), F.col("previous_activity")
    cells = by_whole_cell(hourly, "timestamp", "date", "total_activity")
    rows = with_rule_inputs(cells, activity_floor(cells)).where("eligible")
    high = F.concat(
        F.lit("HIGH_ACTIVITY: current activity "), fixed(now, 2),
        F.lit(f" is above {HIGH_THRESHOLD:.1f}x baseline activity "), fixed(base, 2),
    )
    drop = F.concat(
        F.lit("ACTIVITY_DROP: current activity "), fixed(now, 2),
        F.lit(f" is below {DROP_THRESHOLD:.1f}x baseline activity "), fixed(base, 2),
    )
    # A day with a single hour has no baseline, shown as "nan".
    spike = F.concat(
        F.lit("ACTIVITY_SPIKE: current activity "), fixed(now, 2),
        F.lit(f" is more than {SPIKE_THRESHOLD:.1f}x the previous-hour activity "), fixed(prev, 2),
        F.lit("; baseline activity is "), F.coalesce(fixed(base, 2), F.lit("nan")),
    )
    hits = F.array_compact(
        F.array(
            _alert("HIGH_ACTIVITY", now > base * HIGH_THRESHOLD, high),
            _alert("ACTIVITY_DROP", now < base * DROP_THRESHOLD, drop),
            _alert("ACTIVITY_SPIKE", (prev > 0) & (now > prev * SPIKE_THRESHOLD), spike),
        )
    )
    return rows.withColumn("hit", F.explode(hits)).select(
        "grid_id",
        "timestamp",
        "hit.alert_type",
        F.col("total_activity").alias("current_activity"),
        "baseline_activity",
        "hit.reason",
    )


def alert_summary(alerts: DataFrame, hourly: DataFrame) -> DataFrame:
    """Grid-hours, alerts, alerted grid-hours, their share and counts by type."""
    kinds = ["HIGH_ACTIVITY", "ACTIVITY_DROP", "ACTIVITY_SPIKE"]
    per_hour = alerts.groupBy("grid_id", "timestamp").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("alert_type") == k).alias(k.lower()) for k in kinds]
    )
    summary = per_hour.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_alerts"),
        F.count("*").alias("alerted_grid_hours"),
        *[F.coalesce(F.sum(k.lower()), F.lit(0)).alias(k.lower()) for k in kinds],
    )
    return summary.withColumn("total_grid_hours", hourly.agg(F.count("*")).scalar()).withColumn(
        "alert_proportion",
        F.coalesce(F.col("alerted_grid_hours") / F.nullif(F.col("total_grid_hours"), F.lit(0)), F.lit(0.0)),
    )


def top_alert_grids(alerts: DataFrame, limit: int = 10) -> DataFrame:
    return alerts.groupBy("grid_id").agg(F.count("*").alias("alerts")).orderBy(F.desc("alerts"), "grid_id").limit(limit)


def alert_feed(alerts: DataFrame, as_of: Column, alert_type: str | None = None, limit: int = 10) -> DataFrame:
    """Newest alerts up to `as_of`; ties fall by cell id as text, then type."""
    if not 1 <= limit <= 10000:
        raise ValueError("limit must be between 1 and 10000")
    rows = alerts.where(F.col("timestamp") <= as_of)
    if alert_type is not None:
        rows = rows.where(F.col("alert_type") == alert_type)
    return rows.orderBy(F.desc("timestamp"), F.col("grid_id").cast("string").desc(), F.desc("alert_type")).limit(limit)


def display_priority(alerts: DataFrame, hotspots: DataFrame) -> DataFrame:
    """Display priority per cell of one hour's alerts and hotspots."""
    alerted = alerts.groupBy("grid_id").agg(
        F.bool_or(F.col("alert_type").isin("HIGH_ACTIVITY", "ACTIVITY_SPIKE")).alias("urgent")
    )
    ranked = hotspots.select("grid_id", "rank")
    return alerted.join(ranked, "grid_id", "full").select(
        "grid_id",
        F.when(F.col("urgent"), "HIGH")
        .when(F.col("urgent").isNotNull(), "ATTENTION")
        .when(F.col("rank") == 1, "HIGH")
        .otherwise("ATTENTION")
        .alias("priority"),
    )
