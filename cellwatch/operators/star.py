"""Star schema: time and cell dimensions and the activity fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellwatch.functions import geometry as geo
from cellwatch.functions.columns import grid_text
from cellwatch.schemas import MEASURES, TOTALS

CELLS_PER_BUCKET = 4096


def sequential_keys(df: DataFrame, order: str, bucket: Column, name: str) -> DataFrame:
    """Keys 1..n in the order of a unique column, without sorting all rows together.

    `bucket` must rise with `order`. Rows number within their bucket, and only
    one row per bucket is put in global order to find the offsets.
    """
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("_bucket", F.coalesce(before, F.lit(0)).alias("_offset"))
    within = F.row_number().over(W.partitionBy("_bucket").orderBy(order))
    return rows.join(offsets, "_bucket").select(
        (F.col("_offset") + within).alias(name), *[c for c in df.columns]
    )


def dim_time(hourly: DataFrame) -> DataFrame:
    """One row per hour in time order; weekday counts from Sunday as 1."""
    stamps = hourly.select("timestamp").distinct()
    return sequential_keys(stamps, "timestamp", F.to_date("timestamp"), "time_key").select(
        "time_key",
        "timestamp",
        F.to_date("timestamp").alias("date"),
        F.hour("timestamp").alias("hour"),
        F.dayofweek("timestamp").alias("day_of_week"),
    )


def dim_grid(reference: DataFrame, geometry_reference: str) -> DataFrame:
    """One row per cell by ascending id; the last of duplicate features wins."""
    shape = F.max_by("geometry", F.struct("source_file", "position"))
    cells = reference.groupBy("grid_id").agg(shape.alias("geometry")).select(
        "grid_id",
        geo.vertex_mean(F.col("geometry"), 1).alias("centroid_latitude"),
        geo.vertex_mean(F.col("geometry"), 0).alias("centroid_longitude"),
    )
    bucket = F.floor(F.col("grid_id") / CELLS_PER_BUCKET)
    return sequential_keys(cells, "grid_id", bucket, "grid_key").select(
        "grid_key",
        grid_text(F.col("grid_id")).alias("grid_id"),
        "centroid_latitude",
        "centroid_longitude",
        F.lit(geometry_reference).alias("geometry_reference"),
    )


def fact_network_activity(hourly: DataFrame, times: DataFrame, grids: DataFrame) -> DataFrame:
    """Hourly rows under surrogate keys; NULL measures become zero.

    The time dimension has one row per hour of history and is broadcast; the
    cell dimension grows with the cells, so Spark decides from its size.
    """
    measures = MEASURES + TOTALS + ["internet_share"]
    rows = hourly.select(
        "timestamp", grid_text(F.col("grid_id")).alias("grid_id"), *[F.coalesce(m, F.lit(0.0)).alias(m) for m in measures]
    )
    return (
        rows.join(F.broadcast(times.select("time_key", "timestamp")), "timestamp")
        .join(grids.select("grid_key", "grid_id"), "grid_id")
        .select("time_key", "grid_key", *measures)
    )


def unknown_keys(hourly: DataFrame, times: DataFrame, grids: DataFrame) -> DataFrame:
    """Hours or cells of the source no dimension knows, with their row counts."""
    rows = hourly.select("timestamp", grid_text(F.col("grid_id")).alias("grid_id"))
    by_time = rows.groupBy("timestamp").count().join(times, "timestamp", "left_anti")
    by_grid = rows.groupBy("grid_id").count().join(grids, "grid_id", "left_anti")
    return by_time.select(
        F.lit("timestamp").alias("key"), F.col("timestamp").cast("string").alias("value"), F.col("count").alias("rows")
    ).unionByName(by_grid.select(F.lit("grid_id").alias("key"), F.col("grid_id").alias("value"), F.col("count").alias("rows")))


def star_activity(fact: DataFrame, times: DataFrame, grids: DataFrame) -> DataFrame:
    """Fact rows with their hour and cell."""
    return (
        fact.join(F.broadcast(times), "time_key")
        .join(grids, "grid_key")
        .select(
            "timestamp", "grid_id", "date", "hour", "centroid_latitude", "centroid_longitude",
            *MEASURES, *TOTALS, "internet_share",
        )
    )
