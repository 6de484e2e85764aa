"""Sinks: partitioned Parquet, plain Parquet, small CSV exports, footprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwatch.functions.columns import hour_number
from cellwatch.functions.morton import cell_of, morton
from cellwatch.operators.cleaning import drop_geometry, ensure_date


def write_activity_partitioned(activity: DataFrame, path: str) -> None:
    """Clean activity by date; a re-run replaces only the dates it carries.

    The rebalance splits a heavy date over as many tasks as its size asks for
    and packs light dates together. Rows are sorted by cell inside each file,
    so row groups can be skipped on `grid_id`.
    """
    (
        ensure_date(activity)
        .hint("rebalance", "date")
        .sortWithinPartitions("date", "grid_id", "timestamp")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(path)
    )


def write_parts(df: DataFrame, path: str, keys: list[str]) -> None:
    """Parquet parted by `keys`; a write replaces the parts it carries and leaves the others.

    The rebalance splits a heavy part over as many tasks as its size asks for;
    rows are sorted by cell inside each file.
    """
    order = [c for c in ("grid_id", "timestamp") if c in df.columns]
    (
        drop_geometry(df)
        .hint("rebalance", *keys)
        .sortWithinPartitions(*keys, *order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def write_clustered(hourly: DataFrame, path: str, rows_per_file: int = 1_000_000, row_group_bytes: int = 16 << 20) -> None:
    """Hours in Z-order of (cell, hour), with Bloom filters on the cell.

    Close cells and hours share files and row groups, whose ranges of both are
    narrow, so a scan for a cell, for a date, or for both skips most of them;
    the filters tell row groups that only span a cell from those that hold it.
    Filters on `date` and `hour` reach Parquet, those on a zone-free time stamp
    do not.
    """
    ends = hourly.agg(
        F.count("*").alias("n"), F.min("grid_id").alias("g0"), F.max("grid_id").alias("g1"), F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1")
    ).first()
    if not ends["n"]:
        hourly.write.mode("overwrite").parquet(path)
        return
    hours = hour_number(F.col("timestamp"))
    first, last = (hour_number(F.lit(ends[t]).cast("timestamp_ntz")) for t in ("t0", "t1"))
    code = morton(cell_of(F.col("grid_id"), F.lit(ends["g0"]), F.lit(float(ends["g1"] - ends["g0"]))), cell_of(hours, first, (last - first).cast("double")))
    (
        drop_geometry(hourly)
        .withColumn("_z", code)
        .repartitionByRange(-(-ends["n"] // rows_per_file), "_z")
        .sortWithinPartitions("_z")
        .drop("_z")
        .write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#grid_id", "true")
        .option("parquet.bloom.filter.expected.ndv#grid_id", str(min(rows_per_file, ends["g1"] - ends["g0"] + 1)))
        .option("parquet.block.size", str(row_group_bytes))
        .parquet(path)
    )


def write_table(df: DataFrame, path: str) -> None:
    """Plain Parquet table, geometry kept out."""
    drop_geometry(df).write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int) -> None:
    """Catalog table bucketed by cell: jobs that work by cell read it without a shuffle."""
    (
        drop_geometry(df)
        .repartition(buckets, "grid_id")
        .write.mode("overwrite")
        .option("path", path)
        .bucketBy(buckets, "grid_id")
        .sortBy("grid_id", "timestamp")
        .saveAsTable(table)
    )


def write_small_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for results already cut to a top-k."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def format_footprint(spark: SparkSession, csv_path: str, parquet_path: str) -> DataFrame:
    """Bytes of the same rows stored as CSV and Parquet, with the reduction."""

    def stored(path: str, suffix: str) -> DataFrame:
        return (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", f"*.{suffix}")
            .load(path)
            .agg(F.sum("length").alias("bytes"))
        )

    return spark.range(1).select(
        stored(csv_path, "csv").scalar().alias("csv_bytes"),
        stored(parquet_path, "parquet").scalar().alias("parquet_bytes"),
    ).withColumn(
        "reduction_pct",
        F.round((1 - F.col("parquet_bytes") / F.nullif(F.col("csv_bytes"), F.lit(0))) * 100, 2),
    )
