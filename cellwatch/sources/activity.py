"""Raw activity files and processed Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwatch.schemas import LANDING_PATTERN, RAW_CSV_SCHEMA, RAW_TO_CANONICAL


def scan_csv_raw(spark: SparkSession, folder: str, pattern: str = LANDING_PATTERN) -> DataFrame:
    """Daily files of a folder under the fixed schema; bad cells become NULL."""
    return (
        spark.read.schema(RAW_CSV_SCHEMA)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(f"{folder}/{pattern}")
    )


def canonical_columns(raw: DataFrame) -> DataFrame:
    """Raw column names to canonical ones."""
    return raw.withColumnsRenamed(RAW_TO_CANONICAL)


def with_source_file(df: DataFrame) -> DataFrame:
    """Tag each row with the file it was read from."""
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def load_raw_network_data(spark: SparkSession, folder: str, pattern: str = LANDING_PATTERN) -> DataFrame:
    """Scan, tag and rename in one step."""
    return canonical_columns(with_source_file(scan_csv_raw(spark, folder, pattern)))


def plain_path(path: Column) -> Column:
    """Path without scheme, as listings and scans spell it with one slash or with three."""
    return F.regexp_replace(path, "^[a-zA-Z0-9+.-]+:/+", "/")


def only_files(rows: DataFrame, names: list[str], path: str = "source_file") -> DataFrame:
    """Rows of the named files; the scan lists the others but does not read them."""
    return rows.where(plain_path(F.col(path)).isin(names))


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
