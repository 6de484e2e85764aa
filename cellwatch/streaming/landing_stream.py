"""Unattended landing: a checkpointed file stream over the landing folder.

Files are moved into the folder complete. Each run takes those not seen before,
reads and parses them once into a stored table, judges every file whole, appends
the audit and stores accepted rows. The audit is the state that is kept between
runs: a file sent again, under its name or with the same lines under another, is
skipped. Outputs are keyed by micro-batch, so a batch that is retried after a
failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cellwatch import runtime
from cellwatch.schemas import GRID_ID_MAX, LANDING_PATTERN, RAW_TO_CANONICAL
from cellwatch.sources import landing

AUDIT_SCHEMA = "filename string, status string, row_count bigint, reason string, digest string, processed_at timestamp, batch_id bigint"
ROWS_SCHEMA = "source_file string, " + ", ".join(f"{c} string" for c in RAW_TO_CANONICAL.values()) + ", batch_id bigint"


def start_landing(
    spark: SparkSession,
    folder: str,
    audit_path: str,
    raw_path: str,
    checkpoint: str,
    pattern: str = LANDING_PATTERN,
    grid_id_max: int = GRID_ID_MAX,
    name: Callable[[Column], Column] = landing.file_name,
) -> StreamingQuery:
    """Process all files that are new since the last run, then stop. `name` gives a file's name from its path."""
    # A streaming file source takes a folder; the pattern filters file names.
    stream = (
        spark.readStream.format("text")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select(
            F.col("value"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
        )
    )

    def run(batch: DataFrame, batch_id: int) -> None:
        # The file source hands on no trace of files without bytes.
        land_batch(batch, batch_id, audit_path, raw_path, landing.empty_files(batch.sparkSession, folder, pattern), grid_id_max, name)

    ensure_audit(spark, audit_path)
    ensure_rows(spark, raw_path)
    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def land_batch(
    batch: DataFrame,
    batch_id: int,
    audit_path: str,
    raw_path: str,
    empty: DataFrame,
    grid_id_max: int = GRID_ID_MAX,
    name: Callable[[Column], Column] = landing.file_name,
) -> None:
    """Judge, record and store the files of one micro-batch, whose text is read once.

    `empty` names files without bytes, of which those that the audit knows are
    left out.
    """
    session = batch.sparkSession
    lines, names = landing.parse_text(batch)
    headers = runtime.materialize(landing.file_headers(lines), "headers")
    audit = read_audit(session, audit_path).where(F.col("batch_id") != batch_id)
    named = name(F.col("file"))
    new_empty = empty.withColumn("filename", named).join(audit.select("filename"), "filename", "left_anti").select("file")
    unread = landing.unread_files(names.unionByName(new_empty).distinct(), headers)
    verdicts = landing.landing_verdicts(lines, headers, unread, grid_id_max).withColumn("filename", named)
    verdicts = runtime.materialize(verdicts, "verdicts")
    records = landing.audit_records(landing.landing_route(verdicts, audit)).withColumn("batch_id", F.lit(batch_id))
    replace_batch(records, audit_path)
    # The stored audit decides what is kept, so both outputs agree.
    stored = read_audit(session, audit_path).where(F.col("batch_id") == batch_id)
    kept = stored.join(verdicts.select("filename", "file"), "filename").select("file", "status")
    replace_batch(landing.accepted_rows(lines, headers, kept, name).withColumn("batch_id", F.lit(batch_id)), raw_path)


def replace_batch(df: DataFrame, path: str) -> None:
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


def ensure_audit(spark: SparkSession, path: str) -> None:
    """An empty audit table where there is none yet; an existing one stays."""
    spark.createDataFrame([], AUDIT_SCHEMA).write.mode("ignore").partitionBy("batch_id").parquet(path)


def ensure_rows(spark: SparkSession, path: str) -> None:
    """An empty table of accepted rows where there is none yet; an existing one stays."""
    spark.createDataFrame([], ROWS_SCHEMA).write.mode("ignore").partitionBy("batch_id").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).parquet(path)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of accepted files; none where no file was accepted, which leaves no file to take a schema from."""
    return spark.read.schema(ROWS_SCHEMA).parquet(path)
