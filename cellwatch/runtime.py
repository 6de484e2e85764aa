"""Session settings and shared scratch storage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "cellwatch", master: str | None = None, partitions: int | None = None, initial_partitions: int = 2000) -> SparkSession:
    """Session with the settings the operators are tuned for.

    On a cluster shuffles start with `initial_partitions`, which adaptive
    execution merges but never splits: size it to the largest shuffle, about
    128 MB a partition. `partitions` is the fixed small number of local runs.

    Adaptive execution coalesces small shuffle partitions, splits skewed join
    partitions and turns joins into broadcasts from measured sizes.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    else:
        builder = builder.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(initial_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the cluster's `spark.checkpoint.dir`."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return folder


def local_scratch(spark: SparkSession) -> SparkSession:
    """Name a scratch folder for a local session that has none.

    Tests, benchmark and entry call this; a cluster must name its own folder.
    The folder goes when the process ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and spark.sparkContext.master.startswith("local["):
        folder = tempfile.mkdtemp(prefix="cellwatch-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the application's part of the shared folder.

    Who owns the shared folder clears it, as with any checkpoint folder.
    """
    return f"{shared_dir(spark)}/cellwatch-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once and read it back: a restart point for several readers."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.scratch = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete tables of `materialize` that nothing reads any more, so that later steps have their disk."""
    for table in stored:
        context = table.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(table.scratch)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
