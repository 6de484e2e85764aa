"""Batch jobs: activity load, star load, features and scores.

Each job reads stored tables and writes stored tables. A table is written once
and read by all later steps, so a lost executor costs the tasks it ran and a
failed job restarts from its last written table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cellwatch.operators import alerts, anomaly, baselines, cleaning, features, geo, guards, model, ops, quality, rollup, star
from cellwatch.operators.tree import TreeModel
from cellwatch.runtime import discard, materialize
from cellwatch.schemas import GRID_ID_MAX, LANDING_PATTERN, MEASURES, MODEL_FEATURES
from cellwatch.sources import activity, landing, reference, sinks


LEDGER_SCHEMA = "filename string, status string, row_count bigint, reason string, digest string, file string, processed_at timestamp, load string"


@dataclass(frozen=True)
class Layout:
    """Table paths under one output folder.

    With `hourly_table` the hourly rows become a catalog table bucketed by
    cell, and the four signal jobs read it without shuffling it.
    """

    root: str
    hourly_table: str | None = None
    buckets: int = 200

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        if table in ("activity", "rejects", "hourly_parts"):
            return self.loaded(spark, table, self.committed(spark))
        if table == "hourly" and self.hourly_table:
            return spark.table(self.hourly_table)
        return spark.read.parquet(self.path(table))

    def loaded(self, spark: SparkSession, table: str, loads: list[str]) -> DataFrame:
        """Rows that the named loads brought to the activity, the rejects or the state of the hours."""
        rows = spark.read.parquet(self.path("hourly_parts" if table == "hourly_parts" else "loaded"))
        rows = rows.withColumn("load", F.col("load").cast("string")).where(F.col("load").isin(loads))
        if table == "hourly_parts":
            return rows
        rows = rows.where(F.col("kind") == ("clean" if table == "activity" else "rejected")).drop("kind")
        return rows.drop("reject_reason") if table == "activity" else rows

    def committed(self, spark: SparkSession) -> list[str]:
        """Loads that ended well, one short name each."""
        spark.createDataFrame([], "load string").write.mode("ignore").parquet(self.path("loads"))
        return sorted({r["load"] for r in spark.read.schema("load string").parquet(self.path("loads")).collect()})

    def write(self, df: DataFrame, table: str) -> None:
        if table == "hourly" and self.hourly_table:
            sinks.write_bucketed(df, self.hourly_table, self.path(table), self.buckets)
            return
        df.write.mode("overwrite").parquet(self.path(table))


def load_activity(raw: DataFrame, out: Layout, load: str = "load") -> dict[str, int]:
    """Add raw rows to the clean activity, the rejects and the hourly summary; dashboard CSV.

    Raw rows are read once, and written once as clean or rejected, parted by
    date and `load`. The roll-up of this load is kept as a mergeable state, and
    only the hours of its dates are made anew, from the states of those dates.
    A load that is repeated replaces what it wrote, for which `load` must name
    the same rows each time; one that failed counts for nothing.
    """
    spark = raw.sparkSession
    earlier = [name for name in out.committed(spark) if name != load]
    nulls = sum((F.col(m).isNull().cast("bigint") for m in MEASURES[1:]), F.col(MEASURES[0]).isNull().cast("bigint"))
    seen = Observation("raw rows")
    watched = raw.observe(
        seen,
        F.count(F.lit(1)).alias("rows_in"),
        F.coalesce(F.sum(cleaning.invalid().cast("bigint")), F.lit(0)).alias("rows_rejected"),
        F.coalesce(F.sum(nulls), F.lit(0)).alias("nulls_handled"),
    )
    kind = F.when(F.col("reject_reason").isNull(), "clean").otherwise("rejected")
    sinks.write_parts(cleaning.judged(watched).withColumns({"kind": kind, "load": F.lit(load)}), out.path("loaded"), ["kind", "date", "load"])
    parts = rollup.hourly_partials(out.loaded(spark, "activity", [load])).withColumn("load", F.lit(load))
    sinks.write_parts(parts, out.path("hourly_parts"), ["date", "load"])
    dates = [r["date"] for r in out.loaded(spark, "hourly_parts", [load]).select("date").distinct().collect()]  # days of this load
    touched = F.col("date").isin(dates)
    merge_hours(spark, out, [*earlier, load], touched)
    hours = out.read(spark, "hourly")
    clean = out.loaded(spark, "activity", [*earlier, load])
    guards.require_passed(quality.dq_grain(hours.where(touched), clean.where(touched)), true=("unique_grain", "reduced"))
    sinks.write_small_csv(rollup.dashboard_summary(hours), out.path("dashboard_csv"))
    if load not in out.committed(spark):
        spark.createDataFrame([(load,)], "load string").coalesce(1).write.mode("append").parquet(out.path("loads"))
    return dict(seen.get)


def merge_hours(spark: SparkSession, out: Layout, loads: list[str], touched: Column) -> None:
    """The hourly rows of the touched dates from the states of `loads`; other dates are neither read nor written.

    A bucketed table has no dates to replace and is written whole.
    """
    parts = out.loaded(spark, "hourly_parts", loads)
    if out.hourly_table:
        out.write(rollup.hourly_grid_summary(parts), "hourly")
    else:
        sinks.write_parts(rollup.hourly_grid_summary(parts.where(touched)), out.path("hourly"), ["date"])


def _ledger(spark: SparkSession, out: Layout, load: str) -> DataFrame:
    """Audit of the files of other loads that ended well; a load that is repeated does not know its own."""
    spark.createDataFrame([], LEDGER_SCHEMA).write.mode("ignore").partitionBy("load").parquet(out.path("audit"))
    others = [name for name in out.committed(spark) if name != load]
    return spark.read.schema(LEDGER_SCHEMA).parquet(out.path("audit")).where(F.col("load").isin(others))


def accept_landed(
    spark: SparkSession,
    folder: str,
    out: Layout,
    pattern: str = LANDING_PATTERN,
    grid_id_max: int = GRID_ID_MAX,
    load: str = "load",
    name: Callable[[Column], Column] = landing.file_name,
) -> DataFrame:
    """Gate over landed files; returns the typed rows of files accepted by this load alone.

    Files that an earlier load accepted are not read. Verdicts and audit are
    stored; the text is read and parsed once.
    """
    ledger = _ledger(spark, out, load)
    lines, names = landing.parse_folder(spark, folder, pattern, ledger.where(F.col("status") == "ACCEPTED"))
    headers = materialize(landing.file_headers(lines), "headers")
    found = landing.landing_verdicts(lines, headers, landing.unread_files(names, headers), grid_id_max)
    out.write(found.withColumn("filename", name(F.col("file"))), "verdicts")
    verdicts = out.read(spark, "verdicts")
    routed = landing.landing_route(verdicts, ledger).join(verdicts.select("filename", "file"), "filename")
    sinks.write_parts(landing.audit_records(routed).withColumn("load", F.lit(load)), out.path("audit"), ["load"])
    mine = spark.read.schema(LEDGER_SCHEMA).parquet(out.path("audit")).where(F.col("load") == load)
    return cleaning.standardize_types(landing.accepted_rows(lines, headers, mine.select("file", "status"), name))


def new_raw_rows(spark: SparkSession, folder: str, out: Layout, pattern: str = LANDING_PATTERN, load: str = "load") -> DataFrame:
    """Rows of the raw files of a folder that no other load holds; the files are recorded."""
    rows = activity.load_raw_network_data(spark, folder, pattern)
    names = spark.createDataFrame([(f,) for f in rows.inputFiles()], "file string")
    fresh = landing.unread_files(names, _ledger(spark, out, load))
    record = fresh.select(landing.file_name(F.col("file")).alias("filename"), F.lit("ACCEPTED").alias("status"), F.lit("not judged here").alias("reason"), "file")
    sinks.write_parts(landing.audit_records(record).withColumn("load", F.lit(load)), out.path("audit"), ["load"])
    return activity.only_files(rows, [r["p"] for r in fresh.select(activity.plain_path(F.col("file")).alias("p")).collect()])  # new files alone


def load_star(spark: SparkSession, out: Layout, grid_reference: DataFrame, reference_name: str) -> DataFrame:
    """Dimensions and fact from the hourly table; returns the key checks.

    Cells on one side only, unknown keys and broken keys stop the load.
    """
    hours = out.read(spark, "hourly")
    guards.require_none(geo.grid_set_difference(hours, grid_reference), "cells on one side only")
    sinks.write_table(geo.enrich_geo(hours, geo.area_centroids(grid_reference)), out.path("enriched"))
    out.write(star.dim_time(hours), "dim_time")
    out.write(star.dim_grid(grid_reference, reference_name), "dim_grid")
    times, grids = out.read(spark, "dim_time"), out.read(spark, "dim_grid")
    guards.require_none(star.unknown_keys(hours, times, grids), "unknown keys")
    out.write(star.fact_network_activity(hours, times, grids), "fact_network_activity")
    fact = out.read(spark, "fact_network_activity")
    guards.require_passed(rollup.control_totals(hours, fact).agg(F.bool_and("matches").alias("totals_match")), true=("totals_match",))
    keys = ("orphan_time_keys", "orphan_grid_keys", "duplicate_timestamps", "duplicate_grids")
    return guards.require_passed(quality.dq_foreign_keys(fact, times, grids, hours), zero=keys)


def load_signals(spark: SparkSession, out: Layout) -> None:
    """Alerts, features, model dataset and anomaly scores from the hourly table."""
    hours = out.read(spark, "hourly")
    guards.require_passed(
        quality.dq_source(hours), zero=("rows_with_nulls", "duplicate_rows", "negative_total", "negative_internet")
    )
    out.write(alerts.network_alerts(hours), "alerts")
    out.write(features.network_features(hours), "features")
    ranges = ("non_finite_rows", "duplicate_rows", "active_hours_out_of_range", "internet_share_out_of_range")
    guards.require_passed(quality.dq_features(out.read(spark, "features")), zero=ranges)
    # The split reads the hours of the dataset before its rows: stored, so that the windows run once.
    dataset = materialize(features.model_dataset(hours), "model-rows")
    out.write(model.chronological_split(dataset), "model_dataset")
    discard(dataset)
    out.write(anomaly.anomaly_scores(baselines.hour_bucket_baseline(hours)), "anomalies")


def score_risk(spark: SparkSession, out: Layout, model_version: str = "ML3-v1") -> TreeModel:
    """Train on the stored dataset, save the model, store scores and predictions."""
    dataset = out.read(spark, "model_dataset")
    fitted = model.train_risk_model(dataset)
    fitted.save(spark, out.path("risk_model"))
    _store_scores(spark, out, fitted, dataset, model_version)
    return fitted


def score_saved(spark: SparkSession, out: Layout, model_version: str = "ML3-v1", model_path: str | None = None) -> TreeModel:
    """Scores and predictions of the stored dataset by a saved model, whose inputs must be the dataset's features."""
    fitted = TreeModel.load(spark, model_path or out.path("risk_model"))
    wanted, dataset = fitted.inputs, out.read(spark, "model_dataset")
    if list(wanted) != MODEL_FEATURES or not set(wanted) <= set(dataset.columns):
        raise ValueError(f"the saved model takes other features: {wanted}")
    _store_scores(spark, out, fitted, dataset, model_version)
    return fitted


def _store_scores(spark: SparkSession, out: Layout, fitted: TreeModel, dataset: DataFrame, model_version: str) -> None:
    out.write(model.risk_scores(fitted, dataset, model_version), "risk_scores")
    checks = quality.dq_risk_scores(out.read(spark, "risk_scores"), dataset.agg(F.count("*")).scalar())
    complete = checks.withColumn("complete", F.col("row_count") == F.col("expected_rows"))
    guards.require_passed(
        complete,
        zero=("duplicate_rows", "rows_with_nulls", "score_out_of_range", "unknown_levels"),
        true=("single_version", "complete"),
    )
    out.write(model.serving_predictions(fitted, dataset), "predictions")


def compare_signals(spark: SparkSession, out: Layout, model_path: str | None = None) -> None:
    """Stored comparison of rule, model and anomaly, its counts, and the cells that need attention most."""
    fitted = TreeModel.load(spark, model_path or out.path("risk_model"))
    out.write(anomaly.signals(out.read(spark, "hourly"), fitted.probability()), "signals")
    sinks.write_small_csv(anomaly.signal_overlap_metrics(out.read(spark, "signals")), out.path("signal_metrics_csv"))
    out.write(ops.top_attention(out.read(spark, "risk_scores"), out.read(spark, "anomalies")), "top_attention")


def publish(spark: SparkSession, out: Layout, run_id: str, counts: dict[str, int], now: Column | None = None, done: tuple[str, ...] = ()) -> DataFrame:
    """Publication gate and the status record of the run; `done` names further steps that are over."""
    gate = quality.dq_publish(
        out.read(spark, "fact_network_activity"),
        out.read(spark, "dim_time"),
        out.read(spark, "features"),
        out.read(spark, "risk_scores"),
    )
    stamp = now if now is not None else F.localtimestamp()
    outcome = F.when(F.col("publishable"), "SUCCESS").otherwise("FAILED")
    record = gate.select(
        F.lit(run_id).alias("run_id"),
        stamp.alias("run_timestamp"),
        outcome.alias("status"),
        F.create_map(*[F.lit(x) for step in (*done, "load") for x in (step, "SUCCESS")], F.lit("quality_check"), outcome).alias("per_task_status"),
        *[F.lit(counts[c]).cast("bigint").alias(c) for c in ("rows_in", "rows_rejected", "nulls_handled")],
        "rows_published",
        F.col("as_of").alias("AS_OF"),
    )
    reference.write_status(record, out.path("status"))
    return reference.read_status(spark, out.path("status"), multiline=False)


def record_failure(spark: SparkSession, out: Layout, run_id: str, done: list[str], failed: str, rest: list[str], counts: dict[str, int], now: Column | None = None) -> None:
    """Status record of a run that stopped: earlier steps SUCCESS, later ones NOT_RUN."""
    tasks = {**dict.fromkeys(done, "SUCCESS"), failed: "FAILED", **dict.fromkeys(rest, "NOT_RUN")}
    record = spark.range(1).select(
        F.lit(run_id).alias("run_id"),
        (now if now is not None else F.localtimestamp()).alias("run_timestamp"),
        F.lit("FAILED").alias("status"),
        F.create_map(*[F.lit(x) for pair in tasks.items() for x in pair]).alias("per_task_status"),
        *[F.lit(counts.get(c)).cast("bigint").alias(c) for c in ("rows_in", "rows_rejected", "nulls_handled")],
        F.lit(0).cast("bigint").alias("rows_published"),
        F.lit(None).cast("timestamp_ntz").alias("AS_OF"),
    )
    reference.write_status(record, out.path("status"))


def run(
    spark: SparkSession,
    raw: Callable[[], DataFrame],
    cells: Callable[[], DataFrame],
    reference_name: str,
    out: Layout,
    run_id: str,
    now: Column | None = None,
    saved_model: str | None = None,
) -> DataFrame:
    """All jobs over the raw rows of a run, on top of what earlier runs loaded; returns the status record.

    The rows are made inside the first step, so that a gate that fails there is
    recorded. A step that raises leaves a FAILED record, and the error goes on.
    With `saved_model`, the folder of a model that an earlier run saved, hours
    are scored by it and nothing is trained.
    """
    counts: dict[str, int] = {}
    score = (lambda: score_saved(spark, out, model_path=saved_model)) if saved_model else (lambda: score_risk(spark, out))
    steps: dict[str, Callable[[], object]] = {
        "load": lambda: counts.update(load_activity(raw(), out, run_id)),
        "star": lambda: load_star(spark, out, cells(), reference_name),
        "signals": lambda: load_signals(spark, out),
        "score": score,
        "compare": lambda: compare_signals(spark, out, saved_model),
        "quality_check": lambda: publish(spark, out, run_id, counts, now, ("star", "signals", "score", "compare")),
    }
    names, record = list(steps), None
    for place, (name, step) in enumerate(steps.items()):
        try:
            record = step()
        except Exception:
            record_failure(spark, out, run_id, names[:place], name, names[place + 1 :], counts, now)
            raise
    return record


def _cells(spark: SparkSession, geojson: str, out: Layout, multiline: bool = True) -> DataFrame:
    """Cells of a GeoJSON reference; features that are left out are stored with the reason."""
    found = reference.read_features(spark, geojson, multiline)
    out.write(reference.rejected_features(found), "rejected_features")
    return reference.one_per_cell(reference.grid_reference(found))


def run_day(spark: SparkSession, folder: str, geojson: str, root: str, run_id: str, saved_model: str | None = None) -> DataFrame:
    """All jobs over the files of a folder that no earlier run loaded and that passed the gate elsewhere."""
    out = Layout(root)
    rows = lambda: new_raw_rows(spark, folder, out, load=run_id)
    return run(spark, rows, lambda: _cells(spark, geojson, out), geojson.rsplit("/", 1)[-1], out, run_id, saved_model=saved_model)


def run_landed(
    spark: SparkSession,
    folder: str,
    geojson: str,
    root: str,
    run_id: str,
    pattern: str = LANDING_PATTERN,
    grid_id_max: int = GRID_ID_MAX,
    saved_model: str | None = None,
    name: Callable[[Column], Column] = landing.file_name,
    multiline: bool = True,
    now: Column | None = None,
) -> DataFrame:
    """All jobs over a landing folder: rows of rejected files never reach the tables, files loaded before are not read."""
    out = Layout(root)
    rows = lambda: accept_landed(spark, folder, out, pattern, grid_id_max, run_id, name)
    return run(spark, rows, lambda: _cells(spark, geojson, out, multiline), geojson.rsplit("/", 1)[-1], out, run_id, now, saved_model)
