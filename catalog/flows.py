"""Whole jobs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sources
from catalog import views as v
from catalog.core import query, rounded
from cellwatch import runtime
from cellwatch.plans import batch

D = v.dirty_sql()
CLEAN = f"SELECT * FROM ({D}) WHERE NOT {v.INVALID_SQL}"
FILLED = f"SELECT timestamp, grid_id, {', '.join(f'coalesce({m}, 0) AS {m}' for m in v.MEASURES)} FROM ({CLEAN})"
HC = v.hourly_sql(source=FILLED)


@query(
    "activity_load",
    rounded(
        f"""SELECT (SELECT count(*) FROM ({D})) AS rows_in, (SELECT count(*) FROM ({D}) WHERE {v.INVALID_SQL}) AS rows_rejected,
              count(*) AS hourly_rows, sum(total_activity) AS total_activity FROM ({HC})""",
        "total_activity",
        "rows_in, rows_rejected, hourly_rows",
    ),
)
def _(spark, sf):
    out = batch.Layout(runtime.scratch_path(spark, "load"))
    counts = batch.load_activity(v.dirty_telemetry(spark, sf).drop("event_id"), out)
    return out.read(spark, "hourly").agg(
        *[F.lit(counts[c]).cast("bigint").alias(c) for c in ("rows_in", "rows_rejected")],
        F.count("*").alias("hourly_rows"),
        F.sum("total_activity").alias("total_activity"),
    )


@query(
    "published_run",
    f"""SELECT 'run-1' AS run_id, 'SUCCESS' AS status, count(*) AS rows_in, CAST(0 AS BIGINT) AS rows_rejected, CAST(0 AS BIGINT) AS nulls_handled,
          (SELECT count(*) FROM ({v.hourly_sql(v.DENSE)})) AS rows_published, max(timestamp) AS "AS_OF" FROM ({v.telemetry_sql(v.DENSE)})""",
)
def _(spark, sf):
    """Raw rows to published tables: load, star, signals, model, gate, status."""
    out = batch.Layout(runtime.scratch_path(spark, "run"))
    counts = batch.load_activity(v.telemetry(spark, sf, v.DENSE), out)
    batch.load_star(spark, out, v.grid_cells(spark, sf, v.DENSE), "milano-grid.geojson")
    batch.load_signals(spark, out)
    batch.score_risk(spark, out)
    record = batch.publish(spark, out, "run-1", counts, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return record.select("run_id", "status", "rows_in", "rows_rejected", "nulls_handled", "rows_published", "AS_OF")


_HOURLY = "sms_in sms_out call_in call_out internet_activity total_sms total_calls total_activity internet_share"


@query(
    "incremental_load",
    rounded(HC, _HOURLY, "timestamp, grid_id, hour, day_of_week, CAST(date AS VARCHAR) AS date"),
)
def _(spark, sf):
    """Hours after three loads that share dates, one of them repeated: those of one load of all rows."""
    out = batch.Layout(runtime.scratch_path(spark, "increments"))
    rows = v.dirty_telemetry(spark, sf)
    early, odd = F.dayofmonth("timestamp") <= 10, F.col("event_id") % 2 == 1
    loads = {"first": F.coalesce(early, F.lit(True)) & ~odd, "late": F.coalesce(early, F.lit(True)) & odd, "rest": ~early}
    for name in ("first", "rest", "late", "rest"):
        batch.load_activity(rows.where(loads[name]).drop("event_id"), out, name)
    return out.read(spark, "hourly")


# Files of the landed run: a day's file of the dense telemetry each; the ninth day's holds a bad cell.
_LANDED_CELLS = v.telemetry_sql(v.DENSE)
_KEPT = f"SELECT * FROM ({_LANDED_CELLS}) WHERE dayofmonth(timestamp) <> 9"


@query(
    "landed_run",
    f"""SELECT 'run-2' AS run_id, 'SUCCESS' AS status, (SELECT count(*) FROM ({_KEPT}) WHERE dayofmonth(timestamp) > 20) AS rows_in, CAST(0 AS BIGINT) AS rows_rejected,
          (SELECT count(*) FROM ({v.hourly_sql(source=_KEPT)})) AS rows_published, max(timestamp) AS "AS_OF",
          (SELECT count(DISTINCT CAST(timestamp AS DATE)) FROM ({_KEPT})) AS accepted_files, 1::BIGINT AS rejected_files, TRUE AS saved_model_scored, TRUE AS signals_complete
        FROM ({_KEPT})""",
)
def _(spark, sf):
    """A first load trains the model; a run over the same folder later takes the new files alone and scores by the saved model."""
    folder, root, geojson = (runtime.scratch_path(spark, n) for n in ("landed-files", "landed-out", "landed-grid"))
    rows = v._spread(v._events(spark, sf, v.DENSE))
    v.feature_documents(rows.select("grid_id").distinct()).write.text(geojson)
    day = F.dayofmonth("timestamp")
    # One file a day; the record of least id carries the fault.
    faulty = F.col("event_id") == rows.where(day == 9).agg(F.min("event_id")).scalar()
    files = rows.withColumns(
        {
            "landing_file": F.concat(F.lit("sms-call-internet-mi-"), F.to_date("timestamp").cast("string"), F.lit(".csv")),
            "day": day,
            "grid_id": F.when(faulty, "x").otherwise(F.col("grid_id").cast("string")),
            "timestamp": F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"),
        }
    )

    def land(rows) -> None:
        sources._write_files(sources._raw_names(rows.drop("day")), folder)

    out, now = batch.Layout(root), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    # The gate's grid is that of the view, which outgrows the default one.
    last = v.grid_size(spark, sf, v.DENSE)
    land(files.where("day <= 20"))
    batch.load_activity(batch.accept_landed(spark, folder, out, sources.PATTERN, last, "run-1", sources._landed_name), out, "run-1")
    batch.load_signals(spark, out)
    batch.score_risk(spark, out)
    land(files.where("day > 20"))
    record = batch.run_landed(
        spark, folder, geojson, root, "run-2", sources.PATTERN, last, saved_model=out.path("risk_model"), name=sources._landed_name, multiline=False, now=now
    )
    audit = spark.read.parquet(out.path("audit"))
    seen = audit.agg(F.count_if(F.col("status") == "ACCEPTED").alias("a"), F.count_distinct(F.when(F.col("status") == "REJECTED", F.col("filename"))).alias("r"))
    scored = out.read(spark, "risk_scores").count() == out.read(spark, "model_dataset").count()
    complete = out.read(spark, "signals").count() == out.read(spark, "anomalies").count() == out.read(spark, "hourly").count()
    return record.select(
        "run_id", "status", "rows_in", "rows_rejected", "rows_published", "AS_OF",
        seen.select("a").scalar().alias("accepted_files"), seen.select("r").scalar().alias("rejected_files"),
        F.lit(scored).alias("saved_model_scored"), F.lit(complete).alias("signals_complete"),
    )


@query(
    "failed_run",
    f"""SELECT 'run-2' AS run_id, 'FAILED' AS status, 'SUCCESS' AS load, 'FAILED' AS star, 'NOT_RUN' AS quality_check, count(*) AS rows_in,
          CAST(0 AS BIGINT) AS rows_published FROM ({v.telemetry_sql(v.DENSE)})""",
)
def _(spark, sf):
    """A run that stops at the star, as its reference lacks a cell: the record of what ran and what did not."""
    out = batch.Layout(runtime.scratch_path(spark, "failed"))
    cells = v.grid_cells(spark, sf, v.DENSE).where("grid_id <> 1")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    try:
        batch.run(spark, lambda: v.telemetry(spark, sf, v.DENSE), lambda: cells, "milano-grid.geojson", out, "run-2", now)
    except AssertionError:
        pass
    record = batch.reference.read_status(spark, out.path("status"), multiline=False)
    tasks = [F.col("per_task_status")[t].alias(t) for t in ("load", "star", "quality_check")]
    return record.select("run_id", "status", *tasks, "rows_in", "rows_published")
