"""Scan, landing and sink queries over files Spark writes from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views as v
from catalog.core import query, rounded
from cellwatch import runtime
from cellwatch.operators import cleaning, rollup
from cellwatch.schemas import LANDING_PATTERN, MEASURES, RAW_MEASURES, RAW_TO_CANONICAL
from cellwatch.sources import activity, landing, reference, sinks
from cellwatch.streaming import landing_stream

H = v.hourly_sql()
D = v.dirty_sql()
M = " ".join(MEASURES)
KEYS = "timestamp, grid_id, country_code"
DATE = "CAST(date AS VARCHAR) AS date"

# A daily file holds at most this many records; a busier day has more files.
FILE_RECORDS = 1_000_000
# Written files sit one to a folder that carries the daily file's name.
FOLDER = "landing_file="
PATTERN = FOLDER + LANDING_PATTERN
FILE_SQL = f"'sms-call-internet-mi-' || strftime(timestamp, '%Y-%m-%d') || '-' || CAST(event_id // {FILE_RECORDS} AS VARCHAR) || '.csv'"


def _file(day: Column) -> Column:
    shard = F.floor(F.col("event_id") / FILE_RECORDS).cast("string")
    return F.concat(F.lit("sms-call-internet-mi-"), day.cast("string"), F.lit("-"), shard, F.lit(".csv"))


def _landed_name(path: Column) -> Column:
    return F.regexp_extract(path, FOLDER + "([^/]+)", 1)


def _write_files(rows: DataFrame, path: str) -> None:
    """One CSV file per name, records in event order."""
    (
        rows.repartition("landing_file")
        .sortWithinPartitions("landing_file", "event_id")
        .drop("event_id")
        .write.mode("append")
        .partitionBy("landing_file")
        .option("header", True)
        .csv(path)
    )


def _raw_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({canonical: raw for raw, canonical in RAW_TO_CANONICAL.items()})


def _activity_folder(spark: SparkSession, sf: str) -> str:
    """Raw daily files of the dirty telemetry."""
    k = F.col("country_code")
    source = v._events(spark, sf, None)
    value = F.when(k % 20 == 7, F.lit(None)).when(k % 50 == 13, -F.col("v")).otherwise(F.col("v"))
    rows = (
        v._spread(source.withColumn("v", value.cast("decimal(18,2)")))
        .withColumn("landing_file", _file(F.to_date("timestamp")))
        .withColumn("timestamp", F.when(k % 50 != 41, F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")))
        .withColumn("grid_id", F.when(k % 50 != 31, F.col("grid_id")))
    )
    path = runtime.scratch_path(spark, "activity-csv")
    _write_files(_raw_names(rows), path)
    return path


RAW_SELECT = ", ".join(f"{c} AS {r}" for r, c in RAW_TO_CANONICAL.items())


@query("scan_csv_raw", rounded(f"SELECT {RAW_SELECT} FROM ({D})", " ".join(RAW_MEASURES), "datetime, CellID, countrycode"))
def _(spark, sf):
    return activity.scan_csv_raw(spark, _activity_folder(spark, sf), PATTERN)


@query("canonical_columns", rounded(D, M, KEYS))
def _(spark, sf):
    return activity.canonical_columns(activity.scan_csv_raw(spark, _activity_folder(spark, sf), PATTERN))


@query(
    "source_file_profile",
    f"""SELECT {FILE_SQL} AS source_file, count(*) AS records, CAST(0 AS BIGINT) AS null_names FROM ({v.telemetry_sql()}) GROUP BY 1""",
)
def _(spark, sf):
    rows = activity.load_raw_network_data(spark, _activity_folder(spark, sf), PATTERN)
    return rows.groupBy(_landed_name(F.col("source_file")).alias("source_file")).agg(
        F.count("*").alias("records"), F.count_if(F.col("source_file").isNull()).alias("null_names")
    )


@query(
    "ingestion_profile",
    f"""SELECT count(*) AS row_count, count(DISTINCT f) AS file_count, count(DISTINCT grid_id) AS grid_count,
          count(DISTINCT country_code) AS country_code_count, count(DISTINCT timestamp) AS timestamp_count,
          count(*) FILTER (WHERE grid_id NOT BETWEEN 1 AND 10000) AS invalid_grid_count, CAST(0 AS BIGINT) AS null_filename_count,
          count(DISTINCT f) * 24 AS expected_timestamp_count
        FROM (SELECT d.*, t.f FROM ({D}) d JOIN (SELECT event_id, {FILE_SQL} AS f FROM ({v.telemetry_sql()})) t USING (event_id))""",
)
def _(spark, sf):
    rows = activity.load_raw_network_data(spark, _activity_folder(spark, sf), PATTERN)
    return rollup.ingestion_profile(rows)


# ---------------------------------------------------------------- landing zone


def _landing_folder(spark: SparkSession, sf: str) -> str:
    """Daily files with one kind of fault each by day of month.

    Faults sit in the records' text; on every seventh day the files lack the
    internet column.
    """
    path = runtime.scratch_path(spark, "landing")
    _land(spark, sf, path)
    return path


def _land(spark: SparkSession, sf: str, path: str, days: Column | None = None, prefix: str = "") -> None:
    """Write the files of some days, or of all, under names with `prefix`."""
    k, day = F.col("country_code"), F.dayofmonth("timestamp")
    events = v._events(spark, sf, None)
    if days is not None:
        events = events.where(days)
    negated = F.when((day % 5 == 0) & (k % 50 == 13), -F.col("v")).otherwise(F.col("v"))
    rows = (
        v._spread(events.withColumn("v", negated.cast("decimal(18,2)")))
        .withColumn("landing_file", F.concat(F.lit(prefix), _file(F.to_date("timestamp"))))
        .withColumn("_no_internet", day % 7 == 3)
        .withColumn("sms_in", F.when((day % 5 == 3) & (k % 50 == 3), F.lit("x")).otherwise(F.col("sms_in").cast("string")))
        .withColumn("grid_id", F.when((day % 5 != 1) | (k % 50 != 31), F.col("grid_id")))
        .withColumn(
            "timestamp",
            F.when((day % 5 == 2) & (k % 50 == 41), F.lit("bad")).otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")),
        )
    )
    rows = _raw_names(rows)
    _write_files(rows.where(~F.col("_no_internet")).drop("_no_internet"), path)
    _write_files(rows.where("_no_internet").drop("_no_internet", "internet"), path)


_LANDED = f"""
  SELECT event_id, dayofmonth(timestamp) AS d, country_code AS k, {FILE_SQL} AS file,
    row_number() OVER (PARTITION BY {FILE_SQL} ORDER BY event_id) + 1 AS n, grid_id, event_type, v
  FROM ({v._events_sql(None)})"""
_COLUMN = "CASE event_type WHEN 'click' THEN 'smsin' WHEN 'view' THEN 'smsout' WHEN 'purchase' THEN 'callin' WHEN 'signup' THEN 'callout' ELSE 'internet' END"
_FAULT = f"""
  CASE WHEN d % 5 = 2 AND k % 50 = 41 THEN 'malformed datetime at row ' || n || ': bad'
       WHEN d % 5 = 1 AND k % 50 = 31 THEN 'missing CellID at row ' || n
       WHEN grid_id > 10000 AND NOT (d % 5 = 1 AND k % 50 = 31) THEN 'CellID outside 1-10000 at row ' || n || ': ' || grid_id
       WHEN d % 5 = 3 AND k % 50 = 3 THEN 'non-numeric smsin at row ' || n || ': x'
       WHEN d % 5 = 0 AND k % 50 = 13 AND v > 0 THEN 'negative ' || {_COLUMN} || ' at row ' || n || ': ' || CAST(CAST(-v AS DOUBLE) AS VARCHAR)
  END"""
GATE = f"""
  SELECT file, bool_and(fault IS NULL) AS quality_ok, coalesce(min(n) FILTER (WHERE fault IS NOT NULL) - 1, count(*)) AS row_count,
    coalesce('QUALITY_VALIDATION_FAILED: ' || arg_min(fault, n) FILTER (WHERE fault IS NOT NULL), 'quality_valid') AS reason
  FROM (SELECT *, {_FAULT} AS fault FROM ({_LANDED})) GROUP BY file"""
_MISSING = "SCHEMA_VALIDATION_FAILED: missing required columns: internet"
SCHEMA = f"""
  SELECT DISTINCT file, d % 7 <> 3 AS schema_ok, CASE WHEN d % 7 = 3 THEN '{_MISSING}' ELSE 'schema_valid' END AS reason FROM ({_LANDED})"""
VERDICT = f"""
  SELECT s.file AS filename, schema_ok AND quality_ok AS valid, CASE WHEN schema_ok THEN row_count ELSE 0 END AS row_count,
    CASE WHEN schema_ok THEN g.reason ELSE s.reason END AS reason
  FROM ({SCHEMA}) s JOIN ({GATE}) g ON s.file = g.file"""
_EARLIER = "filename < 'sms-call-internet-mi-2024-01-16'"
_STATUS = "CASE WHEN valid THEN 'ACCEPTED' ELSE 'REJECTED' END"
ROUTED = f"""
  SELECT filename, CASE WHEN {_EARLIER} THEN 'SKIPPED' ELSE {_STATUS} END AS status, row_count,
    CASE WHEN {_EARLIER} THEN 'Already processed; existing file: ' || filename ELSE reason END AS reason
  FROM ({VERDICT})"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return landing.landing_lines(spark, _landing_folder(spark, sf), PATTERN)


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    verdicts = landing.judge_folder(spark, _landing_folder(spark, sf), PATTERN)
    return verdicts.select(_landed_name(F.col("file")).alias("filename"), "valid", "row_count", "reason")


def _earlier_run(spark: SparkSession, verdicts: DataFrame) -> DataFrame:
    """Audit of a run over the files of the first half of the month."""
    nothing = spark.createDataFrame([], "filename string, status string")
    earlier = verdicts.where(F.col("filename") < "sms-call-internet-mi-2024-01-16")
    return landing.landing_route(earlier, nothing)


@query("landing_schema_check", SCHEMA)
def _(spark, sf):
    check = landing.landing_schema_check(landing.file_headers(_lines(spark, sf)))
    return check.withColumn("file", _landed_name(F.col("file")))


@query("landing_quality_gate", GATE)
def _(spark, sf):
    lines = _lines(spark, sf)
    gate = landing.landing_quality_gate(lines, landing.file_headers(lines))
    return gate.withColumn("file", _landed_name(F.col("file"))).drop("digest")


@query("landing_verdicts", VERDICT)
def _(spark, sf):
    return _verdicts(spark, sf)


@query("landing_route", ROUTED)
def _(spark, sf):
    verdicts = runtime.materialize(_verdicts(spark, sf), "verdicts")
    return landing.landing_route(verdicts, _earlier_run(spark, verdicts))


@query(
    "ingestion_audit",
    f"""SELECT status, count(*) AS files, CAST(sum(row_count) AS BIGINT) AS rows FROM (
          SELECT {_STATUS} AS status, row_count FROM ({VERDICT}) WHERE {_EARLIER}
          UNION ALL SELECT status, row_count FROM ({ROUTED})) GROUP BY status""",
)
def _(spark, sf):
    path = runtime.scratch_path(spark, "audit")
    verdicts = runtime.materialize(_verdicts(spark, sf), "verdicts")
    landing.append_audit(landing.audit_records(_earlier_run(spark, verdicts)), path)
    landing.append_audit(landing.audit_records(landing.landing_route(verdicts, spark.read.parquet(path))), path)
    return landing.audit_counts(spark.read.parquet(path))


_AGAIN = "substr(filename, 22, 10) <= '2024-01-12'"


@query(
    "landing_stream",
    f"""SELECT status, count(*) AS files, CAST(sum(row_count) AS BIGINT) AS rows, CAST(sum(stored) AS BIGINT) AS stored_rows FROM (
          SELECT {_STATUS} AS status, row_count, CASE WHEN valid THEN row_count ELSE 0 END AS stored FROM ({VERDICT})
          UNION ALL SELECT CASE WHEN valid THEN 'SKIPPED' ELSE 'REJECTED' END, row_count, 0 FROM ({VERDICT}) WHERE {_AGAIN})
        GROUP BY status""",
)
def _(spark, sf):
    """Two runs of the landing stream: all files, and then some of them again under other names."""
    folder, audit, raw, state = (runtime.scratch_path(spark, n) for n in ("stream-landing", "stream-audit", "stream-raw", "stream-state"))

    def run() -> None:
        stream = landing_stream.start_landing(spark, folder, audit, raw, state, "*.csv", name=_landed_name)
        stream.awaitTermination()

    _land(spark, sf, folder)
    run()
    _land(spark, sf, folder, F.dayofmonth("timestamp") <= 12, "sms-call-internet-mi-again-")
    run()
    stored = landing_stream.read_rows(spark, raw).groupBy("source_file").agg(F.count("*").alias("stored"))
    files = landing_stream.read_audit(spark, audit).join(stored, F.col("filename") == F.col("source_file"), "left")
    return files.groupBy("status").agg(F.count("*").alias("files"), F.sum("row_count").alias("rows"), F.sum(F.coalesce("stored", F.lit(0))).alias("stored_rows"))


# -------------------------------------------------------- reference and status


@query(
    "grid_reference",
    rounded(
        f"""SELECT grid_id, 'Polygon' AS geometry_type, 5 AS vertices, x0 AS first_longitude, y0 AS first_latitude,
              x1 AS max_longitude, y1 AS max_latitude FROM ({v.cells_sql()})""",
        "first_longitude first_latitude max_longitude max_latitude",
        "grid_id, geometry_type, vertices",
    ),
)
def _(spark, sf):
    from cellwatch.functions import geometry as geo

    shape = F.col("geometry")
    return v.grid_cells(spark, sf).select(
        "grid_id",
        "geometry_type",
        F.size(geo.points(shape)).alias("vertices"),
        shape[0][0][0][0].alias("first_longitude"),
        shape[0][0][0][1].alias("first_latitude"),
        geo.bounds(shape)["max_lon"].alias("max_longitude"),
        geo.bounds(shape)["max_lat"].alias("max_latitude"),
    )


def status_records(spark: SparkSession, sf: str) -> DataFrame:
    """One run record per day of dirty telemetry, counts from the data.

    A day with over 4% rejects fails its cleaning task.
    """
    rows = v._events(spark, sf, None).select(F.to_date("timestamp").alias("date"), "timestamp", (F.col("country_code") % 50).alias("k"), F.col("country_code").alias("c"))
    daily = rows.groupBy("date").agg(
        F.count("*").alias("rows_in"),
        F.count_if(F.col("k").isin(13, 31, 41)).alias("rows_rejected"),
        F.count_if(F.col("c") % 20 == 7).alias("nulls_handled"),
        F.max("timestamp").alias("AS_OF"),
    )
    failed = F.col("rows_rejected") * 100 > F.col("rows_in") * 6
    return daily.select(
        F.concat(F.lit("run-"), F.col("date").cast("string")).alias("run_id"),
        (F.col("AS_OF") + F.make_dt_interval(hours=F.lit(1))).alias("run_timestamp"),
        F.when(failed, "FAILED").otherwise("SUCCESS").alias("status"),
        F.create_map(
            F.lit("ingest"), F.lit("SUCCESS"),
            F.lit("clean"), F.when(failed, "FAILED").otherwise("SUCCESS"),
            F.lit("publish"), F.when(failed, "SKIPPED").otherwise("SUCCESS"),
        ).alias("per_task_status"),
        "rows_in",
        "rows_rejected",
        "nulls_handled",
        (F.col("rows_in") - F.col("rows_rejected")).alias("rows_published"),
        "AS_OF",
    )


STATUS_SQL = f"""
  SELECT 'run-' || CAST(date AS VARCHAR) AS run_id, as_of + INTERVAL 1 HOUR AS run_timestamp,
    CASE WHEN failed THEN 'FAILED' ELSE 'SUCCESS' END AS status, failed, rows_in, rows_rejected, nulls_handled,
    rows_in - rows_rejected AS rows_published, as_of AS "AS_OF"
  FROM (SELECT *, rows_rejected * 100 > rows_in * 6 AS failed FROM (
    SELECT CAST(timestamp AS DATE) AS date, count(*) AS rows_in, count(*) FILTER (WHERE country_code % 50 IN (13, 31, 41)) AS rows_rejected,
      count(*) FILTER (WHERE country_code % 20 = 7) AS nulls_handled, max(timestamp) AS as_of FROM ({v._events_sql(None)}) GROUP BY 1))"""


def stored_status(spark: SparkSession, sf: str) -> DataFrame:
    path = runtime.scratch_path(spark, "status")
    reference.write_status(status_records(spark, sf), path)
    return reference.read_status(spark, path, multiline=False)


@query(
    "grid_reference_split",
    rounded(
        f"""SELECT grid_id, 'Polygon' AS geometry_type, 5 AS vertices, x0 AS first_longitude, y1 AS max_latitude, TRUE AS many_splits FROM ({v.cells_sql()})""",
        "first_longitude max_latitude",
        "grid_id, geometry_type, vertices, many_splits",
    ),
)
def _(spark, sf):
    """The cells of one large document, which is read in many splits."""
    from cellwatch.functions import geometry as geo

    path = runtime.scratch_path(spark, "one-document")
    cells = v.telemetry(spark, sf).select("grid_id").distinct().withColumn("band", F.lit(0))
    v.one_document(cells).coalesce(1).write.text(path)
    size = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        # Splits of an eighth of the document, as a large one has at the usual size.
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 8 + 1))
        features = runtime.materialize(reference.read_split_features(spark, path), "features")
        blocks = reference.split_records(spark, path).select("block").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    many = blocks > 4
    shape = F.col("geometry")
    return reference.grid_reference(features).select(
        "grid_id",
        "geometry_type",
        F.size(geo.points(shape)).alias("vertices"),
        shape[0][0][0][0].alias("first_longitude"),
        geo.bounds(shape)["max_lat"].alias("max_latitude"),
        F.lit(many).alias("many_splits"),
    )


@query(
    "pipeline_status_record",
    f"""SELECT run_id, run_timestamp, status, rows_in, rows_rejected, nulls_handled, rows_published, "AS_OF",
          CASE WHEN failed THEN 'clean=FAILED,ingest=SUCCESS,publish=SKIPPED' ELSE 'clean=SUCCESS,ingest=SUCCESS,publish=SUCCESS' END AS tasks
        FROM ({STATUS_SQL})""",
)
def _(spark, sf):
    entries = F.array_sort(F.map_entries("per_task_status"))
    tasks = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return stored_status(spark, sf).withColumn("tasks", tasks).drop("per_task_status")


# ----------------------------------------------------------------------- sinks


@query(
    "scan_parquet",
    rounded("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders", "o_totalprice", "o_orderkey, o_custkey, o_orderstatus, o_orderdate"),
)
def _(spark, sf):
    rows = activity.scan_parquet(spark, f"{sf}/orders.parquet")
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


CLEAN_SQL = f"SELECT CAST(timestamp AS DATE) AS date, grid_id, {v.TOTAL_SQL.replace(' + ', ', ')} FROM ({D}) WHERE NOT {v.INVALID_SQL}"


@query(
    "sink_activity_partitioned",
    rounded(
        f"""SELECT date, count(*) AS records, sum({' + '.join(f'coalesce({m}, 0)' for m in MEASURES)}) AS total_activity FROM ({CLEAN_SQL}) GROUP BY date""",
        "total_activity",
        f"records, {DATE}",
    ),
)
def _(spark, sf):
    path = runtime.scratch_path(spark, "activity")
    clean = v.clean_activity(spark, sf)
    sinks.write_activity_partitioned(clean, path)
    # A re-run of one week replaces its dates only.
    sinks.write_activity_partitioned(cleaning.filter_date_window(clean, "2024-01-08", "2024-01-14"), path)
    return activity.scan_parquet(spark, path).groupBy("date").agg(
        F.count("*").alias("records"), F.sum("total_activity").cast("double").alias("total_activity")
    )


@query("sink_hourly_summary", rounded(H, M + " total_sms total_calls total_activity internet_share", f"timestamp, grid_id, hour, day_of_week, {DATE}"))
def _(spark, sf):
    path = runtime.scratch_path(spark, "hourly")
    sinks.write_table(v.hourly(spark, sf), path)
    return activity.scan_parquet(spark, path)


@query(
    "clustered_cell_hours",
    rounded(
        f"""WITH h AS ({H}), c AS (SELECT grid_id FROM h GROUP BY grid_id ORDER BY count(*) DESC, grid_id LIMIT 1)
            SELECT timestamp, grid_id, total_activity, TRUE AS narrow FROM h WHERE grid_id = (SELECT grid_id FROM c)""",
        "total_activity",
        "timestamp, grid_id, narrow",
    ),
)
def _(spark, sf):
    """Hours of the cell with most of them from the clustered table; the files that may hold it are a part of all."""
    hours, path = v.stored_hourly(spark, sf), runtime.scratch_path(spark, "clustered")
    sinks.write_clustered(hours, path, rows_per_file=max(50, hours.count() // 64))
    table = activity.scan_parquet(spark, path)
    cell = hours.groupBy("grid_id").count().orderBy(F.desc("count"), "grid_id").first()["grid_id"]
    spans = table.groupBy(F.input_file_name().alias("f")).agg(F.min("grid_id").alias("a"), F.max("grid_id").alias("b"))
    share = spans.agg(F.count_if(F.lit(cell).between(F.col("a"), F.col("b"))) / F.count("*")).first()[0]
    return table.where(F.col("grid_id") == cell).select("timestamp", "grid_id", "total_activity", F.lit(share < 0.5).alias("narrow"))


@query(
    "sink_dashboard_csv",
    rounded(
        f"""SELECT grid_id, sum(total_activity) AS total_activity FROM ({H}) GROUP BY grid_id
            ORDER BY round(sum(total_activity), 6) DESC, grid_id LIMIT 10""",
        "total_activity",
        "grid_id",
    ),
)
def _(spark, sf):
    path = runtime.scratch_path(spark, "dashboard")
    sinks.write_small_csv(rollup.dashboard_summary(v.hourly(spark, sf)), path)
    return spark.read.schema("grid_id int, total_activity double").option("header", True).csv(path)


@query(
    "format_footprint",
    f"""WITH c AS (SELECT timestamp, grid_id, country_code FROM ({D}) WHERE NOT {v.INVALID_SQL})
        SELECT CAST(sum(strlen(strftime(timestamp, '%Y-%m-%dT%H:%M:%S.000'))) AS BIGINT) AS stamp_bytes, TRUE AS csv_holds_stamps, TRUE AS smaller, TRUE AS reduction_fits FROM c""",
)
def _(spark, sf):
    """The CSV holds at least its own time stamps, Parquet is smaller, and the reduction is that of the two sizes."""
    clean, sizes = _footprint(spark, sf)
    stamps = clean.agg(F.sum(F.length(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS"))))
    reduction = F.round((1 - F.col("parquet_bytes") / F.col("csv_bytes")) * 100, 2)
    return sizes.withColumn("stamp_bytes", stamps.scalar()).select(
        "stamp_bytes",
        (F.col("csv_bytes") > F.col("stamp_bytes")).alias("csv_holds_stamps"),
        ((F.col("parquet_bytes") > 0) & (F.col("parquet_bytes") < F.col("csv_bytes"))).alias("smaller"),
        (F.col("reduction_pct") == reduction).alias("reduction_fits"),
    )


def _footprint(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    csv_path, parquet_path = runtime.scratch_path(spark, "footprint-csv"), runtime.scratch_path(spark, "footprint-parquet")
    clean = v.clean_activity(spark, sf)
    clean.write.option("header", True).csv(csv_path)
    clean.write.parquet(parquet_path)
    return clean, sinks.format_footprint(spark, csv_path, parquet_path)
