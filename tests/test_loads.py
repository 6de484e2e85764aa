"""Loads on top of earlier loads, the file ledger and retried landing batches."""

import pathlib
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

import catalog
from catalog import views
from cellwatch.operators import cleaning, rollup
from cellwatch.plans import batch
from cellwatch.schemas import MEASURES, RAW_COLUMNS
from cellwatch.sources import landing
from cellwatch.streaming import landing_stream
from helpers import START, hour, rows_of

HEADER = ",".join(RAW_COLUMNS)
NAME = "sms-call-internet-mi-2024-01-{:02d}.csv"


def raw(spark, rows):
    """Raw rows from (cell, hour number, value)."""
    full = [(hour(h) if h is not None else None, g, 39, *[v] * 5) for g, h, v in rows]
    return spark.createDataFrame(full, "timestamp timestamp_ntz, grid_id int, country_code int, " + ", ".join(f"{m} double" for m in MEASURES))


def told(df):
    return rows_of(df, "grid_id", "timestamp", "total_activity", "internet_share")


def test_two_loads_equal_one_and_leave_other_dates_alone(spark, tmp_path):
    first, second = [(1, 0, 1.0), (1, 30, 2.0), (2, 60, 5.0), (1, None, 1.0)], [(1, 30, 3.0), (3, 31, 4.0), (1, 30, -1.0)]
    out = batch.Layout(str(tmp_path / "out"))
    counts = batch.load_activity(raw(spark, first), out, "a")
    assert (counts["rows_in"], counts["rows_rejected"], counts["nulls_handled"]) == (4, 1, 0)
    hours = pathlib.Path(out.path("hourly"))
    before = {p: p.stat().st_mtime_ns for p in hours.rglob("*.parquet")}
    batch.load_activity(raw(spark, second), out, "b")
    whole = rollup.hourly_grid_summary(cleaning.clean(raw(spark, first + second)))
    assert told(out.read(spark, "hourly")) == told(whole)
    after = {p: p.stat().st_mtime_ns for p in hours.rglob("*.parquet")}
    kept = {p for p in before if after.get(p) == before[p]}
    assert {p.parent.name for p in kept} == {"date=2024-01-01", "date=2024-01-03"}
    assert {p.parent.name for p in after if p not in kept} == {"date=2024-01-02"}
    assert sorted(r.reject_reason for r in out.read(spark, "rejects").collect()) == ["NEGATIVE_MEASURE", "NULL_KEY"]
    # A repeated load adds nothing.
    batch.load_activity(raw(spark, second), out, "b")
    assert told(out.read(spark, "hourly")) == told(whole)
    assert out.read(spark, "activity").count() == 5


def test_merge_reads_only_the_touched_dates(spark, tmp_path):
    out = batch.Layout(str(tmp_path / "out"))
    batch.load_activity(raw(spark, [(1, h, 1.0) for h in range(72)]), out, "a")
    parts = out.read(spark, "hourly_parts").where(F.col("date").isin([hour(24).date()]))
    plan = rollup.hourly_grid_summary(parts)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "date" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert len(parts.inputFiles()) >= 1 and parts.select(F.input_file_name()).distinct().count() == 1


def test_failed_load_counts_for_nothing(spark, tmp_path, monkeypatch):
    out = batch.Layout(str(tmp_path / "out"))
    batch.load_activity(raw(spark, [(1, 0, 1.0)]), out, "a")

    def fail(*_, **__):
        raise AssertionError("grain")

    with monkeypatch.context() as m:
        m.setattr(batch.guards, "require_passed", fail)
        with pytest.raises(AssertionError):
            batch.load_activity(raw(spark, [(1, 0, 10.0)]), out, "b")
    assert out.committed(spark) == ["a"]
    batch.load_activity(raw(spark, [(1, 1, 1.0)]), out, "c")
    assert told(out.read(spark, "hourly")) == [(1, hour(0), 5.0, 0.2), (1, hour(1), 5.0, 0.2)]
    batch.load_activity(raw(spark, [(1, 0, 10.0)]), out, "b")
    assert told(out.read(spark, "hourly")) == [(1, hour(0), 55.0, 0.2), (1, hour(1), 5.0, 0.2)]


def line(day, h=0, cell=1, value=1):
    stamp = (hour(0) + timedelta(days=day - 1, hours=h)).strftime("%Y-%m-%d %H:%M:%S")
    return f"{stamp},{cell},39,{value},1,1,1,1"


def write(folder, day, lines, name=NAME):
    (folder / name.format(day)).write_text("\n".join([HEADER, *lines]) + "\n")


def test_files_of_earlier_loads_are_not_read_again(spark, tmp_path):
    folder, out = tmp_path / "landing", batch.Layout(str(tmp_path / "out"))
    folder.mkdir()
    write(folder, 1, [line(1)])
    write(folder, 2, ["bad"])
    batch.load_activity(batch.accept_landed(spark, str(folder), out, load="a"), out, "a")
    write(folder, 3, [line(3)])
    # The lines of the first file under another name; a rejected file that was mended.
    write(folder, 4, [line(1)])
    write(folder, 2, [line(2)])
    rows = batch.accept_landed(spark, str(folder), out, load="b")
    assert rows_of(out.read(spark, "verdicts"), "filename", "valid") == [(NAME.format(d), True) for d in (2, 3, 4)]
    batch.load_activity(rows, out, "b")
    audit = spark.read.schema(batch.LEDGER_SCHEMA).parquet(out.path("audit"))
    assert rows_of(audit, "load", "filename", "status") == [
        ("a", NAME.format(1), "ACCEPTED"), ("a", NAME.format(2), "REJECTED"), ("b", NAME.format(2), "ACCEPTED"), ("b", NAME.format(3), "ACCEPTED"), ("b", NAME.format(4), "SKIPPED"),
    ]
    assert [r[1] for r in told(out.read(spark, "hourly"))] == [hour(0), hour(24), hour(48)]
    # Repeated, the load takes its own files again.
    assert batch.accept_landed(spark, str(folder), out, load="b").count() == 2
    assert batch.accept_landed(spark, str(folder), out, load="c").count() == 0


def test_raw_folder_is_loaded_file_by_file(spark, tmp_path):
    folder, out = tmp_path / "raw", batch.Layout(str(tmp_path / "out"))
    folder.mkdir()
    write(folder, 1, [line(1), line(1, 1)])
    assert batch.load_activity(batch.new_raw_rows(spark, str(folder), out, load="a"), out, "a")["rows_in"] == 2
    write(folder, 2, [line(2)])
    fresh = batch.new_raw_rows(spark, str(folder), out, load="b")
    assert batch.load_activity(fresh, out, "b")["rows_in"] == 1
    assert out.read(spark, "hourly").count() == 3


def test_wider_grid_passes_the_gate_where_the_job_allows_it(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    write(folder, 1, [line(1, cell=25_000)])
    assert batch.accept_landed(spark, str(folder), batch.Layout(str(tmp_path / "a"))).count() == 0
    assert batch.accept_landed(spark, str(folder), batch.Layout(str(tmp_path / "b")), grid_id_max=30_000).count() == 1
    paths = [str(tmp_path / p) for p in ("audit", "raw", "checkpoint")]
    landing_stream.start_landing(spark, str(folder), *paths, grid_id_max=30_000).awaitTermination()
    assert [r.status for r in spark.read.parquet(paths[0]).collect()] == ["ACCEPTED"]


def test_stream_that_accepts_no_file_leaves_an_empty_table(spark, tmp_path):
    # Users beyond the grid: each file has a cell outside it, as at 1 GB.
    rows = [(i, START + timedelta(days=i % 14, hours=1), 10_000 + i, "click", 1.0, '{"k": 1}') for i in range(28)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    found = catalog.QUERIES["landing_stream"](spark, str(tmp_path)).collect()
    # Fourteen days' files, and those of twelve days sent again; two days' files lack a column.
    assert [(r.status, r.files, r.stored_rows) for r in found] == [("REJECTED", 26, 0)]
    folder = tmp_path / "landing"
    folder.mkdir()
    paths = [str(tmp_path / p) for p in ("audit", "raw", "checkpoint")]
    write(folder, 1, [line(1, cell=25_000)])
    landing_stream.start_landing(spark, str(folder), *paths).awaitTermination()
    assert landing_stream.read_rows(spark, paths[1]).count() == 0
    write(folder, 2, [line(2)])
    landing_stream.start_landing(spark, str(folder), *paths).awaitTermination()
    stored = landing_stream.read_rows(spark, paths[1])
    assert sorted(stored.dtypes) == sorted(spark.read.parquet(paths[1]).withColumn("batch_id", F.col("batch_id").cast("long")).dtypes)
    assert [(r.source_file, r.grid_id) for r in stored.collect()] == [(NAME.format(2), "1")]


def test_retried_batch_and_sent_again_files_add_no_row(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    audit, rows = str(tmp_path / "audit"), str(tmp_path / "rows")
    landing_stream.ensure_audit(spark, audit)
    write(folder, 1, [line(1), line(1, 1)])
    write(folder, 2, [line(1, 1), line(1)])
    nothing = spark.createDataFrame([], "file string")

    def land(batch_id, pattern):
        landing_stream.land_batch(landing.landing_text(spark, str(folder), pattern), batch_id, audit, rows, nothing)
        return rows_of(spark.read.parquet(audit), "batch_id", "filename", "status"), spark.read.parquet(rows).count()

    # Equal lines in another order are the same file sent again.
    one = [(0, NAME.format(1), "ACCEPTED"), (0, NAME.format(2), "SKIPPED")]
    assert land(0, "*.csv") == land(0, "*.csv") == (one, 2)
    write(folder, 3, [line(1), line(1, 1)])
    write(folder, 4, [line(1), line(1)])
    two = [*one, (1, NAME.format(3), "SKIPPED"), (1, NAME.format(4), "ACCEPTED")]
    assert land(1, "*0[34].csv") == land(1, "*0[34].csv") == (two, 4)


def test_text_is_read_once(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    write(folder, 1, [line(1)] * 5)
    (folder / NAME.format(2)).write_text("\n \n")
    lines, names = landing.parse_text(landing.landing_text(spark, str(folder)))
    headers = landing.file_headers(lines)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (headers, landing.landing_verdicts(lines, headers), landing.accepted_rows(lines, headers, headers.withColumn("status", F.lit("ACCEPTED"))))]
    assert not any("FileScan text" in p for p in plans)
    assert names.count() == 2 and headers.count() == 1


def test_windows_of_the_model_rows_run_once(spark, tmp_path, monkeypatch):
    """The split reads the dataset twice, its hours and its rows: it must be a stored table."""
    out = batch.Layout(str(tmp_path))
    telemetry = raw(spark, [(cell, h, float(1 + (h * cell) % 7)) for cell in (1, 2) for h in range(60)])
    batch.load_activity(telemetry, out, "all")
    plans, plain = [], batch.model.chronological_split
    monkeypatch.setattr(batch.model, "chronological_split", lambda d: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or plain(d))
    batch.load_signals(spark, out)
    assert len(plans) == 1 and "Window" not in plans[0]
    wanted = plain(batch.features.model_dataset(out.read(spark, "hourly")))
    assert out.read(spark, "model_dataset").columns == wanted.columns
    found = sorted(map(tuple, out.read(spark, "model_dataset").collect()))
    assert found and found == sorted(map(tuple, wanted.collect()))


def test_landed_run_accepts_all_cells_of_its_view(spark, tmp_path, monkeypatch):
    # A view of more than the default grid's 10,000 cells, as from 25 million events on.
    monkeypatch.setattr(views, "EVENTS_PER_VIEW", 1)
    rows = [(n, START + timedelta(hours=n // 4), 10_000 + n % 4, "click", float(1 + n * n % 11), '{"k": 1}') for n in range(4 * 24 * 30)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    (found,) = catalog.QUERIES["landed_run"](spark, str(tmp_path)).collect()
    assert (found.status, found.accepted_files, found.rejected_files) == ("SUCCESS", 29, 1)
    assert (found.rows_in, found.rows_published) == (4 * 24 * 10, 4 * 24 * 29)
    assert found.saved_model_scored and found.signals_complete
