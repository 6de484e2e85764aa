import pytest

from cellwatch.operators import rollup
from cellwatch.runtime import materialize
from cellwatch.schemas import RAW_COLUMNS
from cellwatch.sources import activity, landing
from cellwatch.streaming import landing_stream
from pyspark.sql import functions as F

HEADER = ",".join(RAW_COLUMNS)
GOOD = "2013-11-01 00:00:00,1,39,10,5,3,2,100"
NAME = "sms-call-internet-mi-2013-11-{:02d}.csv"


def write(folder, files):
    for name, lines in files.items():
        (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(folder)


def verdicts(spark, folder):
    result = landing.judge_folder(spark, folder)
    return {landing_name(r.file): (r.valid, r.row_count, r.reason) for r in result.collect()}


def landing_name(path):
    return path.rsplit("/", 1)[-1]


def judge(spark, tmp_path, lines):
    return verdicts(spark, write(tmp_path, {NAME.format(1): lines}))[NAME.format(1)]


@pytest.mark.parametrize(
    "bad, fault",
    [
        ("2013-11-01,1,39,1,1,1,1,1", "malformed datetime at row 3: 2013-11-01"),
        (",1,39,1,1,1,1,1", "malformed datetime at row 3: "),
        ("2013-11-01 00:00:00,,39,1,1,1,1,1", "missing CellID at row 3"),
        ("2013-11-01 00:00:00,4x,39,1,1,1,1,1", "invalid CellID at row 3: 4x"),
        ("2013-11-01 00:00:00,1.0,39,1,1,1,1,1", "invalid CellID at row 3: 1.0"),
        ("2013-11-01 00:00:00,0,39,1,1,1,1,1", "CellID outside 1-10000 at row 3: 0"),
        ("2013-11-01 00:00:00,10001,39,1,1,1,1,1", "CellID outside 1-10000 at row 3: 10001"),
        ("2013-11-01 00:00:00,1,39,1,abc,1,1,1", "non-numeric smsout at row 3: abc"),
        ("2013-11-01 00:00:00,1,39,1,1.5d,1,1,1", "non-numeric smsout at row 3: 1.5d"),
        ("2013-11-01 00:00:00,1,39,1,1,1,1,-2", "negative internet at row 3: -2.0"),
    ],
)
def test_first_fault_rejects_the_file(spark, tmp_path, bad, fault):
    later = "oops,1,39,1,1,1,1,1"
    assert judge(spark, tmp_path, [HEADER, GOOD, bad, GOOD, later]) == (False, 2, f"QUALITY_VALIDATION_FAILED: {fault}")


def test_blank_measures_blank_lines_and_quotes_are_fine(spark, tmp_path):
    lines = [HEADER, GOOD, "", "2013-11-01 01:00:00,2,39,,,,,", '"2013-11-01 02:00:00","3",39," 1 ",0,0,0,0']
    assert judge(spark, tmp_path, lines) == (True, 3, "quality_valid")


def test_columns_are_found_by_name(spark, tmp_path):
    order = list(reversed(RAW_COLUMNS)) + ["extra"]
    good = ",".join(reversed(GOOD.split(","))) + ",x"
    assert judge(spark, tmp_path, ["﻿" + ", ".join(order), good]) == (True, 1, "quality_valid")


def test_missing_columns_are_listed_in_order(spark, tmp_path):
    assert judge(spark, tmp_path, ["datetime,CellID,countrycode,smsin,smsout", "x"]) == (
        False, 0, "SCHEMA_VALIDATION_FAILED: missing required columns: callin, callout, internet",
    )


def test_empty_file_lacks_every_column(spark, tmp_path):
    folder = write(tmp_path, {NAME.format(1): [HEADER, GOOD]})
    (tmp_path / NAME.format(2)).write_text("")
    (tmp_path / NAME.format(3)).write_text("\n \n")
    lacking = (False, 0, "SCHEMA_VALIDATION_FAILED: missing required columns: " + ", ".join(sorted(RAW_COLUMNS)))
    found = verdicts(spark, folder)
    assert len(found) == 3 and found[NAME.format(2)] == found[NAME.format(3)] == lacking


def test_header_only_file_is_rejected(spark, tmp_path):
    assert judge(spark, tmp_path, [HEADER]) == (False, 0, "QUALITY_VALIDATION_FAILED: file contains no data rows")


def test_row_numbers_hold_when_a_file_is_read_in_many_splits(spark, tmp_path):
    lines = [HEADER] + [GOOD] * 3000
    lines[2500] = GOOD.replace("2013", "bad")
    lines[2900] = GOOD.replace("2013", "worse")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
        folder = write(tmp_path, {NAME.format(1): lines, NAME.format(2): [HEADER, GOOD]})
        splits = landing.landing_lines(spark, folder).select("file", "block").distinct().count()
        result = verdicts(spark, folder)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert splits > 5
    assert result[NAME.format(1)] == (
        False, 2500, "QUALITY_VALIDATION_FAILED: malformed datetime at row 2501: bad-11-01 00:00:00",
    )
    assert result[NAME.format(2)] == (True, 1, "quality_valid")


def test_verdicts_hold_when_the_scans_split_files_differently(spark, tmp_path):
    other = ",".join(reversed(HEADER.split(",")))
    turned = ",".join(reversed(GOOD.split(",")))
    bad = [HEADER] + [GOOD] * 3000
    bad[2700] = HEADER
    bad[2900] = GOOD.replace("2013", "bad")
    folder = write(tmp_path, {NAME.format(1): [HEADER] + [GOOD] * 3000, NAME.format(2): bad, NAME.format(3): [other] + [turned] * 3000})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for first, second in (("8192", "30000"), ("30000", "8192")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", first)
            headers = materialize(landing.file_headers(landing.landing_lines(spark, folder)), "headers")
            spark.conf.set("spark.sql.files.maxPartitionBytes", second)
            lines = landing.landing_lines(spark, folder)
            found = {landing_name(r.file): (r.valid, r.row_count, r.reason) for r in landing.landing_verdicts(lines, headers).collect()}
            assert found == {
                NAME.format(1): (True, 3000, "quality_valid"),
                NAME.format(2): (False, 2700, "QUALITY_VALIDATION_FAILED: malformed datetime at row 2701: datetime"),
                NAME.format(3): (True, 3000, "quality_valid"),
            }
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_other_files_are_not_detected(spark, tmp_path):
    folder = write(tmp_path, {NAME.format(1): [HEADER, GOOD], "sms-call-internet-mi-2013-11-01.txt": ["x"]})
    assert list(verdicts(spark, folder)) == [NAME.format(1)]


def test_rerun_is_skipped(spark, tmp_path):
    folder = write(tmp_path, {NAME.format(1): [HEADER, GOOD], NAME.format(2): [HEADER, "x"]})
    found = landing.landing_verdicts(landing.landing_lines(spark, folder)).withColumn(
        "filename", landing.file_name(F.col("file"))
    )
    first = landing.landing_route(found, spark.createDataFrame([], "filename string, status string"))
    assert {r.filename: r.status for r in first.collect()} == {NAME.format(1): "ACCEPTED", NAME.format(2): "REJECTED"}
    second = landing.landing_route(found, first)
    assert {r.status for r in second.collect()} == {"SKIPPED"}


def test_stream_takes_each_file_once(spark, tmp_path):
    landed = tmp_path / "landing"
    landed.mkdir()
    paths = [str(tmp_path / p) for p in ("audit", "raw", "checkpoint")]
    write(landed, {NAME.format(1): [HEADER, GOOD, GOOD], NAME.format(2): [HEADER, "bad"], "notes.txt": ["x"]})
    (landed / NAME.format(4)).write_text("")

    def run():
        query = landing_stream.start_landing(spark, str(landed), *paths)
        query.awaitTermination()
        audit = spark.read.parquet(paths[0])
        return sorted((r.filename, r.status, r.row_count) for r in audit.collect())

    one, two, three, four = (NAME.format(i) for i in (1, 2, 3, 4))
    assert run() == [(one, "ACCEPTED", 2), (two, "REJECTED", 1), (four, "REJECTED", 0)]
    assert run() == [(one, "ACCEPTED", 2), (two, "REJECTED", 1), (four, "REJECTED", 0)]
    write(landed, {three: [HEADER, GOOD]})
    assert run() == [(one, "ACCEPTED", 2), (two, "REJECTED", 1), (three, "ACCEPTED", 1), (four, "REJECTED", 0)]
    raw = spark.read.parquet(paths[1])
    assert sorted((r.source_file, r["count"]) for r in raw.groupBy("source_file").count().collect()) == [(one, 2), (three, 1)]
    assert raw.select("grid_id", "internet_activity").distinct().collect() == [("1", "100")]


def test_scan_keeps_bad_cells_as_null_and_counts_files(spark, tmp_path):
    folder = write(
        tmp_path,
        {
            NAME.format(1): [HEADER, GOOD, "oops,2,39,1,1,1,1,1"],
            NAME.format(2): [HEADER, "2013-11-02 00:00:00,20000,40,x,1,1,1,1"],
        },
    )
    raw = activity.load_raw_network_data(spark, folder)
    assert raw.where("timestamp is null").count() == 1
    assert raw.where("sms_in is null").count() == 1
    profile = rollup.ingestion_profile(raw).collect()[0].asDict()
    assert profile == {
        "row_count": 3, "file_count": 2, "grid_count": 3, "country_code_count": 2, "timestamp_count": 2,
        "invalid_grid_count": 1, "null_filename_count": 0, "expected_timestamp_count": 48,
    }
