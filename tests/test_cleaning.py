from datetime import datetime

import pytest

from cellwatch.functions import columns as fn
from cellwatch.operators import cleaning, rollup
from cellwatch.schemas import MEASURES
from pyspark.sql import functions as F

T = datetime(2013, 11, 1, 5)
SCHEMA = "timestamp timestamp_ntz, grid_id int, country_code int, " + ", ".join(f"{m} double" for m in MEASURES)


@pytest.fixture
def records(spark):
    return spark.createDataFrame(
        [
            (T, 1, 39, 1.0, 2.0, 3.0, 4.0, 5.0),
            (T, 2, 39, None, None, 0.0, 0.0, 0.0),
            (None, 3, 39, 1.0, 1.0, 1.0, 1.0, 1.0),
            (T, None, 39, -1.0, 1.0, 1.0, 1.0, None),
            (T, 5, 39, None, 1.0, -0.5, 1.0, 1.0),
        ],
        SCHEMA,
    )


def test_null_key_rejects_but_null_measure_does_not(records):
    assert sorted(r.grid_id for r in cleaning.clean_valid(records).collect()) == [1, 2]


def test_rejects_carry_one_reason(records):
    reasons = sorted((r.reject_reason, r.grid_id or 0) for r in cleaning.clean_rejected(records).collect())
    assert reasons == [("NEGATIVE_MEASURE", 5), ("NULL_KEY", 0), ("NULL_KEY", 3)]
    assert cleaning.reject_union(records).count() == 3


def test_report_and_null_counts(records):
    assert tuple(cleaning.cleaning_report(records).collect()[0]) == (5, 2, 3, 4)
    assert cleaning.null_counts(records).collect()[0].total == 4
    assert cleaning.null_counts(records, after_rejects=True).collect()[0].total == 2


def test_clean_fills_and_derives(records):
    rows = {r.grid_id: r for r in cleaning.clean(records).collect()}
    assert (rows[1].total_sms, rows[1].total_calls, rows[1].total_activity) == (3.0, 7.0, 15.0)
    assert (rows[2].sms_in, rows[2].total_activity) == (0.0, 0.0)
    assert (str(rows[1].date), rows[1].hour, rows[1].day_of_week) == ("2013-11-01", 5, "Friday")


def test_all_weekday_encodings(records):
    row = cleaning.derive_calendar(records).where("grid_id = 1").collect()[0]
    assert (row.day_of_week, row.day_number, row.weekday_number) == ("Friday", 6, 4)


def test_share_is_zero_for_an_idle_cell(records):
    hours = rollup.hourly_grid_summary(cleaning.clean(records))
    rows = {r.grid_id: r for r in hours.collect()}
    assert rows[2].internet_share == 0.0
    assert rows[1].internet_share == 0.3333
    exact = {r.grid_id: r.internet_share for r in rollup.internet_share_exact(hours).collect()}
    assert exact == {1: 5.0 / 15.0, 2: 0.0}


def test_rollup_sums_over_country_codes(spark):
    rows = [(T, 1, c, 1.0, 0.0, 0.0, 0.0, 2.0) for c in (39, 40, 41)]
    hours = rollup.hourly_grid_summary(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.grid_id, r.sms_in, r.internet_activity, r.total_activity) for r in hours] == [(1, 3.0, 6.0, 9.0)]


def test_grid_text_and_geometry_guard(spark):
    df = spark.createDataFrame([(" 12.0 ", 1, 2)], "k string, Geometry int, CENTROID_latitude int")
    assert df.select(fn.grid_text(F.col("k"))).collect()[0][0] == "12"
    assert cleaning.drop_geometry(df).columns == ["k"]
    with pytest.raises(ValueError, match="grid_id, timestamp"):
        cleaning.fact_projection(df)


def test_standardize_types_turns_bad_text_into_null(spark):
    df = spark.createDataFrame([("2013-11-01 00:00:00", "7", "39", "x", "1", "1", "1", "1")], "timestamp string, grid_id string, country_code string, " + ", ".join(f"{m} string" for m in MEASURES))
    row = cleaning.standardize_types(df).collect()[0]
    assert (row.grid_id, row.sms_in, row.sms_out) == (7, None, 1.0)


def test_dedupe_keeps_the_first_in_order(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 3)], "k int, v string, n int")
    assert sorted(map(tuple, cleaning.dedupe_keys(df, ["k"], ["n"]).collect())) == [(1, "a", 1), (2, "c", 3)]


def test_fixed_text_rounds_on_the_binary_value(spark):
    values = [12.345, 0.125, 0.375, 1234567.891, 2.675, 0.0]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    assert [r[0] for r in df.select(fn.fixed(F.col("x"), 2)).collect()] == [f"{x:.2f}" for x in values]
