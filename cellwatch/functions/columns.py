"""Calendar, measure, rounding and text column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hour_floor(ts: Column) -> Column:
    """Start of the hour as a zone-free timestamp."""
    return F.to_date(ts).cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour(ts))


def hour_number(ts: Column) -> Column:
    """Whole hours since 1970 by calendar and clock, free of any time zone."""
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")) * 24 + F.hour(ts)


def second_number(ts: Column) -> Column:
    """Whole seconds since 1970 by calendar and clock."""
    return hour_number(ts).cast("bigint") * 3600 + F.minute(ts) * 60 + F.second(ts)


def hours(n: int) -> Column:
    return F.make_dt_interval(hours=F.lit(n))


def calendar(ts: Column) -> dict[str, Column]:
    """Date, hour and all three weekday encodings of a timestamp."""
    return {
        "date": F.to_date(ts),
        "hour": F.hour(ts),
        "day_of_week": F.date_format(ts, "EEEE"),
        "day_number": F.dayofweek(ts),
        "weekday_number": F.weekday(ts),
    }


def totals() -> dict[str, Column]:
    """SMS, call and overall totals from the five measures."""
    return {
        "total_sms": F.col("sms_in") + F.col("sms_out"),
        "total_calls": F.col("call_in") + F.col("call_out"),
        "total_activity": F.col("sms_in")
        + F.col("sms_out")
        + F.col("call_in")
        + F.col("call_out")
        + F.col("internet_activity"),
    }


def share_exact(part: Column, whole: Column) -> Column:
    """Ratio, 0.0 unless the whole is positive."""
    return F.when(whole > 0, part / F.nullif(whole, F.lit(0))).otherwise(F.lit(0.0))


def share_rounded(part: Column, whole: Column, digits: int = 4) -> Column:
    """Ratio to `digits` decimals, 0 when the whole is zero."""
    return F.round(F.when(whole == 0, F.lit(0.0)).otherwise(part / F.nullif(whole, F.lit(0))), digits)


def ratio_or_null(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole, F.lit(0))


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text of a double, rounded on its exact binary value."""
    pattern = F.lit("0." + "0" * digits)
    return F.call_function("format_number", value, pattern)


def steady_round(value: Column, digits: int) -> Column:
    """Round after absorbing summation noise six digits further out."""
    return F.round(F.round(value, digits + 6), digits)


def finite(value: Column) -> Column:
    """True for a non-NULL double that is neither NaN nor infinite.

    NaN sorts above infinity, so one comparison tells all three.
    """
    return F.coalesce(F.abs(value) < F.lit(float("inf")), F.lit(False))


def grid_text(value: Column) -> Column:
    """Cell key as trimmed text without a trailing '.0'."""
    return F.regexp_replace(F.trim(value.cast("string")), r"\.0$", "")
