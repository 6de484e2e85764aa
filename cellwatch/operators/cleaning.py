"""Row-level cleaning: types, rejects, fills and derived columns."""

from __future__ import annotations

import functools
import operator
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwatch.functions.columns import calendar, totals
from cellwatch.schemas import CANONICAL_TYPES, GEOMETRY_COLUMNS, MEASURES


def standardize_types(df: DataFrame) -> DataFrame:
    """Cast the canonical columns; a value that does not parse becomes NULL."""
    return df.withColumns({name: F.col(name).try_cast(kind) for name, kind in CANONICAL_TYPES.items()})


def _null_key() -> Column:
    return F.col("grid_id").isNull() | F.col("timestamp").isNull()


def _negative() -> Column:
    tests = [F.coalesce(F.col(m) < 0, F.lit(False)) for m in MEASURES]
    return functools.reduce(operator.or_, tests)


def invalid() -> Column:
    """NULL key or a negative measure. A NULL measure is valid."""
    return _null_key() | _negative()


def clean_valid(df: DataFrame) -> DataFrame:
    return df.where(~invalid())


def clean_rejected(df: DataFrame) -> DataFrame:
    """Rows `clean_valid` drops, with the reason."""
    reason = F.when(_null_key(), "NULL_KEY").otherwise("NEGATIVE_MEASURE")
    return df.where(invalid()).withColumn("reject_reason", reason)


def judged(df: DataFrame) -> DataFrame:
    """All rows in one pass: valid ones cleaned, others as they are with a reject_reason, and the calendar of both.

    Rows with a NULL reason are those of `clean`, the others those of
    `clean_rejected`.
    """
    reason = F.when(_null_key(), "NULL_KEY").when(_negative(), "NEGATIVE_MEASURE")
    good, kinds = F.col("reject_reason").isNull(), dict(df.dtypes)
    rows = df.withColumn("reject_reason", reason)
    rows = rows.withColumns({m: F.when(good, F.coalesce(m, F.lit(0).cast(kinds[m]))).otherwise(F.col(m)) for m in MEASURES})
    return derive_calendar(rows.withColumns({name: F.when(good, total) for name, total in totals().items()}), numeric_weekdays=False)


def reject_union(df: DataFrame) -> DataFrame:
    """NULL-key rejects and then negative rejects as one set."""
    null_key = df.where(_null_key()).withColumn("reject_reason", F.lit("NULL_KEY"))
    negative = df.where(~_null_key() & _negative()).withColumn("reject_reason", F.lit("NEGATIVE_MEASURE"))
    return null_key.unionByName(negative)


def fill_measures(df: DataFrame) -> DataFrame:
    """NULL measures to zero, type kept."""
    kinds = dict(df.dtypes)
    return df.withColumns({m: F.coalesce(m, F.lit(0).cast(kinds[m])) for m in MEASURES})


def derive_measures(df: DataFrame) -> DataFrame:
    return df.withColumns(totals())


def derive_calendar(df: DataFrame, ts: str = "timestamp", numeric_weekdays: bool = True) -> DataFrame:
    """Calendar columns; both numeric weekday encodings are optional."""
    columns = calendar(F.col(ts))
    if not numeric_weekdays:
        columns = {k: v for k, v in columns.items() if k in ("date", "hour", "day_of_week")}
    return df.withColumns(columns)


def clean(df: DataFrame) -> DataFrame:
    """Valid rows, filled, with totals and calendar: no shuffle."""
    return derive_calendar(derive_measures(fill_measures(clean_valid(df))), numeric_weekdays=False)


def null_counts(df: DataFrame, after_rejects: bool = False) -> DataFrame:
    """NULLs per measure and in total, before or after rejects, in one pass."""
    source = clean_valid(df) if after_rejects else df
    counts = source.agg(*[F.count_if(F.col(m).isNull()).alias(m) for m in MEASURES])
    return counts.withColumn("total", functools.reduce(operator.add, [F.col(m) for m in MEASURES]))


def cleaning_report(df: DataFrame) -> DataFrame:
    """Rows before, kept and rejected, and NULL measures handled, in one pass."""
    nulls = functools.reduce(operator.add, [F.col(m).isNull().cast("bigint") for m in MEASURES])
    return df.agg(
        F.count("*").alias("records_before"),
        F.count_if(~invalid()).alias("records_after"),
        F.count_if(invalid()).alias("rejected_records"),
        F.coalesce(F.sum(nulls), F.lit(0)).alias("activity_null_values_handled"),
    )


def drop_geometry(df: DataFrame) -> DataFrame:
    """Remove geometry and centroid columns whatever their letter case."""
    unwanted = set(GEOMETRY_COLUMNS)
    return df.drop(*[c for c in df.columns if c.lower() in unwanted])


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def fact_projection(df: DataFrame) -> DataFrame:
    """Geometry-free rows with their keys present."""
    return drop_geometry(require_columns(df, ["timestamp", "grid_id"]))


def filter_date_window(df: DataFrame, start: str | date | None = None, end: str | date | None = None) -> DataFrame:
    """Inclusive window on `date`; prunes partitions on a date-partitioned table."""
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df


def ensure_date(df: DataFrame) -> DataFrame:
    """Keep `date` or derive it from `timestamp`."""
    if "date" in df.columns:
        return df
    return require_columns(df, ["timestamp"]).withColumn("date", F.to_date("timestamp"))


def dedupe_keys(df: DataFrame, keys: list[str], first_by: list[str] | None = None) -> DataFrame:
    """One row per key: any row, or the first in an order when one is given.

    The ordered form is an aggregate, so a hot key is reduced before the shuffle.
    """
    if first_by is None:
        return df.dropDuplicates(keys)
    order = F.struct(*first_by)
    row = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.min_by(row, order).alias("row")).select(*keys, "row.*")
