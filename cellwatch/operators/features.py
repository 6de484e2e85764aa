"""Leak-free rolling features.

All windows share one partitioning by cell and one order by hour number, so
the whole feature set costs a single shuffle and sort. `_stages` computes each
windowed aggregate once, and features are plain expressions over them; Catalyst
drops the aggregates a query does not use. Hour-based windows are range frames
gated on a full count: a missing hour leaves the frame short instead of being
filled.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellwatch.functions.columns import finite, hour_number
from cellwatch.operators.baselines import SURGE_FACTOR, TREND_ROWS, sorted_median, trailing_values
from cellwatch.schemas import FEATURES_24H, FEATURES_EXTRA, MODEL_FEATURES

DAY = 24
RECENT = 6


def _stages(hourly: DataFrame, *kept: str) -> DataFrame:
    """Hourly rows with every windowed aggregate the features are made of, and the columns `kept`."""
    rows = hourly.withColumn("_h", hour_number(F.col("timestamp")))
    by_hour = W.partitionBy("grid_id").orderBy("_h")
    day = by_hour.rangeBetween(1 - DAY, 0)
    recent = by_hour.rangeBetween(1 - RECENT, 0)
    prior = by_hour.rangeBetween(1 - DAY - RECENT, -RECENT)
    last_rows = by_hour.rowsBetween(1 - RECENT, 0)
    trend_rows = by_hour.rowsBetween(1 - TREND_ROWS, 0)
    so_far = by_hour.rowsBetween(W.unboundedPreceding, 0)
    total, internet = F.col("total_activity"), F.col("internet_activity")
    return rows.select(
        "grid_id",
        "timestamp",
        *kept,
        "_h",
        F.count(total).over(day).alias("_day_n"),
        F.avg(total).over(day).alias("_day_mean"),
        F.max(total).over(day).alias("_day_max"),
        F.stddev_pop(total).over(day).alias("_day_std"),
        F.sum(total).over(day).alias("_day_sum"),
        F.sum(internet).over(day).alias("_day_internet"),
        F.sum(F.when(total > 0, 1).otherwise(0)).over(day).alias("_day_active"),
        F.min("_h").over(so_far).alias("_first_h"),
        F.count(total).over(recent).alias("_recent_n"),
        F.avg(total).over(recent).alias("_recent_mean"),
        F.count(total).over(prior).alias("_prior_n"),
        F.avg(total).over(prior).alias("_prior_mean"),
        F.count(total).over(last_rows).alias("_rows_n"),
        F.avg(total).over(last_rows).alias("_rows_mean"),
        F.stddev_pop(total).over(last_rows).alias("_rows_std"),
        F.max(total).over(last_rows).alias("_rows_max"),
        trailing_values(trend_rows).alias("_trend"),
        F.lead("_h").over(by_hour).alias("_next_h"),
        F.lead(total).over(by_hour).alias("_next_total"),
    )


def _when_full(value: str, count: str, size: int) -> Column:
    return F.when(F.col(count) == size, F.col(value))


def _guarded(part: Column, whole: Column) -> Column:
    """Ratio, 0.0 unless the whole is known and positive."""
    return F.when(whole > 0, part / F.nullif(whole, F.lit(0.0))).otherwise(F.lit(0.0))


def _day(value: str) -> Column:
    return _when_full(value, "_day_n", DAY)


def _day_features() -> dict[str, Column]:
    recent = _when_full("_recent_mean", "_recent_n", RECENT)
    prior = _when_full("_prior_mean", "_prior_n", DAY)
    return {
        "avg_activity": _day("_day_mean"),
        # Last 6 hours against the 24 before; 0.0 without a full, positive prior.
        "activity_growth": _guarded(recent - prior, prior),
        # A missing hour counts as inactive: only a cell's first day is NULL.
        "active_hours": F.when(F.col("_h") - F.col("_first_h") >= DAY - 1, F.col("_day_active")),
        "peak_ratio": _guarded(F.col("_day_max"), _day("_day_mean")),
        "variability": _day("_day_std"),
        "internet_share": _guarded(F.col("_day_internet"), _day("_day_sum")),
    }


def _recent_features() -> dict[str, Column]:
    mean = _when_full("_rows_mean", "_rows_n", RECENT)
    return {
        "recent_6h_mean": mean,
        "recent_6h_std": _when_full("_rows_std", "_rows_n", RECENT),
        "recent_6h_peak_ratio": _guarded(F.col("_rows_max"), mean),
    }


def cyclic_time(ts: Column) -> dict[str, Column]:
    """Hour of day and weekday (Monday 0) on the unit circle."""
    hour = F.hour(ts) * (2 * math.pi / 24)
    day = F.weekday(ts) * (2 * math.pi / 7)
    return {"hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "day_sin": F.sin(day), "day_cos": F.cos(day)}


def _all_features() -> dict[str, Column]:
    return {**_day_features(), **_recent_features(), **cyclic_time(F.col("timestamp"))}


def _named(columns: dict[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in columns.items()]


def _complete(names: list[str]) -> Column:
    """All features finite. NULL, NaN and infinity carry over into a sum, so
    one test on it names each feature once and keeps the generated code small."""
    return finite(functools.reduce(operator.add, [F.col(n) for n in names]))


def feature(hourly: DataFrame, name: str) -> DataFrame:
    """One 24-hour feature for every hourly row."""
    return _stages(hourly).select(
        "grid_id", F.col("timestamp").alias("feature_timestamp"), _day_features()[name].alias(name)
    )


def network_features(hourly: DataFrame) -> DataFrame:
    """Complete feature rows of every cell but its last hour.

    The next hour is tested on the gap-filled series, where every row but the
    last has one, so only the last row of each cell goes.
    """
    return (
        _stages(hourly)
        .where(F.col("_next_h").isNotNull() & (F.col("_day_n") == DAY))
        .select("grid_id", F.col("timestamp").alias("feature_timestamp"), *_named(_day_features()))
        .where(_complete(FEATURES_24H))
    )


def recent_features(hourly: DataFrame) -> DataFrame:
    """Statistics of the last 6 rows, whatever their spacing."""
    return _stages(hourly).select("grid_id", "timestamp", *_named(_recent_features()))


def extra_features(hourly: DataFrame) -> DataFrame:
    """Last-6-row statistics and cyclic time."""
    columns = {**_recent_features(), **cyclic_time(F.col("timestamp"))}
    return _stages(hourly).select("grid_id", "timestamp", *_named(columns))


def model_dataset(hourly: DataFrame, with_target: bool = True) -> DataFrame:
    """Features, extras and label per complete row, in one window pass.

    The parts have the same keys and sources, so no join is needed. A complete
    row whose next hour was not observed stays, labelled 0.
    """
    surges = F.col("_next_total") > F.lit(SURGE_FACTOR) * sorted_median(F.col("_trend"), TREND_ROWS)
    label = F.coalesce(((F.col("_next_h") == F.col("_h") + 1) & surges).cast("int"), F.lit(0)).alias("target")
    return (
        _stages(hourly)
        .where(F.col("_next_h").isNotNull() & (F.col("_day_n") == DAY))
        .select(
            "grid_id",
            F.col("timestamp").alias("feature_timestamp"),
            *_named(_all_features()),
            *([label] if with_target else []),
        )
        .where(_complete(FEATURES_24H + FEATURES_EXTRA[:3]))
    )


def with_model_features(hourly: DataFrame, *kept: str) -> DataFrame:
    """Every hourly row with the model's features and `complete`, which tells the rows of `model_dataset`."""
    staged = _stages(hourly, *kept)
    ready = F.col("_next_h").isNotNull() & (F.col("_day_n") == DAY)
    rows = staged.select("grid_id", "timestamp", *kept, ready.alias("_ready"), *_named(_all_features()))
    return rows.withColumn("complete", F.col("_ready") & F.coalesce(_complete(FEATURES_24H + FEATURES_EXTRA[:3]), F.lit(False))).drop("_ready")


def leakage_compare(hourly: DataFrame, cutoff: Column, factor: float = 1000.0, tolerance: float = 1e-10) -> DataFrame:
    """Per feature: rows up to `cutoff` that change when later hours change."""
    names = FEATURES_24H + FEATURES_EXTRA
    scale = F.when(F.col("timestamp") > cutoff, F.lit(factor)).otherwise(F.lit(1.0))
    altered = hourly.withColumns({m: F.col(m) * scale for m in ("total_activity", "internet_activity")})

    def computed(df: DataFrame) -> DataFrame:
        columns = {name: column.cast("double") for name, column in _all_features().items()}
        return _stages(df).where(F.col("timestamp") <= cutoff).select("grid_id", "timestamp", *_named(columns))

    before, after = computed(hourly).alias("a"), computed(altered).alias("b")

    def differs(name: str) -> Column:
        a, b = F.col(f"a.{name}"), F.col(f"b.{name}")
        close = F.abs(a - b) <= tolerance + tolerance * F.abs(b)
        return ~(a.eqNullSafe(b) | F.coalesce(close, F.lit(False)))

    joined = before.join(after, ["grid_id", "timestamp"])
    counts = joined.agg(F.count("*").alias("compared_rows"), *[F.count_if(differs(n)).alias(n) for n in names])
    return counts.unpivot(["compared_rows"], names, "feature", "mismatches")
