"""Operational queries: hotspots, points of a cell, risk, evidence, health."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellwatch.functions.columns import fixed, hours, second_number, steady_round
from cellwatch.operators.baselines import history_summary
from cellwatch.operators.cleaning import filter_date_window
from cellwatch.operators.model import risk_explanation, risk_level
from cellwatch.schemas import FEATURES_24H, MEASURES, TOTALS


def _check_limit(limit: int) -> None:
    if not 1 <= limit <= 10000:
        raise ValueError("limit must be between 1 and 10000")


def _top(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """Top rows with their rank: the cut comes first, so few rows are ranked."""
    return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def hotspot_ranking(
    hourly: DataFrame, start: str | date | None = None, end: str | date | None = None, limit: int = 10
) -> DataFrame:
    """Busiest cells of a date window, ranked; ties fall by cell id."""
    names = ["total_activity", "total_sms", "total_calls", "internet_activity"]
    cells = filter_date_window(hourly, start, end).groupBy("grid_id").agg(*[F.sum(n).alias(n) for n in names])
    return _top(cells, [F.round("total_activity", 6).desc(), F.asc("grid_id")], limit)


def hotspots_as_of(hourly: DataFrame, as_of: Column, limit: int = 10) -> DataFrame:
    """Busiest cells of one hour."""
    _check_limit(limit)
    rows = hourly.where(F.col("timestamp") == as_of).select(
        "grid_id", "timestamp", "total_activity", "total_sms", "total_calls", "internet_activity"
    )
    return _top(rows, [F.desc("total_activity"), F.asc("grid_id")], limit).withColumns(
        {
            "status": F.lit("HOTSPOT"),
            "reason": F.lit("Grid is among the highest activity areas for the effective reporting hour."),
        }
    )


def grid_activity_24h(
    hourly: DataFrame,
    as_of: Column,
    grid_id: int | Column | None = None,
    day: str | date | None = None,
    hour: int | None = None,
) -> DataFrame:
    """Points of one cell (or all) in the 24 hours up to `as_of`, by time."""
    if hour is not None and not 0 <= hour <= 23:
        raise ValueError("hour must be between 0 and 23")
    rows = hourly.where(F.col("timestamp").between(as_of - hours(23), as_of))
    if grid_id is not None:
        rows = rows.where(F.col("grid_id") == grid_id)
    if day is not None:
        rows = rows.where(F.col("date") == F.lit(day).cast("date"))
    if hour is not None:
        rows = rows.where(F.col("hour") == hour)
    return rows.select("grid_id", "timestamp", *MEASURES, *TOTALS, "internet_share").orderBy("grid_id", "timestamp")


def _latest(rows: DataFrame, ts: str) -> DataFrame:
    """Latest row of each cell, as a map-side combined aggregate."""
    row = F.struct(*[c for c in rows.columns if c != "grid_id"])
    return rows.groupBy("grid_id").agg(F.max_by(row, F.col(ts)).alias("row")).select("grid_id", "row.*")


def latest_features(features: DataFrame) -> DataFrame:
    """Latest feature row of every cell."""
    return _latest(features, "feature_timestamp").withColumns(
        {"data_quality": F.lit("GOOD"), "freshness": F.lit("CURRENT")}
    )


def risk_lookup(
    predictions: DataFrame, anomalies: DataFrame, at: Column | None = None, model_version: str = "ML3-v1"
) -> DataFrame:
    """Stored prediction per cell, latest or at an hour, with level and note.

    The note names the anomaly of that hour when there is one.
    """
    rows = predictions.select("grid_id", "timestamp", F.col("risk_probability").alias("risk_score"))
    chosen = _latest(rows, "timestamp") if at is None else rows.where(F.col("timestamp") == at)
    context = anomalies.where(F.col("direction") != "normal").select("grid_id", "timestamp", "reason")
    note = risk_explanation(F.col("risk_score"))
    return chosen.join(context, ["grid_id", "timestamp"], "left").select(
        "grid_id",
        F.col("timestamp").alias("feature_timestamp"),
        "risk_score",
        risk_level(F.col("risk_score")).alias("risk_level"),
        F.lit(model_version).alias("model_version"),
        F.when(F.col("reason").isNotNull(), F.concat(note, F.lit(" ML4 anomaly context: "), F.col("reason")))
        .otherwise(note)
        .alias("explanation_note"),
    )


def top_attention(scores: DataFrame, anomalies: DataFrame, limit: int = 20) -> DataFrame:
    """Highest risk of the latest scored hour with that hour's anomaly."""
    _check_limit(limit)
    latest = scores.agg(F.max("timestamp")).scalar()
    top = scores.where(F.col("timestamp") == latest).orderBy(F.desc("risk_score"), "grid_id").limit(limit)
    keys = ["grid_id", "timestamp"]
    # `top` has at most `limit` rows, and so has what matches it.
    matched = anomalies.join(F.broadcast(top.select(*keys)), keys, "left_semi")
    return top.join(F.broadcast(matched), keys, "left")


def surging_grids(
    features: DataFrame, cells: DataFrame, as_of: Column, min_baseline: float = 50.0, limit: int = 10
) -> DataFrame:
    """Cells growing most against their baseline at `as_of`, with location."""
    _check_limit(limit)
    rows = features.where((F.col("feature_timestamp") == as_of) & (F.col("avg_activity") >= min_baseline))
    top = _top(rows, [F.round("activity_growth", 9).desc(), F.asc("grid_id")], limit)
    places = cells.select("grid_id", "centroid_latitude", "centroid_longitude").join(
        F.broadcast(top.select("grid_id")), "grid_id", "left_semi"
    )
    growth = F.col("activity_growth")
    return top.join(F.broadcast(places), "grid_id", "left").select(
        "rank",
        "grid_id",
        "feature_timestamp",
        steady_round(F.col("avg_activity") * (1 + growth), 2).alias("current_activity"),
        steady_round(F.col("avg_activity"), 2).alias("baseline_activity"),
        steady_round(growth, 4).alias("growth_ratio"),
        F.concat(fixed(F.round(growth * 100, 9), 1), F.lit("%")).alias("growth_percentage"),
        "centroid_latitude",
        "centroid_longitude",
    )


def evidence_package(hourly: DataFrame, features: DataFrame, risk: DataFrame, as_of: Column) -> DataFrame:
    """Rounded evidence per cell: current activity, features and stored risk."""
    recent = hourly.where(F.col("timestamp").between(as_of - hours(23), as_of))
    current = _latest(recent.select("grid_id", "timestamp", "total_activity"), "timestamp")
    return (
        latest_features(features)
        .join(current.select("grid_id", "total_activity"), "grid_id", "left")
        .join(risk.select("grid_id", "risk_score", "risk_level"), "grid_id")
        .select(
            "grid_id",
            "feature_timestamp",
            steady_round(F.coalesce("total_activity", F.lit(0.0)), 2).alias("current_activity"),
            steady_round(F.col("avg_activity"), 2).alias("baseline_activity"),
            *[
                steady_round(F.col(c), 4).alias(c)
                for c in FEATURES_24H
                if c not in ("avg_activity", "active_hours")
            ],
            steady_round(F.col("risk_score"), 4).alias("anomaly_score"),
            F.lower("risk_level").alias("anomaly_direction"),
        )
    )


def evidence_document(evidence: DataFrame) -> DataFrame:
    """Evidence rows as one JSON text per cell."""
    fields = [c for c in evidence.columns if c != "grid_id"]
    return evidence.select("grid_id", F.to_json(F.struct(*fields)).alias("evidence"))


def investigation_package(
    hourly: DataFrame, features: DataFrame, risk: DataFrame, cells: DataFrame, as_of: Column
) -> DataFrame:
    """Curated evidence: current hour, history summary, location and risk."""
    return (
        history_summary(hourly, as_of)
        .join(latest_features(features).select("grid_id", "activity_growth", "peak_ratio", "variability"), "grid_id", "left")
        .join(cells.select("grid_id", "centroid_latitude", "centroid_longitude"), "grid_id", "left")
        .join(risk.select("grid_id", "risk_score", "risk_level", "explanation_note"), "grid_id", "left")
    )


# Fixed thresholds of the four assessment presets: score and growth limits for
# HIGH and ATTENTION (NULL: not used), and whether stale data caps the result.
PRESETS = {
    "supervisor": {"score": (0.6, None), "growth": (None, None), "stale_caps": True, "needs_all": False},
    "investigator": {"score": (0.65, 0.35), "growth": (None, None), "stale_caps": True, "needs_all": False},
    "explain": {"score": (0.6, 0.3), "growth": (1.5, 0.5), "stale_caps": False, "needs_all": False},
    "skill": {"score": (0.7, 0.4), "growth": (None, None), "stale_caps": False, "needs_all": True},
}


def _above(column: str, limit: float | None) -> Column:
    if limit is None:
        return F.lit(False)
    return F.coalesce(F.col(column) > limit, F.lit(False))


def severity(preset: str) -> Column:
    """Severity of an evidence row with a `trustworthy` column."""
    rule = PRESETS[preset]
    (high, attention), (growth_high, growth_attention) = rule["score"], rule["growth"]
    result = (
        F.when(_above("anomaly_score", high) | _above("activity_growth", growth_high), "HIGH")
        .when(_above("anomaly_score", attention) | _above("activity_growth", growth_attention), "ATTENTION")
        .otherwise("NORMAL")
    )
    if rule["stale_caps"]:
        result = F.when(~F.col("trustworthy"), "ATTENTION").otherwise(result)
    if rule["needs_all"]:
        needed = ["grid_id", "current_activity", "baseline_activity", "anomaly_score", "trustworthy"]
        missing = F.greatest(*[F.col(c).isNull().cast("int") for c in needed]) == 1
        result = F.when(missing, "INSUFFICIENT EVIDENCE").otherwise(result)
    return result


def severity_assessment(evidence: DataFrame) -> DataFrame:
    """All presets over every evidence row."""
    return evidence.withColumns({f"severity_{name}": severity(name) for name in PRESETS})


def anomaly_reconciliation(risk: DataFrame, alerts: DataFrame, limit: float = 0.5) -> DataFrame:
    """Does the stored risk of a cell agree with its having an alert?"""
    alerted = alerts.select("grid_id").distinct().withColumn("has_alert", F.lit(True))
    has, high = F.coalesce("has_alert", F.lit(False)), F.col("risk_score") > limit
    return risk.join(alerted, "grid_id", "left").select(
        "grid_id",
        "risk_score",
        has.alias("has_alert"),
        F.when(has & high, "FULL_AGREEMENT")
        .when(has, "RULE_ONLY_DIVERGENCE")
        .when(high, "ML_ONLY_DIVERGENCE")
        .otherwise("BASELINE_NORMAL")
        .alias("agreement_status"),
    )


def run_health(status: DataFrame, now: Column) -> DataFrame:
    """Health, freshness, reasons and trust of run-status records at `now`."""
    age = second_number(now) - second_number(F.col("run_timestamp"))
    state = F.upper(F.coalesce("status", F.lit("UNKNOWN")))
    tasks = F.coalesce("per_task_status", F.create_map().cast("map<string,string>"))
    failing = F.map_filter(tasks, lambda _, v: ~F.upper(v).isin("SUCCESS", "SKIPPED"))
    task_reasons = F.transform(
        F.array_sort(F.map_entries(failing)),
        lambda e: F.concat(F.lit("Task '"), e["key"], F.lit("' status is "), e["value"], F.lit(".")),
    )
    freshness = F.when(age < 3600, "FRESH").when(age < 86400, "STALE").otherwise("VERY_STALE")
    reasons = F.concat(
        F.when(state != "SUCCESS", F.array(F.concat(F.lit("Pipeline status is "), state, F.lit(".")))).otherwise(F.array().cast("array<string>")),
        task_reasons,
        F.when(
            F.col("freshness") != "FRESH",
            F.array(F.concat(F.lit("Analytics status record is "), F.col("freshness"), F.lit("."))),
        ).otherwise(F.array().cast("array<string>")),
    )
    return (
        status.withColumn("freshness", freshness)
        .withColumn("reasons", reasons)
        .withColumn("healthy", F.size("reasons") == 0)
        .withColumn("trustworthy", F.col("healthy") & (F.col("freshness") == "FRESH"))
    )
