"""Historical anomaly scores and the comparison of the three signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwatch.functions.columns import fixed
from cellwatch.operators.alerts import HIGH_THRESHOLD, activity_floor, with_rule_inputs
from cellwatch.operators.baselines import by_whole_cell, hour_bucket_baseline
from cellwatch.operators.cleaning import dedupe_keys
from cellwatch.operators.features import with_model_features
from cellwatch.schemas import GRAIN

HIGH_DEVIATION = 0.50
LOW_DEVIATION = -0.50


def deviation() -> Column:
    """Share by which a row exceeds its baseline, 0.0 where the baseline is not positive."""
    now, base = F.col("total_activity"), F.col("baseline_activity")
    return F.when(base > 0, (now - base) / F.nullif(base, F.lit(0.0))).otherwise(F.lit(0.0))


def direction(share: Column) -> Column:
    return F.when(share > HIGH_DEVIATION, "high").when(share < LOW_DEVIATION, "low").otherwise("normal")


def anomaly_scores(baselined: DataFrame) -> DataFrame:
    """Deviation from the baseline, its size, direction and reason per row."""
    now, base = F.col("total_activity"), F.col("baseline_activity")
    share, side_of = F.col("percentage_deviation"), F.col("direction")
    percent = F.concat(fixed(F.abs(share) * 100, 1), F.lit("%"))

    def text(kind: str, side: str) -> Column:
        return F.concat(
            F.lit(f"ANOMALY_{kind}: Current activity "), fixed(now, 2), F.lit(" is "), percent,
            F.lit(f" {side} the historical hour-of-day baseline of "), fixed(base, 2), F.lit("."),
        )

    return (
        baselined.select("grid_id", "timestamp", "total_activity", "baseline_activity")
        .withColumn("percentage_deviation", deviation())
        .withColumn("anomaly_score", F.abs(share))
        .withColumn("direction", direction(share))
        .withColumn(
            "reason",
            F.when(side_of == "high", text("HIGH", "above"))
            .when(side_of == "low", text("LOW", "below"))
            .otherwise("NORMAL: Activity within expected historical bounds."),
        )
    )


# Names of the eight exclusive outcomes by (rule, model, anomaly) flag.
OUTCOMES = {
    "all_three": (1, 1, 1),
    "np3_ml3_only": (1, 1, 0),
    "np3_ml4_only": (1, 0, 1),
    "ml3_ml4_only": (0, 1, 1),
    "np3_only": (1, 0, 0),
    "ml3_only": (0, 1, 0),
    "ml4_only": (0, 0, 1),
    "none_flagged": (0, 0, 0),
}


def three_way_comparison(
    anomalies: DataFrame, alerts: DataFrame, predictions: DataFrame, first_by: list[str] | None = None
) -> DataFrame:
    """Anomaly rows with rule and model flags and the eight outcomes."""
    rule = alerts.where(F.col("alert_type") == "HIGH_ACTIVITY").select(*GRAIN).distinct()
    model = dedupe_keys(
        predictions.select(
            *GRAIN,
            F.col("risk_probability").cast("double").alias("ml3_probability"),
            F.col("prediction").cast("int").alias("ml3_risk"),
        ),
        GRAIN,
        first_by,
    )
    flagged = (
        anomalies.select(*GRAIN, "anomaly_score", "percentage_deviation", "direction")
        .join(rule.withColumn("np3_flag", F.lit(1)), GRAIN, "left")
        .join(model, GRAIN, "left")
        .withColumns(
            {
                "ml4_high": (F.col("direction") == "high").cast("int"),
                "ml4_low": (F.col("direction") == "low").cast("int"),
                "ml4_anomaly": (F.col("direction") != "normal").cast("int"),
                "np3_flag": F.coalesce("np3_flag", F.lit(0)),
                "ml3_risk": F.coalesce("ml3_risk", F.lit(0)),
                "ml3_probability": F.coalesce("ml3_probability", F.lit(0.0)),
            }
        )
    )
    return with_outcomes(flagged)


def with_outcomes(flagged: DataFrame) -> DataFrame:
    """Rows with the eight exclusive outcomes of their three flags."""
    flags = F.struct("np3_flag", "ml3_risk", "ml4_high")
    return flagged.withColumns(
        {
            name: (flags == F.struct(*[F.lit(v) for v in values])).cast("int")
            for name, values in OUTCOMES.items()
        }
    )


def signals(hourly: DataFrame, probability: Column, decision: float = 0.5) -> DataFrame:
    """`three_way_comparison` of the hourly rows themselves, without a join of the three signals.

    `probability` is the model's, over the model features, cell and timestamp
    of a row; it counts for the rows of the model dataset, others have none.
    Features, rule, and historical baseline are windows by cell, so the hours
    are shuffled once; the floor's own shuffles carry one row per date, or a
    few values next to it.
    """
    cells = by_whole_cell(hourly, "timestamp", "date", "total_activity", "internet_activity")
    rows = with_model_features(cells, "date", "total_activity")
    rows = rows.withColumn("ml3_probability", F.when(F.col("complete"), probability)).select("grid_id", "timestamp", "date", "total_activity", "ml3_probability")
    rule = with_rule_inputs(rows, activity_floor(cells))
    high = F.col("eligible") & (F.col("total_activity") > F.col("baseline_activity") * HIGH_THRESHOLD)
    rule = rule.withColumn("np3_flag", F.coalesce(high, F.lit(False)).cast("int")).drop("baseline_activity")
    scored = hour_bucket_baseline(rule).withColumn("percentage_deviation", deviation())
    side = direction(F.col("percentage_deviation"))
    return with_outcomes(
        scored.select(
            *GRAIN,
            F.abs("percentage_deviation").alias("anomaly_score"),
            "percentage_deviation",
            side.alias("direction"),
            "np3_flag",
            F.coalesce((F.col("ml3_probability") >= decision).cast("int"), F.lit(0)).alias("ml3_risk"),
            F.coalesce("ml3_probability", F.lit(0.0)).alias("ml3_probability"),
            (side == "high").cast("int").alias("ml4_high"),
            (side == "low").cast("int").alias("ml4_low"),
            (side != "normal").cast("int").alias("ml4_anomaly"),
        )
    )


def signal_overlap_metrics(comparison: DataFrame) -> DataFrame:
    """Counts of flags and outcomes and the two agreement rates."""
    same = lambda a, b: F.avg((F.col(a) == F.col(b)).cast("double"))
    return comparison.agg(
        F.count("*").alias("total_records"),
        F.sum("np3_flag").alias("np3_alerts"),
        F.sum("ml3_risk").alias("ml3_risks"),
        F.sum("ml4_high").alias("ml4_high_anomalies"),
        *[F.sum(name).alias(name) for name in OUTCOMES],
        same("ml3_risk", "ml4_high").alias("ml3_ml4_agreement"),
        same("np3_flag", "ml4_high").alias("np3_ml4_agreement"),
    )


# Fixed texts of the disagreement report.
EXPLANATIONS = {
    "np3_only": (
        "NP3-only cases indicate activity that satisfies the current-day high-activity rule but is not "
        "identified as an ML3 future risk or ML4 historical high anomaly."
    ),
    "ml3_only": (
        "ML3-only cases indicate future high-activity risk without a current NP3 alert or current ML4 high "
        "historical anomaly."
    ),
    "ml4_only": (
        "ML4-only cases indicate current activity that is unusual for the grid's historical hour-of-day "
        "behaviour without a current NP3 alert or ML3 future-risk prediction."
    ),
    "all_three": (
        "Cases flagged by all three mechanisms represent the strongest multi-signal operational attention "
        "cases because current rules, future risk, and historical deviation agree."
    ),
}


def disagreement_summary(metrics: DataFrame) -> DataFrame:
    """Explanation of each reported outcome that occurs."""
    names = list(EXPLANATIONS)
    texts = F.create_map(*[F.lit(v) for pair in EXPLANATIONS.items() for v in pair])
    return (
        metrics.select(*names)
        .unpivot([], names, "category", "cases")
        .where(F.col("cases") > 0)
        .withColumn("explanation", texts[F.col("category")])
    )
