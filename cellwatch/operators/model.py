"""Next-hour risk classifier: split, weights, training, scoring, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwatch.operators.tree import TreeModel, fit_tree
from cellwatch.schemas import MODEL_FEATURES

TRAIN_RATIO = 0.60
VALIDATION_RATIO = 0.20
DECISION_THRESHOLD = 0.50
OPERATIONAL_THRESHOLD = 0.85
RISK_HIGH = 0.80
RISK_MEDIUM = 0.40


def chronological_split(dataset: DataFrame) -> DataFrame:
    """Rows labelled train, validation or test by their place in time.

    Only the distinct hours are ordered together.
    """
    stamps = dataset.select("feature_timestamp").distinct()
    ends = stamps.agg(F.array_sort(F.collect_list("feature_timestamp")).alias("t")).select(
        F.struct(
            F.get("t", (F.floor(F.size("t") * F.lit(TRAIN_RATIO)) - 1).cast("int")).alias("train"),
            F.get("t", (F.floor(F.size("t") * F.lit(TRAIN_RATIO + VALIDATION_RATIO)) - 1).cast("int")).alias("validation"),
        )
    )
    return (
        dataset.withColumn("_ends", ends.scalar())
        .withColumn(
            "split",
            F.when(F.col("feature_timestamp") <= F.col("_ends.train"), "train")
            .when(F.col("feature_timestamp") <= F.col("_ends.validation"), "validation")
            .otherwise("test"),
        )
        .drop("_ends")
    )


def class_weights(split: DataFrame) -> DataFrame:
    """Balanced class weights, n / (classes * n_class), over train and validation."""
    counts = split.where(F.col("split") != "test").groupBy("target").agg(F.count("*").alias("rows"))
    whole = counts.agg(F.struct(F.sum("rows").alias("n"), F.count("*").alias("k"))).scalar()
    return counts.withColumn("_all", whole).select(
        "target", "rows", (F.col("_all.n") / (F.col("_all.k") * F.col("rows"))).alias("weight")
    )


def train_risk_model(split: DataFrame) -> TreeModel:
    """Entropy tree of depth 7 over train and validation rows, balanced by class weight."""
    weights = {r["target"]: r["weight"] for r in class_weights(split).collect()}
    rows = split.where(F.col("split") != "test")
    return fit_tree(rows, MODEL_FEATURES, "target", (weights.get(0, 1.0), weights.get(1, 1.0)))


def feature_importance(model: TreeModel, spark) -> DataFrame:
    rows = list(model.importances().items())
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def _scored(model: TreeModel, dataset: DataFrame) -> DataFrame:
    """Dataset rows with the probability of class 1."""
    return dataset.withColumn("risk_score", model.probability()).withColumnRenamed("feature_timestamp", "timestamp")


def risk_scores(model: TreeModel, dataset: DataFrame, model_version: str = "ML3-v1") -> DataFrame:
    """Probability of class 1 per row with its level and model version."""
    return _scored(model, dataset).select(
        "grid_id",
        "timestamp",
        "risk_score",
        risk_level(F.col("risk_score")).alias("risk_level"),
        F.lit(model_version).alias("model_version"),
    )


def serving_predictions(model: TreeModel, dataset: DataFrame) -> DataFrame:
    """Stored predictions of all rows, training rows included."""
    return predictions(_scored(model, dataset).withColumnRenamed("risk_score", "risk_probability"))


def predictions(scored: DataFrame) -> DataFrame:
    return scored.select(
        "grid_id",
        "timestamp",
        "target",
        "risk_probability",
        (F.col("risk_probability") >= DECISION_THRESHOLD).cast("int").alias("prediction"),
    )


def risk_level(score: Column) -> Column:
    return F.when(score >= RISK_HIGH, "HIGH").when(score >= RISK_MEDIUM, "MEDIUM").otherwise("LOW")


def risk_explanation(score: Column) -> Column:
    return (
        F.when(score >= RISK_HIGH, "High future high-activity risk. Investigate the grid.")
        .when(
            score >= RISK_MEDIUM,
            "Medium future high-activity risk. Monitor the grid and consider investigation.",
        )
        .otherwise("Low future high-activity risk based on the ML3 prediction.")
    )


def risk_levels(scores: DataFrame) -> DataFrame:
    return scores.withColumns(
        {"risk_level": risk_level(F.col("risk_score")), "explanation": risk_explanation(F.col("risk_score"))}
    )


def risk_model_metrics(evaluated: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1, rates and confusion counts in one pass."""
    actual, predicted = F.col("target") == 1, F.col("prediction") == 1
    counts = evaluated.agg(
        F.count("*").alias("test_rows"),
        F.count_if(actual).alias("test_positive_rows"),
        F.count_if(actual & predicted).alias("true_positive"),
        F.count_if(~actual & predicted).alias("false_positive"),
        F.count_if(~actual & ~predicted).alias("true_negative"),
        F.count_if(actual & ~predicted).alias("false_negative"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("true_positive", "false_positive", "true_negative", "false_negative"))

    def guarded(part: Column, whole: Column) -> Column:
        return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))

    return counts.withColumns(
        {
            "accuracy": guarded(tp + tn, F.col("test_rows")),
            "precision": guarded(tp, tp + fp),
            "recall": guarded(tp, tp + fn),
            "f1": guarded(2 * tp, 2 * tp + fp + fn),
            "positive_rate": guarded(tp + fn, F.col("test_rows")),
            "predicted_positive_rate": guarded(tp + fp, F.col("test_rows")),
        }
    )


def model_rule_agreement(evaluated: DataFrame, rule_flags: DataFrame) -> DataFrame:
    """Agreement of probability >= 0.85 with the rule flag where one exists."""
    flags = rule_flags.select("grid_id", F.col("timestamp").alias("feature_timestamp"), "np3_high_activity")
    model_high = (F.col("risk_probability") >= OPERATIONAL_THRESHOLD).cast("int")
    compared = (
        evaluated.join(flags, ["grid_id", "feature_timestamp"])
        .where(F.col("np3_high_activity").isNotNull())
        .withColumn("model_high_risk", model_high)
    )
    return compared.agg(
        F.coalesce(F.sum("model_high_risk"), F.lit(0)).alias("model_high_risk"),
        F.coalesce(F.sum("np3_high_activity"), F.lit(0)).alias("np3_high_activity"),
        F.count_if(F.col("model_high_risk") == F.col("np3_high_activity")).alias("agreement_count"),
        F.count("*").alias("comparable_rows"),
    ).withColumn(
        "agreement_rate",
        F.coalesce(F.col("agreement_count") / F.nullif(F.col("comparable_rows"), F.lit(0)), F.lit(0.0)),
    )


def risk_threshold_sensitivity(scores: DataFrame, baseline: float = 0.65, trial: float = 0.35, top: int = 5) -> DataFrame:
    """Rows flagged at two thresholds, the growth, and the top cells of each.

    One scan counts both settings and one finds the overall top rows, of which
    each setting's top rows are those over its threshold.
    """
    settings = {"baseline": baseline, "trial": trial}
    row = F.struct("risk_score", (-F.col("grid_id")).alias("g"))
    top_rows = scores.orderBy(F.desc("risk_score"), "grid_id", "timestamp").limit(top)
    leaders = top_rows.agg(F.sort_array(F.collect_list(row), asc=False)).scalar()
    counts = scores.agg(*[F.count_if(F.col("risk_score") >= t).alias(n) for n, t in settings.items()])

    def cells(threshold: Column) -> Column:
        over = F.filter("leaders", lambda x: x["risk_score"] >= threshold)
        return F.array_join(F.transform(over, lambda x: (-x["g"]).cast("string")), ",")

    growth = 100.0 * (F.col("flagged_volume") - F.col("base")) / F.greatest(F.col("base"), F.lit(1))
    limits = F.when(F.col("setting") == "baseline", baseline).otherwise(trial)
    return (
        counts.withColumns({"leaders": leaders, "base": F.col("baseline")})
        .unpivot(["leaders", "base"], list(settings), "setting", "flagged_volume")
        .withColumn("threshold", limits)
        .select("setting", "threshold", "flagged_volume", cells(F.col("threshold")).alias("top_cells"), growth.alias("growth_pct"))
    )
