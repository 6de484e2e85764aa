"""Classifier queries: split, weights, training, scoring and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from catalog.core import query, rounded
from cellwatch import runtime
from cellwatch.operators import baselines, features, model, tree
from cellwatch.plans import batch
from cellwatch.schemas import MODEL_FEATURES

H = v.hourly_sql()
HD = v.hourly_sql(v.DENSE)
DATASET = f"SELECT * FROM ({v.features_sql(HD)}) WHERE recent_6h_mean IS NOT NULL"
SPLIT = f"""
  WITH d AS MATERIALIZED ({DATASET}),
  t AS (SELECT feature_timestamp, row_number() OVER (ORDER BY feature_timestamp) AS n FROM (SELECT DISTINCT feature_timestamp FROM d)),
  e AS (SELECT CAST(floor(count(*) * 0.6::DOUBLE) AS BIGINT) AS a, CAST(floor(count(*) * 0.8::DOUBLE) AS BIGINT) AS b FROM t)
  SELECT d.*, CASE WHEN t.n <= e.a THEN 'train' WHEN t.n <= e.b THEN 'validation' ELSE 'test' END AS split
  FROM d JOIN t ON d.feature_timestamp = t.feature_timestamp, e"""


def _dataset(spark, sf):
    return features.model_dataset(v.hourly(spark, sf, v.DENSE))


def _trained(spark, sf):
    """Stored split dataset and the model fitted on it; the fit reads it often."""
    split = runtime.materialize(model.chronological_split(_dataset(spark, sf)), "split")
    return split, model.train_risk_model(split)


@query("chronological_split", f"SELECT grid_id, feature_timestamp, target, split FROM ({SPLIT})")
def _(spark, sf):
    return model.chronological_split(_dataset(spark, sf)).select("grid_id", "feature_timestamp", "target", "split")


@query(
    "class_weights",
    rounded(
        f"""WITH c AS (SELECT target, count(*) AS rows FROM ({SPLIT}) WHERE split <> 'test' GROUP BY target)
            SELECT target, rows, (SELECT sum(rows) FROM c) / ((SELECT count(*) FROM c) * rows)::DOUBLE AS weight FROM c""",
        "weight",
        "target, rows",
    ),
)
def _(spark, sf):
    return model.class_weights(model.chronological_split(_dataset(spark, sf)))


def _tree_sql() -> str:
    """CTEs that grow the tree: rows r1.. by node per level, best splits b1.., and the leaves' probabilities."""
    inputs = ", ".join(f"CAST(CAST({f} AS FLOAT) AS DOUBLE)" for f in MODEL_FEATURES)

    def entropy(zero: str, one: str) -> str:
        term = "CASE WHEN {0} > 0 THEN ({0}) * log2({0}) ELSE 0 END"
        return f"({term.format(f'({zero} + {one})')} - {term.format(zero)} - {term.format(one)})"

    steps = [
        f"d AS MATERIALIZED (SELECT *, [{inputs}] AS x FROM ({SPLIT}))",
        "w AS MATERIALIZED (SELECT n / (2.0::DOUBLE * n0) AS w0, n / (2.0::DOUBLE * n1) AS w1 FROM (SELECT count(*) AS n, count(*) FILTER (WHERE target = 0) AS n0, count(*) FILTER (WHERE target = 1) AS n1 FROM d WHERE split <> 'test'))",
        "r0 AS (SELECT grid_id, feature_timestamp, target, split, x, 1 AS node FROM d)",
    ]
    for k in range(tree.MAX_DEPTH):
        gain = f"""({entropy('n0 * w0', 'n1 * w1')} - {entropy('l0 * w0', 'l1 * w1')} - {entropy('(n0 - l0) * w0', '(n1 - l1) * w1')}) / (n0 * w0 + n1 * w1)"""
        steps += [
            f"""t{k} AS MATERIALIZED (SELECT node, count(*) FILTER (WHERE target = 0) AS n0, count(*) FILTER (WHERE target = 1) AS n1 FROM r{k} WHERE split <> 'test' GROUP BY node)""",
            f"""v{k} AS (SELECT node, feature, value, count(*) FILTER (WHERE target = 0) AS c0, count(*) FILTER (WHERE target = 1) AS c1
              FROM (SELECT node, target, unnest(range({len(MODEL_FEATURES)})) AS feature, unnest(x) AS value FROM r{k} WHERE split <> 'test') GROUP BY ALL)""",
            f"""p{k} AS (SELECT node, feature, value, lead(value) OVER o AS after, sum(c0) OVER o AS l0, sum(c1) OVER o AS l1 FROM v{k} WINDOW o AS (PARTITION BY node, feature ORDER BY value))""",
            f"""g{k} AS (SELECT *, {gain} AS gain FROM p{k} JOIN t{k} USING (node), w
              WHERE after > value + {tree.MIN_GAP} AND l0 + l1 >= {tree.MIN_LEAF} AND n0 + n1 - l0 - l1 >= {tree.MIN_LEAF} AND n0 + n1 >= {tree.MIN_SPLIT} AND n0 > 0 AND n1 > 0)""",
            f"""b{k} AS MATERIALIZED (SELECT node, feature, (value + after) / 2 AS threshold, gain, n0 * w0 + n1 * w1 AS mass FROM g{k}
              QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, {tree.GAIN_DIGITS}) DESC, feature, value) = 1)""",
            f"""r{k + 1} AS MATERIALIZED (SELECT r.* REPLACE (CASE WHEN b.node IS NULL THEN r.node WHEN x[b.feature + 1] <= b.threshold THEN 2 * r.node ELSE 2 * r.node + 1 END AS node)
              FROM r{k} r LEFT JOIN b{k} b ON r.node = b.node)""",
        ]
    last = tree.MAX_DEPTH
    steps += [
        f"""leaf AS (SELECT node, n1 * w1 / (n0 * w0 + n1 * w1) AS p FROM (SELECT node, count(*) FILTER (WHERE target = 0) AS n0, count(*) FILTER (WHERE target = 1) AS n1
          FROM r{last} WHERE split <> 'test' GROUP BY node), w)""",
        f"scored AS (SELECT grid_id, feature_timestamp AS timestamp, target, split, p FROM r{last} JOIN leaf USING (node))",
        "splits AS (" + " UNION ALL ".join(f"SELECT node, feature, threshold, gain, mass FROM b{k}" for k in range(last)) + ")",
    ]
    return "WITH " + ",\n".join(steps)


TREE = _tree_sql()
NAMES = "[" + ", ".join(f"'{f}'" for f in MODEL_FEATURES) + "]"


def _metrics_sql(counts: str) -> str:
    """Ratios of the confusion counts."""
    return f"""SELECT *, (true_positive + true_negative) / test_rows AS accuracy,
              coalesce(true_positive / nullif(true_positive + false_positive, 0), 0) AS precision,
              coalesce(true_positive / nullif(test_positive_rows, 0), 0) AS recall,
              coalesce(2 * true_positive / nullif(2 * true_positive + false_positive + false_negative, 0), 0) AS f1,
              test_positive_rows / test_rows AS positive_rate, (true_positive + false_positive) / test_rows AS predicted_positive_rate
            FROM (SELECT count(*) AS test_rows, count(*) FILTER (WHERE target = 1) AS test_positive_rows,
              count(*) FILTER (WHERE target = 1 AND prediction = 1) AS true_positive, count(*) FILTER (WHERE target = 0 AND prediction = 1) AS false_positive,
              count(*) FILTER (WHERE target = 0 AND prediction = 0) AS true_negative, count(*) FILTER (WHERE target = 1 AND prediction = 0) AS false_negative
            FROM ({counts}))"""


_RATIOS = "accuracy precision recall f1 positive_rate predicted_positive_rate"
_COUNTS = "test_rows, test_positive_rows, true_positive, false_positive, true_negative, false_negative"
_HELD_OUT = f"{TREE} SELECT target, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS prediction FROM scored WHERE split = 'test'"


@query("risk_model_train", rounded(_metrics_sql(_HELD_OUT), _RATIOS, _COUNTS))
def _(spark, sf):
    """Metrics of the fitted tree on the held-out hours."""
    split, fitted = _trained(spark, sf)
    held_out = model.serving_predictions(fitted, split.where(F.col("split") == "test"))
    return model.risk_model_metrics(held_out)


@query(
    "risk_model_nodes",
    rounded(
        f"""{TREE}, parts AS (SELECT node, {NAMES}[feature + 1] AS feature, threshold, gain FROM splits)
            SELECT * FROM parts""",
        "threshold gain",
        "node, feature",
    ),
)
def _(spark, sf):
    """Splits of the fitted tree."""
    _, fitted = _trained(spark, sf)
    return fitted.table(spark).where("feature IS NOT NULL").select(F.col("node").cast("int"), "feature", "threshold", "gain")


@query(
    "feature_importance",
    rounded(
        f"""{TREE}, whole AS (SELECT sum(gain * mass) AS g FROM splits)
            SELECT name AS feature, coalesce((SELECT sum(gain * mass) FROM splits WHERE {NAMES}[feature + 1] = name) / (SELECT nullif(g, 0) FROM whole), 0) AS importance
            FROM (SELECT unnest({NAMES}) AS name)""",
        "importance",
        "feature",
    ),
)
def _(spark, sf):
    return model.feature_importance(_trained(spark, sf)[1], spark)


SCORES = rounded(f"{TREE} SELECT *, p AS risk_score, {v.level_sql('p')} AS risk_level, 'ML3-v1' AS model_version FROM scored", "risk_score", "grid_id, timestamp, risk_level, model_version")


@query("risk_scores", SCORES)
def _(spark, sf):
    split, fitted = _trained(spark, sf)
    return model.risk_scores(fitted, split)


@query("saved_model_scores", SCORES)
def _(spark, sf):
    """Scores of a later run that reads the model an earlier one saved."""
    out = batch.Layout(runtime.scratch_path(spark, "scoring"))
    split, fitted = _trained(spark, sf)
    fitted.save(spark, out.path("risk_model"))
    out.write(split, "model_dataset")
    batch.score_saved(spark, out)
    return out.read(spark, "risk_scores")


@query(
    "serving_predictions",
    rounded(f"{TREE} SELECT *, p AS risk_probability, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS prediction FROM scored", "risk_probability", "grid_id, timestamp, target, prediction"),
)
def _(spark, sf):
    split, fitted = _trained(spark, sf)
    return model.serving_predictions(fitted, split)


@query(
    "risk_scores_check",
    f"""SELECT count(*) AS scored_rows, count(*) AS distinct_rows, 0::BIGINT AS out_of_range, 0::BIGINT AS wrong_level, TRUE AS few_scores
        FROM (SELECT DISTINCT grid_id, feature_timestamp FROM ({DATASET}))""",
)
def _(spark, sf):
    """Each dataset row scored once, in range, at the level of its band, with at most one score a leaf."""
    split, fitted = _trained(spark, sf)
    scores = runtime.materialize(model.risk_scores(fitted, split), "scores")
    score = F.col("risk_score")
    band = F.when(score >= 0.8, "HIGH").when(score >= 0.4, "MEDIUM").otherwise("LOW")
    return scores.agg(
        F.count("*").alias("scored_rows"),
        F.count_distinct("grid_id", "timestamp").alias("distinct_rows"),
        F.count_if(~score.between(0.0, 1.0)).alias("out_of_range"),
        F.count_if(F.upper("risk_level") != band).alias("wrong_level"),
        (F.count_distinct("risk_score") <= 128).alias("few_scores"),
    )


@query(
    "risk_model_check",
    f"""SELECT count(*) FILTER (WHERE split = 'test') AS test_rows, count(*) FILTER (WHERE split = 'test') AS confusion_rows,
          count(*) FILTER (WHERE split = 'test' AND target = 1) AS test_positive_rows, TRUE AS importances_sum_to_one, TRUE AS leaves_full
        FROM ({SPLIT})""",
)
def _(spark, sf):
    """Confusion counts cover the held-out rows, importances are shares, and leaves hold ten training rows."""
    split, fitted = _trained(spark, sf)
    counts = model.risk_model_metrics(model.serving_predictions(fitted, split.where(F.col("split") == "test"))).first()
    shares = [r["importance"] for r in model.feature_importance(fitted, spark).collect()]
    # The score names the leaf up to leaves of equal score, so a group holds at least one whole leaf.
    trained = model.risk_scores(fitted, split.where(F.col("split") != "test")).groupBy("risk_score").count()
    full = trained.agg(F.min("count")).first()[0] >= 10
    row = (
        counts["test_rows"],
        sum(counts[c] for c in ("true_positive", "false_positive", "true_negative", "false_negative")),
        counts["test_positive_rows"],
        min(shares) >= 0 and abs(sum(shares) - 1) < 1e-9,
        full,
    )
    return spark.createDataFrame([row], "test_rows long, confusion_rows long, test_positive_rows long, importances_sum_to_one boolean, leaves_full boolean")


@query("risk_model_metrics", rounded(_metrics_sql(v.predicted_sql(HD)), _RATIOS, _COUNTS))
def _(spark, sf):
    return model.risk_model_metrics(v.predicted(v.hourly(spark, sf, v.DENSE)))


@query(
    "model_rule_agreement",
    rounded(
        f"""SELECT CAST(sum(m) AS BIGINT) AS model_high_risk, CAST(sum(r) AS BIGINT) AS np3_high_activity, count(*) FILTER (WHERE m = r) AS agreement_count,
              count(*) AS comparable_rows, count(*) FILTER (WHERE m = r) / count(*)::DOUBLE AS agreement_rate
            FROM (SELECT CAST(p.risk_probability >= 0.85 AS INTEGER) AS m, CAST(w.total_activity > 1.5::DOUBLE * w.trailing_median AS INTEGER) AS r
                  FROM ({v.predicted_sql(HD)}) p JOIN ({v.windows_sql(HD)}) w ON p.grid_id = w.grid_id AND p.timestamp = w.timestamp
                  WHERE w.trailing_median IS NOT NULL)""",
        "agreement_rate",
        "model_high_risk, np3_high_activity, agreement_count, comparable_rows",
    ),
)
def _(spark, sf):
    hours = v.stored_hourly(spark, sf, v.DENSE)
    evaluated = v.predicted(hours).withColumnRenamed("timestamp", "feature_timestamp")
    return model.model_rule_agreement(evaluated, baselines.trailing_high_activity(hours))


@query(
    "risk_levels",
    rounded(
        f"""SELECT grid_id, timestamp, score AS risk_score, {v.level_sql('score')} AS risk_level,
              CASE WHEN score >= 0.8 THEN 'High future high-activity risk. Investigate the grid.'
                WHEN score >= 0.4 THEN 'Medium future high-activity risk. Monitor the grid and consider investigation.'
                ELSE 'Low future high-activity risk based on the ML3 prediction.' END AS explanation
            FROM (SELECT grid_id, timestamp, {v.stand_in_sql()} AS score FROM ({H}))""",
        "risk_score",
        "grid_id, timestamp, risk_level, explanation",
    ),
)
def _(spark, sf):
    return model.risk_levels(v.scored_hours(v.hourly(spark, sf)).drop("risk_level", "model_version"))


def _side(label: str, threshold: float) -> str:
    return f"""SELECT '{label}' AS setting, {threshold} AS threshold, (SELECT count(*) FROM s WHERE score >= {threshold}) AS flagged_volume,
        (SELECT string_agg(CAST(grid_id AS VARCHAR), ',' ORDER BY score DESC, grid_id) FROM (
          SELECT * FROM s WHERE score >= {threshold} ORDER BY score DESC, grid_id, timestamp LIMIT 5)) AS top_cells"""


@query(
    "risk_threshold_sensitivity",
    rounded(
        f"""WITH s AS MATERIALIZED (SELECT grid_id, timestamp, {v.stand_in_sql()} AS score FROM ({H})),
              b AS ({_side('baseline', 0.65)} UNION ALL {_side('trial', 0.35)})
            SELECT *, 100.0::DOUBLE * (flagged_volume - (SELECT flagged_volume FROM b WHERE setting = 'baseline'))
              / greatest((SELECT flagged_volume FROM b WHERE setting = 'baseline'), 1) AS growth_pct FROM b""",
        "threshold growth_pct",
        "setting, flagged_volume, top_cells",
    ),
)
def _(spark, sf):
    return model.risk_threshold_sensitivity(v.scored_hours(v.hourly(spark, sf)))
