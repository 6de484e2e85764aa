"""Decision tree with exact splits, grown level by level.

All nodes of a level are split by one job. Rows become (node, feature, value)
with counts per class; running counts in value order give every possible split
its entropy gain, and the best one of each node is the maximum of an aggregate.
Counts are whole numbers until the gain is computed, so a tree depends neither
on partitions nor on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwatch.runtime import materialize

MAX_DEPTH = 7
MIN_SPLIT = 20
MIN_LEAF = 10
# Values closer than this have no split between them.
MIN_GAP = 1e-7
# Gains that agree to so many digits are a tie.
GAIN_DIGITS = 12
# A feature's values are ordered in chunks of about so many rows.
CHUNK_ROWS = 1_000_000
MOST_CHUNKS = 1024

_NODE_SCHEMA = "node int, feature string, threshold double, rows_0 bigint, rows_1 bigint, gain double, weight_0 double, weight_1 double, inputs array<string>"


@dataclass(frozen=True)
class Node:
    """Rows per class; feature, threshold and gain are None in a leaf. The children of n are 2n and 2n + 1."""

    rows: tuple[int, int]
    feature: str | None = None
    threshold: float | None = None
    gain: float = 0.0


@dataclass(frozen=True)
class TreeModel:
    inputs: tuple[str, ...]
    weights: tuple[float, float]
    nodes: dict[int, Node]

    @property
    def depth(self) -> int:
        return max(self.nodes).bit_length() - 1

    @property
    def stages(self) -> list[TreeModel]:
        """The model as a pipeline of one stage."""
        return [self]

    def leaf(self) -> Column:
        """Number of the leaf a row falls into."""
        return _route(self.nodes, 1, {n: n for n in self.nodes})

    def probability(self) -> Column:
        """Weighted share of class 1 among the training rows of a row's leaf."""
        shares = {}
        for n, node in self.nodes.items():
            zero, one = (count * weight for count, weight in zip(node.rows, self.weights))
            shares[n] = one / (zero + one) if zero + one else 0.0
        return _route(self.nodes, 1, shares)

    def importances(self) -> dict[str, float]:
        """Each input's share of the weighted gain of all splits."""
        total = dict.fromkeys(self.inputs, 0.0)
        for node in self.nodes.values():
            if node.feature:
                total[node.feature] += node.gain * sum(c * w for c, w in zip(node.rows, self.weights))
        whole = sum(total.values())
        return {name: value / whole if whole else 0.0 for name, value in total.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per node."""
        rows = [(n, d.feature, d.threshold, *d.rows, d.gain, *self.weights, list(self.inputs)) for n, d in sorted(self.nodes.items())]
        return spark.createDataFrame(rows, _NODE_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> TreeModel:
        rows = spark.read.schema(_NODE_SCHEMA).parquet(path).collect()  # 255 nodes at most at depth 7
        if not rows:
            raise ValueError(f"no model in {path}")
        nodes = {r["node"]: Node((r["rows_0"], r["rows_1"]), r["feature"], r["threshold"], r["gain"]) for r in rows}
        return TreeModel(tuple(rows[0]["inputs"]), (rows[0]["weight_0"], rows[0]["weight_1"]), nodes)


def _value(feature: str) -> Column:
    """Features have single precision."""
    return F.col(feature).cast("float").cast("double")


def _route(nodes: dict[int, Node], at: int, values: dict[int, object]) -> Column:
    node = nodes[at]
    if node.feature is None:
        return F.lit(values.get(at))
    low, high = (_route(nodes, child, values) for child in (2 * at, 2 * at + 1))
    return F.when(_value(node.feature) <= node.threshold, low).otherwise(high)


def _weighted_entropy(zero: Column, one: Column) -> Column:
    """Weight times entropy in bits."""

    def term(w: Column) -> Column:
        return F.when(w > 0, w * F.log2(w)).otherwise(F.lit(0.0))

    return term(zero + one) - term(zero) - term(one)


def _chunk_bounds(rows: DataFrame, features: Sequence[str], count: int) -> list[list[float]] | None:
    """Per feature the values that part its rows into chunks of about CHUNK_ROWS."""
    chunks = min(MOST_CHUNKS, count // CHUNK_ROWS + 1)
    if chunks == 1:
        return None
    shares = [i / chunks for i in range(1, chunks)]
    found = rows.agg(*[F.percentile_approx(_value(f), shares, 20 * chunks).alias(f) for f in features]).first()
    return [sorted(set(found[f])) for f in features]


def split_candidates(values: DataFrame) -> DataFrame:
    """(node, feature, value, next_value, left_0, left_1) of (node, feature, chunk, value, c0, c1) rows.

    Left counts are those of all values up to `value`. A task orders the values
    of one chunk; chunks are chained by their totals.
    """
    inside = Window.partitionBy("node", "feature", "chunk").orderBy("value")
    fine = values.select("*", F.sum("c0").over(inside).alias("in_0"), F.sum("c1").over(inside).alias("in_1"), F.lead("value").over(inside).alias("next"))
    chain = Window.partitionBy("node", "feature").orderBy("chunk")
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    totals = values.groupBy("node", "feature", "chunk").agg(F.sum("c0").alias("all_0"), F.sum("c1").alias("all_1"), F.min("value").alias("least"))
    chained = totals.select(
        "node",
        "feature",
        "chunk",
        *(F.coalesce(F.sum(f"all_{c}").over(before), F.lit(0)).alias(f"before_{c}") for c in (0, 1)),
        F.lead("least").over(chain).alias("next_least"),
    )
    return fine.join(chained, ["node", "feature", "chunk"]).select(
        "node", "feature", "value", F.coalesce("next", "next_least").alias("next_value"), *((F.col(f"in_{c}") + F.col(f"before_{c}")).alias(f"left_{c}") for c in (0, 1))
    )


def _best_splits(rows: DataFrame, features: Sequence[str], label: str, open_: dict[int, tuple[int, int]], nodes: dict[int, Node], weights: tuple[float, float], bounds: list[list[float]] | None) -> list:
    """Best split of each open node, at most one row a node."""
    node = _route(nodes, 1, {n: n for n in open_})
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), _value(f).alias("value")) for i, f in enumerate(features)]))
    long = rows.select(node.alias("node"), F.col(label).alias("y"), pairs.alias("p")).where("node is not null").select("node", "y", "p.*")
    chunk = F.lit(0)
    if bounds:
        ends = F.element_at(F.array(*[F.array(*map(F.lit, b)) for b in bounds]), F.col("feature") + 1)
        chunk = F.size(F.filter(ends, lambda end: end < F.col("value")))
    counts = long.groupBy("node", "feature", chunk.alias("chunk"), "value").agg(F.count_if(F.col("y") == 0).alias("c0"), F.count_if(F.col("y") == 1).alias("c1"))
    held = F.create_map(*[x for n, r in open_.items() for x in (F.lit(n), F.struct(F.lit(r[0]).alias("n0"), F.lit(r[1]).alias("n1")))])
    zero, one = (F.lit(w) for w in weights)
    found = split_candidates(counts).withColumn("all", F.element_at(held, F.col("node")))
    left, right = F.col("left_0") + F.col("left_1"), F.col("all.n0") + F.col("all.n1") - F.col("left_0") - F.col("left_1")
    found = found.where((F.col("next_value") > F.col("value") + MIN_GAP) & (left >= MIN_LEAF) & (right >= MIN_LEAF))
    whole = F.col("all.n0") * zero + F.col("all.n1") * one
    gain = (
        _weighted_entropy(F.col("all.n0") * zero, F.col("all.n1") * one)
        - _weighted_entropy(F.col("left_0") * zero, F.col("left_1") * one)
        - _weighted_entropy((F.col("all.n0") - F.col("left_0")) * zero, (F.col("all.n1") - F.col("left_1")) * one)
    ) / whole
    split = F.struct("feature", ((F.col("value") + F.col("next_value")) / 2).alias("threshold"), "left_0", "left_1", gain.alias("gain"))
    order = F.struct(F.round(gain, GAIN_DIGITS), -F.col("feature"), -F.col("value"))
    return found.groupBy("node").agg(F.max_by(split, order).alias("s")).select("node", "s.*").collect()


def fit_tree(rows: DataFrame, features: Sequence[str], label: str, weights: tuple[float, float], max_depth: int = MAX_DEPTH) -> TreeModel:
    """Entropy tree on 0/1 labels weighted by class.

    A node is split if it isn't pure, holds MIN_SPLIT rows or more and lies
    above `max_depth`; both sides of a split hold MIN_LEAF rows or more.
    Thresholds are halfway between neighbouring values. Equal gains go to the
    earlier feature, then to the smaller value. Features must not be null.
    """
    base = materialize(rows.select(label, *features), "tree-rows")
    nulls = F.count_if(F.greatest(*[F.col(f).isNull() | F.isnan(F.col(f)) for f in (*features, label)]))
    seen = base.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"), F.count("*").alias("n"), nulls.alias("nulls")).first()
    if seen["nulls"] or seen["n0"] + seen["n1"] != seen["n"]:
        raise ValueError("features and labels must not be null, and labels must be 0 or 1")
    nodes = {1: Node((seen["n0"], seen["n1"]))}
    bounds = _chunk_bounds(base, features, seen["n"])
    level = [1]
    for _ in range(max_depth):
        open_ = {n: nodes[n].rows for n in level if min(nodes[n].rows) > 0 and sum(nodes[n].rows) >= MIN_SPLIT}
        if not open_:
            break
        level = []
        for s in _best_splits(base, features, label, open_, nodes, weights, bounds):
            zero, one = nodes[s["node"]].rows
            nodes[s["node"]] = Node((zero, one), features[s["feature"]], s["threshold"], s["gain"])
            nodes[2 * s["node"]] = Node((s["left_0"], s["left_1"]))
            nodes[2 * s["node"] + 1] = Node((zero - s["left_0"], one - s["left_1"]))
            level += [2 * s["node"], 2 * s["node"] + 1]
    return TreeModel(tuple(features), weights, nodes)
