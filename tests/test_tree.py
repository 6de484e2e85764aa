"""The exact tree against a plain search, and its saved form."""

import random
from math import log2

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwatch.operators import model, tree

FEATURES = ["a", "b", "c"]


def grow(x, y, weights, depth=7):
    """Nodes by trying every split of every node."""

    def mass(part):
        return [weights[k] * sum(1 for i in part if y[i] == k) for k in (0, 1)]

    def spread(part):
        w = mass(part)
        return sum(w) * -sum(v / sum(w) * log2(v / sum(w)) for v in w if v)

    nodes, open_ = {}, {1: list(range(len(y)))}
    while open_:
        n, rows = open_.popitem()
        counts = tuple(sum(1 for i in rows if y[i] == k) for k in (0, 1))
        best = None
        if min(counts) and len(rows) >= 20 and n.bit_length() <= depth:
            for f in range(x.shape[1]):
                values = sorted({x[i, f] for i in rows})
                for v, after in zip(values, values[1:]):
                    low, high = [i for i in rows if x[i, f] <= v], [i for i in rows if x[i, f] > v]
                    if after > v + 1e-7 and len(low) >= 10 and len(high) >= 10:
                        gain = round((spread(rows) - spread(low) - spread(high)) / sum(mass(rows)), 12)
                        if best is None or gain > best[0]:
                            best = (gain, f, (v + after) / 2, low, high)
        nodes[n] = (counts, None, None) if best is None else (counts, FEATURES[best[1]], best[2])
        if best:
            open_[2 * n], open_[2 * n + 1] = best[3], best[4]
    return nodes


def sample(spark, n=240, seed=1):
    rng = random.Random(seed)
    x = np.array([[rng.randint(0, 9), rng.choice([0.5, 0.25, rng.random()]), 1.0 if rng.random() < 0.4 else rng.random()] for _ in range(n)], dtype=np.float32).astype(float)
    y = [int(a > 4 and b > 0.3 or rng.random() < 0.2) for a, b, _ in x]
    rows = [(*map(float, r), k) for r, k in zip(x, y)]
    return x, y, spark.createDataFrame(rows, "a double, b double, c double, target int").repartition(5)


@pytest.mark.parametrize("chunk_rows", [1_000_000, 30])
def test_tree_equals_plain_search(spark, monkeypatch, chunk_rows):
    monkeypatch.setattr(tree, "CHUNK_ROWS", chunk_rows)
    x, y, rows = sample(spark)
    found = tree.fit_tree(rows, FEATURES, "target", (0.7, 1.9))
    assert {n: (d.rows, d.feature, d.threshold) for n, d in found.nodes.items()} == grow(x, y, (0.7, 1.9))
    # Every row falls into a leaf whose counts it is part of.
    counts = [F.count_if(F.col("target") == k).alias(f"n{k}") for k in (0, 1)]
    leaves = rows.groupBy(found.leaf().alias("leaf")).agg(*counts).collect()
    assert {r.leaf: (r.n0, r.n1) for r in leaves} == {n: d.rows for n, d in found.nodes.items() if d.feature is None}
    assert sum(found.importances().values()) == pytest.approx(1.0)


def test_one_hot_value_is_one_row_of_counts(spark):
    rows = spark.createDataFrame([(1.0, 2.0, float(i % 50), int(i % 50 > 30)) for i in range(500)], "a double, b double, c double, target int")
    found = tree.fit_tree(rows, FEATURES, "target", (1.0, 1.0))
    assert (found.nodes[1].feature, found.nodes[1].threshold, found.depth) == ("c", 30.5, 1)
    assert found.importances() == {"a": 0.0, "b": 0.0, "c": 1.0}


def test_small_pure_and_empty_sets_are_one_leaf(spark):
    for rows in ([(1.0, 1.0, 1.0, 0)] * 40, [(float(i), 1.0, 1.0, i % 2) for i in range(19)], []):
        found = tree.fit_tree(spark.createDataFrame(rows, "a double, b double, c double, target int"), FEATURES, "target", (1.0, 1.0))
        assert list(found.nodes) == [1] and found.depth == 0
    with pytest.raises(ValueError):
        tree.fit_tree(spark.createDataFrame([(1.0, None, 1.0, 0)], "a double, b double, c double, target int"), FEATURES, "target", (1.0, 1.0))
    with pytest.raises(ValueError):
        tree.fit_tree(spark.createDataFrame([(1.0, 1.0, 1.0, 2)], "a double, b double, c double, target int"), FEATURES, "target", (1.0, 1.0))


def test_saved_tree_scores_alike(spark, tmp_path):
    _, _, rows = sample(spark, seed=3)
    found = tree.fit_tree(rows, FEATURES, "target", (0.6, 3.1))
    found.save(spark, str(tmp_path / "tree"))
    again = tree.TreeModel.load(spark, str(tmp_path / "tree"))
    assert again == found
    both = rows.select(found.probability().alias("p"), again.probability().alias("q"), F.col("target"))
    assert both.where("p <> q or p < 0 or p > 1").count() == 0
    assert both.select("p").distinct().count() <= 128
    assert model.feature_importance(again, spark).count() == 3
