import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwatch.llm import graph_partition, learned_partitions

SCHEMA = "vec_id long, embedding array<float>, label int, node string, part string, rank string"
EXTRA = (0, "x", "y", "z")


def brute(rows, k):
    fine = [
        (i, np.array(x, dtype=np.float32).astype(float)) for i, x, *_ in rows if i is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x)
    ]
    out = []
    for place, (q, a) in enumerate(fine):
        if q % 20 == 0:
            near = sorted((-float((a * b).sum()), i) for other, (i, b) in enumerate(fine) if other != place and len(a) == len(b))
            out += [(q, rank + 1, i, -s + 0.0) for rank, (s, i) in enumerate(near[:k])]
    return sorted(out)


def told(found):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect())


def clustered(n, seed=4):
    random = np.random.default_rng(seed)
    centers = random.normal(size=(30, 12)) * 2
    return [(i, (centers[i % 30] + random.normal(size=12)).tolist(), *EXTRA) for i in range(n)]


def test_all_parts_give_brute_force(spark):
    rows = clustered(400)
    # Copies, more than are wanted; ties of scores; two rows of one vec_id; equal rows.
    rows += [(1000 + i, rows[40][1], *EXTRA) for i in range(70)] + [(20, rows[3][1], *EXTRA), rows[40], rows[40]]
    rows += [(2000 + i, [0.0] * 11 + [float(i % 2 + 1)], *EXTRA) for i in range(40)]
    rows += [(5000, None, *EXTRA), (5020, [], *EXTRA), (5040, [0.0] * 12, *EXTRA), (5060, [1.0, None] * 6, *EXTRA), (5080, [float("nan")] * 12, *EXTRA), (None, rows[7][1], *EXTRA)]
    rows += [(6000 + 10 * i, [float(i), 1.0], *EXTRA) for i in range(3)] + [(7000, [3.0], *EXTRA)]
    found = learned_partitions.nearest_neighbours(spark.createDataFrame(rows, SCHEMA).repartition(4), F.col("vec_id") % 20 == 0, 20, recall=1.0)
    got, want = told(found), brute(rows, 20)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], rel=1e-14, abs=1e-14)


@pytest.mark.parametrize("blocks", [(32768, 32768), (100, 16)])
def test_recall_of_few_parts(spark, monkeypatch, blocks):
    monkeypatch.setattr(learned_partitions, "PART_ROWS", 50)
    monkeypatch.setattr(learned_partitions, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(learned_partitions, "TILE_QUERIES", blocks[1])
    rows = clustered(2000)
    asked = []
    plain = learned_partitions.search
    monkeypatch.setattr(learned_partitions, "search", lambda index, queries, model, k, n: asked.append(model) or plain(index, queries, model, k, n))
    got = told(learned_partitions.report(spark.createDataFrame(rows, SCHEMA)))
    want = brute(rows, 20)
    hit = {r[::2] for r in got} & {r[::2] for r in want}
    assert len(hit) >= 0.92 * len(want)
    assert len(got) == len(want)
    # It didn't look everywhere.
    assert asked[0].parts == 40 and asked[0].probes < 20
    exact = {r[::2]: r[3] for r in want}
    assert all(abs(exact[r[::2]] - r[3]) < 1e-12 for r in got if r[::2] in exact)


def test_empty_table(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert learned_partitions.report(nothing).count() == 0
    with pytest.raises(ValueError):
        learned_partitions.nearest_neighbours(nothing, F.lit(True), recall=0.0)


def test_graph_parts_are_balanced_and_cut_few_edges():
    random = np.random.default_rng(2)
    # Four rings of 50 nodes, with a few edges between them.
    ring = np.arange(200)
    near = np.stack([ring // 50 * 50 + (ring + d) % 50 for d in (1, 2, 3)], axis=1)
    near[::40, 0] = random.integers(0, 200, 5)
    label = graph_partition.balanced_parts(near, 4)
    assert np.bincount(label).tolist() == [50] * 4
    assert np.mean(label[near] == label[:, None]) > 0.8
    assert sorted(np.bincount(graph_partition.balanced_parts(near, 7))) == [28, 28, 28, 29, 29, 29, 29]
