import numpy as np
import pytest

from cellwatch.llm import embedding_join

SCHEMA = "vec_id long, embedding array<float>, label int, node string, links string"


def brute(rows, cosine):
    fine = {}
    for number, (i, x, *_) in enumerate(rows):
        if i is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x):
            fine[number] = np.array(x, dtype=np.float32).astype(float)
    parent = {i: i for i, *_ in rows if i is not None}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    links = {n: 0 for n in range(len(rows))}
    for a in fine:
        for b in fine:
            if a < b and len(fine[a]) == len(fine[b]):
                x, y = fine[a], fine[b]
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    p, q = root(rows[a][0]), root(rows[b][0])
                    parent[max(p, q)] = min(p, q)
    return [(i, links[n], None if i is None else root(i)) for n, (i, *_) in enumerate(rows)]


@pytest.mark.parametrize("interval", [8192, 40])
def test_links_equal_brute_force(spark, interval):
    random = np.random.default_rng(3)
    centers = random.normal(size=(12, 8))
    rows = [(i, (centers[i % 12] * random.uniform(0.5, 2) + random.normal(size=8) * 0.3).tolist(), 0, "x", "y") for i in range(150)]
    rows += [(200 + i, rows[7][1], 1, "x", "y") for i in range(5)]
    rows += [(300, None, 0, "x", "y"), (301, [], 0, "x", "y"), (302, [0.0] * 8, 0, "x", "y"), (303, [1.0, None] * 4, 0, "x", "y")]
    rows += [(304, [float("nan")] * 8, 0, "x", "y"), (305, [float("inf")] * 8, 0, "x", "y"), (None, rows[7][1], 0, "x", "y")]
    rows += [(306, [1.0, 2.0], 0, "x", "y"), (307, [2.0, 4.0], 0, "x", "y"), (308, [-0.0] * 7 + [1.0], 0, "x", "y"), (309, [0.0] * 7 + [1.0], 0, "x", "y")]
    found = embedding_join.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.9, interval).collect()
    got = sorted(str((r["vec_id"], r["n_links"], r["component_id"])) for r in found)
    assert got == sorted(map(str, brute(rows, 0.9)))
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in found)


def test_empty_table(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert embedding_join.near_duplicates(nothing).count() == 0
    with pytest.raises(ValueError):
        embedding_join.near_duplicates(nothing, 0.0)
