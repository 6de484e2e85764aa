from hashlib import sha256
from math import floor, isfinite

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellwatch.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, of string"


def brute(rows, entries=16, rounds=6):
    kept = [(i, [floor(4096 * v) for v in x], lab, x) for i, x, lab, *_ in rows if x is not None and all(v is not None and isfinite(v) for v in x)]
    out = []
    for length in {len(x) for _, x, _, _ in kept}:
        own = sorted((k for k in kept if len(k[1]) == length), key=lambda k: (k[0] is None, k[0] or 0, k[3]))
        own = [(i, x + [0] * (-length % 8), lab) for i, x, lab, _ in own]
        w = -(-length // 8)
        parts = [[x[p * w : (p + 1) * w] for _, x, _ in own] for p in range(8)]
        books = [part[:entries] for part in parts]

        def nearest(v, book):
            return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

        for _ in range(rounds):
            for p in range(8):
                index = [nearest(v, books[p])[1] for v in parts[p]]
                held = [[v for v, k in zip(parts[p], index) if k == e] for e in range(len(books[p]))]
                books[p] = [[sum(c) // len(h) for c in zip(*h)] if h else b for h, b in zip(held, books[p])]
        name = sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
        for n, (i, _, lab) in enumerate(own):
            best = [nearest(parts[p][n], books[p]) for p in range(8)]
            out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), lab, name))
    total = {}
    for _, _, e, lab, _ in out:
        total[lab] = total.get(lab, 0) + e
    return sorted(((i, c, e, total[lab], name) for i, c, e, lab, name in out), key=str)


def told(found):
    return sorted((tuple(r) for r in found.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_equals_brute_force(spark):
    random = np.random.default_rng(5)
    rows = [(i * 3 % 200, random.normal(size=16).round(2).tolist(), None if i % 5 == 0 else i % 3, "x", "y") for i in range(200)]
    rows += [(300 + i, rows[4][1], 1, "x", "y") for i in range(60)] + rows[:2]
    rows += [(i, None, 1, "x", "y") for i in (-5, -4)] + [(-3, [float("nan")] * 16, 1, "x", "y"), (-2, [1.0, None] * 8, 0, "x", "y"), (None, [0.5] * 16, 0, "x", "y"), (-1, [0.0] * 16, 0, "x", "y")]
    rows += [(400 + i, [float(i), 2.0, 3.0], 2, "x", "y") for i in range(5)] + [(500, [], 2, "x", "y")]
    assert told(vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_large_components_are_exact(spark):
    rows = [(i, [(-1.0) ** i * 10.0 ** (i % 4 + 2) + j for j in range(8)], i, "x", "y") for i in range(40)]
    assert told(vector_codes.compress(spark.createDataFrame(rows, SCHEMA), entries=3)) == brute(rows, 3)
    # Beyond 64 bits there is no error to tell.
    rows = [(1, [1e300] * 8, 0, "x", "y"), (2, [-1e300] * 8, 0, "x", "y")]
    assert [r["error"] for r in vector_codes.compress(spark.createDataFrame(rows, SCHEMA), entries=1).collect()] == [None, None]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-300, 300), min_size=3, max_size=3), min_size=1, max_size=40), st.integers(1, 8), st.integers(0, 9))
def test_memo_gives_the_nearest_entry(points, entries, bits):
    x = np.array(points)
    book = x[:entries]
    memo = vector_codes.CellMemo(book, bits, most=5)
    for _ in range(2):
        index, far = memo.assign(x)
        whole = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert index.tolist() == whole.argmin(axis=1).tolist() and far.tolist() == whole.min(axis=1).tolist()


def test_empty_table(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert vector_codes.compress(nothing).count() == 0
    with pytest.raises(ValueError):
        vector_codes.compress(nothing, entries=257)
