import pathlib
import random

import numpy as np
import xxhash
from llm_edges import EDGES

from cellwatch.llm import common, components, simhash
from cellwatch.llm.components import connected_components
from cellwatch.runtime import materialize, scratch_path


def brute_fingerprint(text, width=3):
    words = common.lower_words(text)
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_fingerprints_and_edges(edges, nothing):
    rows = simhash.groups(edges).collect()
    assert len(rows) == len(EDGES)
    texts = dict(EDGES)
    for row in rows:
        assert int(row["fingerprint"], 16) == brute_fingerprint(texts[row["doc_id"]])
    assert {r["component_id"] for r in rows if r["doc_id"] in (3, 4, 5)} == {3}
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert simhash.groups(nothing).count() == 0


def test_links_connect_what_brute_force_connects(spark):
    random.seed(3)
    centers = [random.getrandbits(64) for _ in range(30)]
    values = {c ^ sum(1 << random.randrange(64) for _ in range(random.randint(0, 4))) & (2**64 - 1) for c in centers for _ in range(12)} | {0, 1, 2**64 - 1}
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), tile=16)
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    want = roots(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    assert {v: got.get(v, v) for v in signed} == want


def test_components_of_a_long_path_and_a_hub(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5)]
    random.Random(1).shuffle(pairs)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1100)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_equal_exact_similarity(spark, edges):
    random.seed(4)
    docs, number = [], 0
    for _ in range(25):
        base = [random.choice(["the", "of", "and"]) + str(random.randrange(400)) for _ in range(random.randint(30, 200))]
        for _ in range(4):
            copy = list(base)
            for _ in range(random.choice([0, 1, 1, 2, 3, 6])):
                copy[random.randrange(len(copy))] = "changed" + str(random.random())
            docs.append((number, " ".join(copy)))
            number += 1
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in docs}
    want = roots(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(got[i] != want[i] for i in got) <= 2
    kept = simhash.keep_one(edges)
    assert kept.columns == edges.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 3, 6, 7, 8, None]))


def test_near_copies_lose_no_pair(spark):
    random.seed(8)
    docs = []
    for _ in range(150):
        base = ["w" + str(random.randrange(10**6)) for _ in range(random.choice([8, 8, 16, 50, 60]))]
        # One word more at the end leaves n of n + 1 shingles; a changed one in long texts is near the bound.
        copy = [*base, "more"]
        if len(base) >= 50:
            copy[len(base) // 2] = "changed"
        docs += [(len(docs), " ".join(base)), (len(docs) + 1, " ".join(copy))]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in docs}
    want = roots(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(frame).collect()}
    assert got == want
    texts = frame.withColumnRenamed("doc_id", "node")
    entries = simhash.prefixes(texts, simhash.shingle_counts(texts, 5), 5, 0.8)
    pairs = [{tuple(r) for r in simhash.candidate_pairs(entries, 0.8, block).collect()} for block in (2, 256)]
    assert pairs[0] == pairs[1] >= {(w, i) for i, w in want.items() if w != i}


def test_repeated_doc_ids_with_different_texts_both_stay(spark):
    one, other = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    docs = spark.createDataFrame([(1, one), (1, other), (1, other), (2, other), (3, one + " more")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()) == [(1, one), (1, other)]


def test_copies_by_fingerprint_and_by_shingle_sets_are_dropped(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    # One fingerprint, but few shingles in common: most of both texts is one repeated line.
    refrain = "over and again " * 300
    repeated = [refrain + words(6), refrain + words(6)]
    base = words(60)
    texts = [*repeated, base, base.replace(base.split()[30], "changed"), words(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in simhash.groups(docs).collect()}
    assert (prints[0] ^ prints[1]).bit_count() <= 2 < (prints[2] ^ prints[3]).bit_count()
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()} == {0: 0, 1: 1, 2: 2, 3: 2, 4: 4}
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [0, 2, 4]


def test_stars_hold_all_entries_of_common_tokens(spark):
    rng = random.Random(6)
    rows = sorted({(rng.choice([1, 1, 1, 2, 3, 4, 5, 6, rng.randrange(100)]), rng.randrange(40)) for _ in range(200)})
    sizes = [rng.randint(5, 60) for _ in range(40)]
    entries = spark.createDataFrame([(t, n % 3, sizes[n], n, n % 2 if t == 1 else 0) for t, n in rows], simhash._ENTRY)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in ("2", "7", "1000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            found = simhash.token_stars(entries, 0.8).collect()
            groups = {}
            for t, n in rows:
                groups.setdefault((t, n % 2 if t == 1 else 0), []).append(n)
            want = []
            for (t, _), nodes in groups.items():
                rep = None
                for n in sorted(nodes, key=lambda n: (sizes[n], n)):
                    if rep is None or sizes[n] * 0.8 > sizes[rep] + 1e-6:
                        rep = n
                    if len(nodes) > 1:
                        want.append((t, n, n % 3, sizes[n], rep, rep % 3, sizes[rep]))
            assert sorted(map(tuple, found)) == sorted(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_large_group_of_near_copies_and_boilerplate(spark):
    """One group of many near copies, and texts that share a passage but nothing else."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    docs = []
    for _ in range(300):
        copy = list(base)
        copy[rng.randrange(60)] = f"c{rng.random()}"
        docs.append(copy)
    docs += [[f"u{rng.random()}" for _ in range(40)] + base[:12] for _ in range(100)]
    rng.shuffle(docs)
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(frame).collect()}
    sets = {i: {tuple(d[k : k + 5]) for k in range(len(d) - 4)} for i, d in enumerate(docs)}
    assert got == roots(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))


def test_copies_of_an_original_meet_it_and_not_each_other(spark, monkeypatch):
    """Each copy is similar to the original alone; few pairs must be looked at."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(64)]
    docs = [list(base)]
    for _ in range(250):
        copy = list(base)
        for at in rng.sample(range(10, 54), 1):
            copy[at] = f"c{rng.random()}"
        docs.append(copy)
    rng.shuffle(docs)
    seen = []
    plain = simhash.candidate_pairs
    monkeypatch.setattr(simhash, "candidate_pairs", lambda *a, **k: seen.append(plain(*a, **k)) or seen[-1])
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(frame).collect()}
    assert set(got.values()) == {0} and seen[0].count() < 1000


def test_texts_and_entries_of_the_near_copy_stage_are_gone_when_its_rows_are_read(spark):
    words = [f"w{i}" for i in range(60)]
    docs = [(1, " ".join(words)), (2, " ".join([*words[:-1], "x"])), (3, " ".join(words[::-1])), (3, " ".join(words[::-1])), (4, None), (5, "")]
    folder = pathlib.Path(scratch_path(spark, "x").removeprefix("file:")).parent
    before = set(folder.iterdir()) if folder.exists() else set()
    rows = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string"))
    left = {path.name.rsplit("-", 1)[0] for path in set(folder.iterdir()) - before}
    assert left and not left & {"shingle-texts", "token-stars", "rooted"}
    assert sorted(r["doc_id"] for r in rows.collect()) == [1, 3, 4]


def test_rounds_of_components_build_no_table_at_the_driver(spark):
    stars = materialize(spark.createDataFrame([(i + 1, i) for i in range(9)], "u long, v long"), "stars")
    for step in (components._large_star, components._small_star):
        plan = step(stars)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {tuple(r) for r in components.connected_components(stars).collect()} == {(i, 0) for i in range(10)}
