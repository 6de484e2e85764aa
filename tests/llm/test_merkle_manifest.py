import zlib
from hashlib import sha256

import pytest

from cellwatch.llm import merkle_manifest
from llm_edges import EDGES

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, root string, path string, block string, n string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text):
    return h(*(field(v) for v in (*row[:4], text)))


def tree(nodes):
    """Root, and per leaf the runs (place, siblings) up to it."""
    proofs = [[] for _ in nodes]
    members = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, held = [], []
        for at in range(0, len(nodes), 3):
            run = nodes[at : at + 3]
            for place, own in enumerate(members[at : at + 3]):
                for m in own:
                    proofs[m].append((place, run[:place] + run[place + 1 :]))
            above.append(h(*run))
            held.append(sum(members[at : at + 3], []))
        nodes, members = above, held
    return nodes[0], proofs


def brute(rows):
    by = {}
    for row in rows:
        bad = row[4]
        if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and bad is not None:
            bad = bad.replace("\n", "")
        by.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row, row[4]), leaf(row, bad), row[0]))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: tree([r[2] for r in sorted(by[s])]) for s in sources}
    root, tops = tree([made[s][0] for s in sources]) if sources else (None, [])
    out = []
    for number, s in enumerate(sources):
        for (_, _, good, bad, doc_id), proof in zip(sorted(by[s]), made[s][1]):
            proof, now = proof + tops[number], bad
            for place, siblings in proof:
                run = list(siblings)
                run.insert(place, now)
                now = h(*run)
            told = "".join(x for _, siblings in proof for x in siblings)
            out.append((doc_id, good, made[s][0], root, h(told), now, now == root))
    return sorted(out, key=str)


def sample(n, sources):
    rows = [(i * 7 % 1000, sources[0 if i % 3 == 0 else i % len(sources)], None if i % 11 == 0 else "en", i if i % 5 else None, f"a\nline {i}" if i % 2 else f"plain {i}", "x", "y", "z", "q") for i in range(n)]
    return rows + rows[:3]


@pytest.mark.parametrize(("n", "sources", "levels"), [(120, ["b", None, "é", "a"], 1), (240, ["b", "B", "", "z", None], 2), (60, [f"s{i:02}" for i in range(40)], 1), (1, ["only"], 7), (150, ["b", "c"], 7)])
def test_equals_brute_force(spark, n, sources, levels):
    rows = sample(n, sources)
    found = merkle_manifest.report(spark.createDataFrame(rows, SCHEMA).repartition(5), levels)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_edges_and_witnesses(spark):
    rows = [(i, f"s{(i or 0) % 2}" if i != 4 else None, None, len(t) if t else None, t, "x", "y", "z", "q") for i, t in EDGES]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, merkle_manifest.report(df, 1).collect()), key=str) == brute(rows)
    for r in merkle_manifest.manifest(df, 1).collect():
        assert merkle_manifest.fold(bytes(r["digest"]), bytes(r["path"]), bytes(r["siblings"])) == bytes(r["root"])


def test_empty_table(spark):
    assert merkle_manifest.report(spark.createDataFrame([], SCHEMA)).count() == 0
