import random

import numpy as np
from llm_edges import EDGES

from cellwatch.llm import common, decontaminate
from cellwatch.llm.fm_index import FMIndex


def test_index_finds_and_locates_every_occurrence():
    random.seed(1)
    for _ in range(150):
        n, m = random.randint(1, 300), random.randint(1, 4)
        text = np.array([random.randint(0, 4) for _ in range(n)])
        index = FMIndex(text)
        phrases = np.array([[random.randint(1, 6) for _ in range(m)] for _ in range(15)])
        for phrase, low, high in zip(phrases, *index.search(phrases)):
            want = [i for i in range(n - m + 1) if (text[i : i + m] == phrase).all()]
            assert sorted(index.locate(np.arange(low, high)).tolist()) == want


def brute(text, items, window):
    words = common.alnum_words(text)
    hit, found = set(), set()
    for item, item_text in items:
        own = common.alnum_words(item_text)
        if not own:
            continue
        size = min(window, len(own))
        for i in range(len(own) - size + 1):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == own[i : i + size]:
                    hit |= set(range(j, j + size))
                    found |= {item} - {None}
    return len(words), len(hit), sorted(found)


def test_documents_equal_brute_force_in_one_batch_and_in_many(spark, monkeypatch):
    random.seed(2)
    draw = lambda n: " ".join(random.choice("abc") for _ in range(n))
    items = [(1, draw(9)), (2, draw(3)), (3, ""), (4, None), (None, draw(5)), (5, draw(4)), (5, draw(4)), (6, draw(30))]
    docs = [(i, draw(random.randint(0, 60)) + random.choice(["", " zz ", ", d"]) + draw(20)) for i in range(40)]
    docs += [(i, t) for i, t in EDGES if t is None or len(t) < 300]
    df, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for batch in (1_000_000, 8):
        monkeypatch.setattr(decontaminate, "BATCH_WORDS", batch)
        got = sorted(tuple(map(str, (r["doc_id"], r["n_words"], r["n_hit"], r["items"]))) for r in decontaminate.decontaminate(df, benchmark, 5).collect())
        assert got == sorted(tuple(map(str, (d, *brute(t, items, 5)))) for d, t in docs)


def test_edges(spark, edges, nothing):
    benchmark = spark.createDataFrame([(1, "word " * 13)], "item_id long, text string")
    rows = decontaminate.decontaminate(edges, benchmark).collect()
    assert len(rows) == len(EDGES) and {r["doc_id"] for r in rows if r["contaminated"]} == {6}
    assert next(r for r in rows if r["doc_id"] == 6)["spans"][0]["end"] == 40_000
    assert decontaminate.decontaminate(nothing, benchmark).count() == 0
    empty = decontaminate.decontaminate(edges, benchmark.limit(0)).collect()
    assert not any(r["contaminated"] for r in empty) and next(r for r in empty if r["doc_id"] == 6)["n_words"] == 40_000


def test_items_without_id_hit_words_as_the_sql_has_it(spark):
    import duckdb

    words = " ".join(f"w{i}" for i in range(40))
    docs = [(1, words), (2, "other words " + " ".join(f"w{i}" for i in range(5, 25))), (3, None), (4, "clean text")]
    items = [(None, " ".join(f"w{i}" for i in range(3, 20))), (7, " ".join(f"w{i}" for i in range(20, 36))), (None, ""), (None, "clean")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    found = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({decontaminate.SQL})").fetchall()
    assert sorted(tuple(r) for r in found.select(*names).collect()) == sorted(want)
