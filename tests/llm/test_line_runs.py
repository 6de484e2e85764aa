import random

from llm_edges import EDGES

from cellwatch.llm import line_runs


def brute(docs, min_words):
    """Later copies by comparing every run of enough words with all earlier ones."""
    seen, gone = set(), {}
    for number, (_, text) in enumerate(docs):
        lines = [(at, line) for at, line in enumerate((text or "").split("\n")) if line.strip(" \t\n\r\x0b\x0c")]
        gone[number] = set()
        for begin in range(len(lines)):
            for end in range(begin, len(lines)):
                run = tuple(line for _, line in lines[begin : end + 1])
                if sum(len(line.split()) for line in run) >= min_words:
                    if run in seen:
                        gone[number] |= {at for at, _ in lines[begin : end + 1]}
                    seen.add(run)
    return gone


def test_deleted_lines_equal_brute_force(spark):
    random.seed(5)
    for min_words in (1, 4, 9):
        pool = [" ".join(random.choice("abcdef") for _ in range(random.randint(1, 4))) for _ in range(8)] + ["", " "]
        docs = [(i, "\n".join(random.choice(pool) for _ in range(random.randint(0, 14)))) for i in range(60)]
        want = brute(docs, min_words)
        rows = line_runs.dedupe_lines(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), min_words).collect()
        for row in rows:
            text = docs[row["doc_id"]][1]
            assert set(row["deleted"]) == want[row["doc_id"]]
            assert row["text"] == "\n".join(line for at, line in enumerate(text.split("\n")) if at not in want[row["doc_id"]])


def test_edges(edges, nothing):
    rows = line_runs.dedupe_lines(edges).collect()
    assert len(rows) == len(EDGES)
    kept = [(r["doc_id"], r["kept"], r["n_deleted"]) for r in rows]
    assert sorted(k for k in kept if k[0] in (1, 2)) == [(1, True, 0), (2, False, 2), (2, False, 2)]
    assert all(k[1] for k in kept if k[0] not in (1, 2))
    assert next(r for r in rows if r["doc_id"] == 3)["text"] is None
    assert line_runs.dedupe_lines(nothing).count() == 0


def test_long_texts_cost_their_lines(spark):
    """One document that repeats its lines, at two sizes; four times the lines must not cost sixteen times as much."""
    import time

    took, line = [], "some words of line number {} that are more than ten in all here"
    for n in (6_000, 24_000):
        text = "\n".join(line.format(i % (n // 2)) for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        for _ in range(2):
            start = time.time()
            row = line_runs.dedupe_lines(docs).collect()[0]
            seconds = time.time() - start
        took.append(seconds)
        assert (row["n_lines"], row["n_deleted"]) == (n, n // 2)
        assert row["text"] == "\n".join(line.format(i) for i in range(n // 2))
    assert took[1] < 6 * took[0] + 2
