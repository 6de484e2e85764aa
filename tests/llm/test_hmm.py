import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from llm_edges import EDGES

from cellwatch.llm import common, hmm


def paths(p, sequence):
    """Every path of states with its probability."""
    for z in itertools.product(range(len(p.start)), repeat=len(sequence)):
        q = p.start[z[0]] * p.emits[sequence[0], z[0]]
        for a, b, symbol in zip(z, z[1:], sequence[1:]):
            q *= p.moves[a, b] * p.emits[symbol, b]
        yield z, q


def some_parameters():
    random = np.random.default_rng(0)
    return hmm.Parameters(random.dirichlet(np.ones(3)), random.dirichlet(np.ones(3), 3), random.dirichlet(np.ones(6), 3).T.copy())


def test_likelihoods_and_expected_counts_equal_a_sum_over_all_paths():
    p = some_parameters()
    sequences = [np.random.default_rng(n).integers(0, 6, size=n) for n in (1, 4, 2, 5)]
    starts, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))
    for sequence, found in zip(sequences, hmm.log_likelihoods(sequences, p)):
        whole = sum(q for _, q in paths(p, sequence))
        assert abs(math.log(whole) - found) < 1e-9
        for z, q in paths(p, sequence):
            starts[z[0]] += q / whole
            for a, s in zip(z, sequence):
                emits[s, a] += q / whole
            for a, b in zip(z, z[1:]):
                moves[a, b] += q / whole
    counts = hmm.Counts(p)
    counts.add(sequences)
    assert np.allclose(counts.start, starts) and np.allclose(counts.moves, moves) and np.allclose(counts.emits, emits)


def test_base_scores_equal_brute_force_and_edges(edges, nothing):
    rows = hmm.score(edges, states=2, rounds=2).collect()
    assert len(rows) == len(EDGES)
    tokens = [(i, [*common.lower_words(t), b""]) for i, t in EDGES]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = Counter(w for i, words in tokens if not held(i) for w in words)
    n, v = sum(counts.values()), len(counts)
    wanted = {i: words for i, words in tokens}
    for row in rows:
        words = wanted[row["doc_id"]]
        assert row["held_out"] == held(row["doc_id"]) and row["n_tokens"] == len(words) and row["train_tokens"] == n
        assert row["n_known"] == sum(counts[w] > 0 for w in words)
        assert math.isclose(row["base_score"], sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), rel_tol=1e-9)
        assert row["score"] < 0
    assert hmm.score(nothing).count() == 0


def test_model_beats_the_base_on_held_out_texts_of_two_languages(spark):
    random = np.random.default_rng(1)
    docs = [(i, " ".join(f"{'ab'[i % 2]}{k}" for k in random.zipf(1.5, 40) if k < 200)) for i in range(600)]
    rows = hmm.score(spark.createDataFrame(docs, "doc_id long, text string"), states=3, rounds=6).where("held_out").collect()
    assert sum(r["score"] > r["base_score"] for r in rows) > 0.9 * len(rows)


def test_probabilities_of_all_words_sum_to_one():
    counts = {"a": 3, "b": 1, "c": 7}
    shares = 0.0
    for kind in (0, 1):  # two classes: a and b, c
        own = [c for w, c in counts.items() if (w == "c") == bool(kind)]
        whole = sum(own) + 0.5 * (len(own) + 1)
        shares += (sum(c + 0.5 for c in own) + 0.5) / whole
    assert math.isclose(shares, 2.0)


def test_pieces_count_as_whole_sequences():
    p = some_parameters()
    random = np.random.default_rng(5)
    sequences = [random.integers(0, 6, size=n) for n in (1, 7, 23, 8, 40, 2)]
    whole = hmm.Counts(p)
    whole.add(sequences)
    for size in (1, 2, 5, 8, 100):
        cut = hmm.Counts(p)
        parts = list(hmm.in_pieces(sequences, p, size))
        # Pieces of all sequences in two lots, in any order.
        random.shuffle(parts)
        for lot in (parts[::2], parts[1::2]):
            if lot:
                cut.add(*map(list, zip(*lot)))
        for name in ("start", "moves", "emits", "likelihood"):
            assert np.allclose(getattr(cut, name), getattr(whole, name)), (size, name)


def test_frequent_words_have_their_own_emission(spark, monkeypatch):
    monkeypatch.setattr(hmm, "FREQUENT", 6)
    monkeypatch.setattr(hmm, "BUCKETS", 2)
    monkeypatch.setattr(hmm, "KNOWN", 9)
    # Two kinds of texts with words of their own; all buckets are shared.
    random = np.random.default_rng(2)
    docs = [(i, " ".join(f"{'ab'[i % 2]}{k}" for k in random.integers(0, 3, 30))) for i in range(200)] + [(1000 + i, f"rare{i}") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    totals = hmm.word_counts(df, hmm.is_held_out(df.doc_id))
    known = hmm.vocabulary(totals)
    assert sorted(list(known.counts)[: known.own]) == ["a0", "a1", "a2", "b0", "b1", "b2"]
    # Words that share the next count are too many to be known.
    assert len(known.counts) == 6 and known.classes == 8
    blocks = hmm.token_blocks(df, hmm.is_held_out(df.doc_id), known)
    p = hmm.train(blocks, np.full(9, 1 / 9), states=2, rounds=12)
    by_state = [{w: p.emits[i, s] for i, w in enumerate(list(known.counts)[:6])} for s in range(2)]
    kinds = {max("ab", key=lambda k: sum(v for w, v in e.items() if w[0] == k)) for e in by_state}
    assert kinds == {"a", "b"}
    rows = hmm.score(df, states=2, rounds=8).where("held_out").collect()
    assert all(r["score"] > r["base_score"] for r in rows if r["doc_id"] < 1000)


def test_scores_are_a_distribution_over_texts(spark, monkeypatch):
    """Scores of all texts of up to one word, seen, rare or unseen, add up to no more than one."""
    monkeypatch.setattr(hmm, "FREQUENT", 2)
    monkeypatch.setattr(hmm, "BUCKETS", 1)
    monkeypatch.setattr(hmm, "KNOWN", 3)
    texts = ["a a b", "a b c", "d", "e e"] * 3
    docs = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(["", *"abcde", "unseen"])]
    rows = hmm.score(spark.createDataFrame(docs, "doc_id long, text string"), states=2, rounds=3).where("doc_id >= 100").collect()
    assert 0.1 < sum(10 ** r["score"] for r in rows) <= 1


def test_words_of_a_block_are_coded_and_hashed_from_their_bytes():
    texts = ["B b  a\tÄ 語 ", None, "", " ", "a " + "x" * 300, "ß\n\n語"]
    rows = pa.table({"doc_id": range(len(texts)), "held": [False] * len(texts), "text": pa.array(texts, pa.string())})
    words, tokens, sizes = hmm._coded(rows)
    assert isinstance(words, pa.Array)  # distinct words don't become Python strings
    names = ["", *words.to_pylist()]
    parts = np.split(np.array(names, dtype=object)[tokens], np.cumsum(sizes)[:-1])
    assert [list(p) for p in parts] == [[*(w.decode() for w in common.lower_words(t)), ""] for t in texts]
    for some in (words, words[1:], words[:0]):
        assert hmm._hashes(some).tolist() == [common.xxh(w) for w in some.to_pylist()]
    known = hmm.Vocabulary({"b": 2, "a": 2, "語": 2}, 2, 5)
    block = hmm._block(rows, known, pa.array(list(known.counts)), np.array([2, 2, 2])).to_pylist()[0]
    assert {r["word"] for r in block["rare"]} == {"Ä", "ß", "x" * 300} and all(names[r["number"]] == r["word"] for r in block["rare"])
    classes = dict(zip(names, hmm._unpacked(block["classes"], "<i4").tolist()))
    assert classes == {w: 7 if w == "" else ["b", "a"].index(w) if w in ("b", "a") else 2 + common.xxh(w) % 5 for w in names}
