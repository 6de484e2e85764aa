import random
import zlib
from collections import Counter

from llm_edges import EDGES
from pyspark.sql import functions as F

from cellwatch.llm import toxicity
from cellwatch.llm.lexicon_automaton import LexiconAutomaton


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_gives_the_edit_distance():
    random.seed(1)
    for _ in range(25):
        terms = sorted({"".join(random.choice("abc") for _ in range(random.randint(1, 7))) for _ in range(6)})
        limit = random.randint(0, 2)
        automaton = LexiconAutomaton(terms, lambda t: limit)  # noqa: B023
        words = ["".join(random.choice("abcd") for _ in range(random.randint(0, 9))) for _ in range(200)]
        for word, (term, edits) in zip(words, automaton.match(words).tolist()):
            best = min(distance(word, t) for t in terms)
            assert (term >= 0) == (bool(word) and best <= limit)
            assert term < 0 or distance(word, terms[term]) == edits == best


def corpus(n):
    random.seed(6)
    plain = ["".join(random.choice("aeiourstln") for _ in range(random.randint(3, 8))) for _ in range(400)]
    bad = ["worthless", "idiotic", "pathetic"]
    docs, labels = [], []
    for i in range(n):
        words = [random.choice(plain) for _ in range(60)]
        kind = random.choice(["clean", "clean", "toxic", "misspelt", "quoted"])
        for _ in range(3):
            word = random.choice(bad)
            if kind == "misspelt":
                at = random.randrange(1, len(word))
                word = word[:at] + random.choice("xz") + word[at + 1 :]
            if kind == "quoted":
                word = f'"{word}"'
            if kind != "clean":
                words.insert(random.randrange(len(words)), word)
        docs.append((i, " ".join(words)))
        labels.append((i, int(kind in ("toxic", "misspelt"))))
    return docs, labels


def test_held_out_documents_misspelt_ones_and_quotations(spark):
    docs, labels = corpus(600)
    rows = toxicity.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 600 and len(held) > 60
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_edges(spark, edges, nothing):
    docs, labels = corpus(200)
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (1, None)], "doc_id long, toxic int"))
    rows = toxicity.score(edges, model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] < 0.5 and r["predicted"] == 0 for r in rows)
    assert toxicity.score(nothing, model).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.report(edges, none).collect()} == {0}
    assert toxicity.report(nothing, none).count() == 0


def test_lexicon_is_learnt_from_all_labels(spark):
    random.seed(9)
    letters = lambda n: "".join(random.choice("bcdfghjkmpqvwxyz") for _ in range(n))
    plain, rare = ["".join(random.choice("aeiourstln") for _ in range(6)) for _ in range(300)], [letters(12) for _ in range(700)]
    docs, labels = [], []
    for i in range(700):
        words = [random.choice(plain) for _ in range(40)]
        if i % 2:
            for k in range(20):
                words.insert(random.randrange(len(words)), rare[(i // 2 * 20 + k) % len(rare)])
        docs.append((i, " ".join(words)))
        labels.append((i, i % 2))
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), rows=60)
    held = {i for i in range(700) if zlib.crc32(str(i).encode()) % 5 == 0}
    seen = Counter(w for i, t in docs if i % 2 and i not in held for w in set(t.split()) & set(rare))
    assert {w for w, n in seen.items() if n >= 5} <= set(model.terms) and len(model.terms) > 600


def swap_distance(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 2 : i] == b[j - 2 : j][::-1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_swapped_letters_are_one_edit_and_short_terms_have_one():
    random.seed(2)
    for limit in (0, 1, 2, 1, 2):
        terms = sorted({"".join(random.choice("abc") for _ in range(random.randint(1, 7))) for _ in range(6)})
        words = ["".join(random.choice("abcd") for _ in range(random.randint(1, 9))) for _ in range(300)]
        for word, (term, edits) in zip(words, LexiconAutomaton(terms, lambda t: limit, swaps=True).match(words).tolist()):  # noqa: B023
            best = min(swap_distance(word, t) for t in terms)
            assert (term >= 0) == (best <= limit) and (term < 0 or edits == best)
    found = toxicity.Scanner(["idiot", "scum", "stupid", "trash"], []).terms_of(["idoit", "scmu", "stupdi", "trahs", "skum", "such"])
    assert [t >= 0 for t in found[:, 0].tolist()] == [True] * 5 + [False]


def test_long_short_and_foreign_terms(monkeypatch):
    from cellwatch.llm import lexicon_automaton

    random.seed(3)
    letters = [chr(0x4E00 + i) for i in range(2000)]
    terms = ["ab", "x" * 5000, *("".join(random.choice(letters) for _ in range(random.randint(2, 60))) for _ in range(300))]
    words = terms + [t[:-1] + "q" for t in terms] + ["x" * 5001, "x" * 4000, "y" * 100_000, ""]
    kept = LexiconAutomaton(terms)
    found = kept.match(words)
    # Few bytes are kept: states are made anew, with the same result.
    monkeypatch.setattr(lexicon_automaton, "MOST_BYTES", 1000)
    monkeypatch.setattr(lexicon_automaton, "_WORDS", 7)
    scarce = LexiconAutomaton(terms)
    assert scarce.match(words).tolist() == found.tolist() == scarce.match(words).tolist()
    own = sorted(set(terms))
    assert all(own[t] == w and e == 0 for w, (t, e) in zip(words, found[: len(terms)].tolist()))
    assert found[words.index("x" * 5001)].tolist() == [own.index("x" * 5000), 1]
    assert found[-1].tolist() == found[-2].tolist() == [-1, -1] and kept.size < 80 << 20


def test_terms_of_two_letters_and_of_fifty_enter_the_lexicon(spark):
    random.seed(4)
    plain = ["".join(random.choice("aeiourstln") for _ in range(5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(200):
        words = [random.choice(plain) for _ in range(30)]
        if i % 2:
            words.insert(random.randrange(len(words)), "zq")
            words.insert(random.randrange(len(words)), "k" * 50)
        docs.append((i, " ".join(words)))
        labels.append((i, i % 2))
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {"zq", "k" * 50} <= set(model.terms)


def test_labelled_texts_equal_a_plain_join(spark):
    rows = [(1, "a b"), (2, "a b"), (2, "a b"), (3, "c"), (3, "d"), (4, None), (None, "a b"), (5, ""), (6, "e"), (7, "c"), (9, "zz")]
    labels = [(1, 0), (2, 1), (3, 0), (4, 1), (5, 1), (6, None), (7, 0), (None, 1), (7, 1), (11, 1)]
    held = {i for i in range(12) if zlib.crc32(str(i).encode()) % 5 == 0}
    known = {}
    for i, toxic in labels:
        if i is not None and toxic is not None and i not in held:
            known[i] = max(toxic, known.get(i, 0))
    want = {}
    for i, text in rows:
        if i in known and text is not None:
            want[text] = max(known[i], want.get(text, 0))
    found = toxicity.labelled_texts(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert sorted((r["text"], r["toxic"]) for r in found) == sorted(want.items())


def test_member_filter_keeps_every_member(spark):
    from cellwatch.llm import common

    ids = spark.range(0, 3000, 3).withColumnRenamed("id", "doc_id")
    kept = spark.range(30_000).where(common.may_be_among(F.col("id"), ids, 1 << 12)).collect()
    assert {r["id"] for r in kept} >= set(range(0, 3000, 3)) and len(kept) < 2500
