"""Operator 2: toxicity by a lexicon with misspellings and by the context of each term.

The lexicon is learnt from labels: words that toxic texts use far more often
than others, in many different surroundings, so that copies of one text count
once. A Levenshtein automaton over its trie finds the terms and their
misspellings; a window around each hit tells quotation from abuse. A logistic
model of these counts gives the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwatch.llm import common
from cellwatch.llm.lexicon_automaton import LexiconAutomaton
from cellwatch.runtime import materialize

# Labelled documents that the weights are fitted on, the first by a hash of their id; counts are over all.
TRAINING_ROWS = 20_000
# A term's share among toxic texts over its share among others, and in how many surroundings it must
# occur, of each document one.
MIN_RATIO, MIN_CONTEXTS = 10.0, 4
# Words on each side of a hit.
CONTEXT = 8
_EDGES = ".,;:!?\"'`()[]{}<>|/\\*%$&#~_-+=…“”„«»‘’¡¿"
_QUOTES = "\"“”„«»"
FEATURES = ["exact", "fuzzy", "quoted", "terms", "densest", "share"]


@dataclass
class Model:
    terms: list[str]
    ordinary: list[str]  # words near a term that clean texts use
    weights: list[float]
    center: list[float]
    scale: list[float]


class Scanner:
    """Finds terms in blocks of texts and counts them by context."""

    def __init__(self, terms: list[str], ordinary: list[str]):
        self.automaton = LexiconAutomaton(terms, swaps=True)
        self.ordinary = set(ordinary)

    def terms_of(self, words: list[str]) -> np.ndarray:
        found = self.automaton.match(words)
        for i in np.flatnonzero(found[:, 1] > 0):
            if words[i] in self.ordinary:
                found[i] = -1
        return found

    def features(self, texts: pa.Array) -> np.ndarray:
        tokens = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
        coded = tokens.flatten().dictionary_encode()
        raw = coded.dictionary
        words = pc.utf8_trim(raw, _EDGES).to_pylist()
        found = self.terms_of(words)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        offsets = tokens.offsets.to_numpy() - tokens.offsets[0].as_py()
        out = np.zeros((len(texts), len(FEATURES)))
        at = np.flatnonzero(found[:, 0][codes] >= 0)
        if not len(at):
            return out
        doc = np.searchsorted(offsets, at, side="right") - 1
        cuts = np.flatnonzero(np.diff(doc)) + 1
        raw = raw.to_pylist()
        for places in np.split(at, cuts):
            d = int(np.searchsorted(offsets, places[0], side="right") - 1)
            begin, end = int(offsets[d]), int(offsets[d + 1])
            term = found[codes[places]]
            quoted = np.array([self._quoted(raw, codes, int(p), begin, end) for p in places])
            abuse = ~quoted
            inside = np.searchsorted(places, places + CONTEXT, side="right") - np.searchsorted(places, places - CONTEXT)
            out[d] = [
                math.log1p((abuse & (term[:, 1] == 0)).sum()),
                math.log1p((abuse & (term[:, 1] > 0)).sum()),
                math.log1p(quoted.sum()),
                math.log1p(len(set(term[abuse, 0].tolist()))),
                math.log1p(inside[abuse].max(initial=0)),
                math.log1p(100 * abuse.sum() / (end - begin)),
            ]
        return out

    @staticmethod
    def _quoted(raw: list[str], codes: np.ndarray, p: int, begin: int, end: int) -> bool:
        """Is the last quotation mark within the window before the word open, and one after it near?"""
        opened = False
        for q in range(max(begin, p - CONTEXT), p):
            marks = sum(raw[codes[q]].count(m) for m in _QUOTES)
            opened ^= marks % 2 == 1
        own = raw[codes[p]]
        core = own.strip(_EDGES)
        head = own[: own.find(core)] if core else own
        opened ^= sum(head.count(m) for m in _QUOTES) % 2 == 1
        if not opened:
            return False
        tail = own[len(head) + len(core) :]
        return any(m in tail for m in _QUOTES) or any(
            m in raw[codes[q]] for q in range(p + 1, min(end, p + CONTEXT + 1)) for m in _QUOTES
        )


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, rank) of all distinct texts of labelled documents that are not held out.

    A text with both labels is toxic; `rank` is the least hash of its ids.
    Labels meet hashes of texts, and only then is one text of each hash moved,
    once; a filter of fixed size leaves most other texts where they are read.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    mark = F.unhex(F.md5(F.col("text").cast("binary")))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    marked = texts.select("doc_id", mark.alias("mark")).join(known, "doc_id")
    chosen = marked.groupBy("mark").agg(F.max("toxic").alias("toxic"), F.min(F.xxhash64("doc_id")).alias("rank"), F.min("doc_id").alias("doc_id"))
    chosen = materialize(chosen, "toxic-chosen")
    near = texts.where(common.may_be_among(F.col("doc_id"), chosen.select("doc_id"))).withColumn("mark", mark)
    # Equal rows of one document come together.
    found = near.join(chosen, ["doc_id", "mark"]).groupBy("doc_id", "mark").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"), F.first("rank").alias("rank"))
    return materialize(found.select("text", "toxic", "rank"), "toxic-labelled")


def training_sample(labelled: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """The first `rows` texts by rank, for the weights alone."""
    last = labelled.select("rank").orderBy("rank").limit(rows).agg(F.max("rank")).first()[0]
    return labelled.where(F.col("rank") <= F.lit(last)).select("text", "toxic")


def _words(text: Column) -> Column:
    return F.transform(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: F.btrim(w, F.lit(_EDGES)))


def learn_lexicon(labelled: DataFrame) -> tuple[list[str], DataFrame]:
    """Terms by their odds in toxic texts, and the counts of all words of labelled texts."""
    toxic = F.col("toxic") == 1
    counts = materialize(
        labelled.select("toxic", F.explode(F.array_distinct(_words(F.col("text")))).alias("word"))
        .where(F.length("word") > 1)
        .groupBy("word")
        .agg(F.count_if(toxic).alias("n_toxic"), F.count_if(~toxic).alias("n_clean")),
        "toxic-words",
    )
    size = labelled.agg(F.count_if(toxic).alias("toxic"), F.count_if(~toxic).alias("clean")).first()
    if not size["toxic"] or not size["clean"]:
        return [], counts
    ratio = (F.col("n_toxic") / size["toxic"]) / ((F.col("n_clean") + 0.5) / size["clean"])
    # Few more than the terms, which are sent to every task anyway.
    likely = counts.where((ratio >= MIN_RATIO) & (F.col("n_toxic") >= MIN_CONTEXTS)).select("word")
    words = _words(F.col("text"))
    sides = F.transform("w", lambda w, i: F.struct(w.alias("word"), F.get("w", i - 1).alias("left"), F.get("w", i + 1).alias("right")))
    seen = (
        labelled.where("toxic = 1")
        .select(F.xxhash64("text").alias("document"), words.alias("w"))
        .select("document", F.inline(sides))
        .join(F.broadcast(likely), "word")
        .groupBy("word", "document")
        .agg(F.min(F.struct("left", "right")).alias("sides"))
        .groupBy("word")
        .agg(F.count_distinct("sides").alias("contexts"))
        .where(F.col("contexts") >= MIN_CONTEXTS)
    )
    return sorted(r["word"] for r in seen.collect()), counts


def ordinary_words(counts: DataFrame, terms: list[str]) -> list[str]:
    """Words that are no term but near one, and that labelled clean texts use."""
    sent = counts.sparkSession.sparkContext.broadcast(Scanner(terms, []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            near = np.flatnonzero(sent.value.terms_of(words)[:, 1] > 0)
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in near], pa.string())], ["word"])

    clean = counts.where("n_clean > 1 and n_clean > n_toxic").select("word")
    # Only words within reach of a term come to the driver.
    return sorted(r["word"] for r in clean.mapInArrow(run, "word string").collect())


def _features(docs: DataFrame, scanner: Scanner, keep: list[str]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(scanner)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    schema += ", " + ", ".join(f"__{name} double" for name in FEATURES)
    where = keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in common.text_blocks(batches, decode=False):
            found = sent.value.features(rows.column(where).combine_chunks())
            columns = [*rows.columns, *(pa.array(c) for c in found.T)]
            yield from pa.Table.from_arrays(columns, [*keep, *(f"__{n}" for n in FEATURES)]).combine_chunks().to_batches()

    return docs.select(*keep).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Lexicon from all labelled documents, weights from at most `rows` of them; without both classes, a score of 0.

    Only terms, ordinary words near them and the features of the bounded sample reach the driver.
    """
    common.ship(docs.sparkSession)
    labelled = labelled_texts(docs, labels)
    terms, counts = learn_lexicon(labelled)
    sample = training_sample(labelled, rows)
    ordinary = ordinary_words(counts, terms)
    points = _features(sample, Scanner(terms, ordinary), ["text", "toxic"]).drop("text").toPandas()
    x, y = points[[f"__{n}" for n in FEATURES]].to_numpy(), points["toxic"].to_numpy()
    if len(set(y.tolist())) < 2:
        return Model(terms, ordinary, [0.0] * len(FEATURES) + [-30.0 if not y.sum() else 30.0], [0.0] * len(FEATURES), [1.0] * len(FEATURES))
    center, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    return Model(terms, ordinary, logistic((x - center) / scale, y).tolist(), center.tolist(), scale.tolist())


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights and intercept by Newton steps with a ridge penalty."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs`, plus score (0 to 1) and predicted (1 from 0.5 on).

    Null and empty texts have no terms and get the score of such texts.
    Columns with the names of the new ones are replaced. Rows are independent:
    nothing is shuffled; the model sent holds the terms and the ordinary words near them.
    """
    common.ship(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    found = _features(docs, Scanner(model.terms, model.ordinary), keep)
    logit = F.lit(float(model.weights[-1]))
    for name, weight, center, scale in zip(FEATURES, model.weights, model.center, model.scale):
        logit = logit + (F.col(f"__{name}") - center) / scale * weight
    value = 1 / (1 + F.exp(-logit))
    return found.select(*keep, value.alias("score"), (value >= 0.5).cast("int").alias("predicted"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: held_out, score and predicted."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
