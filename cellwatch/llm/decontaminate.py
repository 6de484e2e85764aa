"""Operator 5: benchmark decontamination by an FM-index per shard of the corpus.

A shard is a block of documents of bounded size. Its index holds the words that
benchmark items use; any other word is a break, as no window spans it, and
stretches shorter than the shortest window are left out. Windows are looked up
by backward search through wavelet ranks, located by sampled suffix positions,
and the words they cover are merged to removal spans.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwatch.llm import common
from cellwatch.llm.fm_index import FMIndex

WINDOW = 13
# Benchmark words broadcast at one time; more are searched in further passes.
BATCH_WORDS = 1_000_000


class Windows:
    """The distinct windows of some benchmark items, by length."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int):
        self.ids: dict[bytes, int] = {}
        owners: dict[tuple, set] = defaultdict(set)
        for item, words in items:
            coded = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
            length = min(window, len(coded))
            for i in range(len(coded) - length + 1):
                own = owners[tuple(coded[i : i + length])]
                if item is not None:
                    own.add(item)
        lengths: dict[int, list[tuple]] = defaultdict(list)
        for key in owners:
            lengths[len(key)].append(key)
        self.phrases = {m: np.array(keys, dtype=np.int64) for m, keys in lengths.items()}
        self.owners = {m: [sorted(owners[k]) for k in keys] for m, keys in lengths.items()}
        self.shortest = min(lengths, default=0)

    def hits(self, docs: list[list[bytes]]) -> tuple[list[np.ndarray], list[set]]:
        """Per document: a mark for each word inside an occurrence, and the items found."""
        return self.hits_of([self.coded(words) for words in docs])

    def coded(self, words: list[bytes]) -> np.ndarray:
        get = self.ids.get
        return np.array([get(w, 0) for w in words], dtype=np.int32)

    def hits_of(self, docs: list[np.ndarray]) -> tuple[list[np.ndarray], list[set]]:
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes + 1)))
        symbols = np.zeros(starts[-1], dtype=np.int64)
        for start, doc in zip(starts.tolist(), docs):
            symbols[start : start + len(doc)] = doc
        marks = np.zeros(len(symbols) + 1, dtype=np.int64)
        found: list[set] = [set() for _ in docs]
        kept = self._kept(symbols)
        if len(kept):
            index = FMIndex(np.where(kept >= 0, symbols[kept], 0))
            for length, phrases in self.phrases.items():
                low, high = index.search(phrases)
                counts = high - low
                phrase = np.repeat(np.arange(len(phrases)), counts)
                within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                at = kept[index.locate(np.repeat(low, counts) + within)]
                np.add.at(marks, at, 1)
                np.add.at(marks, at + length, -1)
                doc = np.searchsorted(starts, at, side="right") - 1
                for d, p in np.unique(np.stack((doc, phrase)), axis=1).T.tolist():
                    found[d].update(self.owners[length][p])
        covered = np.cumsum(marks) > 0
        return [covered[s : s + n] for s, n in zip(starts.tolist(), sizes.tolist())], found

    def _kept(self, symbols: np.ndarray) -> np.ndarray:
        """Places in stretches of known words that can hold a window, -1 between stretches."""
        known = np.concatenate(([0], (symbols > 0).astype(np.int8), [0]))
        edges = np.flatnonzero(np.diff(known))
        begin, end = edges[::2], edges[1::2]
        long = end - begin >= max(1, self.shortest)
        begin, size = begin[long], (end - begin)[long] + 1
        offset = np.repeat(begin - (np.cumsum(size) - size), size)
        places = np.arange(size.sum()) + offset
        places[np.cumsum(size) - 1] = -1
        return places


def _batches(benchmark: DataFrame, window: int) -> Iterator[Windows]:
    """Windows of items, read one partition at a time and cut to bounded batches."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = common.alnum_words(row["text"])
        if not words:
            continue
        # A long item is cut to pieces that overlap by a window less one word.
        for first in range(0, max(1, len(words) - window + 1), BATCH_WORDS):
            held.append((row["item_id"], words[first : first + BATCH_WORDS + window - 1]))
            size += len(held[-1][1])
            if size >= BATCH_WORDS:
                yield Windows(held, window)
                held, size = [], 0
    if held:
        yield Windows(held, window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All columns of `docs`, plus n_words, n_hit, items, spans and contaminated.

    A window is `window` consecutive words of an item, or all words of a
    shorter item that has any. `spans` lists the merged stretches of hit words
    as (first, end) word places, `items` the ids of the items found. A document
    is contaminated if at least one word in twenty is hit. Null and empty texts
    have no words and are clean; items without words are not searched, and words
    of items without id are hit but no item is named.
    Columns of `docs` with the names of new ones are replaced. Rows stay where
    they are: only the benchmark is sent, in batches of bounded size. Each
    further batch is one more pass whose spans are merged with the earlier.
    """
    common.ship(docs.sparkSession)
    new = "n_words long, n_hit long, items array<bigint>, spans array<struct<first:bigint,end:bigint>>"
    names = [part.split()[0] for part in new.split(", ")]
    kept = [c for c in docs.columns if c not in [*names, "contaminated"]]
    source = docs.select(*kept)
    out = None
    for windows in _batches(benchmark, window):
        sent = docs.sparkSession.sparkContext.broadcast(windows)
        columns = kept if out is None else out.columns
        rows = source if out is None else out
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + ", " + new
        out = rows.mapInArrow(_searcher(sent, kept, columns), schema)
    if out is None:
        counted = F.size(F.expr(r"regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', 0)")).cast("long")
        out = source.withColumns({"n_words": counted, "n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<bigint>"), "spans": F.array().cast("array<struct<first:bigint,end:bigint>>")})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _searcher(sent, kept: list[str], columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = sent.value
        for rows, texts in common.text_blocks(batches):
            coded = [windows.coded(common.alnum_words(text)) for text in texts]
            covered, found = windows.hits_of(coded)
            before = rows.column("spans").to_pylist() if "spans" in columns else None
            if before is not None:
                for marks, spans, items, old in zip(covered, before, found, rows.column("items").to_pylist()):
                    items.update(old)
                    for span in spans:
                        marks[span["first"] : span["end"]] = True
            spans = [_spans(marks) for marks in covered]
            yield from pa.Table.from_arrays(
                [
                    *[rows.column(c) for c in kept],
                    pa.array([len(c) for c in covered], pa.int64()),
                    pa.array([int(c.sum()) for c in covered], pa.int64()),
                    pa.array([sorted(f) for f in found], pa.list_(pa.int64())),
                    pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                ],
                [*kept, "n_words", "n_hit", "items", "spans"],
            ).combine_chunks().to_batches()

    return run


def _spans(marks: np.ndarray) -> list[dict]:
    if not marks.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.astype(np.int8), [0])))).tolist()
    return [{"first": a, "end": b} for a, b in zip(edges[::2], edges[1::2])]


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: counts, digest of the items found, and the verdict."""
    items = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return decontaminate(docs.select("doc_id", "text"), benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), "contaminated"
    )


# The same by windows joined as text.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS m, array_to_string(list_slice(w, i, i + least(len(w), {WINDOW}) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT rid, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hit AS (SELECT rid, i, dw.m, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM hit) GROUP BY rid),
items AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
