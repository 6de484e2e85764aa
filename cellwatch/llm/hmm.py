"""Operator 1: a hidden Markov language model trained on all partitions.

Baum-Welch counts are summed in each partition and then over partitions; the
scaled forward recursion gives the exact likelihood of a text. States emit
classes: each of the most frequent words is a class of its own, the others share
buckets of a hash, so the model has a fixed size. Within its bucket a word has
its smoothed share of the bucket's count, which is joined from the counts of all
words. The product is a proper distribution over all words, unseen ones
included. Long texts are trained on in pieces that know what comes before and
after them, so that counts are those of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwatch.llm import common
from cellwatch.runtime import materialize

# Frequent words with a class of their own, and buckets of the others.
FREQUENT, BUCKETS = 1 << 13, 1 << 14
# Words whose counts go to all tasks; those of others are joined.
KNOWN = 1 << 16
STATES = 8
ROUNDS = 6
# Training works on pieces of so many tokens, and on so many tokens at a time.
PIECE, BATCH = 512, 1 << 18
# Bytes of text in a block.
BLOCK_BYTES = 4 << 20
# Weight of the common distribution of classes in that of a state.
PRIOR = 200.0
SEED = 7
END = ""  # no word is empty
_LN10 = np.log(10.0)


@dataclass
class Parameters:
    start: np.ndarray  # states
    moves: np.ndarray  # states x states
    emits: np.ndarray  # classes x states; the last class is the end


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


@dataclass
class Vocabulary:
    """Counts of the known words by falling count; the first `own` of them are classes."""

    counts: dict[str, int]
    own: int
    buckets: int

    @property
    def classes(self) -> int:
        """Classes without the end, which is the last."""
        return self.own + self.buckets


def _coded(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a block, its tokens (1 and on for words, 0 for the end of each text), and the tokens of each text."""
    texts = pc.fill_null(rows.column("text").combine_chunks(), "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary
    codes = coded.indices.to_numpy(zero_copy_only=False)
    ends = parts.offsets.to_numpy()[1:] - parts.offsets[0].as_py()
    # Splitting leaves empty parts at the ends of a text; they go, and one end is put after each text.
    empty = pc.index(words, "").as_py()
    solid = codes != empty
    before = np.concatenate(([0], np.cumsum(solid)))
    stops = before[ends]
    number = np.arange(1, len(words) + 1, dtype=np.int32)
    if empty >= 0:
        number[empty + 1 :] -= 1
        words = pa.concat_arrays([words[:empty], words[empty + 1 :]])
    tokens = np.insert(number[codes[solid]], stops, 0)
    return words, tokens, np.diff(np.concatenate(([0], stops))) + 1


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for rows, _ in common.text_blocks(batches, limit=BLOCK_BYTES, decode=False):
        yield rows.combine_chunks()
        # Else the pool keeps the largest block's memory for as long as the worker lives.
        del rows
        pa.default_memory_pool().release_unused()


def word_counts(docs: DataFrame, held_out: Column) -> DataFrame:
    """(word, c) of all words and the end in training texts, added up in blocks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks_of(batches):
            words, tokens, _ = _coded(rows)
            count = np.bincount(tokens, minlength=len(words) + 1)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array([END]), words]), pa.array(count)], ["word", "n"])

    told = docs.where(~held_out).select("text").mapInArrow(run, "word string, n long")
    return materialize(told.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "word-counts")


def vocabulary(totals: DataFrame) -> Vocabulary:
    """The most frequent words, at most KNOWN, by falling count and then by word.

    Counts fall into steps of about a hundredth; the words above the last step
    that leaves few enough come to the driver.
    """
    words = totals.where(F.col("word") != END)
    step = F.floor(F.log2("c") * 64).cast("int")
    held, least = 0, None
    for row in words.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():  # at most 64 steps to a doubling
        held += row["n"]
        if held > KNOWN:
            break
        least = row["step"]
    top = words.where(step >= least).collect() if least is not None else []
    counts = {r["word"]: r["c"] for r in sorted(top, key=lambda r: (-r["c"], r["word"]))}
    return Vocabulary(counts, min(FREQUENT, len(counts)), BUCKETS)


def token_blocks(docs: DataFrame, held_out: Column, known: Vocabulary) -> DataFrame:
    """Texts as numbers, a block a row: ids, sizes and tokens of its documents, and classes and counts of its own dictionary.

    `rare` lists the words whose counts the vocabulary lacks, with their
    numbers. Blocks hold a bounded number of text bytes and are stored with a
    number.
    """
    sent = docs.sparkSession.sparkContext.broadcast(known)
    schema = "doc_ids array<bigint>, held array<boolean>, sizes binary, tokens binary, classes binary, counts binary, rare array<struct<number:int,word:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, by_place = pa.array(list(sent.value.counts), pa.string()), np.array(list(sent.value.counts.values()), dtype=np.int64)
        for rows in _blocks_of(batches):
            yield _block(rows, sent.value, places, by_place)

    source = docs.select(F.col("doc_id").cast("long"), held_out.alias("held"), "text")
    return materialize(source.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id()), "token-blocks")


def _hashes(words: pa.Array) -> np.ndarray:
    """XXH64 of each word as `common.xxh` computes it, from the bytes as they lie."""
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1].tolist()
    held = data.to_pybytes() if data else b""
    return np.array([common.xxh(held[a:b]) for a, b in zip(ends, ends[1:])], dtype=np.uint64)


def _block(rows: pa.Table, known: Vocabulary, places: pa.Array, by_place: np.ndarray) -> pa.RecordBatch:
    words, tokens, sizes = _coded(rows)
    at = pc.fill_null(pc.index_in(words, places), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    classes, counts = np.empty(len(words) + 1, dtype=np.int64), np.zeros(len(words) + 1, dtype=np.int64)
    classes[0], classes[1:] = known.classes, at
    shared = np.flatnonzero((at < 0) | (at >= known.own))
    hashes = _hashes(words.take(pa.array(shared)))
    classes[1 + shared] = known.own + (hashes % np.uint64(known.buckets)).astype(np.int64)
    counts[1 + np.flatnonzero(at >= 0)] = by_place[at[at >= 0]]
    numbers = np.flatnonzero(at < 0)
    rare = pa.StructArray.from_arrays([pa.array(numbers + 1, pa.int32()), words.take(pa.array(numbers))], ["number", "word"])
    one = lambda x, kind: pa.array([x], kind)
    return pa.RecordBatch.from_arrays(
        [
            one(rows.column("doc_id").to_pylist(), pa.list_(pa.int64())),
            one(rows.column("held").to_pylist(), pa.list_(pa.bool_())),
            one(sizes.astype("<i4").tobytes(), pa.binary()),
            one(_packed(tokens, "<i4"), pa.binary()),
            one(_packed(classes, "<i4"), pa.binary()),
            one(_packed(counts, "<i8"), pa.binary()),
            pa.ListArray.from_arrays(pa.array([0, len(rare)], pa.int32()), rare),
        ],
        ["doc_ids", "held", "sizes", "tokens", "classes", "counts", "rare"],
    )


def _packed(numbers, kind: str) -> bytes:
    """Compressed, after the bytes at one place of all numbers are put together; the count of numbers stands before."""
    data = np.asarray(numbers, dtype=kind)
    planes = data.view(np.uint8).reshape(len(data), -1).T.tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(packed: bytes, kind: str) -> np.ndarray:
    n, width = int.from_bytes(packed[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(packed[8:], n * width, codec="zstd", asbytes=True), np.uint8)
    return planes.reshape(width, n).T.copy(order="C").view(kind).ravel()


def _steps(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences side by side, longest first: order, running numbers at each step, symbols by step."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    width = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    starts = np.concatenate(([0], np.cumsum(width)))
    flat = np.empty(starts[-1], dtype=np.int64)
    for row, i in enumerate(order.tolist()):
        flat[starts[: len(sequences[i])] + row] = sequences[i]
    return order, starts, flat


def log_likelihoods(sequences: list[np.ndarray], p: Parameters) -> np.ndarray:
    """Natural log probability of each sequence of classes by the scaled forward recursion."""
    order, starts, flat = _steps(sequences)
    total = np.zeros(len(sequences))
    alpha = None
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        n = b - a
        alpha = (p.start[None, :] if alpha is None else alpha[:n] @ p.moves) * p.emits[flat[a:b]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:n] += np.log(scale)
    out = np.empty(len(sequences))
    out[order] = total
    return out


class Counts:
    """Expected counts of starts, moves and emissions, and the log likelihood."""

    def __init__(self, p: Parameters):
        self.p = p
        # A row a state, so that each operation runs along the tokens.
        self._emits = np.ascontiguousarray(p.emits.T)
        self.start = np.zeros_like(p.start)
        self.moves = np.zeros_like(p.moves)
        self.emits = np.zeros_like(p.emits)
        self.likelihood = 0.0

    def add(self, sequences: list[np.ndarray], before: list | None = None, after: list | None = None) -> None:
        """Counts of sequences, or of pieces of some.

        `before` holds per piece the state probabilities at the token before
        it, given all tokens up to there, and None where a sequence begins;
        `after` the weights of the states at its last token by what follows,
        None where it ends.
        """
        p, n_states = self.p, len(self.p.start)
        order, starts, flat = _steps(sequences)

        def rows(given: list | None, default: float) -> np.ndarray:
            out = np.full((len(order), n_states), default)
            for i, x in enumerate(given or ()):
                if x is not None:
                    out[i] = x
            return out[order].T

        before, after = rows(before, np.nan), rows(after, 1.0)
        begins = np.isnan(before[0])
        moves_t = np.ascontiguousarray(p.moves.T)
        emitted = np.take(self._emits, flat, axis=1)
        spans = list(zip(starts[:-1].tolist(), starts[1:].tolist()))
        alpha = np.empty_like(emitted)
        scale = np.empty(len(flat))
        for t, (a, b) in enumerate(spans):
            now = alpha[:, a:b]
            if t == 0:
                now[:] = np.where(begins, p.start[:, None], moves_t @ np.nan_to_num(before))
            else:
                np.matmul(moves_t, alpha[:, spans[t - 1][0] : spans[t - 1][0] + b - a], out=now)
            now *= emitted[:, a:b]
            np.add.reduce(now, axis=0, out=scale[a:b])
            now /= scale[a:b]
        self.likelihood += float(np.log(scale).sum())
        beta = None
        gamma = alpha  # turned into state probabilities from the end
        for t in range(len(spans) - 1, -1, -1):
            a, b = spans[t]
            going = 0 if beta is None else spans[t + 1][1] - spans[t + 1][0]
            if going:
                c, d = spans[t + 1]
                onward = emitted[:, c:d]  # not asked for again
                onward *= beta
                onward /= scale[c:d]
                self.moves += p.moves * (alpha[:, a : a + going] @ onward.T)
                beta = p.moves @ onward
            if going < b - a:
                # What ends here starts from what follows it, scaled to probabilities.
                ending = after[:, going : b - a]
                ending = ending / (alpha[:, a + going : b] * ending).sum(axis=0)
                beta = np.concatenate((beta, ending), axis=1) if going else ending
            if t == 0:
                self.start += (alpha[:, a:b] * beta)[:, begins].sum(axis=1)
                onward = (emitted[:, a:b] * beta / scale[a:b])[:, ~begins]
                self.moves += p.moves * (before[:, ~begins] @ onward.T)
            gamma[:, a:b] *= beta
        for s in range(n_states):
            self.emits[:, s] += np.bincount(flat, weights=gamma[s], minlength=len(self.emits))


def _operators(pieces: list[np.ndarray], p: Parameters) -> np.ndarray:
    """Per piece the matrix, up to a factor, that takes state weights at the token before it to those at its last.

    In single precision, which tells the shares of the states to seven digits;
    emissions count relative to those of the likeliest state, so that products
    stay far from the least numbers between the steps that scale them.
    """
    n_states = len(p.start)
    order, starts, flat = _steps(pieces)
    moves_t = np.ascontiguousarray(p.moves.T.astype(np.float32))
    emits = np.ascontiguousarray((p.emits / p.emits.max(axis=1, keepdims=True)).astype(np.float32).T)
    # The pieces are the last axis, so that each operation runs along them.
    out = np.repeat(np.eye(n_states, dtype=np.float32)[:, :, None], len(pieces), axis=2)
    for step, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        now = out[:, :, : b - a]
        now[:] = np.matmul(moves_t, now)
        now *= np.take(emits, flat[a:b], axis=1)
        if step % 8 == 7:
            now /= now.max(axis=(0, 1))
    back = np.empty((len(pieces), n_states, n_states))
    back[order] = (out / out.max(axis=(0, 1))).transpose(2, 0, 1)
    return back


def in_pieces(sequences: list[np.ndarray], p: Parameters, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """Pieces of sequences, each with what `Counts.add` asks about before and after it, None where there is nothing.

    The pieces of all long sequences become matrices side by side; only these
    are chained.
    """
    long, inner = [], []
    for sequence in sequences:
        if len(sequence) <= size:
            yield sequence, None, None
            continue
        pieces = [sequence[at : at + size] for at in range(0, len(sequence), size)]
        # The first piece is chained without its first token, which the start stands for.
        head = [pieces[0][1:]] if size > 1 else []
        long.append((pieces, len(inner), len(head)))
        inner += head + pieces[1:]
    matrices = _operators(inner, p) if inner else None
    for pieces, at, head in long:
        own = matrices[at + head : at + head + len(pieces) - 1]
        state = p.start * p.emits[pieces[0][0]]
        if head:
            state = state @ matrices[at]
        before: list = [None]
        for matrix in own:
            before.append(state / state.sum())
            state = before[-1] @ matrix
        after: list = [None]
        weight = np.ones(len(p.start))
        for matrix in own[::-1]:
            weight = matrix @ weight
            weight = weight / weight.sum()
            after.append(weight)
        yield from zip(pieces, before, after[::-1])


def _sequences(row: dict, keep: np.ndarray) -> Iterator[np.ndarray]:
    """Class sequences of the kept documents of a block."""
    sizes = np.frombuffer(row["sizes"], "<i4")
    classes = _unpacked(row["classes"], "<i4")[_unpacked(row["tokens"], "<i4")]
    stops = np.cumsum(sizes).tolist()
    for doc, (a, b) in enumerate(zip([0, *stops], stops)):
        if keep[doc]:
            yield classes[a:b]


def expected_counts(blocks: DataFrame, p: Parameters) -> tuple[Counts, int]:
    """One pass of Baum-Welch over all training documents."""
    sent = blocks.sparkSession.sparkContext.broadcast(p)
    states = len(p.start)
    names = [f"s{i}" for i in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(sent.value)
        held, size = [], 0

        def add() -> None:
            counts.add(*map(list, zip(*held)))
            held.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                for part in in_pieces(list(_sequences(row, ~np.array(row["held"], dtype=bool))), sent.value):
                    held.append(part)
                    size += len(part[0])
                    if size >= BATCH:
                        add()
                        size = 0
        if held:
            add()
        likelihood = np.zeros((1, states))
        likelihood[0, 0] = counts.likelihood
        table = np.concatenate((counts.emits, counts.moves, counts.start[None, :], likelihood))
        rows = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(table[rows, s]) for s in range(states))], ["row", *names])

    schema = "row long, " + ", ".join(f"{n} double" for n in names)
    # One row per class and partition, summed before and after the shuffle; the sum has the model's fixed size.
    summed = blocks.select("held", "sizes", "tokens", "classes").mapInArrow(run, schema).groupBy("row").agg(*[F.sum(n).alias(n) for n in names])
    classes = len(p.emits)
    table = np.zeros((classes + states + 2, states))
    for row in summed.collect():
        table[row["row"]] = row[1:]
    total = Counts(p)
    total.emits, total.moves = table[:classes], table[classes : classes + states]
    total.start, total.likelihood = table[-2], float(table[-1, 0])
    return total, int(round(total.emits.sum()))


def train(blocks: DataFrame, shares: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Parameters:
    """Parameters after some rounds from a seeded start around the shares of the classes."""
    random = np.random.default_rng(SEED)
    emits = shares[:, None] * np.exp(random.normal(size=(len(shares), states)))
    p = Parameters(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emits / emits.sum(axis=0))
    for _ in range(rounds):
        counts, _ = expected_counts(blocks, p)
        emits = counts.emits + PRIOR * shares[:, None]
        moves, start = counts.moves + 0.1, counts.start + 0.1
        p = Parameters(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))
    return p


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Tokens are the words between ASCII white space, A-Z lower-cased, and one
    end. Learning leaves out documents whose crc32(doc_id as text) mod 5 is 1;
    a null doc_id counts as the empty text. Null and empty texts are an end
    alone. Repeated rows are separate documents. Without training tokens all
    words are unseen. Scores are log10 probabilities.
    """
    common.ship(docs.sparkSession)
    out = is_held_out(F.col("doc_id"))
    totals = word_counts(docs, out)
    known = vocabulary(totals)
    class_n, class_v = np.zeros(known.classes + 1), np.zeros(known.classes + 1)
    for place, c in enumerate(known.counts.values()):
        if place < known.own:
            class_n[place], class_v[place] = c, 1
    bucket = F.when(F.col("word") == END, F.lit(BUCKETS)).otherwise(F.pmod(F.xxhash64("word"), F.lit(BUCKETS)))
    for row in totals.groupBy(bucket.alias("bucket")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # one row per bucket
        class_n[known.own + row["bucket"]], class_v[known.own + row["bucket"]] = row["n"], row["v"]
    # The buckets count all words; those with a class of their own are taken out.
    for place, (word, c) in enumerate(known.counts.items()):
        if place < known.own:
            at = known.own + common.xxh(word) % BUCKETS
            class_n[at] -= c
            class_v[at] -= 1
    n, v, n_ends = int(class_n.sum()), int(class_v.sum()), int(class_n[-1])
    shares = (class_n + 0.5) / (n + 0.5 * len(class_n))
    blocks = token_blocks(docs, out, known)
    sent = docs.sparkSession.sparkContext.broadcast((train(blocks, shares, states, rounds), class_n + 0.5 * (class_v + 1), known.own, n, v))
    # The counts of a block's rare words go back to it; a block holds a bounded number of them.
    rare = blocks.select("block", F.inline("rare"))
    own = rare.join(totals, "word").groupBy("block").agg(F.collect_list(F.struct("number", "c")).alias("joined"))
    both = blocks.select("block", "doc_ids", "held", "sizes", "tokens", "classes", "counts").join(own, "block", "left").drop("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, of_class, n_own, n, v = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
                sizes = np.frombuffer(row["sizes"].as_py(), "<i4")
                tokens = _unpacked(row["tokens"].as_py(), "<i4")
                classes = _unpacked(row["classes"].as_py(), "<i4")
                count = _unpacked(row["counts"].as_py(), "<i8")
                if row["joined"].is_valid:
                    pairs = row["joined"].values
                    count[pairs.field("number").to_numpy()] = pairs.field("c").to_numpy()
                count[0] = n_ends
                firsts = np.cumsum(sizes) - sizes
                per_doc = lambda x: np.add.reduceat(x[tokens], firsts)  # noqa: B023, E731
                base = per_doc(np.log10((count + 0.5) / (n + 0.5 * (v + 1))))
                # A word with a class of its own is all of it, and so is the end.
                alone = (classes < n_own) | (classes == len(of_class) - 1)
                within = per_doc(np.where(alone, 0.0, np.log10((count + 0.5) / of_class[classes])))
                sequences = np.split(classes[tokens], firsts[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        row["doc_ids"].values,
                        row["held"].values,
                        pa.array(sizes.astype(np.int64)),
                        pa.array(per_doc((count > 0).astype(np.int64))),
                        pa.array(np.full(len(sizes), n)),
                        pa.array(base),
                        pa.array(log_likelihoods(sequences, p) / _LN10 + within),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.mapInArrow(run, schema)
