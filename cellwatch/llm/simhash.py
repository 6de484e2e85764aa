"""Operator 3: SimHash near-duplicate groups by exact tiled comparison.

Fingerprints within the radius agree on at least one of radius + 1 stretches of
bits, so only fingerprints with an equal stretch meet. Those are sorted by
stretch and population count and compared tile by tile with exclusive-or and
bit counts; tiles whose population counts lie further apart than the radius are
skipped. Equal fingerprints are one node, and tasks hand on links of a forest,
never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwatch.llm import common
from cellwatch.llm.components import connected_components
from cellwatch.runtime import discard, materialize

SEED = 42
SHINGLE = 3
RADIUS = 2
BITS = 64
TILE = 1024
_CHUNK = 1 << 16


def fingerprint(words: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bits set in over half the hashes of the shingles, repeats included; 0 without words."""
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    width = min(shingle, len(words))
    begins = (ends - sizes)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, dtype=np.int64)
    ends = ends[width - 1 :].tolist()
    for at in range(0, len(begins), _CHUNK):
        hashes = [digest(joined[a:b], seed) for a, b in zip(begins[at : at + _CHUNK], ends[at : at + _CHUNK])]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(begins), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp as a signed long. Null and empty texts have fingerprint 0."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(common.lower_words(t.as_py()), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all within the radius.

    `fps` holds distinct longs in `fp`. A fingerprint goes once to each of
    radius + 1 groups, named by its bits of one stretch. Each group is split
    further by population count: bands as wide as the radius meet themselves
    and the next band, so a group of any size spreads over tasks.
    """
    common.ship(fps.sparkSession)
    parts = radius + 1
    cuts = [BITS * i // parts for i in range(parts + 1)]
    width = radius + 1
    ones = F.bit_count("fp")
    band = F.floor(ones / width).cast("int")
    homes = [
        F.struct(
            F.lit(i).alias("part"),
            F.shiftright(F.shiftleft("fp", BITS - cuts[i + 1]), BITS - cuts[i + 1] + cuts[i]).alias("stretch"),
            (band + step).alias("band"),
        )
        for i in range(parts)
        for step in (0, 1)
    ]
    keyed = fps.select(F.inline(F.array(*homes)), "fp", ones.alias("ones"))
    # A group of one fingerprint has nothing to compare.
    group = ["part", "stretch", "band"]
    tiles = keyed.repartition(*group).sortWithinPartitions(*group, "ones", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for edges in compare(_tiles(batches, tile), radius):
            found = forest.add(edges)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return tiles.mapInArrow(run, "a long, b long")


class Forest:
    """Union-find that hands back the edges which join two trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def add(self, edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
        joined = []
        for a, b in edges:
            x, y = self.root(a), self.root(b)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                joined.append((a, b))
        return joined


def _tiles(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """Per tile: its keys as rows of numbers, fingerprints and population counts."""
    for batch in batches:
        part, stretch, band, fp, ones = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        keys = np.stack((part.astype(np.int64), stretch, band.astype(np.int64)), axis=1)
        for at in range(0, len(fp), size):
            end = at + size
            yield keys[at:end], fp[at:end].view(np.uint64), ones[at:end]


def compare(tiles: Iterator[tuple], radius: int) -> Iterator[list[tuple[int, int]]]:
    """Links of each tile with itself and with earlier tiles whose last group reaches it."""
    earlier: list[tuple] = []
    for keys, fp, ones in tiles:
        first = tuple(keys[0])
        earlier = [t for t in earlier if t[0] == first]
        found = _cross(fp, fp, radius)
        same = (keys == keys[0]).all(axis=1)
        head, least = fp[same], ones[same].min()
        for _, other, most in earlier:
            if least - most <= radius:
                found += _cross(other, head, radius)
        yield found
        last = (keys == keys[-1]).all(axis=1)
        if tuple(keys[-1]) != first:
            earlier = []
        earlier.append((tuple(keys[-1]), fp[last], ones[last].max()))


def _cross(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
    if a is b:
        near &= np.tri(len(a), k=-1, dtype=bool)
    i, j = np.nonzero(near)
    differ = a[i] != b[j]
    return list(zip(a[i[differ]].view(np.int64).tolist(), b[j[differ]].view(np.int64).tolist()))


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per document: doc_id, fingerprint in hexadecimal, and component_id.

    component_id is the smallest doc_id that links reach. Null and empty texts
    share fingerprint zero. A null doc_id is no component's name unless the
    component has no other; repeated rows are separate documents.
    """
    fps = materialize(fingerprints(docs, shingle), "fingerprints")
    # One row per fingerprint, so copies cost one aggregate and no comparison.
    named = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(named.select("fp"), radius))
    placed = materialize(
        named.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "least", F.coalesce("root", "fp").alias("root")),
        "fingerprint-roots",
    )
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(names, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


# Near copies by similarity: exact, by prefixes of shingles in a fixed order, the rare ones first.
SIMILARITY = 0.8
# Counts of shingles by stretches of their hash, which only order them: 4 MB at the driver whatever the corpus.
COUNT_BITS = 19
# Prefix entries of one shingle that meet in one key of a join.
BLOCK = 256
# Entries of one shingle that one task may stream; by the counts, more frequent shingles are dealt to several.
SALT_ROWS = 1 << 16
_ENTRY = "token long, at int, size int, node long, salt int"


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the distinct shingles of a text, sorted; a shorter text is one shingle, one without words has none."""
    words = common.lower_words(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    width = min(shingle, len(words))
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins = (ends - sizes)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(begins, ends[width - 1 :].tolist())], dtype=np.uint64))


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, mark, digest): hash of the text and 128-bit digest of its set of shingles."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [xxhash.xxh128_digest(shingle_hashes(t.as_py(), shingle).tobytes()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary())], ["doc_id", "mark", "digest"])

    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")
    return source.mapInArrow(run, "doc_id long, mark long, digest binary")


def shingle_counts(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many texts hold shingles of each stretch of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0):
                np.add.at(total, (shingle_hashes(t.as_py(), shingle) >> np.uint64(64 - COUNT_BITS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

    rows = texts.select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << COUNT_BITS, dtype=np.int64)
    out[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return out


def prefix_length(size: int, similarity: float) -> int:
    """Shingles of which similar sets share one at least."""
    return size - math.ceil(similarity * size - 1e-9) + 1


def prefixes(texts: DataFrame, counts: np.ndarray, shingle: int, similarity: float) -> DataFrame:
    """(token, at, size, node, salt): the first shingles of each text by (count, hash), their places and the size of the set.

    `salt` parts the entries of a shingle that may have very many.
    """
    sent = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for node, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = shingle_hashes(t.as_py(), shingle)
                if n := len(tokens):
                    held = sent.value[(tokens >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
                    order = np.lexsort((tokens, held))[: prefix_length(n, similarity)]
                    salt = node % (1 + held[order] // SALT_ROWS)
                    parts.append((tokens[order].view(np.int64), np.arange(len(order), dtype=np.int32), np.full(len(order), n, np.int32), np.full(len(order), node), salt.astype(np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["token", "at", "size", "node", "salt"])

    return texts.select("node", "text").mapInArrow(run, _ENTRY)


def token_stars(entries: DataFrame, similarity: float) -> DataFrame:
    """Entries of shingles that several texts have, each with a representative: (token, node, at, size, rep, rep_at, rep_size).

    A task streams the entries of its shingles in the order of set sizes. The
    first is the representative, and so is each that is too large to be similar
    to the last one; nothing is held but the last row.
    """
    ordered = entries.repartition("token", "salt").sortWithinPartitions("token", "salt", "size", "node")
    names = ["token", "node", "at", "size", "rep", "rep_at", "rep_size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the last row: key, node, at, size, representative, and whether its group has others
        for batch in batches:
            token, at, size, node, salt = (batch.column(i).to_numpy() for i in range(5))
            if not len(token):
                continue
            if rest is not None:
                token, at, size, node, salt = (np.concatenate(([x], y)) for x, y in zip(rest[:5], (token, at, size, node, salt)))
            same = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
            fresh = np.concatenate(([True], ~same))
            starts = np.flatnonzero(fresh)
            group = np.cumsum(fresh) - 1
            # The first row may go on a group of the batch before, with a representative of its own.
            carried = rest[5] if rest is not None else None
            head = np.arange(len(token))
            head = np.maximum.accumulate(np.where(fresh, head, 0))
            base = np.where(group == 0, carried[2], size[head]) if carried else size[head]
            far = size * similarity > base + 1e-6
            if far.any():
                for g in np.unique(group[far]).tolist():
                    a = starts[g]
                    b = starts[g + 1] if g + 1 < len(starts) else len(token)
                    least = carried[2] if g == 0 and carried else size[a]
                    for i in range(a, b):
                        if size[i] * similarity > least + 1e-6:
                            head[i:b] = i
                            least = size[i]
            rep, rep_at, rep_size = node[head], at[head], size[head]
            if carried:
                first = head == 0
                rep, rep_at, rep_size = (np.where(first & (group == 0), c, x) for c, x in zip(carried, (rep, rep_at, rep_size)))
            several = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            if rest is not None and rest[6]:
                several[0] = True
            columns = [token, node, at, size, rep, rep_at, rep_size]
            keep = several.copy()
            keep[-1] = False
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names)
            rest = (token[-1], at[-1], size[-1], node[-1], salt[-1], (rep[-1], rep_at[-1], rep_size[-1]), bool(several[-1]))
        if rest is not None and rest[6]:
            row = [rest[0], rest[3], rest[1], rest[2], *rest[5]]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names)

    kinds = "token long, node long, at int, size int, rep long, rep_at int, rep_size int"
    return ordered.select("token", "at", "size", "node", "salt").mapInArrow(run, kinds)


def _fit(p: dict, q: dict, similarity: float) -> Column:
    """Sets may be similar by their sizes and the places of a common shingle."""
    small, large = F.least(p["size"], q["size"]), F.greatest(p["size"], q["size"])
    rest = F.least(p["size"] - p["at"], q["size"] - q["at"])
    return (small >= similarity * large - 1e-6) & (rest * (1 + similarity) >= similarity * (small + large) - 1e-6)


def candidate_pairs(entries: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """(a, b) of nodes that share a token and may still be similar by their sizes and the places of the token.

    The token at places i and j is at most one of 1 + min(rest of a, rest of b)
    common ones if it is their first; similar sets pass at their first. A token
    is dealt to blocks, whose pairs are keys of their own. With a column `root`
    only nodes of different roots meet.
    """
    rooted = "root" in entries.columns
    entries = entries if rooted else entries.withColumn("root", F.col("node"))
    shared = entries.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").drop("low", "high")
    blocks = F.ceil(F.col("n") / block)
    dealt = (
        entries.join(shared, "token")
        .withColumn("own", F.pmod(F.xxhash64("node"), blocks))
        .select("token", F.struct("node", "root", "at", "size").alias("w"), "own", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    )
    key = ["token", "i", "j"]
    met = dealt.where("own = i").select(*key, F.col("w").alias("p")).join(dealt.where("own = j").select(*key, F.col("w").alias("q")), key)
    p, q = ({c: F.col(f"{side}.{c}") for c in ("at", "size")} for side in "pq")
    once = (F.col("p.root") != F.col("q.root")) & ((F.col("i") < F.col("j")) | (F.col("p.node") < F.col("q.node")))
    return met.where(once & _fit(p, q, similarity)).select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct()


def _crossing(entries: DataFrame, links: DataFrame) -> DataFrame:
    """Entries with `root`, their component by the links so far, of shingles that join components."""
    rooted = entries.join(connected_components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialize(rooted, "rooted")
    several = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
    crossing = materialize(rooted.join(several, "token", "left_semi"), "crossing")
    discard(rooted)
    return crossing


def _similar(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs whose sets of shingles have at least this Jaccard similarity, less those that links of the task connect already.

    The pairs are stored, as a bit set of their nodes keeps most texts of no pair from moving.
    """
    pairs = materialize(pairs, "node-pairs")
    texts = texts.where(common.may_be_among(F.col("node"), pairs.select(F.explode(F.array("a", "b")).alias("node"))))
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")

    def shingles(text: str) -> set:
        words = common.lower_words(text)
        return {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        held, right = None, set()
        for batch in batches:
            kept = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if forest.root(a) == forest.root(b):
                    continue
                if b != held:  # rows of one b mostly come in a row
                    held, right = b, shingles(y.as_py())
                left = shingles(x.as_py())
                if len(left & right) >= similarity * len(left | right):
                    kept += forest.add([(a, b)])
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept)], ["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _placed(docs: DataFrame, shingle: int, similarity: float, radius: int | None = None) -> DataFrame:
    """(doc_id, mark, root) of each row with a doc_id: root names its component.

    With a `radius` texts whose fingerprints link within it are copies too.
    """
    rows = materialize(shingle_sets(docs.where("doc_id is not null"), shingle), "shingle-sets")
    # Equal sets are one node, numbered in the stored table; its text is one of its first document.
    first = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    nodes = materialize(first.withColumn("node", F.monotonically_increasing_id()), "shingle-nodes")
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    # Repeated rows become one and meet their node under one key, so that a text moves once.
    once = named.groupBy("doc_id", "mark").agg(F.first("text").alias("text"))
    texts = materialize(once.join(nodes.select("first.*", "node"), ["doc_id", "mark"]).select("node", "text"), "shingle-texts")
    near = texts.sparkSession.createDataFrame([], "a long, b long")
    if radius is not None:
        grouped = groups(texts.select(F.col("node").alias("doc_id"), "text"), radius=radius).where("doc_id <> component_id")
        near = materialize(grouped.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")), "fingerprint-links")
    entries = prefixes(texts, shingle_counts(texts, shingle), shingle, similarity)
    stars = materialize(token_stars(entries, similarity), "token-stars")
    # First each text meets the representatives of its shingles.
    p, q = {"at": F.col("at"), "size": F.col("size")}, {"at": F.col("rep_at"), "size": F.col("rep_size")}
    spokes = stars.where((F.col("node") != F.col("rep")) & _fit(p, q, similarity)).select(F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b")).distinct()
    links = near.unionByName(materialize(_similar(spokes, texts, shingle, similarity), "star-links"))
    crossing = _crossing(stars.select("token", "node", "at", "size"), links)
    # Then, of what is still apart, the text that has the shingle at its earliest place: copies with changes of their
    # own are often similar to the common original alone, which has no rarer shingles.
    hub = crossing.groupBy("token").agg(F.min(F.struct("at", "size", "node", "root")).alias("hub"))
    apart = crossing.join(hub, "token").where((F.col("root") != F.col("hub.root")) & _fit(p, {c: F.col(f"hub.{c}") for c in p}, similarity))
    spokes = apart.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
    links = links.unionByName(materialize(_similar(spokes, texts, shingle, similarity), "hub-links"))
    # Then all that share a shingle and are in different components.
    rest = _crossing(crossing.drop("root"), links)
    pairs = candidate_pairs(rest, similarity)
    roots = connected_components(links.unionByName(materialize(_similar(pairs, texts, shingle, similarity), "other-links")))
    discard(texts, stars, crossing)
    placed = nodes.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    return rows.join(placed, "digest").select("doc_id", "mark", "root")


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) by exact Jaccard similarity of shingle sets.

    Similar sets share a shingle among their first ones in any fixed order
    (prefix filtering), so every similar pair is a candidate, and every link is
    checked by shingle sets. Null and empty texts are copies of each other.
    Rows that share a doc_id are separate texts. component_id is the smallest
    doc_id that links reach.
    """
    placed = materialize(_placed(docs, shingle, similarity), "near-copies")
    names = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(names, "root").select("doc_id", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays, all columns as they were.

    Copies are texts whose SimHash fingerprints link within `radius`, as `groups`
    finds them, and, by the exact join of `near_copies` that follows, those whose
    shingle sets are similar though their fingerprints lie further apart.
    Of rows that repeat that doc_id and text one stays; a row with the doc_id of
    another but a text of its own is a document of its own. Rows without doc_id
    are kept: nothing names them.
    """
    first = _placed(docs, shingle, similarity, radius).groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    stays = first.select(F.col("first.doc_id").alias("__kept"), F.col("first.mark").alias("__text"))
    named = docs.where(F.col("doc_id").isNotNull())
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    same = (F.col("doc_id").cast("long") == F.col("__kept")) & (mark == F.col("__text"))
    once = named.join(stays, same, "left_semi").withColumn("__text", mark).dropDuplicates(["doc_id", "__text"]).drop("__text")
    return once.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)
