"""Operator 11: approximate nearest neighbours by learned partitions.

The neighbour graph of a bounded sample is cut into balanced parts, and a small
classifier learns which part a vector's neighbours are in. Every vector is
stored in its likeliest part; a query goes to as many of its likeliest parts as
the wanted recall takes, and the vectors there are ranked by their exact inner
product. How many that are is measured: the nearest of some held-out vectors
among all vectors are found by brute force, in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwatch.llm import common
from cellwatch.llm.graph_partition import Router, balanced_parts, nearest_rows
from cellwatch.runtime import materialize

NEAREST = 20
QUERY_EVERY = 20
RECALL = 0.95
# Bounds of what the driver holds: the sample that partitions and classifier are fitted on, and the held-out vectors.
SAMPLE = 8192
HELD_OUT = 256
GRAPH_NEIGHBOURS = 10
# Vectors a part is meant to hold, and the bounds of the number of parts.
PART_ROWS = 2048
LEAST_PARTS, MOST_PARTS = 8, 256
# Vectors and queries that meet in one task; larger parts are dealt to several blocks and tiles.
BLOCK_ROWS = 32768
TILE_QUERIES = 32768
# One in so many of the probed parts is searched first.
FIRST_SHARE = 8
_CELLS = 1 << 21


def _matrix(cells: pa.Array) -> np.ndarray:
    return cells.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(cells), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of vectors that take part, as doubles without negative zeros."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.where(F.col("vec_id").isNotNull() & (F.size(x) > 0) & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: v + 0.0).alias("embedding")
    )


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """(node, embedding, ids): each vector once, with its smallest vec_ids, `ids` of them at most.

    No more copies of one vector can be among the nearest `ids - 1` of any row.
    Tasks cut their copies before the shuffle.
    """
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = rows.withColumn("place", place).where(F.col("place") <= ids)
    return few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("node", F.monotonically_increasing_id())


class PartModel:
    """A router with the scale of its input and the number of parts to probe."""

    def __init__(self, router: Router, scale: float, parts: int, probes: int):
        self.router, self.scale, self.parts, self.probes = router, scale, parts, probes

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts by falling probability, per row."""
        return np.argsort(-self.router.scores(x * self.scale), axis=1, kind="stable")


def _sample(distinct: DataFrame, n: int, most: int) -> DataFrame:
    """`most` vectors that a hash of the vector picks; few more reach the sort."""
    share = min(1.0, 2 * most / max(1, n))
    key = F.xxhash64("embedding")
    picked = distinct if share == 1.0 else distinct.where(key < int(-(2**63) + share * 2**64))
    return picked.orderBy(key, "node").limit(most)


def fit(distinct: DataFrame, n: int, sample: int = SAMPLE, held_out: int = HELD_OUT) -> tuple[PartModel, np.ndarray, np.ndarray]:
    """A model fitted on the sample, which probes all parts, and the held-out vectors with their nodes."""
    picked = _sample(distinct, n, sample + held_out).select("embedding", "node").toArrow().combine_chunks()
    x = _matrix(picked.column("embedding").combine_chunks())
    nodes = picked.column("node").to_numpy()
    # A fifth is held out where the whole table is less than the sample.
    cut = len(x) - min(held_out, len(x) // 5)
    held, held_nodes, x = x[cut:], nodes[cut:], x[:cut]
    parts = min(MOST_PARTS, max(LEAST_PARTS, n // PART_ROWS), max(1, len(x) // 4))
    neighbours = nearest_rows(x, GRAPH_NEIGHBOURS)
    label = balanced_parts(neighbours, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), neighbours.shape[1]), label[neighbours].ravel()), 1)
    target[np.arange(len(x)), label] += 1
    target /= target.sum(axis=1, keepdims=True)
    scale = 1 / np.sqrt(np.mean((x / np.abs(x).max()) ** 2) * x.shape[1]) / np.abs(x).max()
    router = Router(x.shape[1], parts).fit(x * scale, target)
    return PartModel(router, scale, parts, parts), held, held_nodes


def build_index(distinct: DataFrame, model: PartModel) -> DataFrame:
    """`distinct` with each vector's likeliest part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = model.ranked(_matrix(batch.column(1)))[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], ["node", "embedding", "ids", "part"])

    made = distinct.select("node", "embedding", "ids").mapInArrow(run, "node long, embedding array<double>, ids array<long>, part int")
    return materialize(made, "parts")


def _best(scores: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k greatest scores that reach its floor, and of those that rounding may put among them."""
    slack = 1e-12 * np.abs(scores).max(axis=1, keepdims=True)
    chosen = scores >= (floor[:, None] - slack)
    many = np.flatnonzero(np.count_nonzero(chosen, axis=1) > k)
    if len(many):
        kth = -np.partition(-scores[many], k - 1, axis=1)[:, k - 1 : k]
        chosen[many] &= scores[many] >= kth - slack[many]
    return np.nonzero(chosen)


def probes_for(index: DataFrame, model: PartModel, held: np.ndarray, nodes: np.ndarray, k: int, recall: float) -> int:
    """The least number of parts that hold `recall` of the true k nearest of the held-out vectors."""
    if not len(held):
        return model.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, part = np.full((len(held), 0), -np.inf), np.zeros((len(held), 0), dtype=np.int32)
        for batch in batches:
            step = max(1, _CELLS // len(held))
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                near = held @ _matrix(piece.column(1)).T
                near[nodes[:, None] == piece.column(0).to_numpy()[None]] = -np.inf
                score = np.concatenate((score, near), axis=1)
                part = np.concatenate((part, np.broadcast_to(piece.column(2).to_numpy()[None], near.shape)), axis=1)
                if score.shape[1] > k:
                    keep = np.argpartition(-score, k - 1, axis=1)[:, :k]
                    score, part = np.take_along_axis(score, keep, 1), np.take_along_axis(part, keep, 1)
        row, column = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(score[row, column]), pa.array(part[row, column])], ["held", "score", "part"])

    found = index.select("node", "embedding", "part").mapInArrow(run, "held long, score double, part int")
    place = F.row_number().over(Window.partitionBy("held").orderBy(F.desc("score"), "part"))
    nearest = found.withColumn("place", place).where(F.col("place") <= k).select("held", "part").collect()  # k rows per held-out vector
    ranked = model.ranked(held)
    rank = np.empty_like(ranked)
    np.put_along_axis(rank, ranked, np.broadcast_to(np.arange(model.parts), ranked.shape), 1)
    needed = np.array([rank[r["held"], r["part"]] for r in nearest])
    shares = [np.mean(needed <= p) if len(needed) else 1.0 for p in range(model.parts)]
    return 1 + next(p for p, share in enumerate(shares) if share >= recall or p == model.parts - 1)


def _blocks(counts: dict[int, int], parts: int, rows: int) -> list[int]:
    return [max(1, -(-counts.get(p, 0) // rows)) for p in range(parts)]


def _of_part(numbers: list[int]) -> Column:
    return F.element_at(F.array(*map(F.lit, numbers)), F.col("part") + 1)


def search(index: DataFrame, queries: DataFrame, model: PartModel, k: int, n: int) -> DataFrame:
    """(query, node, score, ids) of the k + 1 nodes nearest to each of `queries` (node, embedding), as far as the probed parts hold them."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = model.ranked(_matrix(batch.column(1)))[:, : model.probes]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts.tolist(), pa.list_(pa.int32()))], ["node", "embedding", "parts"])

    routed = materialize(queries.select("node", "embedding").mapInArrow(route, "node long, embedding array<double>, parts array<int>"), "routes")
    held = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}  # one row per part
    # A part of more than twice the mean is parted even if a task could hold it.
    blocks = _blocks(held, model.parts, min(BLOCK_ROWS, max(1024, 2 * n // model.parts)))
    first = max(1, model.probes // FIRST_SHARE)
    start = routed.select("node", "embedding", F.slice("parts", 1, first).alias("parts"), F.lit(float("-inf")).alias("floor"))
    found = materialize(_nearest_nodes(_meet(index, start, blocks, model.parts, k + 1), k + 1), "near")
    if first == model.probes:
        return found
    # What comes later counts only if it is no worse than the last of those found, if they are enough.
    floors = found.groupBy("query").agg(F.when(F.count("*") > k, F.min("score")).otherwise(float("-inf")).alias("floor"))
    rest = routed.join(floors, F.col("node") == F.col("query"), "left").select(
        "node", "embedding", F.slice("parts", first + 1, model.probes).alias("parts"), F.coalesce("floor", F.lit(float("-inf"))).alias("floor")
    )
    return _nearest_nodes(found.unionByName(_meet(index, rest, blocks, model.parts, k + 1)), k + 1)


def _nearest_nodes(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0]))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")


def _meet(index: DataFrame, asking: DataFrame, blocks: list[int], parts: int, k: int) -> DataFrame:
    """(query, node, score, ids): per block of their parts the k nearest that reach the floor of each of `asking` (node, embedding, parts, floor).

    Vectors and queries of a part meet by (block, tile); a task holds the
    vectors of one block, and queries stream by.
    """
    asked = {r["part"]: r["count"] for r in asking.select(F.explode("parts").alias("part")).groupBy("part").count().collect()}  # one row per part
    tiles = _blocks(asked, parts, TILE_QUERIES)
    deal, none = F.xxhash64("node"), F.lit(None).cast("array<long>")
    ours = index.where(F.col("part").isin(sorted(asked))).select(
        "part", F.pmod(deal, _of_part(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), _of_part(tiles) - 1)).alias("tile"), F.lit(0).alias("kind"), "node", "embedding", "ids", F.lit(0.0).alias("floor")
    )
    theirs = asking.select("node", "embedding", "floor", F.explode("parts").alias("part")).select(
        "part", F.explode(F.sequence(F.lit(0), _of_part(blocks) - 1).cast("array<long>")).alias("block"), F.pmod(deal, _of_part(tiles)).cast("int").alias("tile"), F.lit(1).alias("kind"), "node", "embedding", none.alias("ids"), "floor"
    )
    met = ours.unionByName(theirs).repartition("part", "block", "tile").sortWithinPartitions("part", "block", "tile", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, block = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if b == a:
                    continue
                if tuple(keys[a, :3]) != name:
                    name, held, block = tuple(keys[a, :3]), [], None
                rows = batch.slice(a, b - a)
                if keys[a, 3] == 0:
                    held.append(rows)
                elif held:
                    block = block or _Block(pa.Table.from_batches(held).combine_chunks())
                    yield from block.nearest(rows, k)

    return met.mapInArrow(run, "query long, node long, score double, ids array<long>")


class _Block:
    """The vectors of one block."""

    def __init__(self, rows: pa.Table):
        self.x = _matrix(rows.column("embedding").combine_chunks())
        self.ids = rows.column("ids").combine_chunks()
        self.node = rows.column("node").combine_chunks()
        self.least = np.array([i[0] for i in self.ids.to_pylist()])

    def nearest(self, queries: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
        q, names, floor = _matrix(queries.column(5)), queries.column(4).to_numpy(), queries.column(7).to_numpy()
        step = max(1, _CELLS // len(self.x))
        for at in range(0, len(q), step):
            some = q[at : at + step]
            row, column = _best(some @ self.x.T, k, floor[at : at + step])
            if not len(row):
                continue
            # Products of rows alone don't depend on what else is in the block.
            score = (some[row] * self.x[column]).sum(axis=1) + 0.0
            order = np.lexsort((self.least[column], -score, row))
            row, column, score = row[order], column[order], score[order]
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            place = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
            keep = (place < k) & (score >= floor[at + row])
            taken = pa.array(column[keep])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[at + row[keep]]), self.node.take(taken), pa.array(score[keep]), self.ids.take(taken)], ["query", "node", "score", "ids"]
            )


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = NEAREST, recall: float = RECALL, sample: int = SAMPLE, held_out: int = HELD_OUT) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each row that `is_query` picks by its vec_id.

    Nearness is the inner product in double precision; all other rows of the
    vector's length are candidates, copies and rows of the same vec_id too, and
    ties go to the smaller vec_id. With fewer candidates all are returned as
    far as they are found. Null, empty and zero vectors, vectors with null or
    non-finite components and rows without vec_id take no part. Repeated query
    rows have their results each. Other columns have no part. An empty table
    gives no rows.
    """
    if not 0 < recall <= 1 or k < 1:
        raise ValueError("recall lies in (0, 1] and k is positive")
    common.ship(vectors.sparkSession)
    rows = usable(vectors)
    every = materialize(distinct_vectors(rows, k + 1), "distinct")
    sizes = every.groupBy(F.size("embedding").alias("length")).count().orderBy("length").collect()  # one row per vector length
    asking = rows.where(is_query)
    found = None
    for r in sizes:
        n, own = r["count"], every.where(F.size("embedding") == r["length"])
        model, held, nodes = fit(own, n, sample, held_out)
        index = build_index(own, model)
        model.probes = probes_for(index, model, held, nodes, k, recall)
        mine = asking.where(F.size("embedding") == r["length"]).join(index.select("node", "embedding"), "embedding")
        mine = materialize(mine.select("vec_id", "node", "embedding"), "queries")
        best = search(index, mine.dropDuplicates(["node"]), model, k, n)
        lists = best.groupBy("query").agg(F.collect_list(F.struct("node", "score", "ids")).alias("near"))
        part = mine.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")).join(lists, "query")
        found = part if found is None else found.unionByName(part)
    schema = "query_id long, rank int, vec_id long, score double"
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    # Among its own vector's ids a row leaves out itself, once.
    others = F.expr(
        """transform(near, c -> transform(
          if(c.node = query AND array_contains(c.ids, query_id),
            concat(slice(c.ids, 1, int(array_position(c.ids, query_id)) - 1), slice(c.ids, int(array_position(c.ids, query_id)) + 1, size(c.ids))),
            c.ids),
          i -> struct(-c.score AS low, i AS vec_id, c.score AS score)))"""
    )
    ranked = found.select("query_id", F.posexplode(F.slice(F.sort_array(F.flatten(others)), 1, k)).alias("place", "hit"))
    return ranked.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def report(vectors: DataFrame) -> DataFrame:
    """The nearest of each row whose vec_id is divisible by QUERY_EVERY."""
    return nearest_neighbours(vectors, F.col("vec_id") % QUERY_EVERY == 0)
