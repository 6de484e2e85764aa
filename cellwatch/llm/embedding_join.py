"""Operator 9: embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine of at least c lie within epsilon = sqrt(2 - 2c). They
are turned to their principal axes and sorted by grid cells of width epsilon on
the leading axes. The sorted sequence is cut into intervals; each pair of
intervals is joined recursively by halves, and a pair of halves whose boxes are
further apart than epsilon is skipped. Survivors are compared in double
precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwatch.llm import common
from cellwatch.llm.components import connected_components
from cellwatch.runtime import materialize

COSINE = 0.9
AXES = 6
# Vectors of one interval; a task holds two.
INTERVAL = 8192
_LEAF = 256
# Margin of the boxes and of the first comparison, far above rounding and far below any distance that matters.
_SLACK = 1e-7


def _vectors(cells: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, all of one length."""
    flat = cells.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(cells), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit length; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct vectors that can link: (node, embedding, copies), the node being the smallest vec_id."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return (
        vectors.where(F.col("vec_id").isNotNull() & (F.size(x) > 0) & fine)
        .select("vec_id", F.transform(x, lambda v: v + 0.0).alias("embedding"))
        .groupBy("embedding")
        .agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    )


def principal_axes(distinct: DataFrame, dimension: int, axes: int) -> np.ndarray:
    """Leading eigenvectors of the second moments of all vectors, summed per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimension, dimension))
        for batch in batches:
            rows = batch.column(0).filter(pa.compute.equal(pa.compute.list_value_length(batch.column(0)), dimension))
            if len(rows):
                unit = _unit(_vectors(rows))
                total += unit.T @ unit
        cells = np.arange(dimension * dimension)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel())], ["cell", "value"])

    summed = distinct.select("embedding").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    moments = np.zeros(dimension * dimension)
    for row in summed.collect():  # dimension squared numbers
        moments[row["cell"]] = row["value"]
    _, vectors = np.linalg.eigh(moments.reshape(dimension, dimension))
    return vectors[:, ::-1][:, :axes].copy()


def _intervals(distinct: DataFrame, axes: np.ndarray, epsilon: float, interval: int) -> DataFrame:
    """(interval, rows): vectors in grid order, packed; each row of the result is one interval."""
    dimension = axes.shape[0]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                grid = np.floor(_unit(_vectors(batch.column(0))) @ axes / epsilon).astype(np.int32)
                names = [f"c{i}" for i in range(axes.shape[1])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in grid.T)], [*batch.schema.names, *names])

    names = [f"c{i}" for i in range(axes.shape[1])]
    placed = distinct.where(F.size("embedding") == dimension).mapInArrow(
        cells, "embedding array<double>, node long, copies long, " + ", ".join(f"{n} int" for n in names)
    )
    ordered = placed.repartitionByRange(*names, "node").sortWithinPartitions(*names, "node")
    numbered = materialize(ordered.withColumn("place", F.monotonically_increasing_id()), "grid-order")
    # Places are numbered by partition; one count per partition makes them ranks.
    part = F.shiftright("place", 33)
    counts = sorted((r["part"], r["n"]) for r in numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for number, n in counts:
        starts.append((number, total - (number << 33)))
        total += n
    starts = distinct.sparkSession.createDataFrame(starts, "part long, shift long")
    ranked = numbered.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.col("place") + F.col("shift"))
    cut = ranked.withColumn("id", F.floor(F.col("rank") / interval).cast("long")).select("id", "rank", "embedding", "node", "copies", *names)
    sequence = cut.repartition("id").sortWithinPartitions("id", "rank")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            ids = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if held and b > a and held[0].column(0)[0].as_py() != ids[a]:
                    yield packed(held)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield packed(held)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        x = _vectors(rows.column("embedding").combine_chunks())
        flat = _unit(x) @ axes
        first = rows.column("c0").to_numpy()
        packs = [x.tobytes(), *(rows.column(c).to_numpy().astype(np.int64).tobytes() for c in ("node", "copies"))]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows.column("id")[0].as_py()], pa.int64()),
                pa.array([int(first.min())], pa.int32()),
                pa.array([int(first.max())], pa.int32()),
                pa.array([flat.min(axis=0).tolist()], pa.list_(pa.float64())),
                pa.array([flat.max(axis=0).tolist()], pa.list_(pa.float64())),
                *(pa.array([p], pa.binary()) for p in packs),
            ],
            ["id", "first", "last", "low", "high", "x", "nodes", "copies"],
        )

    schema = "id long, first int, last int, low array<double>, high array<double>, x binary, nodes binary, copies binary"
    return materialize(sequence.mapInArrow(pack, schema), "intervals")


class _Join:
    """Joins two sequences recursively; keeps link counts and connected labels."""

    def __init__(self, left, right, axes: np.ndarray, cosine: float):
        self.same = right is None
        self.x = left[0] if self.same else np.concatenate((left[0], right[0]))
        self.nodes = left[1] if self.same else np.concatenate((left[1], right[1]))
        self.copies = left[2] if self.same else np.concatenate((left[2], right[2]))
        self.unit = _unit(self.x)
        self.flat = self.unit @ axes
        self.cosine = cosine
        self.epsilon = np.sqrt(max(0.0, 2 - 2 * cosine)) + _SLACK
        self.links = np.zeros(len(self.x), dtype=np.int64)
        self.label = np.arange(len(self.x))
        self.boxes: dict = {}
        n, m = len(left[0]), len(self.x)
        if self.same:
            self._self_join(0, n)
        else:
            self._join((0, n), (n, m))

    def _box(self, span):
        if span not in self.boxes:
            part = self.flat[span[0] : span[1]]
            self.boxes[span] = (part.min(axis=0), part.max(axis=0))
        return self.boxes[span]

    def _self_join(self, a: int, b: int) -> None:
        if b - a <= _LEAF:
            return self._leaf((a, b), (a, b))
        mid = (a + b) // 2
        self._self_join(a, mid)
        self._self_join(mid, b)
        self._join((a, mid), (mid, b))

    def _join(self, p, q) -> None:
        (low, high), (other_low, other_high) = self._box(p), self._box(q)
        gap = np.maximum(0, np.maximum(low - other_high, other_low - high))
        if gap @ gap > self.epsilon**2:
            return
        if p[1] - p[0] <= _LEAF and q[1] - q[0] <= _LEAF:
            return self._leaf(p, q)
        for a in self._halves(p):
            for b in self._halves(q):
                self._join(a, b)

    @staticmethod
    def _halves(span):
        a, b = span
        return [span] if b - a <= _LEAF else [(a, (a + b) // 2), ((a + b) // 2, b)]

    def _leaf(self, p, q) -> None:
        near = self.unit[p[0] : p[1]] @ self.unit[q[0] : q[1]].T >= self.cosine - _SLACK
        if p == q:
            near &= ~np.eye(len(near), dtype=bool)
        i, j = np.nonzero(near)
        if not len(i):
            return
        # The given vectors decide, not their rounded unit forms.
        a, b = self.x[p[0] + i], self.x[q[0] + j]
        fit = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b)) >= self.cosine
        i, j = i[fit] + p[0], j[fit] + q[0]
        np.add.at(self.links, i, self.copies[j])
        if p != q:
            np.add.at(self.links, j, self.copies[i])
        self._connect(i, j)

    def _connect(self, i: np.ndarray, j: np.ndarray) -> None:
        """Least label over links until nothing changes; labels always name the root of a tree."""
        while True:
            a, b = self.label[i], self.label[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            open_ = low < high
            if not open_.any():
                return
            np.minimum.at(self.label, high[open_], low[open_])
            while (hop := self.label[self.label]).tolist() != self.label.tolist():
                self.label = hop

    def result(self) -> pa.RecordBatch:
        told = np.flatnonzero((self.links > 0) | (self.label != np.arange(len(self.label))))
        # The least node of each component stands for it.
        least = np.full(len(self.x), np.iinfo(np.int64).max)
        np.minimum.at(least, self.label, self.nodes)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.nodes[told]), pa.array(self.links[told]), pa.array(least[self.label[told]])], ["node", "links", "root"]
        )


def link_counts(distinct: DataFrame, dimension: int, cosine: float = COSINE, interval: int = INTERVAL) -> DataFrame:
    """(node, links, root) per interval pair: links found there, and a smaller node connected by them."""
    axes = principal_axes(distinct, dimension, min(AXES, dimension))
    epsilon = float(np.sqrt(max(1e-12, 2 - 2 * cosine)))
    blocks = _intervals(distinct, axes, epsilon, interval)
    # Only intervals in equal or neighbouring cells of the first axis meet, and only if their boxes are near.
    boxes = blocks.select("id", "low", "high", F.explode(F.sequence("first", "last")).alias("cell"))
    others = blocks.select(
        F.col("id").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.explode(F.sequence(F.col("first") - 1, F.col("last") + 1)).alias("cell")
    )
    gaps = F.transform(
        F.arrays_zip("low", "high", "low2", "high2"), lambda b: F.greatest(F.lit(0.0), b["low"] - b["high2"], b["low2"] - b["high"])
    )
    apart = F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g)
    pairs = boxes.join(others, "cell").where("id <= other").where(apart <= (epsilon + _SLACK) ** 2).select("id", "other").distinct()
    left = pairs.join(blocks.select("id", "x", "nodes", "copies"), "id")
    right = blocks.select(F.col("id").alias("other"), F.col("x").alias("y"), F.col("nodes").alias("y_nodes"), F.col("copies").alias("y_copies"))
    both = left.join(right, "other").repartition("id", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = {n: batch.column(i)[row].as_py() for i, n in enumerate(batch.schema.names)}
                sides = [
                    (
                        np.frombuffer(get[x], dtype=np.float64).reshape(-1, dimension),
                        np.frombuffer(get[nodes], dtype=np.int64),
                        np.frombuffer(get[copies], dtype=np.int64),
                    )
                    for x, nodes, copies in (("x", "nodes", "copies"), ("y", "y_nodes", "y_copies"))
                ]
                yield _Join(sides[0], None if get["id"] == get["other"] else sides[1], axes, cosine).result()

    return both.mapInArrow(run, "node long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, interval: int = INTERVAL) -> DataFrame:
    """Per vector: vec_id, n_links, component_id and kept.

    Vectors link at a cosine of at least `cosine`, which must be positive, and
    only with vectors of the same length. Null, empty and zero vectors and
    those with null or non-finite components link with nothing. Equal vectors
    are one node with a number of copies. Repeated rows are separate vectors;
    rows that share a vec_id but not the vector share a component. A null
    vec_id links with nothing, has a null component and is not kept. Other
    columns, labels too, have no part.
    """
    if cosine <= 0:
        raise ValueError("cosine must be positive")
    common.ship(vectors.sparkSession)
    distinct = materialize(usable(vectors), "vectors")
    found = None
    for row in distinct.select(F.size("embedding").alias("dimension")).distinct().collect():  # one row per vector length
        part = link_counts(distinct.where(F.size("embedding") == row["dimension"]), row["dimension"], cosine, interval)
        found = part if found is None else found.unionByName(part)
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: v + 0.0)
    if found is None:
        return vectors.select(
            F.col("vec_id").cast("long"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")
        )
    found = materialize(found, "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select("node", "root"))
    nodes = (
        distinct.join(counts, "node", "left")
        .join(roots, "node", "left")
        .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "node").alias("root"))
    )
    rows = vectors.select(F.col("vec_id").cast("long"), F.when(F.col("vec_id").isNotNull(), x).alias("embedding"))
    component = F.coalesce("root", "vec_id")
    return rows.join(nodes, "embedding", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )


SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e))) AND list_bool_or(list_transform(embedding, lambda e: e <> 0))),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= {COSINE}),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON e.vec_id = c.a LEFT JOIN n ON e.vec_id = n.a
"""
