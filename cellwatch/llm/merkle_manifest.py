"""Operator 13: a Merkle manifest of a dataset with a witness for every row.

Rows are leaves of one tree per source, and the roots of the sources are leaves
of one tree above. A task appends the leaves of one aligned block in order. A
node that waits for siblings is an open subtree that holds the partial
witnesses of its leaves; when the sibling run is complete, each of its leaves'
witnesses grows by the other nodes of the run. The roots of blocks are appended
in the same way, in blocks again, until one node of a tree is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwatch.llm import common
from cellwatch.runtime import materialize

ARITY = 3
# Levels that one task closes: a block holds ARITY ** LEVELS leaves.
LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Digest of the values, each with its length in bytes before it, null as a dash."""
    return F.unhex(F.sha2(F.concat(*map(_field, values)).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, digest, tampered): `tampered` is null where tampering leaves the row as it is.

    Tampering takes the line ends out of the text where 2 divides the CRC of the doc_id.
    """
    values = {name: F.col(name) for name in FIELDS}
    cut = values | {"text": F.translate("text", "\n", "")}
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    return docs.select(
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        leaf_digest(*values.values()).alias("digest"),
        F.when(hit, leaf_digest(*cut.values())).alias("tampered"),
    )


def _ranked(nodes: DataFrame, tree: list[str], order: list[str]) -> DataFrame:
    """`nodes` with rank and n: place in, and size of, the tree that the columns of `tree` name.

    Ranges of the order are numbered apart and then shifted by what lies
    before them, so that a tree of any size is spread over many tasks.
    """
    ordered = nodes.repartitionByRange(*tree, *order).sortWithinPartitions(*tree, *order)
    placed = materialize(ordered.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33)), "places")
    stretches = placed.groupBy("part", *tree).agg(F.min("place").alias("first"), F.count("*").alias("held"))
    before = Window.partitionBy(*tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*tree)
    starts = stretches.select(
        F.col("part").alias("in_part"),
        *(F.col(c).alias(f"in_{c}") for c in tree),
        (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("held").over(whole).alias("n"),
    )
    same = F.col("part") == F.col("in_part")
    for c in tree:
        same &= F.col(c).eqNullSafe(F.col(f"in_{c}"))
    return placed.join(starts, same).select(*nodes.columns, (F.col("place") + F.col("shift")).alias("rank"), "n")


class _Block:
    """The open subtrees of one block; `witness` holds a path and siblings per leaf.

    A path has one byte per level, the place in its run times four plus the size of the run.
    """

    def __init__(self, arity: int):
        self.arity = arity
        self.open: list[list[tuple[bytes, range]]] = []
        self.witness: list[tuple[bytearray, bytearray]] = []

    def append(self, digest: bytes) -> None:
        number = len(self.witness)
        self.witness.append((bytearray(), bytearray()))
        self._add(0, digest, range(number, number + 1))

    def _add(self, level: int, digest: bytes, members: range) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((digest, members))
        if len(self.open[level]) == self.arity:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        for place, (_, members) in enumerate(run):
            others = b"".join(digest for other, (digest, _) in enumerate(run) if other != place)
            for m in members:
                path, siblings = self.witness[m]
                path.append(place * 4 + len(run))
                siblings += others
        self._add(level + 1, parent([digest for digest, _ in run]), range(run[0][1].start, run[-1][1].stop))

    def finish(self, levels: int | None) -> bytes:
        """The root at height `levels`, or where one node is left; short runs close as they are."""
        level = 0
        while True:
            above = any(self.open[level + 1 :])
            if level == levels or levels is None and not above and len(self.open[level]) == 1:
                return self.open[level][0][0]
            if self.open[level]:
                self._close(level)
            level += 1


def parent(digests: list[bytes]) -> bytes:
    """Digests are joined as hex text."""
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def fold(digest: bytes, path: bytes, siblings: bytes) -> bytes:
    """The root that a leaf and its witness give."""
    at = 0
    for step in path:
        place, others = step >> 2, (step & 3) - 1
        run = [siblings[at + 32 * i : at + 32 * (i + 1)] for i in range(others)]
        run.insert(place, digest)
        digest = parent(run)
        at += 32 * others
    return digest


def _append(nodes: DataFrame, levels: int) -> DataFrame:
    """`nodes` with block, path, siblings, and at the first row of a block its root."""
    span = ARITY**levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name, block, n = None, _Block(ARITY), 0
        for batch in batches:
            sources, ranks, sizes, digests = (batch.column(c).to_pylist() for c in ("source", "rank", "n", "digest"))
            first = 0
            for row, (source, rank) in enumerate(zip(sources, ranks)):
                if (source, rank // span) != name:
                    if row > first:
                        held.append(batch.slice(first, row - first))
                    if held:
                        yield closed(held, block, n)
                    held, first, block, name, n = [], row, _Block(ARITY), (source, rank // span), sizes[row]
                block.append(digests[row])
            if batch.num_rows > first:
                held.append(batch.slice(first))
        if held:
            yield closed(held, block, n)

    def closed(held: list[pa.RecordBatch], block: _Block, n: int) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        root = block.finish(None if n <= span else levels)
        extra = [
            pa.array([bytes(p) for p, _ in block.witness], pa.binary()),
            pa.array([bytes(s) for _, s in block.witness], pa.binary()),
            pa.array([root, *[None] * (rows.num_rows - 1)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in rows.columns), *extra], [*rows.column_names, "path", "siblings", "top"])

    dealt = nodes.withColumn("block", F.expr(f"rank div {span}")).repartition("source", "block").sortWithinPartitions("source", "block", "rank")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    return materialize(dealt.mapInArrow(run, f"{out}, path binary, siblings binary, top binary"), "witnesses")


def _grow(nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """Witnesses of `nodes` inside their blocks, and (source, block, path, siblings, root) above each block."""
    span = ARITY**levels
    base = _append(nodes, levels)
    stored, most = [base], base.agg(F.max("n")).first()[0] or 0
    while most > span:
        tops = stored[-1].where(F.col("top").isNotNull() & (F.col("n") > span))
        stored.append(_append(tops.select("source", F.col("block").alias("rank"), F.expr(f"(n + {span - 1}) div {span}").alias("n"), F.col("top").alias("digest")), levels))
        most = -(-most // span)
    tops = [s.where(F.col("top").isNotNull()) for s in stored]
    roots = tops[0].where(F.col("n") <= span).select(F.col("source").alias("of"), F.col("top").alias("root"))
    for top in tops[1:]:
        roots = roots.unionByName(top.where(F.col("n") <= span).select(F.col("source").alias("of"), F.col("top").alias("root")))
    # From the last round down, each block takes the witness of its root.
    above = None
    for level in reversed(stored[1:]):
        above = _under(level.select("source", "rank", "block", "path", "siblings"), above).select("source", "rank", "path", "siblings")
    blocks = _under(tops[0].select("source", "block", F.lit(b"").alias("path"), F.lit(b"").alias("siblings")), above)
    blocks = blocks.join(roots, F.col("source").eqNullSafe(F.col("of"))).select("source", "block", "path", "siblings", "root")
    return base, blocks


def _under(nodes: DataFrame, above: DataFrame | None) -> DataFrame:
    """`nodes` with path and siblings continued by those of their block's root."""
    if above is None:
        return nodes
    upper = above.select(F.col("source").alias("up_source"), F.col("rank").alias("up_rank"), F.col("path").alias("up_path"), F.col("siblings").alias("up_siblings"))
    joined = nodes.join(upper, F.col("source").eqNullSafe(F.col("up_source")) & (F.col("block") == F.col("up_rank")), "left")
    more = {c: F.concat(c, F.coalesce(f"up_{c}", F.lit(b""))).alias(c) for c in ("path", "siblings")}
    return joined.select(*(more.get(c, F.col(c)) for c in nodes.columns))


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Per row: doc_id, source, digest, tampered, subroot, root, path and siblings, all digests binary.

    `path` and `siblings` are the whole witness, from the leaf over the root of
    its source to the root; `fold` recomputes the root from them.

    A null source is a source, before all others; a null doc_id comes first in
    its source, and a null in any column has its own mark. Rows that share a
    doc_id are leaves in the order of their digests; equal rows are leaves
    each, empty texts too. Columns other than the five that a leaf is made of
    have no part. An empty table gives no rows.
    """
    common.ship(docs.sparkSession)
    made = materialize(leaves(docs), "leaves")
    base, blocks = _grow(_ranked(made, ["source"], ["doc_id", "digest", "tampered"]), levels)
    blocks = materialize(blocks, "blocks")
    # Every source has a first block.
    subroots = blocks.where("block = 0").select(F.lit(None).cast("string").alias("tree"), F.col("source").alias("name"), F.col("root").alias("digest"))
    tops = _ranked(subroots, ["tree"], ["name"]).withColumnRenamed("tree", "source")
    top_leaves, top_blocks = _grow(tops, levels)
    top_blocks = top_blocks.select(F.col("block").alias("in_block"), F.col("path").alias("up_path"), F.col("siblings").alias("up_siblings"), F.col("root").alias("top_root"))
    sources = top_leaves.join(top_blocks, F.col("block") == F.col("in_block")).select(
        "name", F.concat("path", "up_path").alias("end_path"), F.concat("siblings", "up_siblings").alias("end_siblings"), "top_root"
    )
    # Above each block: its tree, then the tree of sources. A block has bounded rows, so this join has no hot key.
    upper = blocks.join(sources, F.col("source").eqNullSafe(F.col("name"))).select(
        F.col("source").alias("of"),
        F.col("block").alias("of_block"),
        F.concat("path", "end_path").alias("more_path"),
        F.concat("siblings", "end_siblings").alias("more_siblings"),
        F.col("root").alias("subroot"),
        F.col("top_root").alias("root"),
    )
    joined = base.join(upper, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_block")))
    return joined.select(
        "doc_id", "source", "digest", "tampered", "subroot", "root", F.concat("path", "more_path").alias("path"), F.concat("siblings", "more_siblings").alias("siblings")
    )


def report(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified; see `manifest`.

    The root is folded from the tampered leaf where tampering changes the row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proofs, folded = [], []
            for digest, tampered, path, siblings in zip(*(batch.column(c).to_pylist() for c in ("digest", "tampered", "path", "siblings"))):
                proofs.append(sha256(siblings.hex().encode()).hexdigest())
                folded.append(fold(tampered or digest, path, siblings))
            root = batch.column("root").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array([d.hex() for d in batch.column(c).to_pylist()], pa.string()) for c in ("digest", "subroot", "root")),
                    pa.array(proofs, pa.string()),
                    pa.array([f.hex() for f in folded], pa.string()),
                    pa.array([f == r for f, r in zip(folded, root)], pa.bool_()),
                ],
                ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )

    return manifest(docs, levels).mapInArrow(
        run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )


def _sql_field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _sql_tree(name: str, nodes: str) -> str:
    """Nodes of all levels, and per node what stands left and right of it in its run."""
    return f"""
{name} AS (
  SELECT tree, pos, h, 0 AS lvl, n FROM {nodes}
  UNION ALL
  SELECT tree, pos // {ARITY}, sha256(string_agg(h, '' ORDER BY pos)), lvl + 1, (n + {ARITY - 1}) // {ARITY}
  FROM {name} WHERE n > 1 GROUP BY tree, pos // {ARITY}, lvl, n),
{name}_sib AS MATERIALIZED (
  SELECT a.tree, a.pos, a.lvl, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.lvl = b.lvl AND a.pos // {ARITY} = b.pos // {ARITY}
  WHERE a.n > 1 GROUP BY a.tree, a.pos, a.lvl)"""


_LEAF = " || ".join(map(_sql_field, FIELDS))
SQL = f"""
WITH RECURSIVE steps AS (
  SELECT i, i AS c, 0 AS k FROM (SELECT CAST(unnest(range(256)) AS UBIGINT) AS i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
d AS MATERIALIZED (
  SELECT *, sha256({_LEAF}) AS leaf,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS UBIGINT))),
      lambda c, b: xor(t[CAST(xor(c, b) % 256 AS INTEGER) + 1], c // 256)), 4294967295::UBIGINT) AS crc
  FROM documents, tab),
e AS MATERIALIZED (
  SELECT doc_id, leaf, coalesce(strlen(source) || ':' || source, '-') AS tree, source,
    CASE WHEN crc % 2 = 0 THEN sha256({_LEAF.replace("CAST(text AS VARCHAR)", "replace(CAST(text AS VARCHAR), chr(10), '')")}) ELSE leaf END AS bad,
    row_number() OVER (ORDER BY doc_id) AS id
  FROM d),
f AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, bad) - 1 AS pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM e),{_sql_tree("low", "f")},
s AS MATERIALIZED (
  SELECT '' AS tree, x.tree AS name, x.h, row_number() OVER (ORDER BY y.source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM low x JOIN (SELECT DISTINCT tree, source FROM f) y ON x.tree = y.tree WHERE x.n = 1),{_sql_tree("high", "s")},
walk AS (
  SELECT f.id, 0 AS part, f.tree, f.pos, 0 AS lvl, f.bad AS h, '' AS proof FROM f
  UNION ALL
  SELECT w.id, 0, w.tree, w.pos // {ARITY}, w.lvl + 1, sha256(x.l || w.h || x.r), w.proof || x.l || x.r
  FROM walk w JOIN low_sib x ON w.tree = x.tree AND w.lvl = x.lvl AND w.pos = x.pos),
crossed AS MATERIALIZED (
  SELECT m.id, s.pos, m.h, m.proof, s.h AS subroot FROM (SELECT id, tree, max_by(h, lvl) AS h, max_by(proof, lvl) AS proof FROM walk GROUP BY id, tree) m JOIN s ON m.tree = s.name),
climb AS (
  SELECT id, pos, 0 AS lvl, h, proof FROM crossed
  UNION ALL
  SELECT w.id, w.pos // {ARITY}, w.lvl + 1, sha256(x.l || w.h || x.r), w.proof || x.l || x.r FROM climb w JOIN high_sib x ON w.lvl = x.lvl AND w.pos = x.pos),
done AS (SELECT id, max_by(h, lvl) AS folded_root, max_by(proof, lvl) AS proof FROM climb GROUP BY id)
SELECT f.doc_id, f.leaf, c.subroot, (SELECT h FROM high WHERE n = 1) AS root, sha256(done.proof) AS proof_sha256, done.folded_root,
  done.folded_root = (SELECT h FROM high WHERE n = 1) AS verified
FROM f JOIN crossed c ON f.id = c.id JOIN done ON f.id = done.id
"""
