"""Operator 12: vectors compressed to codes of parts, with memoised grid cells.

Components become integers; each part of a vector is coded by the nearest entry
of its codebook, which rounds of assignment and averaging fit on all rows. The
assignment of a part goes by the coarse grid cell it lies in: the cell is hashed
and looked up in a memo of the entries that can be nearest anywhere in the cell,
those whose least distance to the cell's box isn't beyond another's greatest.
Only these are evaluated exactly. A memo lasts for one codebook.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwatch.llm import common
from cellwatch.runtime import materialize

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
# Cells are 2 ** CELL_BITS wide; a memo holds so many cells of a part before it starts anew.
CELL_BITS = 7
MEMO_CELLS = 1 << 16
# Components below this go by 64-bit integers (squares of differences of a part must fit), larger ones by Python's.
_SMALL = 1 << 26
_VALUES = 1 << 19
_MULTIPLIERS = np.random.default_rng(12).integers(1, 1 << 62, 4096, dtype=np.int64) | 1


def _integers(cells: pa.Array) -> np.ndarray:
    """floor(SCALE * x) of vectors of one length, which is padded with zeros to a multiple of PARTS.

    Beyond 64 bits components stay at the least or greatest integer.
    """
    flat = cells.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * SCALE).reshape(len(cells), -1)
    out = np.where(scaled >= 2.0**63, np.iinfo(np.int64).max, np.where(scaled < -(2.0**63), np.iinfo(np.int64).min, 0))
    inside = (scaled < 2.0**63) & (scaled >= -(2.0**63))
    out[inside] = scaled[inside].astype(np.int64)
    short = -out.shape[1] % PARTS
    return np.pad(out, ((0, 0), (0, short)))


class CellMemo:
    """Nearest entries of one part's codebook by memoised cells; ties go to the lower index."""

    def __init__(self, codebook: np.ndarray, cell_bits: int = CELL_BITS, most: int = MEMO_CELLS):
        self.codebook, self.bits, self.most = codebook, cell_bits, most
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.cells = np.empty((0, self.codebook.shape[1]), dtype=np.int64)
        self.near = np.empty((0, len(self.codebook)), dtype=bool)

    def _candidates(self, cells: np.ndarray) -> np.ndarray:
        low = (cells << self.bits)[:, None, :]
        high = low + ((1 << self.bits) - 1)
        below, above = low - self.codebook, self.codebook - high
        least = np.maximum(np.maximum(below, above), 0)
        most = np.maximum(np.abs(below), np.abs(above))
        least, most = (least * least).sum(axis=2), (most * most).sum(axis=2)
        return least <= most.min(axis=1, keepdims=True)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and squared distance, per row."""
        cells = x >> self.bits
        keys = (cells * _MULTIPLIERS[np.arange(x.shape[1]) % len(_MULTIPLIERS)]).sum(axis=1)
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        found = [self.slots.get(key) for key in unique.tolist()]
        missing = [i for i, slot in enumerate(found) if slot is None]
        if missing:
            if len(self.slots) + len(missing) > self.most:
                self._clear()
                missing = list(range(len(unique)))
            new = cells[first[missing]]
            start = len(self.cells)
            self.cells = np.concatenate((self.cells, new))
            self.near = np.concatenate((self.near, self._candidates(new)))
            self.slots.update(zip(unique[missing].tolist(), range(start, start + len(missing))))
            found = [self.slots[key] for key in unique.tolist()]
        slot = np.array(found, dtype=np.int64)[inverse]
        near = self.near[slot]
        # Cells whose hashes clash are not taken for each other.
        near[(self.cells[slot] != cells).any(axis=1)] = True
        row, entry = np.nonzero(near)
        apart = x[row] - self.codebook[entry]
        far = (apart * apart).sum(axis=1)
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(far, starts)
        hit = np.flatnonzero(far == least[row])
        return entry[hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]], least


def _exact(codebook: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As `CellMemo.assign`, for integers of any size."""
    apart = x.astype(object)[:, None, :] - codebook.astype(object)[None]
    far = (apart * apart).sum(axis=2)
    index = far.argmin(axis=1)
    return index, far[np.arange(len(x)), index]


class _Coder:
    """Assigns the parts of vectors by the codebooks, an array (part, entry, position)."""

    def __init__(self, codebooks: np.ndarray, cell_bits: int):
        self.codebooks = codebooks
        self.memos = [CellMemo(c, cell_bits) for c in codebooks]
        width = max(1, codebooks.shape[2])
        self.small = min(_SMALL, int((2**61 / width) ** 0.5) >> 1)
        self.fits = codebooks.size == 0 or max(-int(codebooks.min()), int(codebooks.max())) < self.small

    def assign(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per part: the rows of the part, indexes and distances."""
        width = self.codebooks.shape[2]
        fits = self.fits and (x.size == 0 or max(-int(x.min()), int(x.max())) < self.small)
        for part, memo in enumerate(self.memos):
            rows = x[:, part * width : (part + 1) * width]
            if not width:
                yield rows, np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
            elif fits:
                yield rows, *memo.assign(rows)
            else:
                yield rows, *_exact(self.codebooks[part], rows)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        column = batch.schema.get_field_index("embedding")
        length = len(batch.column(column)[0]) if batch.num_rows else 0
        step = max(1, _VALUES // max(1, length))
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            yield piece, _integers(piece.column(column))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of rows whose vector is not null and has neither null nor non-finite components."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & fine).select("vec_id", "label", "embedding")


def _first_codebooks(rows: DataFrame, entries: int) -> np.ndarray:
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    x = _integers(pa.array([r["embedding"] for r in first], pa.list_(pa.float64())))
    return x.reshape(len(first), PARTS, -1).transpose(1, 0, 2).copy()


def fit(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, cell_bits: int = CELL_BITS) -> np.ndarray:
    """Codebooks (part, entry, position) fitted on all `rows`, whose vectors have one length."""
    codebooks = _first_codebooks(rows, entries)
    width = codebooks.shape[2]
    for _ in range(rounds if width else 0):
        now = codebooks

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder, counts, sums = _Coder(now, cell_bits), np.zeros(now.shape[:2], dtype=np.int64), np.zeros(now.shape, dtype=object)
            for _, x in _pieces(batches):
                wide = np.abs(x.astype(np.float64)).max(initial=0) > 2.0**40
                for part, (own, index, _) in enumerate(coder.assign(x)):
                    total = np.zeros(now.shape[1:], dtype=object if wide else np.int64)
                    np.add.at(total, index, own.astype(object) if wide else own)
                    sums[part] += total
                    counts[part] += np.bincount(index, minlength=now.shape[1])
            part, entry = np.nonzero(counts)
            place = np.tile(np.arange(width), len(part))
            part, entry = np.repeat(part, width), np.repeat(entry, width)
            values = [Decimal(int(v)) for v in sums[part, entry, place]]
            columns = [pa.array(part), pa.array(entry), pa.array(place), pa.array(counts[part, entry]), pa.array(values, pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "place", "held", "total"])

        told = rows.select("embedding").mapInArrow(run, "part long, entry long, place long, held long, total decimal(38,0)")
        summed = told.groupBy("part", "entry", "place").agg(F.sum("held").alias("held"), F.sum("total").alias("total"))
        codebooks = codebooks.copy()
        for r in summed.collect():  # one row per component of the codebooks
            codebooks[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["held"]
    return codebooks


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, comma-joined."""
    return sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def encode(rows: DataFrame, codebooks: np.ndarray, cell_bits: int = CELL_BITS) -> DataFrame:
    """(vec_id, label, code, error): two hex digits per part, and the squared distances summed; null beyond 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _Coder(codebooks, cell_bits)
        for batch, x in _pieces(batches):
            codes, errors = [], np.zeros(len(x), dtype=object)
            for _, index, far in coder.assign(x):
                codes.append(index)
                errors = errors + far.astype(object)
            text = [bytes(r).hex() for r in np.stack(codes, axis=1).astype(np.uint8)]
            error = pa.array([e if e < 1 << 63 else None for e in errors.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), error], ["vec_id", "label", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, cell_bits: int = CELL_BITS) -> DataFrame:
    """Per kept row: vec_id, code, error, label_error and codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components are
    dropped. Repeated rows are coded each, and codebooks start with the rows of
    the smallest vec_ids (rows that share one by vector, null ids last), fewer
    if there are not enough. Vectors of different lengths have codebooks of
    their own; a length that is no multiple of eight is padded with zeros, and
    an empty vector has the code of the first entries and no error. Components
    beyond 64 bits stay at the greatest integer; an error beyond 64 bits is
    null, and a label_error that meets one leaves it out or is null beyond 64
    bits. Null labels are one label. Other columns have no part. An empty
    table gives no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits")
    common.ship(vectors.sparkSession)
    rows = materialize(usable(vectors), "vectors")
    coded = None
    for r in rows.select(F.size("embedding").alias("length")).distinct().orderBy("length").collect():  # one row per length
        own = rows.where(F.size("embedding") == r["length"])
        codebooks = fit(own, entries, rounds, cell_bits)
        part = encode(own, codebooks, cell_bits).withColumn("codebooks_sha256", F.lit(digest(codebooks)))
        coded = part if coded is None else coded.unionByName(part)
    if coded is None:
        empty = rows.select(F.col("vec_id").cast("long"), F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
        return empty.where(F.lit(False))
    coded = materialize(coded, "codes")
    # Partial sums first: a label with a third of the rows is one row per task.
    labels = coded.groupBy(F.col("label").alias("of")).agg(F.expr("try_sum(error)").alias("label_error"))
    return coded.join(labels, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    steps = []
    far = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))"
    for r in range(ROUNDS + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT p.id, p.part, min(CAST({far} AS HUGEINT) * {ENTRIES} + c.entry) AS k FROM p JOIN c{r} c ON p.part = c.part GROUP BY p.id, p.part)"
        )
        if r < ROUNDS:
            steps.append(f"""u{r} AS (
  SELECT part, entry, i, sum(v) AS s, count(*) AS n
  FROM (SELECT a.part, CAST(a.k % {ENTRIES} AS BIGINT) AS entry, unnest(p.x) AS v, unnest(range(len(p.x))) AS i FROM a{r} a JOIN p ON a.id = p.id AND a.part = p.part)
  GROUP BY part, entry, i),
c{r + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(m.x, c.x) AS x
  FROM c{r} c LEFT JOIN (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM u{r} GROUP BY part, entry) m ON c.part = m.part AND c.entry = m.entry)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e)))),
p AS MATERIALIZED (SELECT id, part, x[part * (len(x) // {PARTS}) + 1 : (part + 1) * (len(x) // {PARTS})] AS x FROM v, (SELECT unnest(range({PARTS})) AS part)),
c0 AS (SELECT part, id - 1 AS entry, x FROM p WHERE id <= {ENTRIES}),
{",".join(steps)},
coded AS (
  SELECT v.vec_id, v.label, string_agg(printf('%02x', CAST(k % {ENTRIES} AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(k // {ENTRIES}) AS BIGINT) AS error
  FROM a{ROUNDS} a JOIN v ON a.id = v.id GROUP BY v.id, v.vec_id, v.label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM c{ROUNDS}) AS codebooks_sha256
FROM coded
"""


SQL = _sql()
