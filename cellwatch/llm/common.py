"""Reading tables, shipping the package to executors, and word splitting shared by the operators."""

from __future__ import annotations

import os
import pathlib
import tempfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text a task holds decoded at one time; a longer text is a block alone.
BLOCK_BYTES = 8 << 20
_SHIPPED: set[str] = set()
_TO_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
# ASCII letters and digits and every byte of other characters stay, the rest parts words.
_TO_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def ship(spark: SparkSession) -> None:
    """Let Python workers of every executor import this package."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = pathlib.Path(__file__).resolve().parent.parent
    archive = os.path.join(tempfile.mkdtemp(prefix="cellwatch-py-"), "cellwatch_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased; null has none."""
    return text.encode().translate(_TO_LOWER).split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased."""
    return text.encode().translate(_TO_ALNUM).split() if text else []


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def may_be_among(value: Column, ids: DataFrame, longs: int = 1 << 18) -> Column:
    """True for every value that `ids` (one column) holds, and for few others while these are not many more than the bits.

    A bit set of fixed size, whatever the number of ids: a scalar of `longs`
    64-bit words that is made once and sent to the tasks.
    """

    def places(v: Column) -> tuple[Column, Column]:
        h = F.xxhash64(v, F.lit("member"))
        return F.pmod(h, F.lit(longs)), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 40), F.lit(64)).cast("int"))

    word, bit = places(ids[ids.columns[0]])
    bits = ids.groupBy(word.alias("id")).agg(F.bit_or(bit).alias("bits"))
    dense = ids.sparkSession.range(longs).join(bits, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")).alias("w"))
    table = dense.agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["bits"])).scalar()
    word, bit = places(value)
    return F.get(table, word.cast("int")).bitwiseAND(bit) != 0


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES, decode: bool = True) -> Iterator[tuple[pa.Table, list]]:
    """Rows in blocks of about `limit` bytes of text, and their texts decoded."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        first = 0
        for row, length in enumerate(sizes):
            if size and size + length > limit:
                held.append(batch.slice(first, row - first))
                yield _block(held, column, decode)
                held, size, first = [], 0, row
            size += length
        held.append(batch.slice(first))
    if held:
        yield _block(held, column, decode)


def _block(held: list[pa.RecordBatch], column: str, decode: bool) -> tuple[pa.Table, list]:
    rows = pa.Table.from_batches(held)
    return rows, rows.column(column).to_pylist() if decode else []



def xxh(word: str | bytes) -> int:
    """XXH64 as Spark's xxhash64 computes it, unsigned."""
    return xxhash.xxh64_intdigest(word, 42)
