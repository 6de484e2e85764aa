"""Landing zone: header contract, quality gate, routing and audit.

Files are read as text lines with their place in the file (split offset, then
row id), so a verdict needs one map-side aggregate per split and one small
aggregate per file: no file, however large, is ever gathered in one task.
Splits may differ from scan to scan, so offsets and ids are compared only
within one scan; what one job hands to the next is keyed by file alone. A stored
parse (`parse_folder`) is one scan that headers, verdicts and rows all read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellwatch.runtime import materialize
from cellwatch.schemas import (
    GRID_ID_MAX,
    GRID_ID_MIN,
    LANDING_PATTERN,
    RAW_COLUMNS,
    RAW_MEASURES,
    RAW_TO_CANONICAL,
)
from cellwatch.sources.activity import only_files, plain_path

MISSING_COLUMNS = "SCHEMA_VALIDATION_FAILED: missing required columns: "
# A comma with an even number of quotes after it ends a field.
_OUTSIDE_QUOTES = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def number_lines(text: DataFrame) -> DataFrame:
    """Fields of non-blank lines with row ids, and a hash of each line.

    Ids are handed out after blank lines are gone, so within one split they
    are consecutive and their difference is a count of lines.
    """
    line = F.regexp_replace("value", "^\\x{FEFF}", "")
    return text.where(F.trim("value") != "").select(
        "file",
        "block",
        F.monotonically_increasing_id().alias("row_id"),
        split_fields(line).alias("fields"),
        F.xxhash64(line).alias("line_hash"),
    )


def landing_text(spark: SparkSession, folder: str, pattern: str = LANDING_PATTERN) -> DataFrame:
    """Raw lines of every landing file with file and split offset."""
    return spark.read.text(f"{folder}/{pattern}").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )


def landing_lines(spark: SparkSession, folder: str, pattern: str = LANDING_PATTERN) -> DataFrame:
    """Every line of every landing file: file, split offset, row id, fields."""
    return number_lines(landing_text(spark, folder, pattern))


def parse_text(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored lines, and the names of the files they come from, from one scan of the text.

    Files of blank lines alone are among the names.
    """
    seen = Observation("landed files")
    lines = materialize(number_lines(text.observe(seen, F.collect_set("file").alias("files"))), "landed")
    names = seen.get["files"] or []
    return lines, text.sparkSession.createDataFrame([(name,) for name in names], "file string")


def parse_folder(spark: SparkSession, folder: str, pattern: str = LANDING_PATTERN, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Stored lines of a landing folder, and the names of its files, empty ones too.

    Files that `known` names in a column `file` are neither read nor named.
    """
    text = landing_text(spark, folder, pattern)
    # The names of the very scan, so that a file arriving now is not misjudged.
    names = spark.createDataFrame([(name,) for name in text.inputFiles()], "file string")
    if known is not None:
        names = unread_files(names, known)
        text = only_files(text, [r["p"] for r in names.select(plain_path(F.col("file")).alias("p")).collect()], "file")  # new files alone
    return materialize(number_lines(text), "landed"), names


def split_fields(line: Column) -> Column:
    """Trimmed fields of a CSV line; only lines with quotes pay for quoting."""
    quoted = F.transform(
        F.split(line, _OUTSIDE_QUOTES, -1),
        lambda c: F.replace(F.regexp_replace(F.trim(c), '^"(.*)"$', "$1"), F.lit('""'), F.lit('"')),
    )
    plain = F.split(line, ",", -1)
    return F.transform(F.when(F.contains(line, F.lit('"')), quoted).otherwise(plain), lambda c: F.trim(c))


def file_headers(lines: DataFrame) -> DataFrame:
    """Header of each file, one row per file: the fields of its first line and the places of columns.

    `at` holds the place of each required column, -1 where it is missing.
    """
    places = [(F.array_position("columns", c).cast("int") - 1).alias(c) for c in RAW_COLUMNS]
    return (
        lines.groupBy("file")
        .agg(F.min_by("fields", F.struct("block", "row_id")).alias("columns"))
        .withColumn("at", F.struct(*places))
    )


def with_headers(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Lines with the header, number of columns and places of their file.

    Files with the canonical header need no look-up, so only the others are
    joined: few, and broadcast where their measured size allows.
    """
    usual = F.array(*map(F.lit, RAW_COLUMNS))
    places = F.struct(*[F.lit(i).alias(c) for i, c in enumerate(RAW_COLUMNS)])
    other = headers.where(F.col("columns") != usual).select("file", F.col("columns").alias("header"), F.col("at").alias("own_at"))
    return (
        lines.join(other, "file", "left")
        .withColumns({"at": F.coalesce("own_at", places), "header": F.coalesce("header", usual)})
        .withColumn("width", F.size("header"))
        .drop("own_at")
    )


def empty_files(spark: SparkSession, folder: str, pattern: str = LANDING_PATTERN) -> DataFrame:
    """Files of no bytes, which scans pass over; only names are listed."""
    source = f"{folder}/{pattern}"
    named = spark.read.text(source).inputFiles()
    # Listed later, so that a file arriving between the listings is not taken for empty.
    filled = spark.read.format("binaryFile").load(source).select(F.col("path").alias("file"))
    return unread_files(spark.createDataFrame([(name,) for name in named], "file string"), filled)


def unread_files(names: DataFrame, headers: DataFrame) -> DataFrame:
    """Named files without a header: of no bytes, or of blank lines alone."""
    read = headers.select(plain_path(F.col("file")).alias("_path"))
    return names.withColumn("_path", plain_path(F.col("file"))).join(read, "_path", "left_anti").select("file")


def landing_schema_check(headers: DataFrame) -> DataFrame:
    """Per file: does the header carry every required column?"""
    required = F.array(*[F.lit(c) for c in RAW_COLUMNS])
    missing = F.array_sort(F.array_except(required, F.col("columns")))
    return headers.select(
        "file",
        (F.size(missing) == 0).alias("schema_ok"),
        F.when(
            F.size(missing) > 0,
            F.concat(F.lit(MISSING_COLUMNS), F.array_join(missing, ", ")),
        )
        .otherwise("schema_valid")
        .alias("reason"),
    )


def named_field(name: str) -> Column:
    """Field of a required column, empty where the row or header lacks it."""
    return F.coalesce(F.get("fields", F.col(f"at.{name}")), F.lit(""))


def row_fault(
    datetime: Column, cell: Column, measures: dict[str, Column], short: Column, grid_id_max: int = GRID_ID_MAX
) -> Column:
    """First fault of a row in check order, NULL for a good row.

    The text keeps a `{row}` mark for the file row number.
    """
    number = cell.try_cast("decimal(38,0)")
    fault = (
        F.when(
            F.try_to_timestamp(datetime, F.lit("yyyy-M-d H:m:s")).isNull(),
            F.concat(F.lit("malformed datetime at row {row}: "), datetime),
        )
        .when(cell == "", F.lit("missing CellID at row {row}"))
        .when(~cell.rlike(r"^[+-]?\d+$"), F.concat(F.lit("invalid CellID at row {row}: "), cell))
        .when(
            number.isNull() | ~number.between(GRID_ID_MIN, grid_id_max),
            F.concat(
                F.lit(f"CellID outside {GRID_ID_MIN}-{grid_id_max} at row {{row}}: "),
                F.coalesce(number.cast("string"), cell),
            ),
        )
    )
    for name, text in measures.items():
        value = F.when(~text.rlike(r"\d[dDfF]$"), text.try_cast("double"))
        fault = fault.when(
            (text != "") & value.isNull(),
            F.concat(F.lit(f"non-numeric {name} at row {{row}}: "), text),
        ).when(
            (text != "") & (value < 0),
            F.concat(F.lit(f"negative {name} at row {{row}}: "), value.cast("string")),
        )
    return fault.when(short, F.lit("unable to read file: short row {row}"))


def landing_quality_gate(lines: DataFrame, headers: DataFrame, grid_id_max: int = GRID_ID_MAX) -> DataFrame:
    """Per file: accepted or not, rows read, the first fault with its row, and a digest of its lines.

    As in a line-by-line reader, `row_count` stops at the first bad row and row
    numbers start at 2. Each split reduces to one row (its lines and its first
    fault), and to one more for each line that reads like the header: the first
    line of the file is the header, any other such line a bad row. Which line
    is first is decided among the rows of this very scan.
    """
    rows = with_headers(lines, headers)
    rows = rows.select(
        "file",
        "block",
        "row_id",
        F.when(F.col("fields") == F.col("header"), F.col("row_id")).alias("like_header"),
        "line_hash",
        (F.size("fields") < F.col("width")).alias("short"),
        *[named_field(c).alias(c) for c in ["datetime", "CellID", *RAW_MEASURES]],
    )
    fault = row_fault(F.col("datetime"), F.col("CellID"), {m: F.col(m) for m in RAW_MEASURES}, F.col("short"), grid_id_max)
    bad_id = F.when(F.col("fault").isNotNull(), F.col("row_id"))
    parts = (
        rows.withColumn("fault", fault)
        .groupBy("file", "block", "like_header")
        .agg(
            F.count("*").alias("n"),
            F.min("row_id").alias("first_id"),
            F.min(bad_id).alias("bad_id"),
            F.min_by("fault", bad_id).alias("fault"),
            F.sum(F.col("line_hash").cast("decimal(38,0)")).alias("first_sum"),
            F.sum(F.xxhash64("line_hash", F.lit(1)).cast("decimal(38,0)")).alias("second_sum"),
        )
    )
    in_file, in_split = W.partitionBy("file"), W.partitionBy("file", "block")
    is_header = (F.col("block") == F.min("block").over(in_file)) & (F.col("like_header") == F.min("first_id").over(in_split))
    is_header = F.coalesce(is_header, F.lit(False))
    bad_part = F.when(~F.col("is_header"), F.col("bad_id"))
    earlier = in_file.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    splits = (
        parts.withColumn("is_header", is_header)
        .groupBy("file", "block")
        .agg(
            F.sum(F.when(F.col("is_header"), 0).otherwise(F.col("n"))).alias("n"),
            (F.min(bad_part) - F.min("first_id") + 1 - F.max(F.col("is_header").cast("int"))).alias("bad_at"),
            F.min_by("fault", bad_part).alias("fault"),
            F.sum("first_sum").alias("first_sum"),
            F.sum("second_sum").alias("second_sum"),
        )
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    )
    first_bad = F.min_by(
        F.struct((F.col("before") + F.col("bad_at")).alias("at"), F.col("fault").alias("fault")),
        F.when(F.col("bad_at").isNotNull(), F.col("block")),
    )
    at, fault = F.col("bad.at"), F.col("bad.fault")
    return (
        splits.groupBy("file")
        .agg(F.sum("n").alias("total"), first_bad.alias("bad"), F.sum("first_sum").alias("first_sum"), F.sum("second_sum").alias("second_sum"))
        .select(
            "file",
            (at.isNull() & (F.col("total") > 0)).alias("quality_ok"),
            F.coalesce(at, F.col("total")).alias("row_count"),
            F.when(
                at.isNotNull(),
                F.concat(
                    F.lit("QUALITY_VALIDATION_FAILED: "),
                    F.replace(fault, F.lit("{row}"), (at + 1).cast("string")),
                ),
            )
            .when(F.col("total") == 0, "QUALITY_VALIDATION_FAILED: file contains no data rows")
            .otherwise("quality_valid")
            .alias("reason"),
            # Of the lines in any order, so it doesn't depend on how a file is split.
            F.sha2(F.concat_ws(",", F.col("total").cast("string"), F.col("first_sum").cast("string"), F.col("second_sum").cast("string")), 256).alias("digest"),
        )
    )


def landing_verdicts(
    lines: DataFrame, headers: DataFrame | None = None, unread: DataFrame | None = None, grid_id_max: int = GRID_ID_MAX
) -> DataFrame:
    """Schema check, then quality gate, one verdict per file.

    Headers are stored first: they are read twice, and their measured size
    lets Spark broadcast the unusual ones to the lines where they are few. `unread` names
    files without any line, which lack every column.
    """
    headers = materialize(file_headers(lines), "headers") if headers is None else headers
    schema = landing_schema_check(headers)
    gate = landing_quality_gate(lines, headers, grid_id_max)
    verdicts = schema.alias("s").join(gate.alias("g"), "file").select(
        "file",
        (F.col("s.schema_ok") & F.col("g.quality_ok")).alias("valid"),
        F.when(F.col("s.schema_ok"), F.col("g.row_count")).otherwise(F.lit(0)).cast("bigint").alias("row_count"),
        F.when(F.col("s.schema_ok"), F.col("g.reason")).otherwise(F.col("s.reason")).alias("reason"),
        "g.digest",
    )
    if unread is None:
        return verdicts
    empty = unread.select(
        "file",
        F.lit(False).alias("valid"),
        F.lit(0).cast("bigint").alias("row_count"),
        F.lit(MISSING_COLUMNS + ", ".join(sorted(RAW_COLUMNS))).alias("reason"),
        F.lit(None).cast("string").alias("digest"),
    )
    return verdicts.unionByName(empty)


def judge_folder(
    spark: SparkSession, folder: str, pattern: str = LANDING_PATTERN, grid_id_max: int = GRID_ID_MAX
) -> DataFrame:
    """Verdicts of all files of a landing folder."""
    lines, names = parse_folder(spark, folder, pattern)
    headers = materialize(file_headers(lines), "headers")
    return landing_verdicts(lines, headers, unread_files(names, headers), grid_id_max)


def landing_route(verdicts: DataFrame, audit: DataFrame) -> DataFrame:
    """Status per file; a file that the audit already routed there is SKIPPED.

    Where both sides carry digests, so is a valid file whose lines were
    accepted under another name, in the audit or here, where the first name
    counts.
    """
    wanted = F.when(F.col("valid"), "ACCEPTED").otherwise("REJECTED")
    done = audit.where(F.col("status").isin("ACCEPTED", "REJECTED")).select(
        "filename", F.col("status").alias("wanted"), F.col("filename").alias("by_name")
    ).distinct()
    rows = verdicts.withColumn("wanted", wanted).join(done, ["filename", "wanted"], "left").withColumn("earlier", F.col("by_name"))
    kept = ["filename", "row_count", "reason"]
    if "digest" in verdicts.columns and "digest" in audit.columns:
        known = audit.where((F.col("status") == "ACCEPTED") & F.col("digest").isNotNull()).groupBy("digest").agg(F.min("filename").alias("by_digest"))
        first = F.first("filename").over(W.partitionBy("digest", "wanted").orderBy("filename"))
        same = F.when(F.col("valid") & F.col("digest").isNotNull(), F.coalesce("by_digest", F.when(first != F.col("filename"), first)))
        rows = rows.join(known, "digest", "left").withColumn("earlier", F.coalesce("by_name", same))
        kept.append("digest")
    skipped = F.col("earlier").isNotNull()
    return rows.withColumns(
        {
            "status": F.when(skipped, "SKIPPED").otherwise(F.col("wanted")),
            "reason": F.when(skipped, F.concat(F.lit("Already processed; existing file: "), F.col("earlier"))).otherwise(F.col("reason")),
        }
    ).select("filename", "status", *kept[1:])


def audit_records(routed: DataFrame, processed_at: Column | None = None) -> DataFrame:
    return routed.withColumn("processed_at", processed_at if processed_at is not None else F.current_timestamp())


def append_audit(records: DataFrame, path: str) -> None:
    records.write.mode("append").parquet(path)


def audit_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("status").agg(F.count("*").alias("files"), F.sum("row_count").alias("rows"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def accepted_rows(lines: DataFrame, headers: DataFrame, routed: DataFrame, name: Callable[[Column], Column] = file_name) -> DataFrame:
    """Rows of accepted files under canonical names, as text.

    A second line like the header is a bad row, so an accepted file has one.
    """
    accepted = routed.where(F.col("status") == "ACCEPTED").select("file")
    rows = with_headers(lines.join(accepted, "file", "left_semi"), headers).where(F.col("fields") != F.col("header"))
    return rows.select(
        name(F.col("file")).alias("source_file"),
        *[F.nullif(named_field(raw), F.lit("")).alias(RAW_TO_CANONICAL[raw]) for raw in RAW_COLUMNS],
    )
