"""Operator 7: deletion of repeated line runs by a distributed suffix array.

Every document is a sequence of line ids. Prefix doubling ranks all suffixes by
their first 1, 2, 4, ... lines: pairs of ranks are grouped, sorted by range and
numbered. A run counts if it holds at least `min_words` words. Suffixes that
share such a run as their prefix form an interval of common prefixes; all but
the first of an interval are later copies. Intervals are looked up for the
shortest runs that begin at a line and for those that end at a line: every line
of a maximal repeated run lies in one of these, so the union of their lines is
that of the maximal repeated runs, and it is deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwatch.runtime import materialize

MIN_WORDS = 10
_SEQ = "__seq"


def _ranked(keys: DataFrame) -> DataFrame:
    """Distinct keys with `rank`, a number in their order; stored, as numbering depends on the sort."""
    ordered = keys.repartitionByRange(*keys.columns).sortWithinPartitions(*keys.columns)
    return materialize(ordered.withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """Non-blank lines: (seq, doc_id, n, at, pos, words, key), `at` counting all lines and `pos` these.

    Words are counted up to `min_words`: no run asks for more.
    """
    line = F.transform(F.split(F.col("text"), "\n", -1), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    solid = F.filter(line, lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"))
    # Lines first become a column, as what stands beside an explode is computed for each of its rows.
    parted = docs.select(F.col(_SEQ).alias("seq"), "doc_id", solid.alias("solid"))
    return parted.select("seq", "doc_id", F.size("solid").alias("n"), F.posexplode("solid").alias("pos", "x")).select(
        "seq",
        "doc_id",
        "n",
        "pos",
        F.col("x.at").alias("at"),
        F.least(
            F.size(F.split(F.btrim(F.col("x.line"), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+", min_words + 1)), F.lit(min_words)
        ).alias("words"),
        F.unhex(F.md5("x.line")).alias("key"),
    )


def _near(column: Column, first: int, last: int) -> Column:
    """Values of a document's rows from `first` to `last` lines ahead, as (pos, value)."""
    frame = Window.partitionBy("seq").orderBy("pos").rangeBetween(first, last)
    return F.collect_list(F.struct(F.col("pos").alias("pos"), column.alias("value"))).over(frame)


def _at(near: Column, pos: Column) -> Column:
    return F.get(F.filter(near, lambda x: x["pos"] == pos), F.lit(0))["value"]


def _sizes(ahead: Column, min_words: int) -> Column:
    """(first, last): sizes of the runs to look up at a line, from the shortest with enough words
    to the longest that lacks them without its first line; null where no run has enough."""
    state = F.aggregate(
        ahead,
        F.struct(
            F.lit(0).alias("words"), F.lit(0).alias("rest"), F.lit(0).alias("lines"), F.col("pos").alias("want"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last")
        ),
        lambda acc, x: F.when(x["pos"] != acc["want"], acc).otherwise(_grown(acc, x["value"], min_words)),
    )
    return F.struct(state["first"].alias("first"), state["last"].alias("last"))


def _grown(acc: Column, value: Column, min_words: int) -> Column:
    words, lines = acc["words"] + value, acc["lines"] + 1
    rest = F.when(acc["lines"] > 0, acc["rest"] + value).otherwise(0)
    first = F.coalesce(acc["first"], F.when(words >= min_words, lines))
    last = F.when(first.isNotNull() & ((first == lines) | (rest < min_words)), lines).otherwise(acc["last"])
    names = ["words", "rest", "lines", "want", "first", "last"]
    return F.struct(*[c.alias(n) for c, n in zip((words, rest, lines, acc["want"] + 1, first, last), names)])


def later_copies(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(seq, at) of the lines that lie in a later copy of a repeated run.

    The first copy is that with the smallest doc_id, row and place. Lines that
    occur once are settled at the start: no run crosses them.
    """
    repeated = lines.groupBy("key").count().where("count > 1").select("key")
    ids = _ranked(repeated)
    sizes = _sizes(_near(F.col("words"), 0, min_words - 1), min_words)
    active = materialize(
        lines.join(ids, "key").withColumn("sizes", sizes).select("seq", "doc_id", "n", "pos", "at", F.col("rank").alias("r"), "sizes.first", "sizes.last"),
        "lines",
    )
    copies = None
    width = 1
    level = active
    while width <= min_words:
        found = _copies(level, width)
        copies = found if copies is None else copies.unionByName(found)
        width *= 2
        if width <= min_words:
            level = _doubled(level, width // 2)
    # A run has few lines: its places meet the lines one by one, so that a text of many copies isn't multiplied.
    marks = copies.select("seq", F.explode(F.sequence("begin", F.col("begin") + F.col("size") - 1)).alias("pos")).distinct()
    return marks.join(active.select("seq", "pos", "at"), ["seq", "pos"]).select("seq", "at")


def _doubled(level: DataFrame, width: int) -> DataFrame:
    """Ranks by twice as many lines; rows whose prefix occurs once drop out.

    A prefix that reaches the end of its document goes on with -1.
    """
    beyond = F.col("pos") + width
    second = F.when(beyond >= F.col("n"), F.lit(-1).cast("long")).otherwise(_at(_near(F.col("r"), width, width), beyond))
    paired = materialize(level.withColumn("second", second).where("second is not null"), "pairs")
    keys = paired.groupBy("r", "second").count().where("count > 1").select("r", "second")
    return materialize(paired.join(_ranked(keys), ["r", "second"]).drop("r", "second").withColumnRenamed("rank", "r"), "level")


def _copies(level: DataFrame, width: int) -> DataFrame:
    """(seq, begin, size) of later copies among the runs of `width` to 2 * width - 1 lines.

    Two ranks name such a run: that of its first and that of its last `width` lines.
    """
    from_, to = F.greatest("first", F.lit(width)), F.least("last", F.lit(2 * width - 1))
    ranks = level.withColumn("near", _near(F.col("r"), 0, width)).where(F.col("first").isNotNull() & (from_ <= to))
    runs = ranks.select("seq", "doc_id", "pos", "r", "near", F.explode(F.sequence(from_, to)).alias("size"))
    runs = runs.select("seq", "doc_id", "pos", "r", "size", _at(F.col("near"), F.col("pos") + F.col("size") - width).alias("end_rank")).where("end_rank is not null")
    place, key = F.struct("doc_id", "seq", "pos"), ["r", "end_rank", "size"]
    # One row per interval, aggregated map-side; hot intervals join back as skewed partitions.
    first = runs.groupBy(*key).agg(F.min(place).alias("earliest"), F.count("*").alias("n_copies")).where("n_copies > 1")
    return runs.join(first, key).where(place != F.col("earliest")).select("seq", F.col("pos").alias("begin"), "size")


def _without(parts: Column, deleted: Column) -> Column:
    """Lines joined less those at the places `deleted`; each line is met once, with a mark of its own."""

    def marks(places: Column, stays: bool) -> Column:
        return F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(stays).alias("stays")))

    all_marks = F.array_sort(F.concat(marks(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), deleted), True), marks(deleted, False)))
    marked = F.zip_with(parts, all_marks, lambda line, mark: F.struct(line.alias("line"), mark["stays"].alias("stays")))
    return F.array_join(F.transform(F.filter(marked, lambda x: x["stays"]), lambda x: x["line"]), "\n")


def dedupe_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of `docs` with `text` less later copies, plus n_lines, n_deleted, deleted and kept.

    n_lines counts non-blank lines, `deleted` lists the places of deleted lines
    among all lines, from 0. `kept` is false where every non-blank line of a
    document was deleted. Null and empty texts have no lines and are kept.
    Lines are compared as they are. Repeated rows are separate documents; a
    null doc_id comes first. Columns with the names of new ones are replaced.
    """
    new = ["n_lines", "n_deleted", "deleted", "kept", _SEQ]
    source = materialize(docs.drop(*new).withColumn(_SEQ, F.monotonically_increasing_id()), "numbered")
    lines = materialize(_lines(source, min_words), "all-lines")
    marks = later_copies(lines, min_words)
    gone = marks.groupBy(F.col("seq").alias(_SEQ)).agg(F.array_sort(F.collect_set("at")).alias("deleted"))
    parts = F.split(F.col("text"), "\n", -1)
    n_lines = F.size(F.filter(parts, lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    text = F.when(F.size("deleted") > 0, _without(parts, F.col("deleted"))).otherwise(F.col("text"))
    columns = [c for c in docs.columns if c not in new]
    return (
        source.join(gone, _SEQ, "left")
        .withColumn("deleted", F.coalesce("deleted", F.array().cast("array<int>")))
        .withColumn("n_lines", F.coalesce(F.when(F.col("text").isNotNull(), n_lines), F.lit(0)))
        .withColumn("n_deleted", F.size("deleted"))
        .select(*[text.alias(c) if c == "text" else F.col(c) for c in columns], "n_lines", "n_deleted", "deleted", ((F.col("n_deleted") == 0) | (F.col("n_deleted") < F.col("n_lines"))).alias("kept"))
    )


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document: line counts, places of deleted lines and digest of the text that is left."""
    return dedupe_lines(docs.select("doc_id", "text"), min_words).select(
        "doc_id",
        "n_lines",
        "n_deleted",
        F.array_join(F.transform("deleted", lambda x: x.cast("string")), ",").alias("deleted"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
        "kept",
    )


SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS seq, doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS MATERIALIZED (
  SELECT seq, ln, line, row_number() OVER (PARTITION BY seq ORDER BY ln) AS pos, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM (SELECT seq, unnest(range(len(parts))) AS ln, unnest(parts) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
w AS MATERIALIZED (
  SELECT *, sum(words) OVER (PARTITION BY seq ORDER BY pos) AS upto FROM l),
runs AS MATERIALIZED (
  SELECT a.seq, a.pos, min(b.pos) AS stop
  FROM w a JOIN w b ON a.seq = b.seq AND b.pos BETWEEN a.pos AND a.pos + {MIN_WORDS - 1} AND b.upto - a.upto + a.words >= {MIN_WORDS}
  GROUP BY a.seq, a.pos
  UNION
  SELECT b.seq, max(a.pos) AS pos, b.pos AS stop
  FROM w a JOIN w b ON a.seq = b.seq AND a.pos BETWEEN b.pos - {MIN_WORDS - 1} AND b.pos AND b.upto - a.upto + a.words >= {MIN_WORDS}
  GROUP BY b.seq, b.pos),
named AS MATERIALIZED (
  SELECT r.seq, r.pos, r.stop, string_agg(l.line, chr(10) ORDER BY l.pos) AS run
  FROM runs r JOIN l ON l.seq = r.seq AND l.pos BETWEEN r.pos AND r.stop GROUP BY r.seq, r.pos, r.stop),
copies AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seq, pos) AS k FROM named) WHERE k > 1),
gone AS (SELECT DISTINCT l.seq, l.ln FROM copies c JOIN l ON l.seq = c.seq AND l.pos BETWEEN c.pos AND c.stop),
per AS (SELECT seq, count(*) AS n_deleted, string_agg(CAST(ln AS VARCHAR), ',' ORDER BY ln) AS deleted, list(ln) AS lns FROM gone GROUP BY seq),
n AS (SELECT seq, count(*) AS n_lines FROM l GROUP BY seq),
left_over AS (
  SELECT seq, string_agg(line, chr(10) ORDER BY ln) AS text
  FROM (SELECT seq, unnest(range(len(parts))) AS ln, unnest(parts) AS line FROM d) x
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.seq = x.seq AND g.ln = x.ln) GROUP BY seq)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_deleted, 0) AS INTEGER) AS n_deleted, coalesce(deleted, '') AS deleted,
       sha256(CASE WHEN coalesce(n_deleted, 0) > 0 THEN coalesce(left_over.text, '') ELSE d.text END) AS text_sha256,
       coalesce(n_deleted, 0) = 0 OR n_deleted < n_lines AS kept
FROM d LEFT JOIN n USING (seq) LEFT JOIN per USING (seq) LEFT JOIN left_over USING (seq)
"""
