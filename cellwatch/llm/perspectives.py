"""Operator 6: multi-party perspective rotation of chats, in DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered once,
with that speaker as the assistant and the others as named users, and with the
mask of the characters the assistant is to learn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYSTEM, UNKNOWN = "system", "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _label(role: Column, speaker: Column) -> Column:
    return (
        F.when(role == F.lit(SYSTEM), F.lit(SYSTEM))
        .when(role == speaker, F.lit("assistant"))
        .otherwise(F.concat(F.lit("user name="), role))
    )


def rotate(turns: DataFrame, segment_turns: int | None = None) -> DataFrame:
    """(conv_id, segment, speaker, n_turns, n_assistant, start, rendered, mask), one row per participant.

    A row is the whole dialogue, segment 0, unless `segment_turns` is given:
    then a conversation too long for a row is cut to pieces of so many turns,
    one row per participant and piece, whose texts join to the whole dialogue;
    `start` is the place of a piece in it, and masks count in it too.

    Each participant gets every turn, also where it is silent. System turns are
    nobody's perspective. Turns are ordered by number, null first, then role,
    then text; repeated rows are said as often as they occur. `mask` holds
    start:end of the assistant's texts with their end marks, in code points,
    end exclusive. A null text is an empty turn, a null or empty role is named
    unknown, and a row without conversation is a dialogue of its own. Marks
    inside texts and names are broken by a space. A conversation of system
    turns alone has no perspective. Other columns have no part. An empty table
    gives no rows.
    """
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    role = F.when(F.coalesce(F.trim("role"), F.lit("")) == "", F.lit(UNKNOWN)).otherwise(F.col("role"))
    clean = turns.select(
        F.col("conv_id").cast("long"),
        F.struct(F.col("turn").cast("long").alias("turn"), safe(role).alias("role"), safe(F.coalesce("text", F.lit(""))).alias("text")).alias("said"),
    )
    alone = clean.where("conv_id IS NULL").select("conv_id", F.lit(0).cast("long").alias("segment"), F.array("said").alias("turns"), F.col("said.role").alias("speaker"))
    named = clean.where("conv_id IS NOT NULL")
    if segment_turns is None:
        placed = named.withColumn("segment", F.lit(0).cast("long"))
    else:
        place = F.row_number().over(Window.partitionBy("conv_id").orderBy("said")) - 1
        placed = named.withColumn("segment", F.floor(place / segment_turns).cast("long"))
    segments = placed.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list("said")).alias("turns"))
    # Speakers stay rows, as a room may hold any number.
    speakers = named.select("conv_id", F.col("said.role").alias("speaker")).distinct()
    each = segments.join(speakers, "conv_id").select("conv_id", "segment", "turns", "speaker").unionByName(alone).where(F.col("speaker") != SYSTEM)
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(OPEN), _label(t["role"], F.col("speaker")), F.lit("\n")).alias("head"),
            F.concat(t["text"], F.lit(CLOSE)).alias("body"),
            (t["role"] == F.col("speaker")).alias("own"),
        ),
    )
    each = each.withColumn("pieces", pieces).drop("turns")
    start = F.lit(0)
    if segment_turns is not None:
        size = F.aggregate("pieces", F.lit(0), lambda total, p: total + F.length(p["head"]) + F.length(p["body"]))
        before = Window.partitionBy("conv_id", "speaker").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
        start = F.when(F.col("conv_id").isNull(), 0).otherwise(F.coalesce(F.sum(size).over(before), F.lit(0)))
    each = each.withColumn("start", start.cast("long"))
    spans = F.aggregate(
        "pieces",
        F.struct(F.col("start").alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("at"),
            F.when(
                p["own"],
                F.array_append(
                    acc["spans"],
                    F.concat_ws(
                        ":",
                        (acc["at"] + F.length(p["head"])).cast("string"),
                        (acc["at"] + F.length(p["head"]) + F.length(p["body"])).cast("string"),
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )
    return each.select(
        "conv_id",
        "segment",
        "speaker",
        F.size("pieces").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_assistant"),
        "start",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
        F.array_join(spans["spans"], ",").alias("mask"),
    )


SQL = f"""
WITH t AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, role, text) AS n, turn,
         replace(CASE WHEN coalesce(trim(role), '') = '' THEN '{UNKNOWN}' ELSE role END, '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations),
h AS MATERIALIZED (SELECT *, CASE WHEN conv_id IS NULL THEN -n ELSE 0 END AS lone, coalesce(conv_id, 0) AS home FROM t),
p AS (SELECT DISTINCT home, lone, role AS speaker FROM h WHERE role <> '{SYSTEM}'),
x AS (
  SELECT h.*, speaker, role = speaker AS own,
         '{OPEN}' || CASE WHEN role = '{SYSTEM}' THEN '{SYSTEM}' WHEN role = speaker THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS head,
         text || '{CLOSE.strip()}' || chr(10) AS body
  FROM h JOIN p USING (home, lone)),
y AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY home, lone, speaker ORDER BY turn NULLS FIRST, role, text, n ROWS UNBOUNDED PRECEDING) AS stop
  FROM x)
SELECT conv_id, CAST(0 AS BIGINT) AS segment, speaker, count(*) AS n_turns, count(*) FILTER (own) AS n_assistant, CAST(0 AS BIGINT) AS start,
       string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, text, n) AS rendered,
       coalesce(string_agg(CAST(stop - length(body) AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY turn NULLS FIRST, role, text, n) FILTER (own), '') AS mask
FROM y GROUP BY conv_id, home, lone, speaker
"""
