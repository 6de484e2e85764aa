"""The training-data pipeline: each stage takes what its predecessor kept.

Stages 1 to 4 return the columns of documents, the last the encoded corpus. All
take nulls in any column, empty and very long texts, repeated rows and empty
tables, and leave columns other than doc_id, text and n_chars as they are,
whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cellwatch.llm import bpe, common, decontaminate, line_runs, simhash, toxicity
from cellwatch.runtime import materialize


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Columns that no operator reads under names that none makes, and their own names."""
    names = {c: f"__column_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    return docs.withColumnsRenamed(names), {new: old for old, new in names.items()}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on labelled ones among `docs`, doesn't reject.

    Null and empty texts hold no term and stay; without labels of both kinds
    all documents stay, or go if all labels are toxic.
    """
    rows, names = _apart(docs)
    model = toxicity.fit(rows, common.table(spark, sf_dir, "labels"))
    return toxicity.score(rows, model).where("predicted = 0").select(*rows.columns).withColumnsRenamed(names)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less later copies of line runs; documents of nothing else go. n_chars follows the text.

    Null and empty texts have no lines and stay; of repeated rows the first
    stays if its lines make a run.
    """
    rows, names = _apart(docs)
    left = line_runs.dedupe_lines(rows).where("kept")
    if "n_chars" in rows.columns:
        left = left.selectExpr(*[f"CASE WHEN n_deleted > 0 THEN length(text) ELSE n_chars END AS {c}" if c == "n_chars" else f"`{c}`" for c in rows.columns])
    return left.select(*rows.columns).withColumnsRenamed(names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies by SimHash and an exact check, that of the smallest doc_id.

    Null and empty texts are copies of each other; rows without doc_id stay.
    """
    rows, names = _apart(docs)
    return simhash.keep_one(rows).withColumnsRenamed(names)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a benchmark window; null and empty texts have none and stay."""
    rows, names = _apart(docs)
    judged = decontaminate.decontaminate(rows, common.table(spark, sf_dir, "benchmark"))
    return judged.where("not contaminated").select(*rows.columns).withColumnsRenamed(names)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, digest of the ids and of the decoded bytes; a null text is empty."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]
# A fitted classifier and fingerprints are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
