"""From raw documents to tokens: quality rules, line dedup, near-dedup, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is written as
Parquet in the shared folder and read again before the next. All but the last return the columns
of documents. Empty tables pass through; what a stage does with nulls is said at its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import bpe, decontamination, lines, near_dedup, quality
from quillgraph.llm.common import discard, fresh_dir, kept_in, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail a rule nor stand on a rejected host."""
    return quality.keep(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their host's boilerplate lines; n_chars follows the text."""
    done = lines.drop_lines(docs.select(*COLUMNS))
    return done.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id; rows without a doc_id stay.

    Rows that share a doc_id are one document to groups() and stay or go together; of those equal in text one stays.
    """
    docs = docs.select(*COLUMNS)
    gone = near_dedup.groups(docs).filter(~F.col("kept")).select("doc_id").distinct()
    first = F.min(F.struct("lang", "source", "n_chars")).alias("r")  # a fixed choice among rows equal in text
    kept = docs.filter(F.col("doc_id").isNotNull()).join(gone, "doc_id", "left_anti").groupBy("doc_id", "text").agg(first).select("doc_id", "text", "r.*")
    return kept.select(*COLUMNS).union(docs.filter(F.col("doc_id").isNull()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    return decontamination.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark", "item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether their bytes are the text again."""
    done = bpe.tokens(docs.select("doc_id", "source", "lang", "text"))
    return done.select("doc_id", "source", "lang", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [("quality", quality_rules), ("lines", line_dedup), ("near", near_duplicates), ("decontamination", decontaminate), ("bpe", encode)]

#: Near-duplicate components are a fixed point that plain SQL does not express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents; a stage's rows are deleted when the next one's are written."""
    docs, folder, before = table(spark, sf_dir, "documents", *COLUMNS), fresh_dir(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = kept_in(stage(spark, docs, sf_dir), f"{folder}/{name}")
        if before:
            discard(f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
