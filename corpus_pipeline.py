"""The corpus pipeline: five operators in a row, each stage written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkgauge.llm.common import SharedFolder, read_table
from inkgauge.llm.jaccard_join import keep_one_of_each
from inkgauge.llm.line_dedup import dedup_passages
from inkgauge.llm.packing import pack_documents
from inkgauge.llm.secrets import redact
from inkgauge.llm.toxicity import drop_toxic, train


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity stays below the threshold."""
    return drop_toxic(docs, train(docs, read_table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repetitions of passages, in whole lines or spliced into others, are deleted from texts."""
    return dedup_passages(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets."""
    return redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 1024 tokens."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("jaccard_join", without_near_copies),
    ("secret_scans", without_secrets),
    ("best_fit_packing", packed),
]

#: A trained model and a local search cannot be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the table documents."""
    folder = SharedFolder(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = folder.save(stage(spark, docs, sf_dir), name)
    return docs
