"""The corpus pipeline: quality rules, line dedup, near copies, benchmark leaks, BPE ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as
Parquet to the shared folder and reads it again as the next stage's documents. All stages but the last return the
columns of documents. A document that a stage rejects is in no later stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, decontamination, line_dedup, near_join, quality
from millrace.llm.common import written
from millrace.session import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the certified cutoffs; cutoffs come from the labels of these documents."""
    return quality.quality_stage(docs, table(spark, sf_dir, "labels"))


def line_dedup_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without runs of lines that repeat earlier ones; a document may lose its whole text."""
    return line_dedup.line_dedup_stage(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_join.near_copies_stage(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontamination_stage(docs, table(spark, sf_dir, "benchmark"))


def bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document."""
    return bpe.encode(docs, ["doc_id", "lang", "source"])


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_runs),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("bpe_ids", bpe_ids),
]

#: Certified cutoffs and the tokenizer can't be put in SQL: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, in order, over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
