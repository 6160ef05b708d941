"""The corpus pipeline: quality rules, exact dedup, near-duplicate classes, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and reads all rows and whole texts of
docs; all but the last return the columns of docs, also those whose names clash
with an operator's own. An empty table gives an empty one. Where ids repeat or
are null, rows are told apart by their number in the order id (nulls last), text
(nulls first); so of rows that are alike the first by that order is the one that
stays. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinplan.llm import exact, jaccard, packing, quality, suffixes
from twinplan.llm.common import with_rid, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those that fail the base rules, null and empty texts among them, and those of mostly boilerplate. The line model is fitted on labelled documents among docs."""
    chain = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, chain)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space one row stays: the longest, then the first. Null counts as empty."""
    return exact.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (shingles of five words, similarity of 0.8 or more) the first row stays; texts without a word are in no class."""
    return jaccard.dedup(docs, percent=80, words=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that an earlier document, or an earlier place, has are cut out; n_chars follows the text."""
    stripped = suffixes.strip(docs)
    return stripped.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in stripped.columns else stripped


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches: a row for each document; texts without a word are in no batch."""
    return packing.pack(with_rid(docs)).drop("rid").withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", pack),
]

#: A trained line model, reachability and an optimal partition: not for SQL. tests/llm/test_pipeline.py holds run() against brute force, without labels.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
