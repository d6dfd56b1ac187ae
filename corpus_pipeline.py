"""The corpus pipeline: stages that clean, deduplicate, order and encode the documents.

Each stage takes (spark, docs, sf_dir) and gives the rows that the next one reads from Parquet. All but the last give the columns
of documents; the last gives (doc_id, position, n_tokens, ids), where sorting by position gives the order of training.
Documents with a null doc_id or text pass the stages untouched; rows that share a doc_id are told apart by their text; an empty
table stays one.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revstrata.llm import _exchange, bpe, mixing, ngram_join, substring_dedup, toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier, fitted on the labelled ones, rejects go."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least doc_id; of repeated rows, one."""
    return ngram_join.without_near_duplicates(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more are cut wherever they occur again."""
    return substring_dedup.without_repeats(docs)


def in_training_order(spark: SparkSession, docs: DataFrame, sf_dir: str, schedule: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Every document at its place in the curriculum: files, and rows in them, are in the order of training.

    This only orders; with a schedule of target weights (mixing.flattening, say), documents are repeated or left out to meet them.
    """
    return mixing.mixed(docs, schedule=schedule)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with the place that the document has in the files that were read."""
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("bigint")
    place = F.coalesce(part, F.lit(0)) * F.lit(1 << 36) + F.col("_metadata.row_index")
    rows = docs.select(F.struct("doc_id", place.alias("position")).alias("doc_id"), "text")
    return bpe.encode(rows).select("doc_id.doc_id", "doc_id.position", F.size("ids").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", without_repeats),
    ("mixing", in_training_order),
    ("bpe", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = os.path.join(_exchange.shared_dir(spark), f"pipeline-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
