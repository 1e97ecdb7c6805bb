"""Corpus pipeline: quality, exact and near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its result is written as Parquet
and read again for the next one. All but the last return the columns of `documents`. The rows depend on trained
dictionaries, fingerprints, permutations and a piece lattice, which SQL can't express, so there is no ORACLE_SQL; the
tests hold every stage against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from dosewise.llm import mixing, nbest, quality, resemblance, stream_dedup
from dosewise.llm.common import shared_folder, table
from dosewise.queries.registry import query

ORACLE_SQL = None

# Rows and bytes of a batch of texts. A task holds each batch in the JVM, in the worker and on the way between them; by
# default it is up to 10,000 rows or 64 MB.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage with BATCHES set in its session; they stay set, as its result is computed after it returns."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, value in BATCHES.items():
            spark.conf.set(key, value)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on the labelled ones, scores at least 0.7."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return stream_dedup.without_duplicates(docs)


@in_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: candidates by SimHash balls and MinHash bands, Jaccard similarity of 0.8 or more."""
    return resemblance.without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, one row for each pass that takes some."""
    return mixing.Mix(docs).documents()


@in_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The four best segmentations of each row's text."""
    return nbest.encode(docs, hold=False)


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_dedup),
    ("near-dedup", near_dedup),
    ("mixing to target weights", mix),
    ("SentencePiece encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; every stage's result is a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_folder(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


@query(ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
