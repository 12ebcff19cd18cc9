"""A training corpus from raw documents: quality, exact and near copies, benchmark leaks, source mix.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns
of documents, the last what the mix takes of each document.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontamination, exact_dedup, mixing, near_dedup, quality
from graphloom.llm.common import new_path, recorded, release, table, tidy


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return exact_dedup.dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id stays."""
    return near_dedup.dedup(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document that is left."""
    return mixing.mix(docs)


_LEFT: list[str] = []  # tables that the last stage's operator wrote


def _stage(f):
    """A stage whose predecessor's own tables go first: what the predecessor returned has been written by now."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _LEFT)
        with recorded(_LEFT):
            return f(spark, docs, sf_dir)

    return run_stage


STAGES = [(f.__name__, _stage(f)) for f in (good_quality, exact_copies, near_copies, benchmark_leaks, source_mix)]

#: SQL can't express the classifier, the sketches and the shuffled queues; tests/llm holds each stage, and run(), against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path, kept = new_path(spark, name), stage(spark, docs, sf_dir)
        with tidy(spark):
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return docs
