"""Corpus pipeline: quality classifier, near copies, repeated passages, benchmark leaks, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``docs``. A
stage's output is stored as Parquet under the session's checkpoint folder and read again as the next one's input.

Cases common to all stages: null and empty texts, null ids, repeated rows, empty tables and extra columns pass through, as the
operators' docstrings define for each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlab.llm import decontaminate, group_matrix, packing, pairwise_quality, passages
from cohortlab.session import durable

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose pairwise quality score reaches the cut. The fit sees the labels of rows it is not tested on."""
    return pairwise_quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of linked shingle sets, the one with the least id; documents without words stay."""
    return group_matrix.keep_first(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that another document keeps."""
    return passages.cut_passages(docs, passages.repeated_passages(docs))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, each by its own text."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"), each_row=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token pieces of what is left into sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality), ("near_copies", near_copies), ("repeated_passages", repeats), ("benchmark_leaks", leaks), ("best_fit_packing", pack),
]
#: Not expressible in SQL: fitted scores, chains and packing. Stages are tested against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
