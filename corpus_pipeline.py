"""Corpus pipeline: quality, toxicity, near duplicates, packing.

Each stage reads the documents that its predecessor kept and returns documents
with the same columns, whatever extra ones there are; the last returns one row
per packed piece. Between stages the documents are a Parquet table in the
shared folder. Null texts are empty; of rows that repeat both doc_id and text one stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqmotif.llm import jaccard, packing, quality, toxicity
from seqmotif.session import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text isn't toxic."""
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences."""
    return packing.query(spark, docs, packing.FEWER)  # workers still hold what the stages before left in memory


STAGES: list[tuple[str, Stage]] = [("quality classifier", keep_good), ("toxicity", keep_clean), ("n-gram jaccard join", keep_distinct), ("best-fit packing", pack)]

#: Trained models and tokenizers can't be stated in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, spark)
    return docs
