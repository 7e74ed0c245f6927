"""The queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqmotif.llm import chat, html_text, jaccard, neardup, packing, quality, sentencepiece, topk, toxicity, warc
from seqmotif.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.query(spark, table(spark, sf_dir, "embeddings"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.query(spark, table(spark, sf_dir, "conversations"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query(spark, table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.query(spark, table(spark, sf_dir, "pages"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.query(spark, table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.query(spark, table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.query(spark, table(spark, sf_dir, "pages"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.query(spark, table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    found = [op1_toxicity, op2_exact_topk, op3_chat_formatting, op4_best_fit_packing, op5_warc, op6_ngram_jaccard_join, op7_sentencepiece, op8_quality_classifier, op9_html_extraction, op10_embedding_near_dedup]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_topk": topk.ORACLE, "op3_chat_formatting": chat.ORACLE, "op5_warc": warc.ORACLE, "op6_ngram_jaccard_join": jaccard.ORACLE, "op10_embedding_near_dedup": neardup.ORACLE}
