"""Languages of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodescan.llm.language import document_languages, language_segments, mislabelled
from lodescan.runtime import spread, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mislabelled(_documents(spark, sf_dir), "doc_id", "text", "lang").select("doc_id", "seg_ix", "lang_code")


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_segments(_documents(spark, sf_dir), "doc_id", "text")


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_languages(_documents(spark, sf_dir), "doc_id", "text")


QUERIES = {"p8_found": p8_found, "p8_segments": p8_segments, "p8_documents": p8_documents}
ORACLES: dict[str, str] = {}
