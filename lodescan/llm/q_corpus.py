"""Packing and mixing of ``documents``, sized in tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodescan.llm.mixing import mix_documents, mix_report, quality
from lodescan.llm.packing import pack_documents, packing_report
from lodescan.llm.tokens import tokens
from lodescan.runtime import spread, table


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", tokens(F.col("text")).alias("n_tokens"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = table(spark, sf_dir, "pack_plans").where("plan_id = 3")
    packed = pack_documents(_sized(spark, sf_dir), "doc_id", "n_tokens", plan, "plan_id", "capacity_tokens")
    return packed.where("pieces > 1").select("doc_id").distinct()


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = table(spark, sf_dir, "pack_plans")
    return pack_documents(_sized(spark, sf_dir), "doc_id", "n_tokens", plans, "plan_id", "capacity_tokens")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(p6_packed(spark, sf_dir), table(spark, sf_dir, "pack_plans"), "plan_id", "capacity_tokens")


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "mix_targets").select("mix_id", "source", F.col("target_share").alias("share"), "max_repeats")


def p7_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        "doc_id", "source", tokens(F.col("text")).alias("tokens"), quality(F.col("text")).alias("weight")
    )
    return mix_documents(docs, _targets(spark, sf_dir))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(p7_mixed(spark, sf_dir), _targets(spark, sf_dir))


QUERIES = {"p6_found": p6_found, "p6_packed": p6_packed, "p6_report": p6_report, "p7_mixed": p7_mixed, "p7_report": p7_report}
#: characters a document longer than its container surely has for each token of the container; no document lies near that size
CHARS_A_TOKEN = 3
ORACLES: dict[str, str] = {
    "p6_found": f"SELECT DISTINCT doc_id FROM documents, pack_plans WHERE plan_id = 3 AND length(text) > {CHARS_A_TOKEN} * capacity_tokens",
}
