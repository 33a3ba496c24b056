"""Personal data in ``accuracy_cases`` and ``text_blobs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodescan.llm.pii import find_personal_data, redact
from lodescan.runtime import spread, table


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, blobs = table(spark, sf_dir, "accuracy_cases"), table(spark, sf_dir, "text_blobs")
    parts = [("text", cases, "row_id", "text"), ("notes", cases, "row_id", "notes"), ("blob", blobs, "blob_id", "text")]
    rows = None
    for src, df, row_id, text in parts:
        part = df.select(F.lit(src).alias("src"), F.col(row_id).alias("row_id"), F.col(text).alias("body")).where(F.col("body").isNotNull())
        rows = part if rows is None else rows.unionByName(part)
    # a repeated delivery has the same text; one exchange serves the aggregation and spreads small files over all cores
    return spread(rows, "src", "row_id").groupBy("src", "row_id").agg(F.max("body").alias("body"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(_texts(spark, sf_dir), ["src", "row_id"], "body")
    return found.select("src", "row_id", "pii_type", "start_ix", "end_ix")


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(_texts(spark, sf_dir), "body").select("src", "row_id", "redacted")


QUERIES = {"p5_found": p5_found, "p5_redacted": p5_redacted}
ORACLES: dict[str, str] = {}
