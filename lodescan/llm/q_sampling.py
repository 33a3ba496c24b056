"""Fair samples of the records of every unit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodescan.llm.sampling import sample_records
from lodescan.runtime import table


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = table(spark, sf_dir, "sample_plans")
    sample = sample_records(table(spark, sf_dir, "records"), plans, "unit_id", "record_id", "piece_no", "sample_size")
    return sample.select("unit_id", "record_id", "piece_no", "cells", "population")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = table(spark, sf_dir, "sample_plans").select(F.col("unit_id").alias("u"), "sample_size")
    sample = p3_sample(spark, sf_dir).select("unit_id", "record_id", "population")
    whole = sample.join(plans, (F.col("unit_id") == F.col("u")) & (F.col("population") <= F.col("sample_size")))
    return whole.select("unit_id", "record_id").distinct()


def p3_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_sample(spark, sf_dir).groupBy("unit_id").agg(F.count("*").alias("sampled"), F.max("population").alias("population"))


QUERIES = {"p3_found": p3_found, "p3_sample": p3_sample, "p3_sizes": p3_sizes}
ORACLES = {
    "p3_found": """
WITH n AS (SELECT unit_id, count(DISTINCT record_id) AS population FROM records GROUP BY unit_id)
SELECT DISTINCT r.unit_id, r.record_id
FROM records r JOIN n ON n.unit_id = r.unit_id JOIN sample_plans p ON p.unit_id = r.unit_id
WHERE n.population <= p.sample_size
""",
    "p3_sizes": """
SELECT r.unit_id, least(max(p.sample_size), count(DISTINCT record_id)) AS sampled, count(DISTINCT record_id) AS population
FROM records r JOIN sample_plans p ON p.unit_id = r.unit_id GROUP BY r.unit_id
""",
}
