"""Queries on the nested documents of ``false_alarm_cases``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodescan.operators.nested import NUMBER, STRING, flatten_json, json_tables, unreadable
from lodescan.runtime import latest, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One readable delivery per case. Deliveries of a case differ in spelling only."""
    cases = table(spark, sf_dir, "false_alarm_cases").select("case_id", "documents_json", "loaded_at")
    cases = cases.where(F.col("documents_json").isNotNull())
    return latest(cases, ["case_id"], F.try_parse_json("documents_json").isNotNull(), F.col("loaded_at"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = flatten_json(_documents(spark, sf_dir), ["case_id"], "documents_json")
    return nodes.select("case_id", "record_ix", "node_path", "parent_path", "node_key")


def p1_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_tables(_documents(spark, sf_dir), ["case_id"], "documents_json")["objects"]


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_tables(_documents(spark, sf_dir), ["case_id"], "documents_json")["json_values"]


def p1_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with payloads that cannot be read, with the error and the number of such deliveries."""
    rows = unreadable(table(spark, sf_dir, "false_alarm_cases"), ["case_id"], "documents_json")
    return rows.groupBy("case_id", "error").agg(F.count("*").alias("deliveries"))


_TREE = """
WITH RECURSIVE one AS (
  SELECT case_id, documents_json AS doc
  FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY loaded_at DESC) AS rn
        FROM false_alarm_cases WHERE documents_json IS NOT NULL AND json_valid(documents_json))
  WHERE rn = 1
), roots AS (
  SELECT case_id, CAST(i AS INTEGER) AS record_ix, CAST(json_extract(doc, '$[' || i || ']') AS VARCHAR) AS v
  FROM (SELECT case_id, doc, unnest(range(CAST(json_array_length(doc) AS BIGINT))) AS i FROM one WHERE json_type(doc) = 'ARRAY')
  UNION ALL
  SELECT case_id, 0, doc FROM one WHERE json_type(doc) = 'OBJECT'
), tree AS (
  SELECT case_id, record_ix, '' AS node_path, '' AS parent_path, v, json_type(v) AS kind FROM roots
  UNION ALL
  SELECT t.case_id, t.record_ix,
    CASE WHEN t.kind = 'ARRAY' THEN t.node_path || '[' || e.key || ']'
         WHEN t.node_path = '' THEN e.key ELSE t.node_path || '.' || e.key END,
    CASE WHEN t.kind = 'ARRAY' THEN t.parent_path ELSE t.node_path END,
    CAST(e.value AS VARCHAR), e.type
  FROM tree t, json_each(t.v) e WHERE t.kind IN ('ARRAY', 'OBJECT')
), rows_out AS (
  SELECT case_id, record_ix, node_path, parent_path, regexp_replace(node_path, '\\[\\d+\\]', '[]', 'g') AS node_key, kind, v
  FROM tree
  WHERE node_path <> '' AND (kind IN ('OBJECT', 'BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') OR (kind = 'VARCHAR' AND v <> '""'))
)
"""

QUERIES = {"p1_found": p1_found, "p1_objects": p1_objects, "p1_values": p1_values, "p1_unreadable": p1_unreadable}
ORACLES = {
    "p1_found": _TREE + "SELECT case_id, record_ix, node_path, parent_path, node_key FROM rows_out",
    "p1_values": _TREE + f"""SELECT case_id, record_ix, node_path, parent_path, node_key, CASE WHEN kind = 'VARCHAR' THEN '{STRING}' ELSE '{NUMBER}' END AS kind,
        json_extract_string(v, '$') AS value FROM rows_out WHERE kind <> 'OBJECT'""",
    "p1_unreadable": "SELECT case_id, 'no readable JSON' AS error, count(*) AS deliveries FROM false_alarm_cases WHERE documents_json IS NOT NULL AND NOT json_valid(documents_json) GROUP BY case_id",
    "p1_objects": _TREE + "SELECT case_id, record_ix, node_path, parent_path, node_key FROM rows_out WHERE kind = 'OBJECT'",
}
