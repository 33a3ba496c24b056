"""Relations, collections and change records as inputs: what is pushed to the store and what is decoded here."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

# Schemas, databases and collections of the stores themselves.
SYSTEM_SCHEMAS = frozenset("""
information_schema pg_catalog pg_toast sys mysql performance_schema admin config local master msdb tempdb model guest db_owner
""".split())
SYSTEM_PREFIXES = ("system.", "pg_temp_", "pg_toast_temp_")
# Text types of a customer system's fields.
TEXT_FIELD_TYPES = frozenset("string textarea email phone url encryptedstring combobox picklist address".split())
SAMPLE_ROWS = 10_000


@dataclass(frozen=True)
class RelationScan:
    """One relation of a database: columns, incremental column, head limit and the partitioning of the read."""

    url: str
    relation: str
    incremental_column: str | None = None
    since: str | None = None
    sample_limit: int | None = SAMPLE_ROWS
    partition_column: str | None = None
    bounds: tuple[int, int] | None = None
    partitions: int = 8
    fetch: int = 5000

    def reader(self, spark: SparkSession) -> DataFrameReader:
        r = spark.read.format("jdbc").option("url", self.url).option("dbtable", self.relation).option("fetchsize", self.fetch)
        r = r.option("pushDownPredicate", "true").option("pushDownLimit", "true").option("pushDownTableSample", "true")
        if self.partition_column and self.bounds:
            r = r.option("partitionColumn", self.partition_column).option("lowerBound", self.bounds[0])
            r = r.option("upperBound", self.bounds[1]).option("numPartitions", self.partitions)
        return r

    def load(self, spark: SparkSession) -> DataFrame:
        return limited(changed_since(self.reader(spark).load(), self.incremental_column, self.since), self.sample_limit)


def changed_since(df: DataFrame, column: str | None, since: str | None) -> DataFrame:
    """Rows strictly after the mark; a column the table lacks is ignored."""
    if not column or since is None or column not in df.columns:
        return df
    return df.where(F.col(f"`{column}`") > F.lit(since).cast(df.schema[column].dataType))


def limited(df: DataFrame, rows: int | None, key: str | None = None) -> DataFrame:
    """At most so many rows; none or 0 means all. With a key always the same ones."""
    if not rows:
        return df
    return (df.orderBy(key) if key else df).limit(rows)


def sample_percent(limit: int, estimate: int) -> float | None:
    """Share of a table to sample so that three times the limit is met, or None for a small table."""
    return None if estimate <= 2 * limit else min(100.0, max(0.01, 300.0 * limit / estimate))


def sampled(df: DataFrame, limit: int, estimate: int, seed: int = 7) -> DataFrame:
    percent = sample_percent(limit, estimate)
    return (df.sample(percent / 100, seed) if percent else df).limit(limit)


def user_relations(catalog: DataFrame, *, schema: str | None = None, tables: list[str] | None = None, include_views: bool = True) -> DataFrame:
    """Relations worth scanning of a catalog listing (table_schema, table_name, table_type)."""
    rows = catalog.where(~F.lower("table_schema").isin(*sorted(SYSTEM_SCHEMAS)))
    for p in SYSTEM_PREFIXES:
        rows = rows.where(~F.lower("table_schema").startswith(p) & ~F.lower("table_name").startswith(p))
    if schema:
        rows = rows.where(F.col("table_schema") == schema)
    if tables:
        rows = rows.where(F.col("table_name").isin(*tables) | F.concat_ws(".", "table_schema", "table_name").isin(*tables))
    return rows if include_views else rows.where(~F.upper("table_type").contains("VIEW"))


def text_fields(fields: DataFrame) -> DataFrame:
    """Fields (name, type) that can hold text."""
    return fields.where(F.lower("type").isin(*sorted(TEXT_FIELD_TYPES)))


def reader_endpoint(url: str) -> str:
    """A cluster's writer address turned to its reader."""
    return url.replace(".cluster-", ".cluster-ro-", 1) if ".cluster-ro-" not in url else url


def plain_item(item: object) -> object:
    """An item of typed attributes ({"S": "x"}, {"M": {...}}, ...) as a plain document."""
    if isinstance(item, dict) and len(item) == 1:
        (kind, value), = item.items()
        if kind == "M":
            return {k: plain_item(v) for k, v in value.items()}
        if kind == "L":
            return [plain_item(v) for v in value]
        if kind == "NULL":
            return None
        if kind in ("S", "N", "BOOL", "B", "SS", "NS", "BS"):
            return value
    if isinstance(item, dict):
        return {k: plain_item(v) for k, v in item.items()}
    return item


def stream_table(arn: Column) -> Column:
    """Source table of a change stream's name."""
    return F.regexp_replace(arn, "/stream/.*$", "")
