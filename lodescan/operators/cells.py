"""Tables and documents as long rows of cells: unit, record, place, column, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodescan.operators.nested import NUMBER, STRING, flatten_json

COLUMNAR, RECORD = "columnar", "record"


def collapsed(path: Column) -> Column:
    """``a[3].b`` as ``a[].b``."""
    return F.regexp_replace(path, r"\[\d+\]", "[]")


def leaf(column: Column) -> Column:
    parts = F.filter(F.split(column, r"[.\[\]]+"), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def scope(path: Column, shape: Column) -> Column:
    """The enclosing object's path with indices, which parts array members; none in columnar data."""
    return F.when(shape == RECORD, F.regexp_extract(path, r"(?s)^(.*)\.[^.]*$", 1)).otherwise("")


def text_of(df: DataFrame, field: T.StructField) -> Column:
    """A value's text: binary decoded without its invalid bytes, booleans capitalised, else the plain cast."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.BinaryType):
        return F.regexp_replace(F.decode(c, "UTF-8"), "\\ufffd", "")
    if isinstance(field.dataType, T.BooleanType):
        return F.initcap(c.cast("string"))
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def columnar_cells(df: DataFrame, unit_id: str, record_id: str | None = None, *, strings_only: bool = False) -> DataFrame:
    """One row per non-empty cell of a table.

    With ``strings_only`` only string columns are read at all. ``record_id`` names a column that tells records
    apart (it is scanned as well); without it records are numbered by partition and place.
    """
    kept = [f for f in df.schema if not strings_only or isinstance(f.dataType, T.StringType)]
    number = F.col(f"`{record_id}`").cast("long") if record_id else F.monotonically_increasing_id()
    cells = F.array(*[
        F.struct(F.lit(i).alias("cell_ix"), F.lit(f.name).alias("column"), text_of(df, f).alias("value")) for i, f in enumerate(kept)
    ])
    rows = df.select(number.alias("record_ix"), F.inline(cells))
    return rows.where("value <> ''").select(
        F.lit(unit_id).alias("unit_id"), F.lit(COLUMNAR).alias("shape"), "record_ix", "cell_ix", "column", F.col("column").alias("field"),
        "value", F.concat(F.lit("Row "), F.col("record_ix"), F.lit(", Column '"), F.col("column"), F.lit("'")).alias("location"),
    )


def document_cells(df: DataFrame, keys: list[str], json_col: str) -> DataFrame:
    """Cells of JSON documents: every non-empty string and every number, with path, key, leaf and scope."""
    nodes = flatten_json(df, keys, json_col).where(F.col("kind").isin(STRING, NUMBER))
    shape = F.lit(RECORD)
    return nodes.select(
        *keys, shape.alias("shape"), "record_ix", F.col("node_key").alias("column"), F.col("node_path").alias("field"),
        leaf(F.col("node_key")).alias("leaf"), scope(F.col("node_path"), shape).alias("scope"), "value", F.col("node_path").alias("location"),
    )


def values_seen(cells: DataFrame) -> DataFrame:
    """Non-empty cells per unit and column: what every share is taken of."""
    return cells.groupBy("unit_id", "column").agg(F.count("*").alias("sampled"))
