"""Nested JSON documents as flat, related tables.

A document becomes rows of *objects* and rows of *values*; each row carries its path,
the path of the object that encloses it and its key (the path with array places left out).
The whole work is one SQL projection over a variant: nested transforms hand the
ancestor's path and the member's place down to the children, flatten joins the children of
all parents of a level, and one inline per target table turns the arrays into rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OBJECT, ARRAY, STRING, NUMBER, OTHER = "object", "array", "string", "number", "other"
_MAP, _LIST = "map<string,variant>", "array<variant>"


def _opened(path: Column, parent: Column, v: Column) -> Column:
    """Struct of one JSON node with its members or items, if it is a container."""
    return F.struct(
        path.alias("path"), parent.alias("parent"), v.alias("v"),
        F.try_variant_get(v, "$", _MAP).alias("members"), F.try_variant_get(v, "$", _LIST).alias("items"),
    )


def _children(level: Column) -> Column:
    """The nodes one level deeper, in document order within each parent."""

    def of_object(x: Column) -> Column:
        stem = F.when(x["path"] == "", F.lit("")).otherwise(F.concat(x["path"], F.lit(".")))
        return F.transform(
            F.map_entries(x["members"]), lambda e: _opened(F.concat(stem, e["key"]), x["path"], e["value"])
        )

    def of_array(x: Column) -> Column:
        return F.transform(
            x["items"],
            lambda e, i: _opened(F.concat(x["path"], F.lit("["), i.cast("string"), F.lit("]")), x["parent"], e),
        )

    inner = F.filter(level, lambda x: x["members"].isNotNull() | x["items"].isNotNull())
    return F.flatten(F.transform(inner, lambda x: F.when(x["members"].isNotNull(), of_object(x)).otherwise(of_array(x))))


def _typed(level: Column) -> Column:
    """The nodes of a level without their content, scalars with their text."""

    def kind(x: Column) -> Column:
        named = F.schema_of_variant(x["v"])
        return (
            F.when(x["members"].isNotNull(), OBJECT)
            .when(x["items"].isNotNull(), ARRAY)
            .when(x["v"].isNull() | F.is_variant_null(x["v"]), OTHER)
            .when(named == "STRING", STRING)
            .when(named.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), NUMBER)
            .otherwise(OTHER)
        )

    def slim(x: Column) -> Column:
        text = F.when(x["members"].isNull() & x["items"].isNull(), F.try_variant_get(x["v"], "$", "string"))
        return F.struct(
            x["path"].alias("node_path"), x["parent"].alias("parent_path"), kind(x).alias("kind"), text.alias("value")
        )

    return F.filter(
        F.transform(level, slim),
        lambda x: (x["node_path"] != "")
        & ((x["kind"] == OBJECT) | (x["kind"] == NUMBER) | ((x["kind"] == STRING) & (x["value"] != ""))),
    )


def json_depth(text: Column) -> Column:
    """Deepest nesting of brackets outside of strings; an upper bound for unreadable text."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\\.", ""), r'"[^"]*"', "")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    step = F.aggregate(
        marks,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda a, c: F.struct(
            (a["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("now"),
            F.greatest(a["most"], a["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most"),
        ),
    )
    return step["most"]


def _nodes(root: Column, depth: Column) -> Column:
    """All nodes of a document: one round of transforms for each level it has, and no more."""
    level = F.array(_opened(F.lit(""), F.lit(""), root))
    walked = F.aggregate(
        F.sequence(F.lit(1), depth),
        F.struct(_children(level).alias("level"), F.filter(_typed(level), lambda x: F.lit(False)).alias("out")),
        lambda a, _: F.struct(
            _children(a["level"]).alias("level"), F.concat(a["out"], _typed(a["level"])).alias("out")
        ),
    )
    return walked["out"]


def flatten_json(df: DataFrame, keys: list[str], json_col: str) -> DataFrame:
    """Every object below a document's root and every string or number, one row each.

    Result: ``keys``, record_ix, node_path, parent_path, node_key, kind, value.

    Defined results: a null or unreadable payload, or one that repeats a member name within
    an object, gives no row; nor do null, booleans, empty strings, arrays and roots. An empty
    object gives one row. A lone object is an array of one; root members that are no containers
    give no row. Extra columns are ignored, also when they bear a name of the result.
    """
    tagged = [f"_key{i}" for i in range(len(keys))]
    docs = df.select(*[F.col(f"`{k}`").alias(t) for k, t in zip(keys, tagged)], F.col(f"`{json_col}`").alias("_json"))
    docs = docs.select(*tagged, F.try_parse_json("_json").alias("_v"), json_depth(F.col("_json")).alias("_depth"))
    docs = docs.where(F.col("_v").isNotNull())
    items = F.try_variant_get("_v", "$", _LIST)
    docs = docs.select(*tagged, "_depth", F.posexplode(F.coalesce(items, F.array("_v"))).alias("record_ix", "_doc"))
    rows = docs.select(*tagged, "record_ix", F.inline(_nodes(F.col("_doc"), F.greatest("_depth", F.lit(1)))))
    return rows.select(
        *[F.col(t).alias(k) for k, t in zip(keys, tagged)], "record_ix", "node_path", "parent_path",
        F.regexp_replace("node_path", r"\[\d+\]", "[]").alias("node_key"), "kind", "value",
    )


def json_tables(df: DataFrame, keys: list[str], json_col: str) -> dict[str, DataFrame]:
    """The target tables ``objects`` and ``json_values``, linked by (keys, record_ix, parent_path)."""
    nodes = flatten_json(df, keys, json_col)
    link = [*keys, "record_ix", "node_path", "parent_path", "node_key"]
    return {
        "objects": nodes.where(F.col("kind") == OBJECT).select(*link),
        "json_values": nodes.where(F.col("kind") != OBJECT).select(*link, "kind", "value"),
    }


def unreadable(df: DataFrame, keys: list[str], json_col: str) -> DataFrame:
    """``keys`` and ``error`` of the payloads that ``flatten_json`` gives no rows for because they cannot be read: broken ones, and ones that
    repeat a member name within an object. Null payloads are none."""
    broken = df.where(F.col(f"`{json_col}`").isNotNull() & F.try_parse_json(F.col(f"`{json_col}`")).isNull())
    return broken.select(*[F.col(f"`{k}`").alias(k) for k in keys], F.lit("no readable JSON").alias("error"))
