"""Cells and text blobs that look like an ``allow_list`` value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodescan.llm.lookalike import canonicalised, lookalikes, mapping
from lodescan.runtime import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes(
        table(spark, sf_dir, "cells"), "cell_id", "cell_value", table(spark, sf_dir, "text_blobs"), "blob_id", "text",
        table(spark, sf_dir, "allow_list"), "ref_id", "ref_value",
    )


def p4_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("cell", "cells", "cell_id", "cell_value"), ("blob", "text_blobs", "blob_id", "text"), ("ref", "allow_list", "ref_id", "ref_value")]
    rows = None
    for src, name, row_id, value in parts:
        part = table(spark, sf_dir, name).select(F.lit(src).alias("src"), F.col(row_id).alias("row_id"), F.col(value).alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    return canonicalised(rows.distinct(), "value")


QUERIES = {"p4_found": p4_found, "p4_canonical": p4_canonical}


def _sql() -> str:
    """The same by comparing every text with every reference: mapped by ``translate`` and put in composed form; a disguised stretch is
    one more place of the reference in the mapped text than in the text as written."""
    table = mapping()
    single = {c: to for c, to in table.items() if len(to) == 1}
    gone = "".join(c for c, to in table.items() if to == "")
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    several = ", ".join(f"{quoted(c)}: {quoted(to)}" for c, to in table.items() if len(to) > 1)

    def whole(column: str) -> str:
        form = f"translate({column}, {quoted(''.join(single) + gone)}, {quoted(''.join(single.values()))})"
        return f"nfc_normalize(array_to_string(list_transform(string_split({form}, ''), lambda c: coalesce(several.m[c], c)), ''))"

    def twice(text: str) -> str:
        """Each sign that is no letter or digit doubled, so that of two neighbouring places each has signs of its own around it."""
        return rf"regexp_replace({text}, '([^\p{{L}}\p{{N}}\p{{M}}])', '\1\1', 'g')"

    def places(text: str, ref: str) -> str:
        pattern = rf"'(?:^|[^\p{{L}}\p{{N}}])' || regexp_replace({twice(ref)}, '([.*+?(){{}}|^$\[\]\\-])', '\\\1', 'g') || '(?:$|[^\p{{L}}\p{{N}}\p{{M}}])'"
        return f"len(regexp_extract_all({twice(text)}, {pattern}))"

    return f"""WITH several AS (SELECT MAP {{{several}}} AS m),
a AS (SELECT ref_id, ref_value, {whole('ref_value')} AS r FROM allow_list, several WHERE ref_value <> ''),
c AS (SELECT DISTINCT cell_id, cell_value, {whole('cell_value')} AS v FROM cells, several WHERE cell_value <> ''),
b AS (SELECT DISTINCT blob_id, text, {whole('text')} AS v FROM text_blobs, several WHERE text <> '')
SELECT 'cell' AS src, cell_id AS row_id, ref_id FROM c JOIN a ON v = r AND cell_value <> ref_value AND r <> ''
UNION SELECT 'blob', blob_id, ref_id FROM b JOIN a ON contains(v, r) AND r <> '' WHERE {places('v', 'r')} > {places('text', 'ref_value')}"""


ORACLES: dict[str, str] = {"p4_found": _sql()}
