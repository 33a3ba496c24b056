import json
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodescan.operators.nested import flatten_json, json_tables

SCHEMA = "id string, doc string"


def brute(doc):
    """(record_ix, path, parent, key) of objects and values, by plain recursion."""
    out = set()

    def walk(ix, x, path, parent):
        row = (ix, path, parent, re.sub(r"\[\d+\]", "[]", path))
        if isinstance(x, dict):
            if path:
                out.add(row)
            for k, v in x.items():
                walk(ix, v, f"{path}.{k}" if path else k, path)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                walk(ix, v, f"{path}[{i}]", parent)
        elif not (x is None or isinstance(x, bool) or x == "") and path:
            out.add(row)

    for i, d in enumerate(doc if isinstance(doc, list) else [doc]):
        walk(i, d, "", "")
    return out


def rows(spark, *docs):
    df = spark.createDataFrame([(str(i), d) for i, d in enumerate(docs)], SCHEMA)
    return flatten_json(df, ["id"], "doc").collect()


def paths(found):
    return {(r.record_ix, r.node_path, r.parent_path, r.node_key) for r in found}


def test_levels_and_links(spark):
    doc = [{"a": {"b": [{"c": 1}, {}, [2, {"d": "x"}]]}, "e f": "", "g.h": None, "i": True}, {"z": '{"a":1}'}]
    assert paths(rows(spark, json.dumps(doc))) == brute(doc)


def test_broken_null_empty_and_lone(spark):
    assert rows(spark, None, "", "[", "{}", "[]", "null", '"text"', '[1, "x"]') == []
    assert paths(rows(spark, '{"a": 1.5}')) == {(0, "a", "", "a")}


def test_deep_document(spark):
    doc = {"v": 1}
    for _ in range(60):
        doc = {"n": [doc]}
    assert paths(rows(spark, json.dumps(doc))) == brute(doc)


def test_brackets_and_quotes_in_strings(spark):
    doc = {"a": 'x"[{[{', "b": {"c": "\\"}}
    assert paths(rows(spark, json.dumps(doc))) == brute(doc)


def test_clashing_columns_and_repeats(spark):
    df = spark.createDataFrame([("k", '{"a": 1}', "other"), ("k", '{"a": 1}', "more")], "node_path string, doc string, value string")
    found = flatten_json(df.withColumnRenamed("node_path", "key"), ["key"], "doc").collect()
    assert len(found) == 2 and {r.value for r in found} == {"1"}


def test_empty_table_and_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert flatten_json(df, ["id"], "doc").count() == 0
    t = json_tables(spark.createDataFrame([("1", '{"a": {"b": 1}}')], SCHEMA), ["id"], "doc")
    assert t["objects"].count() == 1 and t["json_values"].first().parent_path == "a"


leaf = st.one_of(st.none(), st.booleans(), st.integers(-10**6, 10**6), st.text(max_size=4))
tree = st.recursive(leaf, lambda c: st.one_of(st.lists(c, max_size=3), st.dictionaries(st.text(alphabet="ab c", min_size=1, max_size=3), c, max_size=3)), max_leaves=12)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(doc=st.lists(st.dictionaries(st.text(alphabet="xyz", min_size=1, max_size=2), tree, max_size=3), max_size=3))
def test_any_document(spark, doc):
    assert paths(rows(spark, json.dumps(doc))) == brute(doc)


def test_unreadable_payloads_are_error_rows(spark):
    from lodescan.operators.nested import unreadable

    df = spark.createDataFrame([(1, "{"), (2, '{"a": 1}'), (3, None), (4, '{"a": 1, "a": 2}'), (5, "")], "i int, j string")
    assert sorted(r.i for r in unreadable(df, ["i"], "j").collect()) == [1, 4, 5]
