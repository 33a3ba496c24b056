"""The queries of this subpackage on the smallest tables, against their SQL or plain recomputation."""

import glob
import os

import duckdb
import pytest

from lodescan.llm import queries as Q
from verify import norm

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    assert norm(Q.QUERIES[name](spark, DATA).toPandas()) == norm(duck.execute(Q.ORACLES[name]).df())


def test_longer_documents_are_the_split_ones(spark, duck):
    from lodescan.llm.tokens import count_tokens, encoding

    enc = encoding()
    want = {i for i, t in duck.execute("SELECT doc_id, text FROM documents").fetchall() if t and count_tokens(t, enc) > 8192}
    assert {r.doc_id for r in Q.QUERIES["p6_found"](spark, DATA).collect()} == want


def test_found_rows_have_the_stated_columns_and_come_once(spark):
    columns = {
        "p2_found": ["profile_id"], "p3_found": ["unit_id", "record_id"], "p4_found": ["src", "row_id", "ref_id"],
        "p5_found": ["src", "row_id", "pii_type", "start_ix", "end_ix"], "p6_found": ["doc_id"], "p8_found": ["doc_id", "seg_ix", "lang_code"],
    }
    for name, names in columns.items():
        df = Q.QUERIES[name](spark, DATA)
        rows = df.collect()
        assert df.columns == names and len(rows) == len(set(rows))


def test_mixes_keep_their_bounds(spark, duck):
    most = {(m, s): n for m, s, n in duck.execute("SELECT mix_id, source, max_repeats FROM mix_targets").fetchall()}
    for r in Q.QUERIES["p7_mixed"](spark, DATA).collect():
        assert 0 < r.copies <= most[r.mix_id, r.source]
