import gzip
import io
import json
import zipfile

from pyspark.sql import functions as F

from lodescan.evaluate import scores, span_scores
from lodescan.operators.cells import columnar_cells
from lodescan.operators.findings import club_values, clubbed, sheet_of
from lodescan.sources import files
from lodescan.sources.files import parse, read_files
from lodescan.sources.sinks import report_rows, summary_row, write_report
from lodescan.sources.tables import changed_since, limited, plain_item, reader_endpoint, sample_percent, text_fields, user_relations
from lodescan.streaming.adaptive import scan_until_settled, settled
from lodescan.streaming.cdc import CHANGE, change_stream, changed_cells, new_objects, run_stream


def cells(name, data):
    return [(r[5], r[7], r[8]) for r in parse("u", name, data) if r[1] == "cell"]


def blobs(name, data):
    return [(r[8], r[7], r[9]) for r in parse("u", name, data) if r[1] == "blob"]


def test_long_texts_are_read_to_their_end():
    text = "first\n" + "a" * 199_990 + " mail jane.doe@acme-corp.de " + "b" * 300_000 + "\n" + ("x" * 999 + "\n") * 9_000 + "last"
    found = [(r[3], r[7], r[9]) for r in parse("u", "a.log", text.encode()) if r[1] == "blob"]
    assert [x[0] for x in found] == list(range(len(found))) and found[-1][1].endswith("last") and found[-1][2] + found[-1][1].count("\n") == 9_002
    assert any("jane.doe@acme-corp.de" in x[1] and x[2] == 1 for x in found) and "".join(x[1] for x in found).count("b") >= 300_000
    assert sum(x[1].count("x") for x in found) == 9_000 * 999
    assert blobs("b.log", b"one\r\ntwo\n") == [("text", "one\ntwo\n", 0)]


def test_what_an_archive_leaves_out_is_reported(monkeypatch):
    monkeypatch.setattr(files, "ARCHIVE_BYTES", 10)
    rows = list(parse("o.zip", "o.zip", _zip(big_dot_txt="x" * 11, small_dot_txt="hello")))
    assert [(r[0], r[1]) for r in rows] == [("o.zip#big.txt", "error"), ("o.zip#small.txt", "blob")] and "left out" in rows[0][10]
    assert [r[1] for r in parse("u", "big.txt.gz", gzip.compress(b"x" * 11))] == ["error"]
    monkeypatch.undo()
    deep = _zip(a_dot_txt="deep")
    for _ in range(3):
        deep = _zip(in_dot_zip=deep)
    assert [r[1] for r in parse("u", "u.zip", deep)] == ["error"]


def test_delimited():
    assert cells("a.csv", b"name,email\nAnn,a@b.c\nBob,NA\nx,y,z\n") == [("name", "Ann", "Chunk 0, Row 0, Column 'name'"), ("email", "a@b.c", "Chunk 0, Row 0, Column 'email'"),
                                                                    ("name", "Bob", "Chunk 0, Row 1, Column 'name'")]
    assert len(cells("a.tsv", b"a\tb\n1\t2\n")) == 2 and cells("e.csv", b"") == []


def test_json_kinds():
    assert [c[0] for c in cells("a.json", b'[{"email":"x@y.z","p":{"n":[1,null,true]}}]')] == ["email", "p.n[]"]
    assert [c[:2] for c in cells("a.json", b'{"db":{"password":"pw","port":1},"tags":["t"]}')] == [("db.password", "pw"), ("tags[]", "t")]
    assert [c[2] for c in cells("a.jsonl", b'{"u":{"e":"x"}}\n\n{"u":"y"}\n')] == ["Line 1: u.e", "Line 3: u"]
    assert blobs("a.jsonl", b"not json\n") == [("Line 1", "not json", 0)] and blobs("a.json", b"{broken")[0][1] == "{broken"


def test_xml_and_text():
    assert cells("a.xml", b"<r><a>x</a><b> </b><c k='1'>y</c></r>") == [("a", "x", "a"), ("c", "y", "c")]
    assert [r[1] for r in parse("u", "a.xml", b"<!DOCTYPE r [<!ENTITY e 'x'>]><r>&e;</r>")] == ["error"]
    assert blobs("a.log", b"one\r\ntwo") == [("text", "one\ntwo", 0)] and blobs("a.bin", b"\0\1\2") == []
    assert [b[2] for b in blobs("a.txt", b"x\n" * 2500)] == [0, 1000, 2000]


def _zip(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), body)
    return out.getvalue()


def test_office_files_and_archives():
    slide = "<p:sld xmlns:p='p' xmlns:a='http://schemas.openxmlformats.org/drawingml/2006/main'><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:sld>"
    deck = _zip(ppt__slides__slide10_dot_xml=slide.format("ten"), ppt__slides__slide2_dot_xml=slide.format("two"), ppt__notesSlides__notesSlide1_dot_xml=slide.format("n"))
    assert [b[:2] for b in blobs("d.pptx", deck)] == [("Slide 2", "two"), ("Slide 10", "ten"), ("Slide 1 Notes", "n")]
    doc = _zip(word__document_dot_xml="<w:d xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'><w:p><w:r><w:t>hi</w:t></w:r></w:p></w:d>")
    assert blobs("d.docx", doc)[0][1] == "hi"
    s = "xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'"
    book = _zip(xl__workbook_dot_xml=f"<workbook {s}><sheets><sheet name='People'/></sheets></workbook>",
                xl__sharedStrings_dot_xml=f"<sst {s}><si><t>email</t></si><si><t>x@y.z</t></si></sst>",
                xl__worksheets__sheet1_dot_xml=f"<worksheet {s}><sheetData><row><c r='A1' t='s'><v>0</v></c></row><row><c r='A2' t='s'><v>1</v></c></row></sheetData></worksheet>")
    rows = list(parse("b.xlsx", "b.xlsx", book))
    assert rows[0][0] == "b.xlsx [People]" and rows[0][7] == "x@y.z"
    nested = _zip(people_dot_csv="a\n1\n", inner_dot_zip=_zip(docs__notes_dot_txt="hello"))
    assert [r[0] for r in parse("o.zip", "o.zip", nested)] == ["o.zip#people.csv", "o.zip#inner.zip#docs/notes.txt"]
    assert blobs("x.txt.gz", gzip.compress(b"zipped"))[0][1] == "zipped"
    assert [r[1] for r in parse("u", "bad.zip", b"no zip")] == ["error"]


def test_read_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.csv").write_text("email\nx@y.z\n")
    (tmp_path / "b.json").write_text("[1")
    (tmp_path / "empty.txt").write_text("")
    spark.createDataFrame([("s", 1)], "name string, n int").write.parquet(str(tmp_path / "t"))
    rows = read_files(spark, str(tmp_path)).collect()
    assert {(r.kind, r.value) for r in rows if r.value} == {("cell", "x@y.z"), ("blob", "[1"), ("cell", "s")}
    assert read_files(spark, str(tmp_path), since="2999-01-01 00:00:00").count() == 0
    assert read_files(spark, str(tmp_path), glob="*.csv").count() == 1


def test_table_helpers(spark):
    df = spark.range(20).withColumn("ts", F.col("id").cast("timestamp"))
    assert changed_since(df, "ts", "1970-01-01 00:00:10").count() == 9 and changed_since(df, "none", "x").count() == 20
    assert limited(df, 5, "id").count() == 5 and limited(df, 0).count() == 20
    assert sample_percent(100, 150) is None and sample_percent(100, 3000) == 10 and sample_percent(1, 10**9) == 0.01
    assert plain_item({"a": {"S": "x"}, "b": {"M": {"c": {"N": "1"}}}, "d": {"L": [{"NULL": True}]}}) == {"a": "x", "b": {"c": "1"}, "d": [None]}
    assert reader_endpoint("db.cluster-abc.host") == "db.cluster-ro-abc.host"
    cat = spark.createDataFrame([("main", "users", "TABLE"), ("pg_catalog", "x", "TABLE"), ("main", "v", "VIEW")], "table_schema string, table_name string, table_type string")
    assert user_relations(cat, include_views=False).count() == 1 and user_relations(cat, tables=["main.v"]).count() == 1
    assert text_fields(spark.createDataFrame([("a", "Email"), ("b", "double")], "name string, type string")).count() == 1


def test_columnar_cells_of_all_types(spark):
    df = spark.sql("select 1L as id, 'x' as s, true as b, cast('ab' as binary) as y, cast(null as string) as n, '' as e, array(1) as a")
    got = {r.column: r.value for r in columnar_cells(df, "u", "id").collect()}
    assert got == {"id": "1", "s": "x", "b": "True", "y": "ab", "a": "[1]"}
    assert {r.column for r in columnar_cells(df, "u", strings_only=True).collect()} == {"s"}


def test_change_stream(spark, tmp_path):
    record = {"eventName": "INSERT", "eventSourceARN": "arn:t/users/stream/1", "dynamodb": {"NewImage": {"Email": {"S": "x@y.z"}}}}
    folder = tmp_path / "in"
    folder.mkdir()
    gone = {**record, "eventName": "REMOVE"}
    (folder / "1.json").write_text(json.dumps(record) + "\n" + json.dumps(gone) + "\n" + json.dumps({**record, "dynamodb": {}}) + "\n")
    out = str(tmp_path / "out")
    query = run_stream(change_stream(spark, str(folder)), lambda df, _: changed_cells(df).write.mode("append").parquet(out), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert [(r.unit_id, r.column, r.value) for r in spark.read.parquet(out).collect()] == [("arn:t/users", "Email", "x@y.z")]
    assert changed_cells(spark.createDataFrame([], CHANGE)).count() == 0


def test_adaptive_stop(spark):
    assert not settled(1999, 0, []) and settled(2000, 1000, [(0.9, 0.5)]) and not settled(2000, 1000, [(0.52, 0.5)]) and not settled(2000, 1500, [])
    data = spark.range(6000).select(F.col("id").alias("record_ix"), F.lit("c").alias("column"), F.lit("x").alias("value"))
    hits, seen = scan_until_settled(data, lambda part: part.withColumn("detector", F.lit("D")))
    assert seen == 2000 and hits.count() == 2000


def test_adaptive_stop_of_few_records(spark):
    one = spark.createDataFrame([(0, "c", "x")], "record_ix long, column string, value string")
    scan = lambda part: part.withColumn("detector", F.lit("Email")).withColumn("category", F.lit("PII"))
    hits, seen = scan_until_settled(one, scan)
    assert (seen, hits.count()) == (1, 1) and scan_until_settled(one.limit(0), scan)[1] == 0


def test_large_files_are_read_in_splits(spark, tmp_path):
    (tmp_path / "a.csv").write_text("email,n\nx@y.z,\n,2\n")
    (tmp_path / "b.jsonl").write_text('{"a": "v"}\nno json\n')
    (tmp_path / "c.log").write_text("one\n\ntwo\n")
    (tmp_path / "d.xml").write_text("<a>xxxxxxxxxx</a>")
    whole = read_files(spark, str(tmp_path)).where("kind = 'cell'").select("column", "value").collect()
    rows = read_files(spark, str(tmp_path), most_bytes=5).collect()
    assert {(r.column, r.value) for r in rows if r.kind == "cell"} == {tuple(r) for r in whole if r.column != "a" or r.value == "v"}
    assert sorted(r.value for r in rows if r.kind == "blob") == ["no json", "one", "two"]
    assert [r.unit_id.rsplit("/", 1)[1] for r in rows if r.kind == "error"] == ["d.xml"]


def test_rows_and_entities_left_out_are_errors():
    assert [r[1] for r in parse("u", "a.csv", b"a,b\n1,2\n1,2,3\n")] == ["cell", "cell", "error"]
    late = b"<!DOCTYPE r [" + b"<!ELEMENT r ANY>" * 400 + b"<!ENTITY e 'x'>]><r>&e;</r>"
    assert [r[1] for r in parse("u", "a.xml", late)] == ["error"]


def test_notifications(spark):
    event = {"eventName": "s3:ObjectCreated:Put", "s3": {"bucket": {"name": "b"}, "object": {"key": "a+b%2Fc.csv", "size": 3}}}
    bodies = [json.dumps({"Records": [event, {**event, "eventName": "s3:ObjectRemoved:Delete"}]}), json.dumps({"Message": json.dumps({"Records": [event]})}), "no json", None]
    got = new_objects(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()
    assert [(r.bucket, r.key, r.size) for r in got] == [("b", "a b/c.csv", 3)] * 2


def test_scores(spark):
    e = spark.createDataFrame([("A", 1), ("A", 1), ("B", 2)], "d string, v int")
    g = spark.createDataFrame([("A", 1), ("C", 3)], "d string, v int")
    got = {r.d: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in scores(e, g, ["d"]).collect()}
    assert got == {"A": (1, 0, 1, 1.0, 0.5), "B": (0, 0, 1, None, 0.0), "C": (0, 1, 0, 0.0, None)}
    gold = spark.createDataFrame([("r", "MAIL", 0, 10), ("r", "TEL", 20, 30)], "rec string, label string, start_ix int, end_ix int")
    hits = spark.createDataFrame([("r", "Email", 0, 9, 2)], "rec string, detector string, start_ix int, end_ix int, tier int")
    assert {r.label: r.found for r in span_scores(gold, hits, "rec", ["label"]).collect()} == {"MAIL": 1, "TEL": 0}


def test_report(spark, tmp_path):
    schema = "unit_id string, detector string, category string, value string, location string, seq long, tier int"
    f = spark.createDataFrame([("b.xlsx [P]", "Email", "PII", "x@y.z", "l1", 1, 1), ("b.xlsx [P]", "Email", "PII", "x@y.z", "l2", 2, 2)], schema)
    units = spark.createDataFrame([("b.xlsx [P]",), ("clean",)], "unit_id string")
    long = f.withColumn("value", F.when(F.col("seq") == 1, F.lit("a" * 300 + "1")).otherwise("a" * 300 + "2"))
    write_report(report_rows(units, clubbed(long)), str(tmp_path / "l"), club_values(long))
    assert {len(r.value) for r in spark.read.json(str(tmp_path / "l" / "values")).collect()} == {301}
    assert summary_row(report_rows(units, clubbed(f))).first().asDict() == {"files_scanned": 2, "with_findings": 1, "failed": 0, "total_count": 2}
    write_report(report_rows(units, clubbed(f)), str(tmp_path / "r"))
    rows = {r.unit_id: r for r in spark.read.json(str(tmp_path / "r")).collect()}
    assert rows["clean"].findings == [] and rows["b.xlsx [P]"].sheet == "P" and rows["b.xlsx [P]"].findings[0].total_count == 2
    thing, sheet = sheet_of(F.lit("x"))
    assert spark.range(1).select(thing, sheet).first()[1] is None
