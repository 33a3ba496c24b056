import re
import unicodedata
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodescan.llm import language as LG
from lodescan.llm import lookalike as LK
from lodescan.llm import pii as P
from lodescan.llm import pii_synthetic as SY
from lodescan.llm.pii_patterns import flattened, matches

FORMS = [
    ("Åsledspire Offices Ltd", "Åsleds­pire Offiсеs Ltd"), ("velvetpoint-ledger-v19", "ｖｅｌｖｅｔｐｏｉｎｔ－ｌｅｄｇｅｒ－ｖ１９"),
    ("Project Fjällvale-78", unicodedata.normalize("NFD", "Project Fjällvale‑78")), ("office file", "oﬃce ﬁle"), ("Ромашка ООО", "Ромашка OOO"),
]
DIFFERENT = [("Renéová", "Reneová"), ("Ltd", "LTD"), ("v1", "vl"), ("abc", "ab"), ("Zürn", "Zurn"), ("O", "0")]


@pytest.mark.parametrize("a,b", FORMS)
def test_same_look(spark, a, b):
    rows = spark.createDataFrame([(a,), (b,)], "v string")
    assert len({r.canonical for r in LK.canonical_members(rows, "v").collect()}) == 1
    assert LK.folded(a) == LK.folded(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_other_look(spark, a, b):
    rows = spark.createDataFrame([(a,), (b,)], "v string")
    assert len({r.canonical for r in LK.canonical_members(rows, "v").collect()}) == 2


def test_canonicalised_keeps_rows_and_names(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "а", "y"), (3, None, "z"), (4, "", "w"), (5, "​", "q")], "id int, v string, canonical string")
    got = {r.id: r.canonical for r in LK.canonicalised(df, "v").collect()}
    assert got == {1: "a", 2: "a", 3: None, 4: "", 5: ""}
    assert LK.canonicalised(df.limit(0), "v").count() == 0


def test_lookalikes_against_brute_force(spark):
    refs = [(1, "acme-v1"), (2, "Zoë Müller"), (3, "аcme-v1"), (4, None)]
    cells = [(1, "acme-v1"), (2, "аcme-v1"), (3, "acme-v2"), (4, None), (5, ""), (2, "аcme-v1")]
    texts = [(7, "see асme-v1, then xacme-v1 and acme-v11"), (8, unicodedata.normalize("NFD", "by Zoë Müller.")), (9, None), (10, "Zoë Müllers"), (11, "w " * 200_000 + "ac​me-v1")]
    make = lambda rows, s: spark.createDataFrame(rows, s)
    got = {tuple(r) for r in LK.lookalikes(make(cells, "i long, v string"), "i", "v", make(texts, "i long, t string"), "i", "t", make(refs, "r long, v string"), "r", "v").collect()}
    assert got == {("cell", 1, 3), ("cell", 2, 1), ("blob", 7, 1), ("blob", 7, 3), ("blob", 8, 2), ("blob", 11, 1), ("blob", 11, 3)}


def spans(text):
    return {(text[s:e], kind) for s, e, kind, _ in P.entities([text], P.trained())[0]}


@pytest.mark.parametrize("text,expected", [
    ("Spoke with Jörg Luntquist; callback +1 938 555 0192.", {("Jörg Luntquist", "NAME"), ("+1 938 555 0192", "PHONE")}),
    ("According to Divya Harrowsson's manager the record at 10.39.100.6 holds NIF 00467198E.", {("Divya Harrowsson", "NAME"), ("00467198E", "ID_NUMBER")}),
    ("Ship the drive to Wyrley, Lena, 53 Tarnholt Street, Suite 138, Roehaven, ME 02830.", {("Wyrley, Lena", "NAME"), ("53 Tarnholt Street, Suite 138, Roehaven, ME 02830", "ADDRESS")}),
    ("write yara-oskf [at] mail [dot] ravworth [dot] invalid today", {("yara-oskf [at] mail [dot] ravworth [dot] invalid", "EMAIL")}),
    ("Pinned lib@5.4.8 in the worker image. Cluster Petra-3153 restarted twice.", set()), ("The Lindwood Street dataset has 5881 columns.", set()),
    ("Order 5065-81-8186 shipped on 09.09.2017, tracking 719649805680.", set()), ("Kind regards,\nLena Wyryan\nWyresen Textiles S.A.\n01 99 00 04 83", {("Lena Wyryan", "NAME"), ("01 99 00 04 83", "PHONE")}),
    ("", set()), ("?!", set()),
])
def test_personal_data(text, expected):
    assert spans(text) == expected


@pytest.mark.parametrize("text,expected", [
    ("The scanner kept travel document (passport) QY0056408 and 0060 2536 1711 from page 5236.", {"QY0056408", "0060 2536 1711"}),
    ("Her identity number, 44051401458, was on the form.", {"44051401458"}), ("He presented PESEL: 08960142782 and 9998321122 at the desk.", {"08960142782", "9998321122"}),
    ("We verified SSN 939 33 6161, 0402 9153 9829 and 00632684-T today.", {"939 33 6161", "0402 9153 9829", "00632684-T"}),
    ("The column ref holds T95973205, KX-5598-16 and T05034745.", set()), ("Ticket T98765432 was closed.", set()),
])
def test_identity_numbers_without_label(text, expected):
    assert spans(text) == {(v, "ID_NUMBER") for v in expected}


def test_places_refer_to_the_text_as_written(spark):
    text = "mail: vossd᠎ottir᠎54@inverara‌m-analytics.test, tel 0770​0 900741"
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, None, "y"), (3, "", "z")], "id int, body string, value string")
    got = {(r.id, r.pii_type, r.value) for r in P.find_personal_data(df.drop("value"), ["id"], "body").collect()}
    assert got == {(1, "EMAIL", "vossd᠎ottir᠎54@inverara‌m-analytics.test"), (1, "PHONE", "0770​0 900741")}
    red = {r.id: r.redacted for r in P.redact(df, "body").collect()}
    assert red == {1: "mail: [EMAIL], tel [PHONE]", 2: None, 3: ""}


def test_long_text_is_read_to_its_end():
    text = "No address was given. " * 20_000 + "Spoke with Jörg Luntquist; callback +1 938 555 0192."
    found = spans(text)
    assert ("Jörg Luntquist", "NAME") in found and ("+1 938 555 0192", "PHONE") in found


def labelled(path):
    """Lines with their entities marked as in the file."""
    out = []
    for line in path.read_text(encoding="utf-8").splitlines():
        text, known = "", []
        for piece in re.split("(⟦[^⟧]+⟧)", line):
            kind, _, value = piece[1:-1].partition(":") if piece.startswith("⟦") else ("", "", piece)
            known += [(len(text), len(text) + len(value), kind)] if kind else []
            text += value
        out.append((text, known))
    return out


def test_plain_prose():
    """Sentences written for this test, about people and things no template speaks of."""
    made = labelled(Path(__file__).parent / "prose.txt")
    recall, precision = P.agreement(made, P.entities([t for t, _ in made], P.trained()))
    assert recall >= 0.9 and precision >= 0.9, (recall, precision)


def test_held_out_templates():
    made = list(SY.texts({}, 400, 31, held_out=True))
    recall, precision = P.agreement(made, P.entities([t for t, _ in made], P.trained()))
    assert recall >= 0.9 and precision >= 0.9, (recall, precision)


def test_made_texts_know_their_spans():
    for text, known in SY.texts({"full_name": ["Ada Byron"], "phone": ["+44 20 7946 0000"]}, 200, 4, held_out=False):
        assert all(0 <= a < z <= len(text) and text[a:z] == text[a:z].strip() for a, z, _ in known)
        assert all(x[1] <= y[0] for x, y in zip(known, known[1:]))
    fit, held = SY.templates(False), SY.templates(True)
    assert not set(fit[0]) & set(held[0]) and not set(fit[1]) & set(held[1]) and len(held[0]) > 20


def test_ties_carry_labels():
    # clear in one place, said in passing in the other
    text = "Dear Mr Vaclav Hrubosz, thank you. Hrubosz 17 is a number of rows."
    b = P.Batch([text], P.trained())
    assert [[b.tokens[i] for i in t] for t in b.ties] == [["Hrubosz", "Hrubosz"]]
    i = b.ties[0, 1]
    names = [P.LABELS.index("B-NAME"), P.LABELS.index("I-NAME")]
    assert P.beliefs(b)[0][i, names].sum() > P.beliefs(b, ties=False)[0][i, names].sum()


def test_ties_do_not_cross_texts():
    assert len(P.Batch(["Vaclav Hrubosz", "Hrubosz 17"], P.trained()).ties) == 0
    texts = ["Name: Ada Byron", "", None, "call +44 20 7946 0123", "x" * 5000, "Ada Byron"]
    assert P.entities(texts, P.trained()) == [P.entities([t], P.trained())[0] for t in texts]


def test_message_passing_is_exact_on_a_chain():
    import itertools

    model = P.trained()
    b = P.Batch(["Jörg Luntquist +1"], model)
    unary = b.unary()
    total = np.zeros_like(unary, dtype=np.float64)
    for labels in itertools.product(range(P.K), repeat=b.n):
        score = sum(float(unary[i, y]) for i, y in enumerate(labels)) + sum(float(model.transition[x, y]) for x, y in zip(labels, labels[1:]))
        for i, y in enumerate(labels):
            total[i, y] += np.exp(score)
    assert b.n == 4 and np.allclose(P.beliefs(b)[0], total / total.sum(axis=1, keepdims=True), atol=1e-4)


def test_forms_stay_within_their_text():
    b = P.Batch(["tel 020 7946", "0303 and Flat 9, 18 Quillbridge Crescent"], P.trained())
    found = matches(b.joined, b.start, b.model.begins[b.ids])
    assert found["english"] == [(b.joined.index("Flat"), len(b.joined))] and not found["national"]


EN = "The scan reads every folder twice. The owner reviews the old list before the release. "
DE = "Der Lauf prüft jede Zeile ohne Eigentümer. Die Verbindung löscht den alten Ordner nach der Freigabe. "


def test_languages():
    profiles = LG.Profiles(LG.trained())
    assert [(s[0], s[3]) for s in LG.stretches(EN + DE + "[12:07:28] cosmos/support.people 0x32141262\n" + DE, profiles)] == [(0, "en"), (1, "de")]
    text = "The scan (\"jede Zeile ohne Eigentümer\") reads every folder. It reads the list twice before the release."
    assert [s[3] for s in LG.stretches(text, profiles)] == ["en"]
    assert LG.stretches("", profiles) == [] and LG.stretches(None, profiles) == [] and LG.stretches("12:30\nunit=pg/main.leads rows=1 ms=2", profiles) == []
    assert [s[3] for s in LG.stretches(EN.upper(), profiles)] == ["en"]
    (seg,) = LG.stretches("  " + EN, profiles)
    assert (seg[1], seg[2]) == (2, len("  " + EN.rstrip())) and 0.5 < seg[4] <= 1
    assert len(LG.stretches(EN * 20_000, profiles)) == 1


def test_held_out_accuracy(spark):
    """Sentences of labelled documents the prototypes were not fitted on."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) between 300 and 2000")
    got = LG.document_languages(df, "doc_id", "text").join(df.select("doc_id", LG.label_language(F.col("lang")).alias("label")), "doc_id").where("label is not null and languages = 1")
    share = got.agg(F.avg((F.col("lang_code") == F.col("label")).cast("int"))).first()[0]
    assert share > 0.85  # about a twelfth of the labels is wrong


def test_labels(spark):
    rows = [("en_GB", "en"), (" English ", "en"), ("dut", "nl"), ("fr-CA", "fr"), ("", None), ("-", None), ("und", None), (None, None), ("zxx", None), ("JA", "ja"), ("n/a", None)]
    df = spark.createDataFrame([(a, b) for a, b in rows], "a string, b string")
    assert all(r[0] == r[1] for r in df.select(LG.label_language(F.col("a")), "b").collect())


def test_mislabelled_rows(spark):
    df = spark.createDataFrame([(1, EN, "en", 0), (2, EN, None, 0), (3, EN, "de", 0), (4, EN + DE, "en", 0), (5, None, None, 0), (6, "12:30", "", 0)], "id int, t string, lang string, seg_ix int")
    got = {(r.id, r.seg_ix, r.lang_code) for r in LG.mislabelled(df, "id", "t", "lang").collect()}
    assert got == {(2, 0, "en"), (3, 0, "en"), (4, 0, "en"), (4, 1, "de")}
    assert LG.mislabelled(df.limit(0), "id", "t", "lang").count() == 0


def test_every_document_has_a_row(spark):
    df = spark.createDataFrame([(1, EN), (2, None), (3, ""), (4, "12:30 17"), (5, EN + DE * 2), (6, "昨天我去商店买了一些面包做晚饭。"), (7, "Χθες πήγα στο μαγαζί και αγόρασα ψωμί για το βραδινό.")], "i int, t string")
    got = {r.i: (r.lang_code, r.languages) for r in LG.document_languages(df, "i", "t").collect()}
    assert got == {1: ("en", 1), 2: ("und", 0), 3: ("und", 0), 4: ("und", 0), 5: ("de", 2), 6: ("und", 0), 7: ("und", 0)}
    assert LG.document_languages(df.limit(0), "i", "t").count() == 0


def test_mapping_is_the_same_in_the_engine_and_in_texts(spark):
    """Every character of the mapping, also those that stand for several others."""
    df = spark.createDataFrame([(c, f"a{c}b") for c in LK.mapping()], "c string, v string").select("c", "v", LK.mapped(F.col("v")).alias("m"))
    wrong = [r.c for r in df.collect() if unicodedata.normalize("NFD", r.m) != unicodedata.normalize("NFD", f"a{LK.mapping()[r.c]}b")]
    assert not wrong


def test_references_in_shards(spark, monkeypatch):
    make = lambda rows, s: spark.createDataFrame(rows, s)
    refs = make([(i, f"acme-v{i}") for i in range(12)], "r long, v string")
    args = (make([(1, "аcme-v3")], "i long, v string"), "i", "v", make([(7, "see асme-v1, and асme-v11.")], "i long, t string"), "i", "t", refs, "r", "v")
    whole = {tuple(r) for r in LK.lookalikes(*args).collect()}
    monkeypatch.setattr(LK, "SHARD_BYTES", 20)
    assert len(LK.reference_shards(refs, "v")) > 3
    assert {tuple(r) for r in LK.lookalikes(*args).collect()} == whole == {("cell", 1, 3), ("blob", 7, 1), ("blob", 7, 11)}


def test_vectors_of_orders_differ():
    import numpy as np

    a, b = LG.bundle("abcabc"), LG.bundle("cbacba")
    assert abs(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 0.5 and np.array_equal(a, LG.bundle("abcabc"))


def test_short_stretches_of_close_languages_are_kept():
    """Two sentences whose summed lead in cosine is under the full price of a change, over that of this pair."""
    profiles = LG.Profiles(LG.trained())
    es, pt, ru = (LG.LANGUAGES.index(x) for x in ("es", "pt", "ru"))
    assert profiles.price[es, pt] < LG.CHANGE / 2 and profiles.price[es, ru] == LG.CHANGE and np.allclose(profiles.price.diagonal(), 0, atol=1e-4)
    scores = np.zeros((8, len(LG.LANGUAGES)))
    scores[:, pt], scores[3:5, es] = 20, 22.5
    assert LG.best_path(scores, profiles.price).tolist() == [pt] * 3 + [es] * 2 + [pt] * 3
    scores[:, ru], scores[:, pt] = scores[:, pt], 0
    assert LG.best_path(scores, profiles.price).tolist() == [ru] * 8


def test_machine_text_ends_at_japanese_characters():
    text = "担当者は毎週3回すべての記録を確認しています。古い一覧はlogs/a.txtに保存されています。"
    assert [(s, e) for s, e, _ in LG.sentences(text)] == [(0, 23), (23, len(text))]
    assert LG.sentences("担当者は毎週3回すべての記録を確認しています。")[0][2] == "担当者は毎週 回すべての記録を確認しています"
    assert [w for _, _, w in LG.sentences("See logs/aé.txt before the next release.")] == ["see before the next release"]
    inside = LG.stretches(EN + "この接続はしきい値が低いのに文脈のない記録を報告しました。" + "古い索引は前回の公開以来文3脈のない記録を移しました。\\n" + EN, LG.Profiles(LG.trained()))
    assert [s[3] for s in inside] == ["en", "ja", "en"]
