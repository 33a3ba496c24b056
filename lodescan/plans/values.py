"""Queries on single values: checks, shapes, candidates that the engine's own expressions can find, and the full scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodescan.engine.credentials import credentials
from lodescan.engine.money import COUNTRIES, HEALTH_WORDS, NO_BANK_CODE
from lodescan.engine.personal import DEMO_DOMAINS, DEMO_ENDINGS, NOBODY, ORGANISATION_ENDS, ROLE_OPENINGS, ROLES, SINGLE
from lodescan.engine.reading import Reading
from lodescan.engine.fields import HINTS, field_table
from lodescan.engine.scan import ScanConfig, find_candidates, without_overlaps
from lodescan.engine.tiers import rank_name
from lodescan.functions import native as N
from lodescan.operators.cells import columnar_cells, document_cells, values_seen
from lodescan.operators.findings import classify
from lodescan.plans.names import described, words_of
from lodescan.runtime import latest, ship, spread, table

WORKER_REGIONS = ("US", "IN", "GB")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "text_blobs"), ["blob_id"], F.col("loaded_at")).where("text is not null")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "cells"), ["cell_id"], F.col("loaded_at")).where("cell_value <> ''")


def _found(df: DataFrame, text: str, pattern: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.explode(F.expr(f"regexp_extract_all({text}, '{pattern}', 1)")).alias("value"))


def customer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = columnar_cells(table(spark, sf_dir, "customer"), "customer", "c_custkey", strings_only=True)
    return cells.groupBy("column").agg(F.count("*").alias("cells"), F.count_distinct("value").alias("distinct_values"))


def flatten_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = document_cells(table(spark, sf_dir, "events").select("event_id", "props"), ["event_id"], "props")
    return cells.select("event_id", "column", "field", "value")


def card_luhn_iin(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).select("cell_id", N.digits_only(F.col("cell_value")).alias("number")).where(F.length("number").between(13, 19))
    return cells.select("cell_id", "number", N.luhn(F.col("number")).alias("luhn"), N.card_network(F.col("number")).alias("network"))


def ipv4_public_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(_texts(spark, sf_dir), "text", r"(?:^|[^0-9.])((?:[0-9]{1,3}[.]){3}[0-9]{1,3})", "blob_id")
    return found.groupBy("value").agg(F.count("*").alias("n")).select("value", "n", N.private_ipv4(F.col("value")).alias("private"))


def email_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).where(F.col("cell_value").rlike("^[^@ ]*@[^@ ]*$"))
    reason = N.email_reason(F.col("cell_value"), DEMO_ENDINGS, sorted(DEMO_DOMAINS))
    return cells.groupBy(F.coalesce(reason, F.lit("fine")).alias("reason")).agg(F.count("*").alias("n"))


def phone_intl_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(_texts(spark, sf_dir), "text", r"([+][1-9][0-9 ().-]{6,18}[0-9])", "blob_id")
    return found.groupBy("value").agg(F.count("*").alias("n"))


def token_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(_texts(spark, sf_dir), "text", "[Cc]hecksum ([0-9a-f]{16,64})", "blob_id")
    return found.select("blob_id", "value", F.length("value").alias("length"))


def entropy_of_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(_texts(spark, sf_dir), "text", "[Cc]hecksum ([0-9a-f]{16,64})", "blob_id").select("value").distinct()
    return found.select("value", F.round(N.entropy(F.col("value")), 4).alias("bits"))


ASSIGNED = ("OAuth Token", "API Key", "Bearer Token")


def key_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value assigned to a key of an interface, an OAuth or a bearer token in the texts, by the detectors' own patterns and shape test."""
    return assigned(_texts(spark, sf_dir).select("blob_id", "text"), "text").select("blob_id", "detector", "value", F.length("value").alias("length"))


def assigned(df: DataFrame, text: str) -> DataFrame:
    ship(df.sparkSession)

    @F.udf("array<struct<detector:string,value:string>>")
    def found(t: str) -> list[tuple[str, str]]:
        hits = [h for h in credentials(Reading(t)) if h.detector in ASSIGNED and not h.encoded]
        return [(h.detector, h.value) for h in without_overlaps(hits)]

    rest = [c for c in df.columns if c != text]
    return spread(df).where(F.col(text).isNotNull()).select(*rest, found.asNondeterministic()(text).alias("_found")).select(*rest, F.inline("_found"))


def opaque_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of every different opaque run of 20 or more characters in the texts."""
    found = _found(_texts(spark, sf_dir), "text", "([A-Za-z0-9/+=_~-]{20,})", "blob_id").select("value").distinct()
    return found.select("value", F.round(N.entropy(F.col("value")), 4).alias("bits"))


def fingerprint_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("cell_id", N.fingerprint(F.col("cell_value")).alias("value_hash"))


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every different run of digits and of letters with digits in texts and cells, separators left out."""
    runs = _found(_texts(spark, sf_dir), "text", "([A-Z]{0,2}[0-9][0-9A-Z .-]{4,30}[0-9A-Z])").select("value")
    cells = _cells(spark, sf_dir).select(F.col("cell_value").alias("value"))
    return runs.unionByName(cells).select(F.upper(F.regexp_replace("value", "[^0-9A-Za-z]", "")).alias("value")).where(F.length("value").between(6, 34)).distinct()


def luhn_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(spark, sf_dir).where(F.col("value").rlike("^[0-9]+$")).select("value", N.luhn(F.col("value")).alias("ok"))


def iban_mod97(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remainders of everything that is written like an account number, and of numbers with the country and check digits of none."""
    v = _numbers(spark, sf_dir)
    made = v.where(F.col("value").rlike("^[0-9]{10,20}$")).select(F.concat(F.lit("DE"), F.substring("value", 1, 20)).alias("value"))
    return v.unionByName(made).distinct().select("value", N.iban_mod97(F.col("value")).alias("ok"))


def aba_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _numbers(spark, sf_dir).where(F.col("value").rlike("^[0-9]{9,}$")).select(F.substring("value", 1, 9).alias("value")).distinct()
    return v.select("value", N.weighted_check(F.col("value"), [3, 7, 1] * 3, 10).alias("ok"))


def verhoeff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(spark, sf_dir).where(F.col("value").rlike("^[0-9]+$")).select("value", N.verhoeff(F.col("value")).alias("ok"))


def filler_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    raw = _found(_texts(spark, sf_dir), "text", "([0-9][0-9 .-]{4,20}[0-9])").select("value")
    raw = raw.unionByName(_cells(spark, sf_dir).select(F.col("cell_value").alias("value")).where(v.rlike("^[0-9][0-9 .-]*$"))).distinct()
    return raw.select("value", N.repeated_digits(v).alias("filler"), N.like_epoch(v).alias("epoch"))


def text_line_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _texts(spark, sf_dir).where("text like '%@%'")
    start = F.instr("text", "@") - 1
    return t.select("blob_id", N.line_of(F.col("text"), start).alias("line"), N.column_of(F.col("text"), start).alias("col"))


def healthcare_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("blob_id", N.keyword_count(F.col("text"), HEALTH_WORDS).alias("n")).where("n > 0")


def field_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _cells(spark, sf_dir).select(F.col("cell_key").alias("column"))
    t = field_table(keys)
    return t.select("column", "words", "kind", "counter", F.concat_ws(",", "hints").alias("hints"))


def scan_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit in the cells, all packs of the worker's regions."""
    cells = _cells(spark, sf_dir).select("cell_id", "unit_id", F.col("cell_key").alias("field"), F.col("cell_value").alias("value"))
    hits = find_candidates(cells, config=ScanConfig(regions=WORKER_REGIONS))
    return hits.select("cell_id", "unit_id", "field", "detector", "value", "score", "start_ix", "end_ix", rank_name(F.col("tier")).alias("tier"), "value_hash")


def scan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = find_candidates(_texts(spark, sf_dir).select("blob_id", F.col("text").alias("body")), "body", None, ScanConfig(regions=WORKER_REGIONS))
    place = N.line_of(F.col("body"), F.col("start_ix"))
    return hits.select("blob_id", "detector", "value", "score", rank_name(F.col("tier")).alias("tier"), place.alias("line"))


def _hits_in_cells(spark: SparkSession, sf_dir: str, *detectors: str) -> DataFrame:
    cells = _cells(spark, sf_dir).select("cell_id", F.col("cell_key").alias("field"), F.col("cell_value").alias("value"))
    return find_candidates(cells, config=ScanConfig(regions=WORKER_REGIONS, only=frozenset(detectors)))


def scan_name_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the cells of name fields, by the scan restricted to them."""
    return _hits_in_cells(spark, sf_dir, "PII.PersonName").where("field_hint").select("cell_id", "value", "score")


def scan_social_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Social security numbers in the cells, with the scores that their form and their field give them."""
    return _hits_in_cells(spark, sf_dir, "US SSN").select("cell_id", "value", "score")


CHECKED = ("UK_NHS", "US_NPI", "GB_UTR")


def scan_checked_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of three kinds with check digits in the cells; where one number is of two kinds the one of higher standing counts."""
    return _hits_in_cells(spark, sf_dir, *CHECKED).select("cell_id", "detector", "value", "score")


def scan_bank_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank codes in the texts."""
    texts = _texts(spark, sf_dir).select("blob_id", F.col("text").alias("body"))
    return find_candidates(texts, "body", None, ScanConfig(only=frozenset({"SWIFT/BIC"}))).select("blob_id", "value", "score")


def scan_addresses_of_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail addresses in texts and cells that belong to people, or may."""
    texts = _texts(spark, sf_dir).select(F.lit("blob").alias("src"), F.col("blob_id").alias("row_id"), F.lit("").alias("field"), F.col("text").alias("body"))
    cells = _cells(spark, sf_dir).select(F.lit("cell").alias("src"), F.col("cell_id").alias("row_id"), F.coalesce("cell_key", F.lit("")).alias("field"), F.col("cell_value").alias("body"))
    hits = find_candidates(texts.unionByName(cells), "body", "field", ScanConfig(only=frozenset({"Email"}), decode_base64=False))
    return hits.select("src", "row_id", "value", (F.col("score") < 0.8).alias("no_person"))


def place_in_unit(record_ix: Column, cell_ix: Column, hit_ix: Column) -> Column:
    """Order of a hit in its unit: record, cell, hit. Any long and two ints fit without sharing digits."""
    whole = "decimal(38,0)"
    record = record_ix.cast("decimal(19,0)") * F.lit(10**9).cast("decimal(10,0)") * F.lit(10**10).cast("decimal(11,0)")
    return (record.cast(whole) + (F.coalesce(cell_ix, F.lit(0)).cast("decimal(10,0)") * F.lit(10**9).cast("decimal(10,0)") + hit_ix).cast(whole)).cast(whole)


def classify_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From cells to findings: scan, profiles, verdicts, promotions, aggregation."""
    cells = _cells(spark, sf_dir).select(
        "unit_id", F.coalesce("record_ix", F.lit(0)).alias("record_ix"), "cell_ix", F.coalesce("cell_key", F.lit("")).alias("column"),
        F.coalesce("field_path", F.lit("")).alias("field"), F.regexp_extract(F.coalesce("field_path", F.lit("")), r"(?s)^(.*)\.[^.]*$", 1).alias("scope"),
        F.col("cell_id").cast("string").alias("cell_id"), F.col("cell_value").alias("value"), F.col("cell_location").alias("location"),
    )
    hits = find_candidates(cells, config=ScanConfig(regions=WORKER_REGIONS)).drop("cell_value", "field", "field_hint", "score")
    hits = hits.withColumn("seq", place_in_unit(F.col("record_ix"), F.col("cell_ix"), F.col("hit_ix"))).drop("cell_ix", "hit_ix")
    columns = cells.select("unit_id", "column").distinct()
    rows = classify(hits, values_seen(cells), columns.join(field_table(columns), "column"))
    return rows.select("unit_id", "column", "detector", "value", rank_name(F.col("tier")).alias("tier"), "location", "aggregated", "occurrences")


QUERIES = {f.__name__: f for f in (
    customer_cells, flatten_json_props, card_luhn_iin, ipv4_public_private, email_reason, phone_intl_candidates, token_assignment, entropy_of_tokens, key_assignments, opaque_entropy,
    fingerprint_values, luhn_validator, iban_mod97, aba_checksum, verhoeff, filler_numbers, text_line_locator, healthcare_keywords, field_words,
    scan_cells, scan_texts, scan_name_fields, scan_social_numbers, scan_checked_numbers, scan_bank_codes, scan_addresses_of_mail, classify_cells,
)}
_T = "WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY loaded_at DESC) AS rn FROM text_blobs) WHERE rn = 1 AND text IS NOT NULL) "
_C = "WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC) AS rn FROM cells) WHERE rn = 1 AND cell_value <> '') "
_LUHN = ("list_sum(list_transform(range(1, length({0})::BIGINT + 1), lambda i: CASE WHEN (length({0}) - i) % 2 = 0 THEN substr({0}, i, 1)::INT "
         "WHEN substr({0}, i, 1)::INT > 4 THEN substr({0}, i, 1)::INT * 2 - 9 ELSE substr({0}, i, 1)::INT * 2 END)) % 10 = 0")


# the check's two tables by rule: products in the symmetries of a pentagon, and the eight powers of its permutation
_VERHOEFF_PRODUCTS = "".join(str((a + b) % 5 if a < 5 and b < 5 else 5 + (a + b - 5) % 5 if a < 5 else 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5) for a in range(10) for b in range(10))
_POWERS = [list(range(10))]
for _ in range(7):
    _POWERS.append([_POWERS[-1][x] for x in (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)])
_VERHOEFF_PLACES = "".join(str(x) for row in _POWERS for x in row)
_IBAN_FORM = "[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"
_NUMBERS = """, n AS (SELECT DISTINCT upper(regexp_replace(v, '[^0-9A-Za-z]', '', 'g')) AS value FROM (
    SELECT unnest(regexp_extract_all(text, '([A-Z]{0,2}[0-9][0-9A-Z .-]{4,30}[0-9A-Z])', 1)) AS v FROM t
    UNION ALL SELECT cell_value FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC) AS rn FROM cells) WHERE rn = 1 AND cell_value <> '')
    WHERE length(regexp_replace(v, '[^0-9A-Za-z]', '', 'g')) BETWEEN 6 AND 34) """
_DEMO = " OR ".join(f"ends_with(dom, '{e}')" for e in DEMO_ENDINGS) + " OR dom IN (" + ", ".join(f"'{x}'" for x in sorted(DEMO_DOMAINS)) + ")"
_KEYS = "SELECT DISTINCT coalesce(cell_key, '') AS name FROM cells"
_CELLS_NAMED = words_of(_KEYS) + described(HINTS) + """, c AS (SELECT cell_id, coalesce(cell_key, '') AS name, cell_value AS v FROM
    (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC) AS rn FROM cells) WHERE rn = 1 AND cell_value <> ''),
    n AS (SELECT c.*, words, kind, counter FROM c JOIN words USING (name) JOIN kinds USING (name))"""
# a number that fields of identifiers and counters keep from being reported, one repeated or running, and one that is a time
_PLAIN = "regexp_full_match(value, '[A-Za-z0-9]{1,16}|[0-9][0-9 .-]{4,20}[0-9]')"
_LINE = "regexp_replace(value, '[^0-9]', '', 'g')"
_FILLER = f"""(len(list_filter(regexp_split_to_array(value, '[^0-9]+'), lambda g: g <> '' AND replace(g, g[1], '') <> '')) = 0 OR contains('01234567890123456789', {_LINE}) OR contains('98765432109876543210', {_LINE}))"""
_TIME = "(regexp_full_match(value, '[0-9]{10}') AND TRY_CAST(value AS BIGINT) BETWEEN 1300000000 AND 2200000000)"
_FOUR = "|".join(c + "{4}" for c in "abcdefghijklmnopqrstuvwxyz")


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words))


def _digit_sum(weights: list[int], line: str = _LINE) -> str:
    return "(" + " + ".join(f"{w} * substr({line}, {i + 1}, 1)::INT" for i, w in enumerate(weights) if w) + ")"


_WORD_COUNT = " + ".join(f"regexp_matches(' ' || lower(text) || ' ', '[^a-z0-9_]{w}[^a-z0-9_]')::INT" for w in HEALTH_WORDS)
ORACLES = {
    "customer_cells": """SELECT 'c_name' AS "column", count(*) AS cells, count(DISTINCT c_name) AS distinct_values FROM customer WHERE c_name <> ''
        UNION ALL SELECT 'c_mktsegment', count(*), count(DISTINCT c_mktsegment) FROM customer WHERE c_mktsegment <> ''""",
    "flatten_json_props": """SELECT event_id, e.key AS "column", e.key AS field, CAST(json_extract_string(props, '$.' || e.key) AS VARCHAR) AS value FROM events, json_each(props) e""",
    "card_luhn_iin": _C + f"""SELECT cell_id, number, {_LUHN.format('number')} AS luhn,
        CASE WHEN number[1] = '4' THEN CASE WHEN length(number) IN (13, 16, 19) THEN 'visa' END
          WHEN number[1:2]::INT IN (34, 37) THEN CASE WHEN length(number) = 15 THEN 'amex' END
          WHEN number[1:2]::INT BETWEEN 51 AND 55 OR number[1:4]::INT BETWEEN 2221 AND 2720 THEN CASE WHEN length(number) = 16 THEN 'mastercard' END
          WHEN number[1:4]::INT = 6011 OR number[1:2]::INT = 65 OR number[1:3]::INT BETWEEN 644 AND 649 THEN CASE WHEN length(number) IN (16, 19) THEN 'discover' END
          WHEN number[1:2]::INT = 35 THEN CASE WHEN length(number) IN (16, 19) THEN 'jcb' END
          WHEN number[1:2]::INT IN (81, 82, 60, 50) THEN CASE WHEN length(number) = 16 THEN 'rupay' END
          WHEN number[1:2]::INT IN (36, 38, 39) OR number[1:3]::INT BETWEEN 300 AND 305 THEN CASE WHEN length(number) IN (14, 16, 19) THEN 'diners' END
          WHEN number[1:2]::INT = 62 THEN CASE WHEN length(number) BETWEEN 16 AND 19 THEN 'unionpay' END END AS network
        FROM (SELECT cell_id, regexp_replace(cell_value, '[^0-9]', '', 'g') AS number FROM c) WHERE length(number) BETWEEN 13 AND 19""",
    "ipv4_public_private": _T + """, f AS (SELECT unnest(regexp_extract_all(text, '(?:^|[^0-9.])((?:[0-9]{1,3}[.]){3}[0-9]{1,3})', 1)) AS value FROM t),
        g AS (SELECT value, count(*) AS n, split_part(value, '.', 1)::INT AS a, split_part(value, '.', 2)::INT AS b FROM f GROUP BY value)
        SELECT value, n, a IN (0, 10, 127) OR a >= 224 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) AS private FROM g""",
    "email_reason": _C + f""", e AS (SELECT regexp_extract(cell_value, '^(.*)@[^@]*$', 1) AS local, lower(regexp_extract(cell_value, '@([^@]*)$', 1)) AS dom
        FROM c WHERE regexp_full_match(cell_value, '[^@ ]*@[^@ ]*'))
        SELECT CASE WHEN local = '' OR dom = '' THEN 'malformed' WHEN {_DEMO} THEN 'demo'
          WHEN len(list_filter(string_split(dom, '.')[:-2], lambda x: regexp_full_match(x, '[0-9-]+'))) > 0 THEN 'numeric-label'
          WHEN NOT regexp_matches(local, '[A-Za-z]') THEN 'no-letter'
          WHEN contains(local, '..') OR starts_with(local, '.') OR ends_with(local, '.') THEN 'malformed' ELSE 'fine' END AS reason, count(*) AS n FROM e GROUP BY 1""",
    "phone_intl_candidates": _T + "SELECT value, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '([+][1-9][0-9 ().-]{6,18}[0-9])', 1)) AS value FROM t) GROUP BY value",
    "token_assignment": _T + "SELECT blob_id, value, length(value)::INT AS length FROM (SELECT blob_id, unnest(regexp_extract_all(text, '[Cc]hecksum ([0-9a-f]{16,64})', 1)) AS value FROM t)",
    "entropy_of_tokens": _T + """, v AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[Cc]hecksum ([0-9a-f]{16,64})', 1)) AS value FROM t),
        k AS (SELECT value, ch, count(*) / length(value) AS p FROM (SELECT value, unnest(string_split(value, '')) AS ch FROM v) WHERE ch <> '' GROUP BY value, ch)
        SELECT value, round(-sum(p * log2(p)), 4) AS bits FROM k GROUP BY value""",
    "opaque_entropy": _T + """, v AS (SELECT DISTINCT unnest(regexp_extract_all(text, '([A-Za-z0-9/+=_~-]{20,})', 1)) AS value FROM t),
        k AS (SELECT value, ch, count(*) / length(value) AS p FROM (SELECT value, unnest(string_split(value, '')) AS ch FROM v) WHERE ch <> '' GROUP BY value, ch)
        SELECT value, round(-sum(p * log2(p)), 4) AS bits FROM k GROUP BY value""",
    "fingerprint_values": _C + "SELECT cell_id, sha256(cell_value)[1:16] AS value_hash FROM c",
    "luhn_validator": _T + _NUMBERS + f"SELECT value, {_LUHN.format('value')} AND length(value) BETWEEN 13 AND 19 AS ok FROM n WHERE regexp_full_match(value, '[0-9]+')",
    "iban_mod97": _T + _NUMBERS + f""", m AS (SELECT value FROM n UNION SELECT 'DE' || value[1:20] FROM n WHERE regexp_full_match(value, '[0-9]{{10,20}}')),
        k AS (SELECT value, list_transform(string_split(value[5:] || value[1:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END) AS parts FROM m)
        SELECT value, coalesce(regexp_full_match(value, '{_IBAN_FORM}'), false) AND
          list_reduce(list_prepend(0::BIGINT, list_transform(parts, lambda p: p::BIGINT)), lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97) = 1 AS ok FROM k""",
    "aba_checksum": _T + _NUMBERS + """SELECT DISTINCT value[1:9] AS value, (3 * (value[1]::INT + value[4]::INT + value[7]::INT) + 7 * (value[2]::INT + value[5]::INT + value[8]::INT)
        + value[3]::INT + value[6]::INT + value[9]::INT) % 10 = 0 AS ok FROM n WHERE regexp_full_match(value, '[0-9]{9,}')""",
    "verhoeff": _T + _NUMBERS + f"""SELECT value, list_reduce(list_prepend(0, list_transform(range(0, length(value)), lambda i:
          substr('{_VERHOEFF_PLACES}', ((i % 8) * 10 + substr(value, (length(value) - i)::BIGINT, 1)::INT + 1)::BIGINT, 1)::INT)),
          lambda c, p: substr('{_VERHOEFF_PRODUCTS}', (c * 10 + p + 1)::BIGINT, 1)::INT) = 0 AS ok FROM n WHERE regexp_full_match(value, '[0-9]+')""",
    "filler_numbers": _T + """, r AS (SELECT unnest(regexp_extract_all(text, '([0-9][0-9 .-]{4,20}[0-9])', 1)) AS value FROM t
        UNION SELECT cell_value FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC) AS rn FROM cells) WHERE rn = 1 AND regexp_full_match(cell_value, '[0-9][0-9 .-]*')),
        d AS (SELECT DISTINCT value, regexp_replace(value, '[^0-9]', '', 'g') AS line, list_filter(regexp_split_to_array(value, '[^0-9]+'), lambda g: g <> '') AS groups FROM r)
        SELECT value, length(line) >= 6 AND (len(list_filter(groups, lambda g: replace(g, g[1], '') <> '')) = 0 OR contains('01234567890123456789', line) OR contains('98765432109876543210', line)) AS filler,
          regexp_full_match(value, '[0-9]{10}|[0-9]{13}') AND coalesce(TRY_CAST(value[1:10] AS BIGINT) BETWEEN 1300000000 AND 2200000000, false) AS epoch FROM d""",
    "scan_name_fields": _CELLS_NAMED + f""", p AS (SELECT cell_id, regexp_replace(v, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS value, words, list_filter(regexp_split_to_array(v, '[\\s\\p{{Z}}]+'), lambda x: x <> '') AS parts
          FROM n JOIN hinted h ON h.name = n.name AND h.detector = 'PII.PersonName' WHERE kind IS DISTINCT FROM 'credential')
        SELECT cell_id, value, 0.85::DOUBLE AS score FROM p WHERE len(parts) BETWEEN 1 AND 4 AND length(value) <= 80 AND length(parts[1]) >= 2
          AND len(list_filter(parts, lambda x: NOT regexp_full_match(x, '[\\p{{L}}\\p{{Nl}}\\p{{No}}](?:[\\p{{L}}\\p{{Nl}}\\p{{No}}]|[''’.-]){{0,30}}'))) = 0
          AND len(list_filter(parts, lambda x: regexp_matches(x, '[aeiouyAEIOUY]|[^\\x00-\\x7f]'))) > 0 AND lower(value) NOT IN ({_quoted(NOBODY)})
          AND rtrim(lower(parts[len(parts)]), '.') NOT IN ({_quoted(ORGANISATION_ENDS)}) AND NOT regexp_matches(lower(value), '{_FOUR}')
          AND (len(parts) > 1 OR len(list_filter(string_split(words, ' '), lambda w: w IN ({_quoted(SINGLE)}))) > 0)""",
    "scan_social_numbers": _CELLS_NAMED + f""", k AS (SELECT *, regexp_matches(lower(name), '(^|[^a-z])ssns?([^a-z]|$)|social_?security|social_?sec([^a-z]|$)|(^|[^a-z])ss_?(num|no|number)([^a-z]|$)') AS hint,
          regexp_matches(' ' || words || ' ', ' (social|security|ssn|ssns|ssid) ') AS told FROM n),
        f AS (SELECT *, unnest(regexp_extract_all(v, '\\b[0-9]{{3}}[- .][0-9]{{2}}[- .][0-9]{{4}}\\b')) AS value, 0.5 AS base FROM k
          UNION ALL SELECT *, unnest(regexp_extract_all(v, '\\b(?:[0-9]{{5}}-[0-9]{{4}}|[0-9]{{3}}-[0-9]{{6}}|[0-9]{{9}})\\b')), 0.05 FROM k),
        g AS (SELECT *, greatest(CASE WHEN hint THEN 0.85 ELSE 0 END, CASE WHEN told THEN greatest(base + 0.35, 0.4) ELSE base END) AS score, regexp_replace(value, '[0-9]', '', 'g') AS seps, {_LINE} AS line FROM f)
        SELECT cell_id, value, score::DOUBLE AS score FROM g WHERE score >= 0.5 AND (seps = '' OR replace(seps, seps[1], '') = '') AND replace(line, line[1], '') <> '' AND line[4:5] <> '00' AND line[6:] <> '0000'
          AND line[1:3] NOT IN ('000', '666') AND line NOT IN ('123456789', '987654320', '078051120') AND NOT {_FILLER} AND (hint OR NOT (kind IS NOT DISTINCT FROM 'identifier' OR counter))""",
    "scan_checked_numbers": _CELLS_NAMED + f""", f AS (SELECT *, 'UK_NHS' AS detector, unnest(regexp_extract_all(v, '\\b[0-9]{{3}}[- ]?[0-9]{{3}}[- ]?[0-9]{{4}}\\b')) AS value FROM n
          UNION ALL SELECT *, 'US_NPI', unnest(regexp_extract_all(v, '\\b(?:[12][0-9]{{9}}|[12][0-9]{{3}}[ -][0-9]{{3}}[ -][0-9]{{3}})\\b')) FROM n
          UNION ALL SELECT *, 'GB_UTR', unnest(regexp_extract_all(v, '\\b[0-9]{{5}}\\s?[0-9]{{5}}\\b')) FROM n),
        ok AS (SELECT *, CASE detector WHEN 'UK_NHS' THEN {_digit_sum(list(range(10, 0, -1)))} % 11 = 0
            WHEN 'GB_UTR' THEN [2, 1, 9, 8, 7, 6, 5, 4, 3, 2, 1][{_digit_sum([0, 6, 7, 8, 9, 10, 5, 4, 3, 2])} % 11 + 1] = substr({_LINE}, 1, 1)::INT
            ELSE {_LUHN.format("('80840' || " + _LINE + ")")} END AS holds,
          CASE detector WHEN 'UK_NHS' THEN '(^|[^a-z])nhs([^a-z]|$)|nhs_?(num|no|id)' WHEN 'US_NPI' THEN '(^|[^a-z])npi([^a-z]|$)|national_?provider' ELSE '(^|[^a-z])utr([^a-z]|$)|taxpayer_?ref' END AS hint FROM f),
        s AS (SELECT *, regexp_matches(lower(name), hint) AS hinted FROM ok WHERE holds OR detector = 'GB_UTR'),
        t AS (SELECT cell_id, detector, value, CASE WHEN hinted THEN CASE WHEN holds THEN 1.0 ELSE 0.85 END WHEN holds THEN 0.75 ELSE 0.05 END AS score FROM s
          WHERE (hinted OR NOT ({_PLAIN} AND (kind IS NOT DISTINCT FROM 'identifier' OR counter))) AND NOT ({_TIME} AND NOT (holds AND hinted)) AND (detector <> 'GB_UTR' OR NOT {_FILLER}))
        SELECT cell_id, detector, value, score::DOUBLE AS score FROM t WHERE score >= 0.5
          AND NOT (detector <> 'GB_UTR' AND EXISTS (SELECT 1 FROM t o WHERE o.cell_id = t.cell_id AND o.detector = 'GB_UTR' AND o.score >= 0.5 AND o.value = t.value))""",
    "scan_bank_codes": _T + f""", f AS (SELECT blob_id, text, unnest(regexp_extract_all(regexp_replace(text, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'), '(?:^|[^\\p{{L}}\\p{{N}}_])([A-Z]{{6}}[A-Z0-9]{{2}}(?:[A-Z0-9]{{3}})?)(?:$|[^\\p{{L}}\\p{{N}}_])', 1)) AS value FROM t),
        w AS (SELECT *, lower(text[greatest(1, instr(text, value) - 40):instr(text, value) + length(value) + 9]) AS beside,
            lower(text[greatest(1, instr(text, value) - 120):instr(text, value) + length(value) + 59]) AS around FROM f WHERE value[5:6] IN ({_quoted(COUNTRIES)}) AND value NOT IN ({_quoted(NO_BANK_CODE)}))
        SELECT blob_id, value, CASE WHEN regexp_matches(beside, '(^|[^a-z0-9_])(swift|bic|bank identifier)')
          OR (regexp_matches(value, '[0-9]') AND regexp_matches(around, '(^|[^a-z0-9_])(swift|bic|iban|bank identifier|bank code)')) THEN 0.85 ELSE 0.5 END::DOUBLE AS score FROM w""",
    "scan_addresses_of_mail": _T + f""", r AS (SELECT 'blob' AS src, blob_id AS row_id, text AS body FROM t UNION ALL SELECT 'cell', cell_id, cell_value FROM
          (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC) AS rn FROM cells) WHERE rn = 1 AND cell_value <> ''),
        f AS (SELECT src, row_id, ltrim(unnest(regexp_extract_all(body, '([.A-Za-z0-9!#$%&''*+/=?^_`{{|}}~-]{{1,64}}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?\\.)+[A-Za-z]{{2,24}})(?:$|[^A-Za-z0-9])', 1)), '.') AS value FROM r WHERE contains(body, '@')),
        e AS (SELECT *, regexp_extract(value, '^(.*)@[^@]*$', 1) AS local, lower(regexp_extract(value, '@([^@]*)$', 1)) AS dom FROM f)
        SELECT src, row_id, value, lower(local) IN ({_quoted(ROLES)}) OR regexp_matches(lower(local), '^(?:{"|".join(x.replace("+", "[+]") for x in ROLE_OPENINGS)})|(-bot|\\[bot\\])$')
            OR (length(local) >= 20 AND regexp_full_match(local, '[A-Za-z0-9_+=-]+') AND regexp_matches(local, '[0-9]') AND lower(local) <> local) AS no_person
        FROM e WHERE local <> '' AND NOT ({_DEMO}) AND len(list_filter(string_split(dom, '.')[:-2], lambda x: regexp_full_match(x, '[0-9-]+'))) = 0
          AND regexp_matches(local, '[A-Za-z]') AND NOT contains(local, '..') AND NOT ends_with(local, '.')""",
    "field_words": words_of("SELECT DISTINCT cell_key AS name FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC) AS rn FROM cells) WHERE rn = 1 AND cell_value <> '' AND cell_key IS NOT NULL")
        + described(HINTS) + f""", ranks(detector, r) AS (VALUES {', '.join(f"('{d}', {i})" for i, d in enumerate(HINTS))}), h AS (SELECT name, string_agg(detector, ',' ORDER BY r) AS hints FROM hinted JOIN ranks USING (detector) GROUP BY name)
        SELECT name AS "column", words, kind, counter, coalesce(hints, '') AS hints FROM words JOIN kinds USING (name) LEFT JOIN h USING (name)""",
    "text_line_locator": _T + """SELECT blob_id, (length(b) - length(replace(b, chr(10), '')) + 1)::INT AS line, (length(list_last(string_split(b, chr(10)))) + 1)::INT AS col
        FROM (SELECT blob_id, text[1:instr(text, '@') - 1] AS b FROM t WHERE contains(text, '@'))""",
    "healthcare_keywords": _T + f"SELECT blob_id, ({_WORD_COUNT})::INT AS n FROM t WHERE ({_WORD_COUNT}) > 0",
}
