"""The pipeline's grouped operators over the tables of candidates, cells, profiles and units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodescan.engine.fields import HINTS, field_table
from lodescan.engine.policies import policy_for, with_policy
from lodescan.engine.scan import PRIORITY
from lodescan.engine.tiers import name_rank, rank_name, score_rank
from lodescan.engine.units import unit_hints
from lodescan.evaluate import counters
from lodescan.operators import findings as ops
from lodescan.operators.cells import collapsed, leaf, scope
from lodescan.plans.chain_sql import CHAIN
from lodescan.plans.names import described, words_of
from lodescan.runtime import checkpointed, latest, table
from lodescan.sources.tables import changed_since, limited


def base_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates table in the pipeline's form, each delivery counted once."""
    raw = latest(table(spark, sf_dir, "candidates"), ["candidate_id"], F.col("loaded_at"))
    return raw.where("value_hash is not null").select(
        "unit_id", "record_ix", F.coalesce("cell_key", F.lit("")).alias("column"), scope(F.coalesce("cell_key", F.lit("")), F.lit("record")).alias("scope"),
        F.concat_ws("#", F.col("record_ix").cast("string"), F.coalesce("cell_key", F.lit(""))).alias("cell_id"),
        "detector", "category", "severity", F.lower("value_hash").alias("value"),
        F.concat(F.lit("Record "), F.col("record_ix"), F.lit(", "), F.coalesce("cell_key", F.lit(""))).alias("location"),
        name_rank(F.col("confidence")).alias("tier"), "start_ix", "end_ix",
        (F.coalesce("score", F.lit(0.0)) >= 0.9).alias("validated"), F.lit(False).alias("needs_context"), F.lit(False).alias("encoded"),
        F.when(F.coalesce("score", F.lit(0.0)) >= 0.9, F.array(F.lit("checksum"))).otherwise(F.array(F.lit("shape"))).alias("evidence"),
        F.col("candidate_id").alias("seq"),
    ).where("tier is not null")


_BASE = """
WITH raw AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY loaded_at DESC) AS rn FROM candidates) WHERE rn = 1
), base AS (
  SELECT unit_id, record_ix, coalesce(cell_key, '') AS col,
    CASE WHEN contains(coalesce(cell_key, ''), '.') THEN regexp_extract(cell_key, '^(.*)\\.[^.]*$', 1) ELSE '' END AS scope,
    record_ix || '#' || coalesce(cell_key, '') AS cell_id, detector, category, severity, lower(value_hash) AS value,
    'Record ' || record_ix || ', ' || coalesce(cell_key, '') AS location,
    CASE lower(trim(confidence)) WHEN 'possible' THEN 0 WHEN 'likely' THEN 1 WHEN 'very_likely' THEN 2 END AS tier,
    start_ix, end_ix, coalesce(score, 0) >= 0.9 AS validated, candidate_id AS seq
  FROM raw WHERE value_hash IS NOT NULL AND confidence IS NOT NULL
)"""

_DETECTORS = [
    ("Address", "PII"), ("Credit Card", "Financial"), ("Date of Birth", "PII"), ("Email", "PII"), ("IBAN", "Financial"), ("IMEI", "Technical"),
    ("PII.IPAddress", "PII"), ("PII.PersonName", "PII"), ("Phone Number", "PII"), ("UK_NHS", "PHI"), ("US SSN", "Regional"), ("VIN", "Technical"),
]


def _policy_values() -> str:
    rows = []
    for d, c in _DETECTORS:
        p = policy_for(d, c)
        rows.append(
            f"('{d}', '{p.context}', {p.column_ratio}, {p.column_min_matches}, {p.column_classify}, {p.column_requires_validation}, {p.min_count}, "
            f"{p.count_promotion}, {p.identity}, {p.identity_corroboration}, " + (f"'{p.siblings}'" if p.siblings else "NULL") + ", " + (f"'{p.negative_fields}'" if p.negative_fields else "NULL") + ")"
        )
    return (", policy(detector, context, column_ratio, column_min_matches, column_classify, needs_validation, min_count, count_promotion, identity, "
            "corroborated, siblings, negative_fields) AS (VALUES " + ", ".join(rows) + ")")


_POLICY = _policy_values()
_PROFILE = """
, per_cell AS (
  SELECT unit_id, col, detector, cell_id, max(tier) AS tier, bool_or(validated) AS validated, min(seq) AS seq FROM base GROUP BY ALL
), profile AS (
  SELECT a.*, b.distinct_values FROM (
    SELECT unit_id, col, detector, count(*) AS matches, sum(validated::INT)::BIGINT AS validated, count_if(tier = 0)::BIGINT AS t0,
      count_if(tier = 1)::BIGINT AS t1, count_if(tier = 2)::BIGINT AS t2, min(seq) AS first_seq
    FROM per_cell GROUP BY ALL) a
  JOIN (SELECT unit_id, col, detector, count(DISTINCT value) AS distinct_values FROM base GROUP BY ALL) b USING (unit_id, col, detector)
), sampled AS (SELECT unit_id, col, count(DISTINCT cell_id) AS sampled FROM base GROUP BY ALL)"""
_VERDICT = _PROFILE + """
, verdict AS (
  SELECT p.*, s.sampled, (CASE WHEN y.needs_validation THEN p.validated ELSE p.matches END) / s.sampled AS ratio,
    y.column_classify AND p.matches >= y.column_min_matches AND p.distinct_values >= y.column_min_matches
      AND (CASE WHEN y.needs_validation THEN p.validated ELSE p.matches END) / s.sampled >= y.column_ratio AS classified,
    least(2, 1 + CASE WHEN t2 * 2 >= matches THEN 2 WHEN (t2 + t1) * 2 >= matches THEN 1 ELSE 0 END) AS raised
  FROM profile p JOIN sampled s USING (unit_id, col) JOIN policy y USING (detector)
), owners AS (
  SELECT unit_id, col, detector AS owner FROM (
    SELECT *, row_number() OVER (PARTITION BY unit_id, col ORDER BY (validated / sampled >= 0.5) DESC, ratio DESC, validated DESC, first_seq) AS rn
    FROM verdict WHERE classified) WHERE rn = 1
)"""


def _sampled(c: DataFrame) -> DataFrame:
    return c.groupBy("unit_id", "column").agg(F.count_distinct("cell_id").alias("sampled"))


def _verdicts(c: DataFrame) -> DataFrame:
    return ops.column_verdicts(ops.column_profiles(c), _sampled(c))


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ops.column_profiles(base_candidates(spark, sf_dir))
    return p.select("unit_id", "column", "detector", "matches", "validated", "t0", "t1", "t2", "distinct_values", "first_seq")


def column_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _verdicts(base_candidates(spark, sf_dir))
    return v.select("unit_id", "column", "detector", "sampled", F.round("ratio", 6).alias("ratio"), "classified", rank_name(F.col("verdict_tier")).alias("tier"))


def dominant_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.column_owners(_verdicts(base_candidates(spark, sf_dir)))


def dominance_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = checkpointed(ops.corroborated_by_record(base_candidates(spark, sf_dir)))
    kept = ops.without_losers(c, checkpointed(_verdicts(c)))
    return kept.groupBy("unit_id", "detector").agg(F.count("*").alias("kept"))


def record_identity_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.corroborated_by_record(base_candidates(spark, sf_dir))
    return rows.where(F.exists("evidence", lambda e: e == "record:identity")).select(F.col("seq").alias("candidate_id"), rank_name(F.col("tier")).alias("tier"))


def context_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.capped_by_context(base_candidates(spark, sf_dir))
    return rows.groupBy("detector").agg(F.count_if(F.exists("evidence", lambda e: e == "uncorroborated")).alias("capped"), F.sum("tier").alias("tiers"))


def count_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.promoted_by_count(base_candidates(spark, sf_dir), ["unit_id", "column", "detector"])
    return rows.groupBy("unit_id", "detector").agg(F.count_if(F.exists("evidence", lambda e: e.startswith("count:"))).alias("promoted"))


def sibling_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = base_candidates(spark, sf_dir)
    columns = c.select("unit_id", "column").distinct()
    fields = columns.join(field_table(columns), "column").select("unit_id", "column", "words")
    return ops.sibling_columns(c, fields).select("unit_id", "column", "detector", F.concat_ws(",", "siblings").alias("siblings"))


def aggregate_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = base_candidates(spark, sf_dir)
    rows = ops.aggregated(c, _verdicts(c))
    return rows.where("aggregated").select(
        "unit_id", "column", "detector", "value", rank_name(F.col("tier")).alias("tier"), F.concat_ws(",", "evidence").alias("evidence"), "occurrences",
        "column_sampled", "column_matches", "column_ratio",
    )


def dedup_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.distinct_findings(base_candidates(spark, sf_dir)).select("unit_id", "detector", "value", "location", "seq")


def club_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    clubs = ops.clubbed(base_candidates(spark, sf_dir))
    return clubs.select("unit_id", "detector", "category", rank_name(F.col("tier")).alias("tier"), "total_count", F.col("n_values").cast("int").alias("n_values"))


def club_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every club with each of its places."""
    return ops.club_values(base_candidates(spark, sf_dir)).select("unit_id", "detector", "category", "value", "location", "first_seq")


def unit_name_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detectors of the field patterns that the names of the scanned units hint at."""
    hints = unit_hints(table(spark, sf_dir, "scan_units"))
    return hints.where(F.col("detector").isin(*HINTS)).select("unit_id", "unit_name", "detector")


def scan_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan has read: records, cells and texts per unit, each delivery counted once."""
    cells = latest(table(spark, sf_dir, "cells"), ["cell_id"], F.col("loaded_at"))
    blobs = latest(table(spark, sf_dir, "text_blobs"), ["blob_id"], F.col("loaded_at"))
    return counters(cells, blobs)


def clean_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = base_candidates(spark, sf_dir).where("detector = 'VIN' and tier = 2")
    rows = ops.with_clean_units(table(spark, sf_dir, "scan_units").select("unit_id", "unit_name"), ops.clubbed(some))
    return rows.select("unit_id", "unit_name", F.size("findings").alias("n_findings"))


def unit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scanned unit with the number of its clubs of all candidates; units without any have none."""
    # the clubs without their values, which nothing here reads
    clubs = base_candidates(spark, sf_dir).groupBy("unit_id", "detector", "category").agg(F.max("tier").alias("tier"), F.count("*").alias("total_count"))
    rows = ops.with_clean_units(table(spark, sf_dir, "scan_units").select("unit_id", "unit_name"), clubs)
    return rows.select("unit_id", "unit_name", F.size("findings").alias("n_findings"))


def allow_list_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = latest(table(spark, sf_dir, "cells"), ["cell_id"], F.col("loaded_at")).where("cell_value <> ''")
    kept = ops.without_allowed(cells, table(spark, sf_dir, "allow_list"), "cell_value", "ref_value", [r"@staff\."])
    return kept.groupBy("unit_id").agg(F.count("*").alias("cells"))


def negative_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = base_candidates(spark, sf_dir).withColumn("column", F.when(F.col("column").endswith("ref"), "order_ref").otherwise(F.col("column")))
    kept = ops.without_negative_fields(c, field_table(c))
    return kept.groupBy("column", "detector").agg(F.count("*").alias("kept"))


def policy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = base_candidates(spark, sf_dir).select("detector", "category").distinct()
    return with_policy(pairs).select(
        "detector", F.col("policy.context").alias("context"), F.col("policy.column_ratio").alias("column_ratio"), F.col("policy.min_count").alias("min_count"),
        F.col("policy.identity").alias("identity"),
    )


def overlap_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ops.without_covered(base_candidates(spark, sf_dir), {d: PRIORITY[d] for d, _ in _DETECTORS if d in PRIORITY})
    return kept.groupBy("unit_id", "detector").agg(F.count("*").alias("kept"))


def min_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.at_least(base_candidates(spark, sf_dir), 1).groupBy("unit_id").agg(F.count("*").alias("findings"))


def score_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = latest(table(spark, sf_dir, "candidates"), ["candidate_id"], F.col("loaded_at"))
    rows = c.select("detector", score_rank(F.col("score")).alias("tier")).where("tier is not null")
    return rows.groupBy("detector", rank_name(F.col("tier")).alias("tier")).agg(F.count("*").alias("n"))


def cell_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = latest(table(spark, sf_dir, "cells"), ["cell_id"], F.col("loaded_at")).where("field_path is not null")
    key = collapsed(F.col("field_path"))
    return cells.select("cell_id", key.alias("column"), leaf(key).alias("leaf"), scope(F.col("field_path"), F.lit("record")).alias("scope"))


def values_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = latest(table(spark, sf_dir, "cells"), ["cell_id"], F.col("loaded_at")).where("cell_value <> ''")
    return cells.groupBy("unit_id", F.coalesce("cell_key", "field_path", F.lit("")).alias("column")).agg(F.count("*").alias("sampled"))


def sheet_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "scan_units").select(F.concat("unit_id", F.when(F.col("shape") == "columnar", F.concat(F.lit(" ["), "unit_name", F.lit("]"))).otherwise("")).alias("resource"))
    thing, sheet = ops.sheet_of(F.col("resource"))
    return units.select("resource", thing.alias("object"), sheet.alias("sheet"))


def _grading(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    profiles = latest(table(spark, sf_dir, "column_profiles"), ["profile_id"], F.col("computed_at"))
    verdicts = latest(table(spark, sf_dir, "column_verdicts"), ["verdict_id"], F.col("decided_at"))
    return profiles.select("profile_id", "detector", "matches_n"), verdicts.select("profile_id", F.col("matches_n").alias("reported"))


def eval_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodescan.evaluate import scores

    gold, reported = _grading(spark, sf_dir)
    expected = gold.select(F.coalesce("detector", F.lit("any")).alias("detector"), F.col("profile_id").alias("item"))
    got = reported.join(gold, "profile_id").where("reported >= 10").select(F.coalesce("detector", F.lit("any")).alias("detector"), F.col("profile_id").alias("item"))
    s = scores(expected, got, ["detector"])
    return s.select("detector", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"))


def incremental_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return changed_since(e, "ts", "2024-01-10 00:00:00").groupBy("event_type").agg(F.count("*").alias("n"))


def head_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limited(table(spark, sf_dir, "events"), 1000, "event_id").select("event_id", "event_type")


def findings_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = checkpointed(base_candidates(spark, sf_dir))
    columns = c.select("unit_id", "column").distinct()
    fields = checkpointed(columns.join(field_table(columns), "column"))
    rows = ops.classify(c, _sampled(c), fields)
    return rows.select("unit_id", "column", "detector", rank_name(F.col("tier")).alias("tier"), "location", "aggregated", "occurrences", F.concat_ws(",", "evidence").alias("evidence"))


QUERIES = {f.__name__: f for f in (
    column_profile, column_verdict, dominant_detector, dominance_antijoin, record_identity_promotion, context_cap, count_promotion, sibling_columns,
    aggregate_threshold, dedup_findings, club_findings, club_locations, unit_name_hints, scan_counters, clean_units, unit_findings, allow_list_antijoin, negative_fields, policy_lookup, overlap_resolution, min_confidence, score_floor,
    cell_paths, values_seen, sheet_regroup, eval_precision_recall, incremental_filter, head_sample, findings_pipeline,
)}
_TIER = "CASE {0} WHEN 0 THEN 'possible' WHEN 1 THEN 'likely' WHEN 2 THEN 'very_likely' END"
_CELLS = "WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC) AS rn FROM cells) WHERE rn = 1) "
_IDENTITY = """
, named AS (SELECT b.*, y.* EXCLUDE (detector) FROM base b JOIN policy y USING (detector)),
known AS (SELECT unit_id, record_ix, scope, list(DISTINCT detector) AS identity_set FROM named WHERE identity AND tier >= 1 GROUP BY ALL),
up AS (
  SELECT n.*, (n.tier = 0 AND corroborated AND coalesce(len(identity_set), 0) >= 2 AND NOT coalesce(list_contains(identity_set, detector), false)) AS raised_by_record
  FROM named n LEFT JOIN known k ON k.unit_id IS NOT DISTINCT FROM n.unit_id AND k.record_ix = n.record_ix AND k.scope = n.scope
)"""
ORACLES = {
    "column_profile": _BASE + _PROFILE + 'SELECT unit_id, col AS "column", detector, matches, validated, t0, t1, t2, distinct_values, first_seq FROM profile',
    "column_verdict": _BASE + _POLICY + _VERDICT + f"""SELECT unit_id, col AS "column", detector, sampled, round(ratio, 6) AS ratio, classified,
        CASE WHEN classified THEN {_TIER.format('raised')} END AS tier FROM verdict""",
    "dominant_detector": _BASE + _POLICY + _VERDICT + 'SELECT unit_id, col AS "column", owner FROM owners',
    "dominance_antijoin": _BASE.replace("), base AS", "), base0 AS") + _POLICY + _IDENTITY.replace("FROM base b", "FROM base0 b") + """
, base AS (SELECT unit_id, record_ix, col, scope, cell_id, detector, category, severity, value, location,
    CASE WHEN raised_by_record THEN 1 ELSE tier END AS tier, start_ix, end_ix, validated, seq, tier >= 1 AS independent FROM up)""" + _VERDICT + """
, j AS (SELECT b.*, o.owner, coalesce(v.validated / v.sampled, 0) >= 0.2 AS proof FROM base b LEFT JOIN owners o USING (unit_id, col)
        LEFT JOIN verdict v USING (unit_id, col, detector))
SELECT unit_id, detector, count(*) AS kept FROM j
WHERE owner IS NULL OR owner = detector OR (proof AND tier = 2)
   OR (independent AND NOT EXISTS (SELECT 1 FROM j o WHERE o.unit_id = j.unit_id AND o.cell_id = j.cell_id AND o.col = j.col AND o.detector = j.owner
       AND least(o.end_ix, j.end_ix) - greatest(o.start_ix, j.start_ix) > 0
       AND (least(o.end_ix, j.end_ix) - greatest(o.start_ix, j.start_ix)) / greatest(1, j.end_ix - j.start_ix) >= 0.8))
GROUP BY ALL""",
    "record_identity_promotion": _BASE + _POLICY + _IDENTITY + "SELECT seq AS candidate_id, 'likely' AS tier FROM up WHERE raised_by_record",
    "context_cap": _BASE + _POLICY + """SELECT detector, count_if(capped)::BIGINT AS capped, sum(CASE WHEN capped THEN 0 ELSE tier END)::BIGINT AS tiers
        FROM (SELECT b.*, y.context = 'required' AND tier > 0 AND NOT validated AS capped FROM base b JOIN policy y USING (detector)) GROUP BY detector""",
    "count_promotion": _BASE + _POLICY + """, n AS (SELECT b.*, tier = 0 AND context <> 'none' AND count_promotion AS open, min_count FROM base b JOIN policy y USING (detector)),
        k AS (SELECT unit_id, col, detector, count(DISTINCT value) AS k FROM n WHERE open GROUP BY ALL)
        SELECT unit_id, detector, count_if(open AND coalesce(k, 0) >= min_count)::BIGINT AS promoted FROM n LEFT JOIN k USING (unit_id, col, detector) GROUP BY ALL""",
    "aggregate_threshold": _BASE + _POLICY + _VERDICT + f""", g AS (
        SELECT unit_id, col, detector, count(*) AS occurrences, max(tier) AS t, arg_min(value, seq) AS value,
          array_to_string(list_transform(list_sort(list(DISTINCT e)), lambda x: x.n), ',') AS evidence FROM (
            SELECT *, {{'s': min(seq) OVER (PARTITION BY unit_id, col, detector, validated), 'n': CASE WHEN validated THEN 'checksum' ELSE 'shape' END}} AS e FROM base)
        GROUP BY ALL HAVING count(*) >= 25)
        SELECT unit_id, col AS "column", detector, value, {_TIER.format('t')} AS tier, evidence, occurrences, sampled AS column_sampled, matches AS column_matches,
          round(matches / sampled, 3) AS column_ratio FROM g JOIN verdict USING (unit_id, col, detector)""",
    "dedup_findings": _BASE + "SELECT unit_id, detector, value, location, min(seq) AS seq FROM base GROUP BY ALL",
    "club_findings": _BASE + f"SELECT unit_id, detector, category, {_TIER.format('max(tier)')} AS tier, count(*) AS total_count, count(DISTINCT value)::INT AS n_values FROM base GROUP BY unit_id, detector, category",
    "clean_units": _BASE + """SELECT u.unit_id, u.unit_name, coalesce(n, 0)::INT AS n_findings FROM scan_units u LEFT JOIN
        (SELECT unit_id, count(DISTINCT detector) AS n FROM base WHERE detector = 'VIN' AND tier = 2 GROUP BY unit_id) USING (unit_id)""",
    "unit_findings": _BASE + """SELECT u.unit_id, u.unit_name, coalesce(n, 0)::INT AS n_findings FROM scan_units u LEFT JOIN
        (SELECT unit_id, count(*) AS n FROM (SELECT DISTINCT unit_id, detector, category FROM base) GROUP BY unit_id) USING (unit_id)""",
    "allow_list_antijoin": _CELLS + """SELECT unit_id, count(*) AS cells FROM c WHERE cell_value <> '' AND NOT contains(cell_value, '@staff.')
        AND NOT EXISTS (SELECT 1 FROM allow_list a WHERE a.ref_value = c.cell_value) GROUP BY unit_id""",
    "negative_fields": _BASE + """SELECT CASE WHEN ends_with(col, 'ref') THEN 'order_ref' ELSE col END AS "column", detector, count(*) AS kept FROM base
        WHERE NOT (ends_with(col, 'ref') AND detector IN ('Phone Number', 'Credit Card', 'UK_NHS', 'US SSN', 'IMEI')) GROUP BY ALL""",
    "policy_lookup": _BASE + _POLICY + "SELECT DISTINCT detector, context, column_ratio::DOUBLE AS column_ratio, min_count, identity FROM base JOIN policy USING (detector)",
    "overlap_resolution": _BASE + ", pr(detector, p) AS (VALUES " + ", ".join(f"('{d}', {PRIORITY.get(d, 50)})" for d, _ in _DETECTORS) + """)
, h AS (SELECT b.*, p, end_ix - start_ix AS len FROM base b JOIN pr USING (detector))
SELECT unit_id, detector, count(*) AS kept FROM h WHERE NOT EXISTS (
  SELECT 1 FROM h o WHERE o.unit_id = h.unit_id AND o.cell_id = h.cell_id AND o.seq <> h.seq AND (
    (o.p > h.p AND least(o.end_ix, h.end_ix) > greatest(o.start_ix, h.start_ix) AND ((o.start_ix <= h.start_ix AND h.end_ix <= o.end_ix)
      OR least(o.end_ix, h.end_ix) - greatest(o.start_ix, h.start_ix) >= 0.8 * greatest(1, h.len)))
    OR (o.detector = h.detector AND o.start_ix <= h.start_ix AND h.end_ix <= o.end_ix AND (o.len > h.len OR o.seq < h.seq))))
GROUP BY ALL""",
    "sibling_columns": _BASE + _POLICY + """, w(col, words) AS (SELECT DISTINCT col, replace(trim(regexp_replace(replace(replace(col, 'birthdate', 'birth date'),
        'cardnumber', 'card number'), '[^a-z]+', ' ', 'g')), '  ', ' ') FROM base),
        c AS (SELECT DISTINCT unit_id, col, detector, CASE WHEN contains(col, '.') THEN regexp_extract(col, '^(.*)[.][^.]*$', 1) ELSE '' END AS parent, siblings
              FROM base JOIN policy USING (detector) WHERE siblings IS NOT NULL),
        o AS (SELECT DISTINCT b.unit_id, b.col AS other, CASE WHEN contains(b.col, '.') THEN regexp_extract(b.col, '^(.*)[.][^.]*$', 1) ELSE '' END AS parent, words FROM base b JOIN w USING (col))
        SELECT c.unit_id, c.col AS "column", detector, string_agg(other, ',' ORDER BY other) AS siblings FROM c JOIN o ON c.unit_id = o.unit_id AND c.parent = o.parent
          AND other <> c.col AND regexp_matches(words, siblings) GROUP BY ALL""",
    "min_confidence": _BASE + "SELECT unit_id, count(*) AS findings FROM base WHERE tier >= 1 GROUP BY unit_id",
    "score_floor": _BASE + f"SELECT detector, {_TIER.format('t')} AS tier, count(*) AS n FROM (SELECT detector, CASE WHEN score >= 0.9 THEN 2 WHEN score >= 0.8 THEN 1 WHEN score >= 0.5 THEN 0 END AS t FROM raw) WHERE t IS NOT NULL GROUP BY ALL",
    "cell_paths": _CELLS + r"""SELECT cell_id, regexp_replace(field_path, '\[\d+\]', '[]', 'g') AS "column",
        coalesce(list_filter(regexp_split_to_array(field_path, '[.\[\]]+'), lambda x: x <> '' AND NOT regexp_full_match(x, '\d+'))[-1], '') AS leaf,
        regexp_extract(field_path, '^(.*)\.[^.]*$', 1) AS scope FROM c WHERE field_path IS NOT NULL""",
    "values_seen": _CELLS + """SELECT unit_id, coalesce(cell_key, field_path, '') AS "column", count(*) AS sampled FROM c WHERE cell_value <> '' GROUP BY ALL""",
    "sheet_regroup": "SELECT unit_id || CASE WHEN shape = 'columnar' THEN ' [' || unit_name || ']' ELSE '' END AS resource, unit_id AS object, CASE WHEN shape = 'columnar' THEN unit_name END AS sheet FROM scan_units",
    "eval_precision_recall": """
WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY computed_at DESC) AS rn FROM column_profiles) WHERE rn = 1),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY verdict_id ORDER BY decided_at DESC) AS rn FROM column_verdicts) WHERE rn = 1),
e AS (SELECT coalesce(detector, 'any') AS detector, profile_id AS item, count(*) AS n FROM p GROUP BY ALL),
g AS (SELECT coalesce(detector, 'any') AS detector, profile_id AS item, count(*) AS n FROM v JOIN p USING (profile_id) WHERE v.matches_n >= 10 GROUP BY ALL),
s AS (SELECT coalesce(e.detector, g.detector) AS detector, sum(least(coalesce(e.n, 0), coalesce(g.n, 0)))::BIGINT AS tp,
        sum(greatest(coalesce(g.n, 0) - coalesce(e.n, 0), 0))::BIGINT AS fp, sum(greatest(coalesce(e.n, 0) - coalesce(g.n, 0), 0))::BIGINT AS fn
      FROM e FULL JOIN g ON e.detector = g.detector AND e.item = g.item GROUP BY 1)
SELECT detector, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM s""",
    "club_locations": _BASE + "SELECT unit_id, detector, category, value, location, min(seq) AS first_seq FROM base GROUP BY ALL",
    "unit_name_hints": words_of("SELECT unit_name AS name FROM scan_units") + """, plain AS (SELECT name, words,
          array_to_string(list_transform(string_split(words, ' '), lambda w: CASE WHEN length(w) > 4 AND ends_with(w, 'ies') THEN w[:-4] || 'y'
            WHEN length(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN w[:-2] ELSE w END), ' ') AS single FROM words)
        SELECT DISTINCT unit_id, unit_name, detector FROM scan_units JOIN plain ON unit_name = name, (VALUES """ + ", ".join(f"('{d}', '{p.pattern}')" for d, p in HINTS.items()) + """) h(detector, pattern)
        WHERE words <> '' AND (regexp_matches(words, pattern) OR regexp_matches(single, pattern))""",
    "scan_counters": """WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY loaded_at DESC) AS rn FROM cells) WHERE rn = 1),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY loaded_at DESC) AS rn FROM text_blobs) WHERE rn = 1),
        u AS (SELECT unit_id, count(DISTINCT record_ix) AS records, count(*) AS cells, count_if(coalesce(cell_value, '') = '') AS empty_cells, 0 AS texts, 0 AS characters FROM c GROUP BY unit_id
          UNION ALL SELECT unit_id, 0, 0, 0, count_if(text <> ''), sum(length(coalesce(text, ''))) FROM b GROUP BY unit_id)
        SELECT unit_id, sum(records)::BIGINT AS records, sum(cells)::BIGINT AS cells, sum(empty_cells)::BIGINT AS empty_cells, sum(texts)::BIGINT AS texts, sum(characters)::BIGINT AS characters FROM u GROUP BY unit_id""",
    "findings_pipeline": words_of("SELECT DISTINCT col AS name FROM base", _BASE) + _POLICY + described(HINTS) + CHAIN,
    "incremental_filter": "SELECT event_type, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00' GROUP BY event_type",
    "head_sample": "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 1000",
}
