import random

from pyspark.sql import functions as F

from lodescan.engine.fields import field_table
from lodescan.engine.policies import REQUIRED, Policy
from lodescan.engine.units import unit_hints
from lodescan.operators import findings as ops
from lodescan.plans.values import place_in_unit

SCHEMA = (
    "unit_id string, record_ix long, column string, scope string, cell_id string, detector string, category string, severity string, value string, "
    "location string, tier int, start_ix int, end_ix int, validated boolean, needs_context boolean, encoded boolean, evidence array<string>, seq long"
)


def row(seq, column="ref", detector="US SSN", category="Regional Compliance", value=None, tier=0, start=0, end=9, validated=False, record=None, evidence=(), scope=""):
    record = seq if record is None else record
    return ("u", record, column, scope, f"{record}/{column}", detector, category, "High", value or f"v{seq}", f"row:{record}:{column}", tier, start, end, validated,
            False, False, list(evidence), seq)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def sampled(spark, **counts):
    return spark.createDataFrame([("u", c, n) for c, n in counts.items()], "unit_id string, column string, sampled long")


def test_dense_column_is_classified_and_sparse_is_not(spark):
    c = frame(spark, [row(i) for i in range(40)])
    v = ops.column_verdicts(ops.column_profiles(c), sampled(spark, ref=40)).first()
    assert v.classified and v.verdict_tier == 1 and v.matches == 40
    v = ops.column_verdicts(ops.column_profiles(c.limit(1)), sampled(spark, ref=201)).first()
    assert not v.classified and v.verdict_tier is None


def test_repeated_value_is_no_column(spark):
    c = frame(spark, [row(i, value="same") for i in range(30)])
    assert not ops.column_verdicts(ops.column_profiles(c), sampled(spark, ref=30)).first().classified


def test_owner_and_losers(spark):
    rows = [row(i, detector="FR_NIR", validated=True, end=15) for i in range(10)] + [row(100 + i, detector="PK_CNIC", record=i, end=13, tier=1) for i in range(10)]
    rows += [row(200, detector="Email", category="PII", record=3, start=40, end=60, tier=1)]
    c = frame(spark, rows).withColumn("independent", F.col("tier") >= 1)
    v = ops.column_verdicts(ops.column_profiles(c), sampled(spark, ref=10))
    assert ops.column_owners(v).first().owner == "FR_NIR"
    kept = ops.without_losers(c, v)
    assert {(r.detector, r.n) for r in kept.groupBy("detector").agg(F.count("*").alias("n")).collect()} == {("FR_NIR", 10), ("Email", 1)}


def test_identity_of_the_record_and_its_scope(spark):
    who = [row(1, "name", "PII.PersonName", "PII", tier=1, record=1, scope="a"), row(2, "mail", "Email", "PII", tier=2, record=1, scope="a")]
    c = frame(spark, who + [row(3, record=1, scope="a"), row(4, record=1, scope="b"), row(5, record=2, scope="a")])
    up = {r.seq: r.tier for r in ops.corroborated_by_record(c).collect()}
    assert up == {1: 1, 2: 2, 3: 1, 4: 0, 5: 0}


def test_count_promotion_needs_different_values(spark):
    many = [row(i, "t", "Email-like", "PII") for i in range(10)]
    assert {r.tier for r in ops.promoted_by_count(frame(spark, many), ops.PAIR).collect()} == {1}
    same = [row(i, "t", "Email-like", "PII", value="x") for i in range(10)]
    assert {r.tier for r in ops.promoted_by_count(frame(spark, same), ops.PAIR).collect()} == {0}
    assert {r.tier for r in ops.promoted_by_count(frame(spark, [row(i) for i in range(40)]), ops.PAIR).collect()} == {0}


def test_context_cap_and_unit_hint(spark):
    c = frame(spark, [row(1, tier=2), row(2, tier=2, evidence=["checksum"]), row(3, tier=1, evidence=["field"])])
    assert {r.seq: r.tier for r in ops.capped_by_context(c).collect()} == {1: 0, 2: 2, 3: 1}
    hints = spark.createDataFrame([("u", "ssns", "US SSN")], "unit_id string, unit_name string, detector string")
    got = {r.seq: (r.tier, r.evidence) for r in ops.hinted_by_unit(ops.capped_by_context(c), hints).collect()}
    assert got[1] == (1, ["uncorroborated", "unit:ssns"])


def test_siblings_raise_verdicts_only(spark):
    c = frame(spark, [row(i, "person.ref") for i in range(5)])
    fields = spark.createDataFrame([("u", "person.ref"), ("u", "person.gender"), ("u", "gender")], "unit_id string, column string")
    fields = fields.join(field_table(fields), "column").select("unit_id", "column", "words")
    s = ops.sibling_columns(c, fields)
    assert s.first().siblings == ["person.gender"]
    v = ops.column_verdicts(ops.column_profiles(c), sampled(spark, **{"person.ref": 5}))
    up = ops.promoted_by_columns(c, v, s).first()
    assert up.tier == 2 and up.evidence == ["column:1.00", "siblings:person.gender"]


def test_aggregation_clubbing_and_dedup(spark):
    rows = [row(i, evidence=["b"] if i % 2 else ["a"], tier=1 + (i == 7)) for i in range(30)] + [row(99, "other", tier=1)]
    c = frame(spark, rows + [row(1000, tier=1, value="v1", record=1)])
    one = ops.distinct_findings(c)
    assert one.count() == 31
    v = ops.column_verdicts(ops.column_profiles(c), sampled(spark, ref=60, other=1))
    out = ops.aggregated(one, v).collect()
    big = next(r for r in out if r.aggregated)
    assert len(out) == 2 and big.occurrences == 30 and big.tier == 2 and big.evidence == ["a", "b"] and big.value == "v0" and big.column_ratio == 0.5
    club = ops.clubbed(one).where("detector = 'US SSN'").first()
    assert club.total_count == 31 and ops.club_values(one).where("value = 'v99'").first().location == "row:99:other"


def test_order_of_rows_does_not_matter(spark):
    rng = random.Random(3)
    rows = [row(i, rng.choice("ab"), rng.choice(["US SSN", "IBAN", "Email"]), rng.choice(["PII", "Financial Data"]), f"v{rng.randrange(40)}", rng.randrange(3),
                record=rng.randrange(30), evidence=["shape"]) for i in range(200)]
    fields = spark.createDataFrame([("u", "a"), ("u", "b")], "unit_id string, column string")
    fields = fields.join(field_table(fields), "column")

    def run(order):
        found = ops.classify(frame(spark, order).repartition(3), sampled(spark, a=30, b=30), fields)
        return sorted(map(str, found.select("column", "detector", "value", "tier", "evidence", "occurrences").collect()))

    mixed = rows[:]
    rng.shuffle(mixed)
    assert run(rows) == run(mixed)


def test_clean_units_stay(spark):
    units = spark.createDataFrame([("u",), ("clean",)], "unit_id string")
    got = {r.unit_id: len(r.findings) for r in ops.with_clean_units(units, ops.clubbed(frame(spark, [row(1)]))).collect()}
    assert got == {"u": 1, "clean": 0}


def test_allowed_values_overrides_and_unit_names(spark):
    fields = spark.createDataFrame([("u", "c", "c", [])], "unit_id string, column string, words string, hints array<string>")
    rows = frame(spark, [row(i, "c", "Email", "PII", f"v{i}", 1) for i in range(4)])
    run = lambda **more: {r.value for r in ops.classify(rows, sampled(spark, c=100), fields, threshold=0, **more).collect()}
    assert run() == {"v0", "v1", "v2", "v3"}
    allowed = spark.createDataFrame([("v1",), (None,)], "value string")
    assert run(allowed=allowed) == {"v0", "v2", "v3"} and run(allow_patterns=["[12]$"]) == {"v0", "v3"} and run(allowed=allowed, allow_patterns=["2"]) == {"v0", "v3"}
    capped = {"Email": Policy(REQUIRED, count_promotion=False)}
    assert run(overrides=capped) == set()
    hints = unit_hints(spark.createDataFrame([("u", "customer_emails"), ("w", "passports"), ("x", None)], "unit_id string, unit_name string"))
    assert ("u", "customer_emails", "Email") in {tuple(r) for r in hints.collect()} and {r.detector for r in hints.where("unit_id = 'w'").collect()} >= {"US_PASSPORT"}
    low = frame(spark, [row(i, "c", "Email", "PII", f"v{i}", 0) for i in range(2)])
    assert ops.classify(low, sampled(spark, c=100), fields, threshold=0, unit_hints=hints).count() == 2 and ops.classify(low, sampled(spark, c=100), fields, threshold=0).count() == 0


def test_siblings_do_not_classify_a_column(spark):
    """Two matches are too few for a verdict, whatever stands beside them."""
    rows = frame(spark, [row(i, "a.ssn", "US SSN", "Regional", f"v{i}", 1) for i in range(2)])
    v = ops.column_verdicts(ops.column_profiles(rows), spark.createDataFrame([("u", "a.ssn", 2)], "unit_id string, column string, sampled long"))
    beside = spark.createDataFrame([("u", "a.ssn", "US SSN", ["a.full_name"])], "unit_id string, column string, detector string, siblings array<string>")
    assert {(r.tier, tuple(r.evidence)) for r in ops.promoted_by_columns(rows, v, beside).collect()} == {(1, ())}


def test_empty_candidates(spark):
    fields = spark.createDataFrame([], "unit_id string, column string, words string, hints array<string>")
    assert ops.classify(frame(spark, []), sampled(spark, x=1), fields).count() == 0


def test_column_nobody_counted_is_not_classified(spark):
    v = ops.column_verdicts(ops.column_profiles(frame(spark, [row(i) for i in range(5)])), sampled(spark, other=3)).first()
    assert v.sampled == 0 and not v.classified and v.ratio is None


def test_losing_hits_that_start_together_all_stay(spark):
    rows = [row(i, detector="FR_NIR", validated=True, end=15) for i in range(10)]
    # three losers of one cell and one seq, apart from the owner's span
    rows += [row(3, detector=d, category="PII", record=3, start=40, end=60, tier=t) for d, t in (("Email", 1), ("Address", 1), ("Phone Number", 2))]
    # a loser that stays for both reasons counts once
    rows += [row(4, detector="Password Pattern", category="Credentials and Secrets", record=4, start=40, end=60, tier=2)]
    c = frame(spark, rows).withColumn("independent", F.col("tier") >= 1)
    kept = ops.without_losers(c, ops.column_verdicts(ops.column_profiles(c), sampled(spark, ref=10)))
    assert sorted(r.detector for r in kept.where("detector <> 'FR_NIR'").collect()) == ["Address", "Email", "Password Pattern", "Phone Number"]


def test_places_of_hits_in_a_unit_differ(spark):
    at = [(0, 0, 100_000), (0, 0, 100_001), (0, 1, 0), (0, 10_000, 0), (1, 0, 0), (2**63 - 1, 2**31 - 1, 10**9 - 1)]
    rows = spark.createDataFrame([(*a, i) for i, a in enumerate(at)], "r long, c int, h int, i int")
    places = [x.p for x in rows.select("i", place_in_unit(F.col("r"), F.col("c"), F.col("h")).alias("p")).orderBy("i").collect()]
    assert None not in places and places == sorted(set(places))
