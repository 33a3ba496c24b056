"""From candidates to findings: the grouped operators of the pipeline, each a DataFrame transformation.

Candidates: unit_id, record_ix, column, scope, cell_id, detector, category, severity, value, location, tier (rank),
start_ix, end_ix, validated, needs_context, encoded, evidence (array), seq (dense order within the unit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodescan.engine.policies import REQUIRED, Policy, with_policy
from lodescan.engine.tiers import LIKELY, POSSIBLE, VERY_LIKELY, raised
from lodescan.runtime import checkpointed, counted, small

Overrides = dict[str, Policy] | None
PAIR = ["unit_id", "column", "detector"]
CELL = ["unit_id", "cell_id"]
#: share of its column a losing detector must validate to keep its very likely hits
STRAGGLER_RATIO = 0.2
#: share of a loser's span the owner must cover to count as the same value
SAME_SPAN = 0.8
EXEMPT_CATEGORIES = ("Credentials and Secrets", "Entropy-Based Secret Detection")
AGGREGATION_THRESHOLD = 25


# --- filters -------------------------------------------------------------------------------------------------


def without_allowed(candidates: DataFrame, allowed: DataFrame, value: str, ref: str, patterns: list[str] | None = None) -> DataFrame:
    """Candidates whose value is on no allow list and matches none of the patterns anywhere."""
    kept = candidates.join(small(allowed.select(F.col(ref).alias("_ref")).distinct()), F.col(value) == F.col("_ref"), "left_anti")
    for p in patterns or []:
        kept = kept.where(~F.coalesce(F.col(value).rlike(p), F.lit(False)))
    return kept


def without_negative_fields(candidates: DataFrame, fields: DataFrame, overrides: Overrides = None) -> DataFrame:
    """Drops hits of detectors whose policy rules out the field's name, unless the name hints at the detector."""
    named = with_policy(candidates, overrides).join(small(fields.select(F.col("column").alias("_c"), "words", "hints")), F.col("column") == F.col("_c"), "left")
    veto = F.coalesce(F.expr("words rlike policy.negative_fields"), F.lit(False))
    hinted = F.coalesce(F.expr("array_contains(hints, detector)"), F.lit(False))
    return named.where(~veto | hinted).select(*candidates.columns)


def without_covered(candidates: DataFrame, priorities: dict[str, int], default: int = 50) -> DataFrame:
    """Hits no hit of higher priority in the same cell holds or covers by 80 %, and no equal one of their detector holds.

    An interval anti-join within the cell; of equal spans of one detector the first in order stays.
    """
    known = F.create_map(*[F.lit(x) for pair in sorted(priorities.items()) for x in pair])
    rows = candidates.withColumn("_p", F.coalesce(F.try_element_at(known, F.col("detector")), F.lit(default)))
    others = rows.select(
        *[F.col(c).alias(f"_{c}") for c in CELL], F.col("detector").alias("_d"), F.col("start_ix").alias("_s"), F.col("end_ix").alias("_e"),
        F.col("_p").alias("_q"), F.col("seq").alias("_seq"),
    )
    inside = (F.col("_s") <= F.col("start_ix")) & (F.col("end_ix") <= F.col("_e"))
    cover = F.least("end_ix", "_e") - F.greatest("start_ix", "_s")
    wider = (F.col("_e") - F.col("_s") > F.col("end_ix") - F.col("start_ix")) | (F.col("_seq") < F.col("seq"))
    drop = ((F.col("_q") > F.col("_p")) & (cover > 0) & (inside | (cover >= SAME_SPAN * F.greatest(F.lit(1), F.col("end_ix") - F.col("start_ix"))))) | (
        (F.col("_d") == F.col("detector")) & inside & wider & (F.col("_seq") != F.col("seq"))
    )
    return rows.join(others, (F.col(CELL[0]) == F.col(f"_{CELL[0]}")) & (F.col(CELL[1]) == F.col(f"_{CELL[1]}")) & drop, "left_anti").select(*candidates.columns)


def at_least(candidates: DataFrame, tier: int) -> DataFrame:
    return candidates.where(F.col("tier") >= tier)


def distinct_findings(findings: DataFrame) -> DataFrame:
    """One finding per unit, detector, value and location: the first in order."""
    keys = ["unit_id", "detector", "value", "location"]
    rest = [c for c in findings.columns if c not in keys]
    first = findings.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col("seq")).alias("_f"))
    return first.select(*keys, "_f.*").select(*findings.columns)


# --- promotions of single candidates ---------------------------------------------------------------------------


def has_context(evidence: Column) -> Column:
    return F.exists(evidence, lambda e: e.rlike("^(context:|field|key:|record:|column:)") | e.isin("body", "jwt_header"))


def has_validation(evidence: Column) -> Column:
    return F.exists(evidence, lambda e: e.isin("checksum", "format"))


def capped_by_context(candidates: DataFrame, overrides: Overrides = None) -> DataFrame:
    """Detectors that require context stay possible without context or validation."""
    named = with_policy(candidates, overrides)
    cap = (F.col("policy.context") == REQUIRED) & (F.col("tier") > POSSIBLE) & ~has_context(F.col("evidence")) & ~has_validation(F.col("evidence"))
    return named.withColumn("_cap", cap).withColumn("evidence", F.when(F.col("_cap"), F.concat("evidence", F.array(F.lit("uncorroborated")))).otherwise(F.col("evidence"))).withColumn(
        "tier", F.when(F.col("_cap"), POSSIBLE).otherwise(F.col("tier"))
    ).select(*candidates.columns)


def hinted_by_unit(candidates: DataFrame, hints: DataFrame) -> DataFrame:
    """Possible hits become likely where the unit's name hints at the detector; ``hints``: unit_id, unit_name, detector."""
    h = small(hints.select(F.col("unit_id").alias("_u"), F.col("detector").alias("_d"), F.col("unit_name").alias("_n")).distinct())
    joined = candidates.join(h, (F.col("unit_id") == F.col("_u")) & (F.col("detector") == F.col("_d")), "left")
    hit = F.col("_n").isNotNull() & (F.col("tier") == POSSIBLE)
    return joined.withColumn("_hit", hit).withColumn(
        "evidence", F.when(F.col("_hit"), F.concat("evidence", F.array(F.concat(F.lit("unit:"), F.col("_n"))))).otherwise(F.col("evidence"))
    ).withColumn("tier", F.when(F.col("_hit"), LIKELY).otherwise(F.col("tier"))).select(*candidates.columns)


def corroborated_by_record(candidates: DataFrame, overrides: Overrides = None) -> DataFrame:
    """Possible hits become likely where their record (and scope) holds two other kinds of identity.

    Adds ``independent``: whether the hit was at least likely before. The identities of a record are found by an
    aggregation and joined back, so that a record is never gathered in one place.
    """
    named = with_policy(candidates, overrides).withColumn("independent", F.col("tier") >= LIKELY)
    group = ["unit_id", "record_ix", "scope"]
    mine = named.where(F.col("policy.identity") & F.col("independent")).select(*group, "detector").distinct()
    known = mine.groupBy(*group).agg(F.collect_set("detector").alias("_identity"))
    known = known.select(*[F.col(c).alias(f"_{c}") for c in group], "_identity")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group]
    joined = named.join(known, on[0] & on[1] & on[2], "left")
    up = (
        (F.col("tier") == POSSIBLE) & F.col("policy.identity_corroboration") & ~F.col("needs_context")
        & (F.size(F.coalesce("_identity", F.array().cast("array<string>"))) >= 2)
        & ~F.coalesce(F.expr("array_contains(_identity, detector)"), F.lit(False))
    )
    return joined.withColumn("_up", up).withColumn(
        "evidence", F.when(F.col("_up"), F.concat("evidence", F.array(F.lit("record:identity")))).otherwise(F.col("evidence"))
    ).withColumn("tier", F.when(F.col("_up"), LIKELY).otherwise(F.col("tier"))).select(*candidates.columns, "independent")


# --- columns ---------------------------------------------------------------------------------------------------


def column_profiles(candidates: DataFrame) -> DataFrame:
    """Matching and validated cells, tiers of cells, different values and first place, per unit, column and detector."""
    per_cell = candidates.groupBy(*PAIR, "category", "severity", "cell_id").agg(
        F.max("tier").alias("tier"), F.max("validated").alias("validated"), F.min("seq").alias("seq")
    )
    counts = per_cell.groupBy(*PAIR).agg(
        F.min_by("category", "seq").alias("category"), F.min_by("severity", "seq").alias("severity"), F.count("*").alias("matches"),
        F.sum(F.col("validated").cast("long")).alias("validated"), *[F.count_if(F.col("tier") == t).alias(f"t{t}") for t in range(3)],
        F.min("seq").alias("first_seq"),
    )
    values = candidates.groupBy(*PAIR).agg(F.count_distinct("value").alias("distinct_values"))
    return counts.join(values, PAIR)


def majority(t2: str = "t2", t1: str = "t1", matches: str = "matches") -> Column:
    return F.when(F.col(t2) * 2 >= F.col(matches), VERY_LIKELY).when((F.col(t2) + F.col(t1)) * 2 >= F.col(matches), LIKELY).otherwise(POSSIBLE)


def column_verdicts(profiles: DataFrame, sampled: DataFrame, ratio: float | None = None, least: int | None = None, overrides: Overrides = None) -> DataFrame:
    """Profiles with sampled, ratio, classified and verdict_tier (null where the column is not classified)."""
    joined = with_policy(profiles.join(sampled, ["unit_id", "column"], "left").fillna(0, ["sampled"]), overrides)
    need = F.lit(least) if least is not None else F.col("policy.column_min_matches")
    floor = F.lit(ratio) if ratio is not None else F.col("policy.column_ratio")
    share = F.try_divide(F.when(F.col("policy.column_requires_validation"), F.col("validated")).otherwise(F.col("matches")), "sampled")
    yes = F.col("policy.column_classify") & (F.col("sampled") > 0) & (F.col("matches") >= need) & (F.col("distinct_values") >= need) & (share >= floor)
    return joined.withColumn("ratio", share).withColumn("classified", F.coalesce(yes, F.lit(False))).withColumn(
        "verdict_tier", F.when(F.col("classified"), raised(majority()))
    )


def column_owners(verdicts: DataFrame) -> DataFrame:
    """The detector that owns each classified column: mostly validated, densest, best validated, first seen."""
    strength = F.struct(
        (F.try_divide("validated", "sampled") >= 0.5).alias("a"), F.col("ratio").alias("b"), F.col("validated").alias("c"), (-F.col("first_seq")).alias("d")
    )
    return verdicts.where("classified").groupBy("unit_id", "column").agg(F.max_by("detector", strength).alias("owner"))


def without_losers(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Hits of other detectors than a column's owner stay only with a case of their own.

    Independent hits stay unless a hit of the owner in the same cell covers 80 % of them (an interval anti-join
    within the cell); very likely ones stay for exempt categories or detectors that validate a fifth of the column.
    """
    owners = column_owners(verdicts)
    own = verdicts.select(*PAIR, (F.coalesce(F.try_divide("validated", "sampled"), F.lit(0.0)) >= STRAGGLER_RATIO).alias("_proof"))
    few = counted(verdicts)
    rows = candidates.join(few(owners), ["unit_id", "column"], "left").join(few(own), PAIR, "left")
    loser = F.col("owner").isNotNull() & (F.col("owner") != F.col("detector"))
    fine = rows.where(~loser)
    losers = rows.where(loser)
    spans = rows.where((F.col("owner") == F.col("detector")) & ~F.col("encoded")).select(
        *[F.col(c).alias(f"_{c}") for c in CELL], F.col("column").alias("_column"), F.col("start_ix").alias("_s"), F.col("end_ix").alias("_e")
    )
    # the two ways to stay share no row, so that no key has to tell hits apart
    proven = F.coalesce((F.col("category").isin(*EXEMPT_CATEGORIES) | F.coalesce("_proof", F.lit(False))) & (F.col("tier") == VERY_LIKELY), F.lit(False))
    covered = F.least("end_ix", "_e") - F.greatest("start_ix", "_s")
    same = [F.col(c) == F.col(f"_{c}") for c in CELL]
    apart = losers.where(F.col("independent") & ~proven).join(
        spans, same[0] & same[1] & (F.col("column") == F.col("_column")) & ~F.col("encoded") & (covered > 0)
        & (covered / F.greatest(F.lit(1), F.col("end_ix") - F.col("start_ix")) >= SAME_SPAN), "left_anti",
    )
    kept = apart.select(*candidates.columns).unionByName(losers.where(proven).select(*candidates.columns))
    return fine.select(*candidates.columns).unionByName(kept)


def promoted_by_count(candidates: DataFrame, group: list[str], least: int | None = None, overrides: Overrides = None) -> DataFrame:
    """Possible hits become likely where their group holds enough different ones."""
    named = with_policy(candidates, overrides)
    open_ = (F.col("tier") == POSSIBLE) & (F.col("policy.context") != "none") & F.col("policy.count_promotion")
    counts = named.where(open_).groupBy(*group).agg(F.count_distinct("value").alias("_n"))
    counts = counts.select(*[F.col(c).alias(f"_{c}") for c in group], "_n")
    on = F.lit(True)
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = named.join(counts, on, "left")
    need = F.lit(least) if least is not None else F.col("policy.min_count")
    up = F.coalesce(open_ & (F.col("_n") >= need), F.lit(False))
    return joined.withColumn("_up", up).withColumn(
        "evidence", F.when(F.col("_up"), F.concat("evidence", F.array(F.concat(F.lit("count:"), F.col("_n").cast("string"))))).otherwise(F.col("evidence"))
    ).withColumn("tier", F.when(F.col("_up"), LIKELY).otherwise(F.col("tier"))).select(*candidates.columns)


def sibling_columns(pairs: DataFrame, fields: DataFrame, overrides: Overrides = None) -> DataFrame:
    """For each (unit, column, detector) the columns of the same parent whose names corroborate the detector.

    ``pairs``: unit_id, column, detector, category; ``fields``: unit_id, column, words. A self-join of the columns,
    not of the cells, on the unit and the parent's path.
    """
    parent = F.regexp_extract("column", r"^(.*)\.[^.]*$", 1)
    mine = with_policy(pairs.select(*PAIR, "category").distinct(), overrides).where("policy.siblings is not null").withColumn("_parent", parent)
    others = fields.select(F.col("unit_id").alias("_u"), F.col("column").alias("_other"), parent.alias("_p"), "words")
    hit = mine.join(others, (F.col("unit_id") == F.col("_u")) & (F.col("_parent") == F.col("_p")) & (F.col("column") != F.col("_other")) & F.expr("words rlike policy.siblings"))
    return hit.groupBy(*PAIR).agg(F.array_sort(F.collect_set("_other")).alias("siblings"))


def promoted_by_columns(candidates: DataFrame, verdicts: DataFrame, siblings: DataFrame | None = None, overrides: Overrides = None) -> DataFrame:
    """Hits rise to the tier of their column's verdict, one more where siblings corroborate it; others may rise by count."""
    v = verdicts.select(*PAIR, "ratio", "verdict_tier")
    if siblings is not None:
        v = v.join(siblings, PAIR, "left")
        v = v.withColumn("verdict_tier", F.when(F.size(F.coalesce("siblings", F.array().cast("array<string>"))) > 0, raised(F.col("verdict_tier"))).otherwise(F.col("verdict_tier")))
    else:
        v = v.withColumn("siblings", F.lit(None).cast("array<string>"))
    joined = candidates.join(counted(verdicts)(v), PAIR, "left")
    tags = F.filter(F.array(
        F.format_string("column:%.2f", F.col("ratio")),
        F.when(F.size(F.coalesce("siblings", F.array().cast("array<string>"))) > 0, F.concat(F.lit("siblings:"), F.concat_ws(",", F.slice("siblings", 1, 3)))),
    ), lambda x: x.isNotNull())
    yes = joined.where(F.col("verdict_tier").isNotNull()).withColumn("tier", F.greatest("tier", "verdict_tier")).withColumn("evidence", F.concat("evidence", tags))
    no = promoted_by_count(joined.where(F.col("verdict_tier").isNull()).select(*candidates.columns), PAIR, overrides=overrides)
    return yes.select(*candidates.columns).unionByName(no)


def merged_evidence(lists: Column) -> Column:
    """Different entries of an array of evidence arrays, in order of first appearance."""
    return F.array_distinct(F.flatten(lists))


def aggregated(findings: DataFrame, verdicts: DataFrame, threshold: int = AGGREGATION_THRESHOLD) -> DataFrame:
    """Groups of at least ``threshold`` findings of a column and detector become one finding with statistics.

    The first finding represents the group; its tier is the greatest, its evidence that of all in order. Evidence is
    first reduced to its different lists, which are few, before it is gathered.
    """
    stats = ["occurrences", "column_sampled", "column_matches", "column_ratio", "column_validated_matches", "column_validated_ratio"]
    sizes = findings.groupBy(*PAIR).agg(F.count("*").alias("occurrences"), F.max("tier").alias("_tier"), F.min_by(F.struct(*findings.columns), "seq").alias("_first"))
    sizes = sizes.where(F.col("occurrences") >= threshold) if threshold else sizes.where(F.lit(False))
    lists = findings.groupBy(*PAIR, "evidence").agg(F.min("seq").alias("_s")).groupBy(*PAIR).agg(
        F.array_sort(F.collect_list(F.struct("_s", "evidence"))).alias("_lists")
    )
    v = verdicts.select(
        *PAIR, F.col("sampled").alias("column_sampled"), F.col("matches").alias("column_matches"),
        F.round(F.try_divide("matches", "sampled"), 3).alias("column_ratio"), F.col("validated").alias("column_validated_matches"),
        F.round(F.try_divide("validated", "sampled"), 3).alias("column_validated_ratio"),
    )
    folded = sizes.join(lists, PAIR).join(v, PAIR, "left")
    keep = [c for c in findings.columns if c not in (*PAIR, "tier", "evidence", "location")]
    grouped = folded.select(
        *PAIR, F.col("_tier").alias("tier"), merged_evidence(F.transform("_lists", lambda x: x["evidence"])).alias("evidence"),
        F.concat(F.lit("Column '"), F.col("column"), F.lit("' ("), F.col("occurrences"), F.lit(" matches)")).alias("location"),
        *[F.col("_first").getField(c).alias(c) for c in keep], F.lit(True).alias("aggregated"), *stats,
    )
    single = findings.join(sizes.select(*PAIR), PAIR, "left_anti")
    kinds = {f.name: f.dataType for f in grouped.schema}
    single = single.select(*PAIR, "tier", "evidence", "location", *keep, F.lit(False).alias("aggregated"), *[F.lit(None).cast(kinds[s]).alias(s) for s in stats])
    return grouped.unionByName(single)


# --- output ----------------------------------------------------------------------------------------------------


def clubbed(findings: DataFrame) -> DataFrame:
    """Per unit, detector and category: greatest tier, occurrences and number of different values; the values are rows of ``club_values``."""
    count = F.coalesce("occurrences", F.lit(1)) if "occurrences" in findings.columns else F.lit(1)
    by_value = findings.groupBy("unit_id", "detector", "category", "value").agg(F.max("tier").alias("tier"), F.sum(count).alias("n"))
    return by_value.groupBy("unit_id", "detector", "category").agg(F.max("tier").alias("tier"), F.sum("n").alias("total_count"), F.count("*").alias("n_values"))


def club_values(findings: DataFrame) -> DataFrame:
    """The values of the clubs with their different places, one row per place: a value seen in a billion places is no single row's burden.

    ``first_seq`` orders the places of a value as they were found.
    """
    return findings.groupBy("unit_id", "detector", "category", "value", "location").agg(F.min("seq").alias("first_seq"), F.max("tier").alias("tier"))


def with_clean_units(units: DataFrame, clubs: DataFrame) -> DataFrame:
    """Every scanned unit with its clubs; units without findings have an empty list."""
    packed = clubs.groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct("detector", "category", "tier", "total_count"))).alias("findings"))
    joined = units.join(packed, "unit_id", "left")
    empty = F.array().cast(packed.schema["findings"].dataType)
    return joined.withColumn("findings", F.coalesce("findings", empty))


def sheet_of(unit_id: Column) -> tuple[Column, Column]:
    """Object and sheet of a unit id like ``book.xlsx [Sheet]``; the sheet is null where there is none."""
    name = F.regexp_extract(unit_id, r"^(.*) \[([^\]]+)\]$", 2)
    return F.when(name != "", F.regexp_extract(unit_id, r"^(.*) \[([^\]]+)\]$", 1)).otherwise(unit_id), F.when(name != "", name)


def classify(
    candidates: DataFrame, sampled: DataFrame, fields: DataFrame, *, unit_hints: DataFrame | None = None, least_tier: int = LIKELY,
    threshold: int = AGGREGATION_THRESHOLD, allowed: DataFrame | None = None, allow_patterns: list[str] | None = None, overrides: Overrides = None,
    ratio: float | None = None, least_matches: int | None = None,
) -> DataFrame:
    """The whole chain, in the order that the promotions must keep.

    ``unit_hints``: unit_id, unit_name, detector (see ``engine.units.unit_hints``); ``allowed``: a column ``value`` of values that are no findings,
    as are those that match one of ``allow_patterns``; ``overrides``: policies by detector; ``ratio``, ``least_matches``: instead of the policies'.
    """
    rows = without_negative_fields(candidates, fields.drop("unit_id").dropDuplicates(["column"]), overrides)
    if allowed is not None or allow_patterns:
        listed = allowed if allowed is not None else candidates.select("value").limit(0)
        rows = without_allowed(rows, listed, "value", "value", allow_patterns)
    if unit_hints is not None:
        rows = hinted_by_unit(rows, unit_hints)
    rows = capped_by_context(rows, overrides)
    # read by five operators below, each of them a shuffle: written once instead of computed five times
    rows = checkpointed(corroborated_by_record(rows, overrides))
    verdicts = checkpointed(column_verdicts(column_profiles(rows), sampled, ratio, least_matches, overrides))
    kept = checkpointed(without_losers(rows, verdicts))
    kept = promoted_by_columns(kept, verdicts, sibling_columns(rows, fields, overrides), overrides)
    return distinct_findings(aggregated(checkpointed(at_least(kept, least_tier)), verdicts, threshold))
