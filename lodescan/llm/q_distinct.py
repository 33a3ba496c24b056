"""Distinct value hashes of ``candidates`` against the counts recorded in ``column_profiles``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodescan.llm.distinct import distinct_by, distinct_by_spec, partials, rolled_up
from lodescan.runtime import latest, table


def _value():
    return F.lower(F.col("value_hash"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = latest(table(spark, sf_dir, "column_profiles"), ["profile_id"], F.col("computed_at"))
    counts = distinct_by_spec(
        table(spark, sf_dir, "candidates"), profiles, "profile_id", ["unit_id", "detector", "cell_key"],
        "scan_date", "first_day", "last_day", _value(),
    )
    recorded = profiles.select("profile_id", (F.col("distinct_n") + F.col("distinct_overflow")).alias("recorded"))
    judged = recorded.join(counts, "profile_id")
    return judged.where(F.abs(F.col("recorded") - F.col("estimate")) > 0.1 * F.col("estimate")).select("profile_id")


def p2_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_by(table(spark, sf_dir, "candidates"), ["scan_date"], _value())


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["scan_date", "unit_id", "detector", "cell_key"]
    return distinct_by(table(spark, sf_dir, "candidates"), keys, _value())


def p2_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = ["unit_id", "detector", "cell_key"]
    return rolled_up(partials(table(spark, sf_dir, "candidates"), dims, _value()), dims)


#: levels whose estimates are compared with exact counts, and the error allowed in standard deviations
LEVELS = {"daily": ["scan_date"], "groups": ["scan_date", "unit_id", "detector", "cell_key"], "combinations": ["unit_id", "detector", "cell_key"]}
ALLOWED = 5


def p2_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per level the number of groups and of those whose estimate is further from the exact count than the stated error allows.

    A check of the sketches, not a way to count: the exact counts need every different value of every group.
    """
    out = None
    for level, keys in LEVELS.items():
        rows = table(spark, sf_dir, "candidates").select(*keys, _value().alias("v")).where("v is not null")
        exact = rows.groupBy(*keys).agg(F.count_distinct("v").alias("exact"))
        got = distinct_by(rows, keys, F.col("v")).select(*[F.col(k).alias(f"_{k}") for k in keys], "estimate", "relative_error")
        on = None
        for k in keys:
            same = F.col(k).eqNullSafe(F.col(f"_{k}"))
            on = same if on is None else on & same
        # two more for groups so small that the error is that of values which share a register
        far = F.abs(F.col("estimate") - F.col("exact")) > 2 + ALLOWED * F.col("relative_error") * F.col("exact")
        counts = exact.join(got, on, "left").agg(F.count("*").alias("groups"), F.count_if(F.coalesce(far, F.lit(True))).alias("outside"))
        counts = counts.select(F.lit(level).alias("level"), "groups", "outside")
        out = counts if out is None else out.unionByName(counts)
    return out


QUERIES = {"p2_within": p2_within, "p2_found": p2_found, "p2_daily": p2_daily, "p2_groups": p2_groups, "p2_combinations": p2_combinations}
ORACLES = {
    "p2_within": " UNION ALL ".join(
        f"SELECT '{level}' AS level, count(*) AS groups, 0::BIGINT AS outside FROM (SELECT DISTINCT {', '.join(keys)} FROM candidates WHERE value_hash IS NOT NULL)"
        for level, keys in LEVELS.items()
    ),
    "p2_found": """
SELECT p.profile_id
FROM column_profiles p LEFT JOIN candidates c
  ON c.scan_date BETWEEN p.first_day AND p.last_day
 AND (p.unit_id IS NULL OR c.unit_id = p.unit_id)
 AND (p.detector IS NULL OR c.detector = p.detector)
 AND (p.cell_key IS NULL OR c.cell_key = p.cell_key)
GROUP BY p.profile_id
HAVING abs(max(p.distinct_n + p.distinct_overflow) - count(DISTINCT lower(c.value_hash))) > 0.1 * count(DISTINCT lower(c.value_hash))
""",
}
