"""Expected against reported findings as bags: counts, precision, recall, F1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scores(expected: DataFrame, reported: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn and rates per group; both sides have the same columns. Undefined rates are null."""
    keys = expected.columns
    both = expected.withColumn("_e", F.lit(1)).withColumn("_g", F.lit(0)).unionByName(reported.select(*keys).withColumn("_e", F.lit(0)).withColumn("_g", F.lit(1)))
    items = both.groupBy(*keys).agg(F.sum("_e").alias("_e"), F.sum("_g").alias("_g"))
    s = items.groupBy(*by).agg(
        F.sum(F.least("_e", "_g")).alias("tp"), F.sum(F.greatest(F.col("_g") - F.col("_e"), F.lit(0))).alias("fp"),
        F.sum(F.greatest(F.col("_e") - F.col("_g"), F.lit(0))).alias("fn"),
    )
    share = lambda a, b: F.when(b > 0, a / b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.withColumn("precision", share(tp, tp + fp)).withColumn("recall", share(tp, tp + fn)).withColumn("f1", share(2 * tp, 2 * tp + fp + fn))


def bag_difference(expected: DataFrame, reported: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Missing and surplus rows, repeated as often as they are missing or surplus."""
    return expected.exceptAll(reported.select(*expected.columns)), reported.select(*expected.columns).exceptAll(expected)


def span_scores(gold: DataFrame, hits: DataFrame, record: str, by: list[str], least_overlap: float = 0.5) -> DataFrame:
    """Gold spans found by a hit of the same record that covers at least a share of them; hits that find none are false.

    ``gold``: record, label, start_ix, end_ix; ``hits``: record, detector, start_ix, end_ix, tier.
    """
    g = gold.withColumn("_id", F.xxhash64(record, "label", "start_ix", "end_ix"))
    h = hits.select(F.col(record).alias("_r"), F.col("start_ix").alias("_s"), F.col("end_ix").alias("_e"), "detector", "tier")
    cover = F.least("end_ix", "_e") - F.greatest("start_ix", "_s")
    pairs = g.join(h, (F.col(record) == F.col("_r")) & (cover > 0) & (cover / F.greatest(F.lit(1), F.col("end_ix") - F.col("start_ix")) >= least_overlap), "left")
    first = pairs.groupBy("_id", *by).agg(F.max(F.col("_r").isNotNull().cast("int")).alias("found"), F.max("tier").alias("best_tier"))
    return first.groupBy(*by).agg(F.count("*").alias("gold"), F.sum("found").alias("found"), (F.sum("found") / F.count("*")).alias("recall"))


def counters(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """records, cells, empty_cells, texts and characters read per unit, for the report of a scan."""
    by = cells.groupBy("unit_id").agg(
        F.count_distinct("record_ix").alias("records"), F.count("*").alias("cells"), F.count_if(F.coalesce("cell_value", F.lit("")) == "").alias("empty_cells"),
    ).select("*", F.lit(0).cast("long").alias("texts"), F.lit(0).cast("long").alias("characters"))
    of_texts = texts.groupBy("unit_id").agg(F.count_if(F.col("text") != "").alias("texts"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("characters")).select(
        "unit_id", *[F.lit(0).cast("long").alias(c) for c in ("records", "cells", "empty_cells")], "texts", "characters"
    )
    return by.unionByName(of_texts).groupBy("unit_id").agg(*[F.sum(c).alias(c) for c in ("records", "cells", "empty_cells", "texts", "characters")])
