"""Mixing sources to target shares of the tokens.

The total is the greatest one at which every source that has any documents can give its share
without repeating a document more often than allowed; shares of absent sources fall to the others in
proportion. A source's budget is met by complete epochs first and then by a fraction of its documents,
drawn without replacement with weights after Efraimidis and Spirakis: each document gets the key
-ln(u) / weight, and the documents with the least keys are taken until their tokens fill the budget.

The prefix sums run in two steps, over key ranges of about a thousand documents, as many as the source needs, and then only
within the one range in which the budget ends. From there on a document can only be taken if it is no longer than the room
that is left; of documents of one length at most as many as fit into the room, the first ones in key order, so that only
these are tried one by one. A source with a third of all documents is hence no task's burden, and none is passed over.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodescan.runtime import checkpointed, table_bytes

#: documents of a key range, by which prefix sums are taken
RANGE_DOCS = 1000
#: words in a row among which quality counts the different ones
STRETCH_WORDS = 50


def uniform(*parts: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the parts and the seed only."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11).cast("double") + 0.5) / float(1 << 53)


def quality(text: Column) -> Column:
    """How much a text reads like prose, 0.05 to 1: the share of letters and blanks, times the share of different lines and of different
    words, so that logs, tables and repetition weigh less. All of the text counts. Long texts repeat words by nature, so words are compared
    within each stretch of fifty and the stretches added up; what repeats farther apart lowers the share of lines only."""
    plain = F.try_divide(F.length(F.regexp_replace(text, r"[^\p{L}\s]", "")), F.length(text))
    lines, words = F.split(text, r"\n"), F.split(F.lower(F.trim(text)), r"\s+")
    different = F.try_divide(F.size(F.array_distinct(lines)), F.size(lines)) * _different_words(words)
    return F.greatest(F.coalesce(plain * different, F.lit(0.0)), F.lit(0.05))


def _different_words(words: Column) -> Column:
    """Share of different words, counted by stretches."""

    def share(ws: Column) -> Column:
        starts = F.sequence(F.lit(1), F.array_size(ws), F.lit(STRETCH_WORDS))
        return F.try_divide(F.aggregate(starts, F.lit(0), lambda n, at: n + F.size(F.array_distinct(F.slice(ws, at, STRETCH_WORDS)))), F.size(ws))

    return F.transform(F.array(words), share)[0]  # as an element the text is split once, not for each use


def source_key(source: Column) -> Column:
    return F.lower(F.trim(source))


def plan_budgets(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: have (tokens), docs, share, budget (tokens) and epochs."""
    have = docs.groupBy("source").agg(F.sum("tokens").alias("have"), F.count("*").alias("n_docs"))
    wanted = targets.where("share > 0").join(have, "source", "left").fillna(0, ["have", "n_docs"])
    able = F.col("have") * F.greatest(F.coalesce(F.col("max_repeats"), F.lit(1)), F.lit(0))
    w = Window.partitionBy("mix_id")
    wanted = wanted.withColumn("able", able).withColumn("present", F.sum(F.when(able > 0, F.col("share")).otherwise(0.0)).over(w))
    wanted = wanted.withColumn("total", F.min(F.when(able > 0, able * F.col("present") / F.col("share"))).over(w))
    budget = F.when(F.col("able") > 0, F.least(F.col("total") * F.col("share") / F.col("present"), F.col("able"))).otherwise(0.0)
    wanted = wanted.withColumn("budget", F.floor(budget + 1e-6).cast("long"))
    epochs = F.when(F.col("have") > 0, F.floor(F.col("budget") / F.col("have"))).otherwise(0).cast("long")
    return wanted.withColumn("epochs", epochs).withColumn("open", F.col("budget") - F.col("epochs") * F.col("have")).drop("able", "present")


def mix_documents(docs: DataFrame, targets: DataFrame, *, seed: int = 23, range_docs: int = RANGE_DOCS) -> DataFrame:
    """Chosen documents with their number of copies: mix_id, source, doc_id, copies, tokens.

    ``docs``: doc_id, source, tokens, weight; ``targets``: mix_id, source, share, max_repeats (one row per
    mix and source). Sources are compared without case and outer blanks. Documents without a source, without
    tokens or of a source no mix names are not chosen; null weights count as 1. Within a source the fraction
    takes documents in key order while their sum stays within the budget; at its end longer ones are passed over.
    """
    docs = docs.select(
        "doc_id", source_key(F.col("source")).alias("source"), F.col("tokens").cast("long").alias("tokens"),
        F.coalesce(F.col("weight"), F.lit(1.0)).alias("weight"),
    ).where(F.col("source").isNotNull() & (F.col("tokens") > 0))
    docs = checkpointed(docs)  # read three times below; counting tokens is the dear part
    side = table_bytes(targets) <= 8 << 20
    targets = targets.select("mix_id", source_key(F.col("source")).alias("source"), "share", "max_repeats")
    ranges = F.greatest(F.ceil(F.col("n_docs") / range_docs), F.lit(1)).alias("ranges")
    budgets = plan_budgets(docs, targets).where("budget > 0").select("mix_id", "source", "epochs", "open", ranges)
    drawn = docs.join(F.broadcast(budgets) if side else budgets, "source")
    key = -F.log(uniform(F.col("mix_id"), F.col("doc_id"), seed=seed)) / F.greatest(F.col("weight"), F.lit(1e-9))
    drawn = drawn.withColumn("key", key).withColumn("range", F.floor((1 - F.exp(-F.col("key"))) * F.col("ranges")))
    sums = drawn.groupBy("mix_id", "source", "range").agg(F.sum("tokens").alias("in_range"), F.first("open").alias("budget"))
    group = Window.partitionBy("mix_id", "source")
    upto = group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_range").over(upto), F.lit(0)))
    over = F.col("before") + F.col("in_range") > F.col("budget")
    # one row per mix and source: the range in which the budget ends and the room it begins with; none where all documents fit
    edges = sums.where(over).groupBy("mix_id", "source").agg(F.min("range").alias("edge"), F.min_by(F.col("budget") - F.col("before"), "range").alias("room"))
    drawn = drawn.join(F.broadcast(edges) if side else edges, ["mix_id", "source"], "left")
    keep = ["mix_id", "source", "doc_id", "tokens", "epochs", "taken"]
    kinds = {f.name: f.dataType.simpleString() for f in drawn.schema} | {"taken": "long"}
    inside = F.col("edge").isNull() | (F.col("range") < F.col("edge"))
    sure = drawn.where(inside).withColumn("taken", F.lit(1).cast("long")).select(*keep)
    left = drawn.where(~inside)
    alike = Window.partitionBy("mix_id", "source", "tokens").orderBy("key", "doc_id")
    tried = left.where("tokens <= room").withColumn("_n", F.row_number().over(alike)).where("_n <= room div tokens")
    chosen = tried.select("mix_id", "source", "doc_id", "tokens", "epochs", "key", "room").groupBy("mix_id", "source").applyInPandas(
        _fill, ", ".join(f"{c} {kinds[c]}" for c in keep)
    )
    # documents that no epoch takes come from the tried ones only; the others of the edge come with their epochs
    rest = left.where("epochs > 0").join(
        chosen.where("taken > 0").select(F.col("mix_id").alias("_m"), F.col("source").alias("_s"), F.col("doc_id").alias("_d")),
        (F.col("mix_id") == F.col("_m")) & (F.col("source") == F.col("_s")) & (F.col("doc_id") == F.col("_d")), "left_anti",
    ).withColumn("taken", F.lit(0).cast("long")).select(*keep)
    rows = sure.unionByName(chosen.where("taken > 0")).unionByName(rest).withColumn("copies", F.col("epochs") + F.col("taken"))
    return rows.where("copies > 0").select("mix_id", "source", "doc_id", "copies", "tokens")


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """In key order every document that still fits into the room left at the edge."""
    pdf = pdf.sort_values(["key", "doc_id"], kind="stable")
    room, taken = int(pdf["room"].iloc[0]), []
    for n in pdf["tokens"].tolist():
        taken.append(int(n <= room))
        room -= n * taken[-1]
    return pdf.assign(taken=taken)[["mix_id", "source", "doc_id", "tokens", "epochs", "taken"]]


def mix_report(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached share of each source of each mix; sources that gave nothing have 0."""
    targets = targets.select("mix_id", source_key(F.col("source")).alias("source"), "share")
    by = chosen.groupBy("mix_id", "source").agg(
        F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.max("copies").alias("most_copies"), F.count("*").alias("documents")
    )
    rows = targets.join(by, ["mix_id", "source"], "left").fillna(0, ["tokens", "most_copies", "documents"])
    total = F.sum("tokens").over(Window.partitionBy("mix_id"))
    return rows.withColumn("reached", F.when(total > 0, F.col("tokens") / total).otherwise(0.0))
