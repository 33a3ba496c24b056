"""Uniform samples of a fixed size from data that arrives in pieces.

1. The pieces are counted after arrival; from the counts each group gets so many leaves that
   none exceeds ``leaf_rows``. A record's leaf is its group, the piece it first arrived in and
   a hash bucket, so it is the same on every attempt of a task.
2. The sample size is split down a binary tree over the leaves by hypergeometric draws.
3. Within each leaf with a quota, sequential selection sampling chooses exactly that many places,
   and the records at these places are the sample.

Every subset of the wanted size is equally likely. All draws are seeded by (seed, group, leaf).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

LEAF_ROWS = 100_000
#: rows of a sample (three short columns) that are sent to every task; larger samples are joined by a shuffle
MOST_BROADCAST = 200_000
#: leaves whose quotas are split at once; of more, bundles of leaves come first
BUNDLE_LEAVES = 1000


def generator(*parts: object) -> np.random.Generator:
    digest = hashlib.blake2b("\x1f".join(map(str, parts)).encode(), digest_size=16).digest()
    return np.random.Generator(np.random.PCG64(int.from_bytes(digest, "big")))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` draws without replacement hit the ``good`` ones, by inversion from the most likely number outwards.

    The chances of neighbouring numbers follow from one another, so that the work grows with the spread, not with the
    numbers: a population of any size takes as many steps as the root of the draws.
    """
    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    if low >= high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    top = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(total, draws))
    u, up, down, p_up, p_down = rng.random(), mode, mode, top, top
    u -= top
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
        if p_up + p_down < 1e-300:
            break
    return mode


def split_quota(rng: np.random.Generator, sizes: list[int], k: int) -> list[int]:
    """Quota of each leaf: k split at every inner node of a balanced binary tree."""
    quotas = [0] * len(sizes)
    sums = np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))])
    todo = [(0, len(sizes), k)]
    while todo:
        a, b, n = todo.pop()
        if n == 0:
            continue
        if b - a == 1:
            quotas[a] = n
            continue
        mid = (a + b) // 2
        left = hypergeometric(rng, int(sums[mid] - sums[a]), int(sums[b] - sums[mid]), n)
        todo += [(a, mid, left), (mid, b, n - left)]
    return quotas


def select_places(rng: np.random.Generator, size: int, quota: int) -> np.ndarray:
    """Sequential selection: places 0..size-1 are passed in order, and exactly ``quota`` are kept.

    A place is kept with the chance (still wanted) / (still to come); how many places are skipped
    before the next kept one is found from the running product of the chances to skip.
    """
    if quota >= size:
        return np.arange(size, dtype=np.int64)
    kept = np.empty(quota, dtype=np.int64)
    at = 0
    for i in range(quota):
        wanted, coming = quota - i, size - at
        u, base, skip, chunk = rng.random(), 1.0, 0, 64
        while True:
            left = coming - skip - np.arange(min(chunk, coming - skip - wanted + 1))
            chance = base * np.cumprod(np.maximum(left - wanted, 0) / left)
            over = int(np.searchsorted(-chance, -u, side="left"))
            if over < len(chance):
                skip += over
                break
            base, skip, chunk = chance[-1], skip + len(chance), chunk * 2
        kept[i] = at + skip
        at = kept[i] + 1
    return kept


def _quotas(seed: int, level: str):
    """Splits a quota among the parts of one group (and bundle): columns _part, _size, _k in; _quota and population out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_part", kind="stable")
        sizes = [int(x) for x in pdf["_size"]]
        total = sum(sizes)
        quotas = split_quota(generator(seed, level, pdf["_group"].iloc[0], pdf["_bundle"].iloc[0]), sizes, min(max(int(pdf["_k"].iloc[0]), 0), total))
        out = pdf[["_group", "_bundle", "_part", "_size"]].assign(_quota=quotas, population=total)
        return out[out["_quota"] > 0]

    return run


def _places(seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (g, leaf, int(place) + 1, int(n))
                for g, leaf, size, quota, n in pdf[["_group", "_leaf", "_size", "_quota", "population"]].itertuples(index=False)
                for place in select_places(generator(seed, g, leaf), int(size), int(quota))
            ]
            yield pd.DataFrame(rows, columns=["_group", "_leaf", "_place", "population"])

    return run


def sample_records(
    df: DataFrame, sizes: DataFrame, group: str, record: str, piece: str, size: str, *, seed: int = 17,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """A uniform sample of exactly ``sizes.size`` different records of each group, or all if there are fewer.

    Result: ``df``'s columns of the chosen records plus ``population``, the group's number of different
    records. A record delivered several times counts once and comes out as one of the rows of the piece it
    first arrived in. Groups without a size, sizes null or below 1, and null records give no rows; a group's
    repeated sizes count with the greatest. A null group or piece is a group or piece like any other.
    """
    plan = sizes.groupBy(F.col(group).alias("_group")).agg(F.max(size).cast("long").alias("_k")).where("_k > 0")
    seen = df.where(F.col(record).isNotNull()).select(
        F.col(group).alias("_group"), F.col(record).alias("_record"), F.col(piece).alias("_piece")
    )
    seen = seen.join(plan.select("_group"), seen["_group"].eqNullSafe(plan["_group"]), "left_semi")
    arrived = seen.groupBy("_group").agg(F.count("*").alias("_rows"))
    buckets = arrived.select(F.col("_group").alias("_g"), F.ceil(F.col("_rows") / leaf_rows).cast("int").alias("_buckets"))
    # the group's buckets are decided before copies are merged: a bucket holds all copies of its records
    placed = seen.join(buckets, seen["_group"].eqNullSafe(buckets["_g"])).select(
        "_group", F.pmod(F.xxhash64("_record"), F.col("_buckets")).cast("int").alias("_bucket"), "_record", "_piece"
    )
    first = placed.groupBy("_group", "_bucket", "_record").agg(F.min("_piece").alias("_piece"))
    leaves = first.select(
        "_group", F.concat_ws("/", F.coalesce(F.col("_piece").cast("string"), F.lit("-")), "_bucket").alias("_leaf"), "_record", "_piece"
    )
    counted = leaves.groupBy("_group", "_leaf").agg(F.count("*").alias("_size"))
    # a tree of two levels: the group's bundles of leaves, then the leaves of each bundle, so that no task holds all leaves of a group
    bundles = arrived.select(F.col("_group").alias("_g"), F.ceil(F.col("_rows") / (leaf_rows * BUNDLE_LEAVES)).cast("int").alias("_n"))
    counted = counted.join(bundles, F.col("_group").eqNullSafe(F.col("_g"))).select(
        "_group", F.pmod(F.xxhash64("_leaf"), F.col("_n")).cast("int").alias("_bundle"), F.col("_leaf").alias("_part"), "_size"
    )
    kind = df.schema[group].dataType

    def split(rows: DataFrame, keys: list[str], level: str, part: T.DataType) -> DataFrame:
        return rows.groupBy(*keys).applyInPandas(_quotas(seed, level), T.StructType([
            T.StructField("_group", kind), T.StructField("_bundle", T.IntegerType()), T.StructField("_part", part), T.StructField("_size", T.LongType()),
            T.StructField("_quota", T.LongType()), T.StructField("population", T.LongType()),
        ]))

    upper = counted.groupBy("_group", "_bundle").agg(F.sum("_size").alias("_size")).withColumn("_part", F.col("_bundle")).withColumn("_bundle", F.lit(0))
    upper = split(upper.join(plan.withColumnRenamed("_group", "_g"), F.col("_group").eqNullSafe(F.col("_g"))).drop("_g"), ["_group"], "bundles", T.IntegerType())
    upper = upper.select(F.col("_group").alias("_g"), F.col("_part").alias("_b"), F.col("_quota").alias("_k"), F.col("population").alias("_all"))
    lower = counted.join(upper, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_bundle") == F.col("_b")))
    quotas = split(lower.drop("_g", "_b", "_all"), ["_group", "_bundle"], "leaves", T.StringType())
    quotas = quotas.drop("population").join(upper.drop("_k"), F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_bundle") == F.col("_b"))).select(
        "_group", F.col("_part").alias("_leaf"), "_size", "_quota", F.col("_all").alias("population")
    )
    places = quotas.mapInPandas(_places(seed), T.StructType([
        T.StructField("_group", kind), T.StructField("_leaf", T.StringType()), T.StructField("_place", T.LongType()),
        T.StructField("population", T.LongType()),
    ])).select(F.col("_group").alias("_g"), F.col("_leaf").alias("_l"), "_place", "population")
    order = Window.partitionBy("_group", "_leaf").orderBy("_record")
    ranked = leaves.withColumn("_row", F.row_number().over(order))
    chosen = ranked.join(
        places, ranked["_group"].eqNullSafe(places["_g"]) & (F.col("_leaf") == F.col("_l")) & (F.col("_row") == F.col("_place"))
    ).select(F.col("_group").alias("_g"), F.col("_record").alias("_r"), F.col("_piece").alias("_p"), "population")
    # the sizes say how many rows are chosen at most: few of them go to the records, instead of the records to them
    wanted = plan.agg(F.sum("_k")).first()[0] or 0
    rows = df.join(
        F.broadcast(chosen) if wanted <= MOST_BROADCAST else chosen, (F.col(record) == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g")) & F.col(piece).eqNullSafe(F.col("_p"))
    )
    # copies within one piece
    one = rows.groupBy("_g", "_r").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in df.columns], "population")).alias("_row"))
    return one.select("_row.*")
