"""Filling containers of a fixed token capacity with documents, balanced by cost.

A document's cost is its estimated work in a transformer: a linear part for its tokens and a
quadratic part for attention within it. Documents longer than the container are cut into full
containers and a rest. Everything else is packed in shards of bounded size: in descending order
each piece goes to the sequence of lowest cost that still has room for it. A shard starts with as
many sequences as its tokens fill; only when none has room a further one is opened.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_DOCS = 4000
LINEAR, QUADRATIC = 1.0, 1.0 / 4096


def cost(tokens: np.ndarray | float, linear: float = LINEAR, quadratic: float = QUADRATIC):
    return linear * tokens + quadratic * tokens * tokens


def assign(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Sequence number of each size (descending order), each at most ``capacity``."""
    n = len(sizes)
    out = np.empty(n, dtype=np.int64)
    start = max(1, math.ceil(int(sizes.sum()) / capacity)) if n else 0
    room = np.full(n + start, -1, dtype=np.int64)
    load = np.full(n + start, np.inf)
    room[:start], load[:start] = capacity, 0.0
    used = start
    work = cost(sizes.astype(np.float64))
    for i in range(n):
        fits = np.where(room[:used] >= sizes[i], load[:used], np.inf)
        best = int(fits.argmin()) if used else 0
        if used == 0 or not np.isfinite(fits[best]):
            best = used
            used += 1
            room[best], load[best] = capacity, 0.0
        out[i] = best
        room[best] -= sizes[i]
        load[best] += work[i]
    return out


def _shard_packer(names: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity, shard = int(pdf["_capacity"].iloc[0]), int(pdf["_shard"].iloc[0])
        pdf = pdf.assign(_rest=pdf["_tokens"] % capacity).sort_values(["_rest", "_doc"], ascending=[False, True], kind="stable")
        total, left = pdf["_tokens"].to_numpy(np.int64), pdf["_rest"].to_numpy(np.int64)
        full = total // capacity
        places = np.full(len(pdf), -1, dtype=np.int64)
        places[left > 0] = assign(left[left > 0], capacity)
        out = []
        for doc, n, whole, rest, place in zip(pdf["_doc"], total.tolist(), full.tolist(), left.tolist(), places.tolist()):
            pieces = whole + (rest > 0)
            out += [(doc, i, pieces, i * capacity, capacity, f"d{doc}-{i}") for i in range(whole)]
            if rest:
                out.append((doc, whole, pieces, whole * capacity, rest, f"s{shard}-{place}"))
            if not n:
                out.append((doc, None, 0, 0, 0, None))
        result = pd.DataFrame(out, columns=names[1:])
        result.insert(0, names[0], pdf["_plan"].iloc[0])
        return result

    return run


def pack_documents(
    docs: DataFrame, doc_id: str, n_tokens: str, plans: DataFrame, plan_id: str, capacity: str, *,
    shard_docs: int = SHARD_DOCS, plans_at_once: int = 1000,
) -> DataFrame:
    """Pieces of documents with their containers, for every plan.

    Result: plan_id, doc_id, piece_ix, pieces, start_token, tokens, container_id. ``docs`` has one row per
    document with its size. A document is split only if it exceeds the capacity: full containers from its
    start, and a rest that is packed with others. Documents without tokens (null or 0) come out with a null
    container and no piece. Plans with a null or non-positive capacity give no rows; many plans are gone through in
    blocks of ``plans_at_once``. Repeated rows of a document are packed as often as they occur.
    """
    listed = plans.select(plan_id, F.col(capacity).cast("long")).where(F.col(capacity) > 0).distinct().collect()
    if len(listed) > plans_at_once:
        out = None
        for at in range(0, len(listed), plans_at_once):
            some = plans.where(F.struct(plan_id, F.col(capacity).cast("long")).isin(*[F.struct(F.lit(p).cast(plans.schema[plan_id].dataType), F.lit(c).cast("long")) for p, c in listed[at:at + plans_at_once]]))
            part = pack_documents(docs, doc_id, n_tokens, some, plan_id, capacity, shard_docs=shard_docs, plans_at_once=plans_at_once)
            out = part if out is None else out.unionByName(part)
        return out
    types = {"_plan": plans.schema[plan_id].dataType.simpleString(), "_doc": docs.schema[doc_id].dataType.simpleString()}
    wanted = F.array(*[F.struct(F.lit(p).cast(types["_plan"]).alias("_plan"), F.lit(c).cast("long").alias("_capacity")) for p, c in listed])
    if not listed:
        wanted = F.array().cast(f"array<struct<_plan:{types['_plan']},_capacity:bigint>>")
    shards = max(1, math.ceil(docs.count() / shard_docs))
    rows = docs.select(
        F.col(doc_id).alias("_doc"), F.greatest(F.coalesce(F.col(n_tokens), F.lit(0)), F.lit(0)).cast("long").alias("_tokens"),
        F.pmod(F.xxhash64(doc_id), F.lit(shards)).alias("_shard"), F.explode(wanted).alias("_w"),
    ).select("_w._plan", "_w._capacity", "_shard", "_doc", "_tokens")
    names = [plan_id, doc_id, "piece_ix", "pieces", "start_token", "tokens", "container_id"]
    kinds = [types["_plan"], types["_doc"], "int", "int", "long", "long", "string"]
    return rows.groupBy("_plan", "_capacity", "_shard").applyInPandas(
        _shard_packer(names), ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))
    )


def packing_report(packed: DataFrame, plans: DataFrame, plan_id: str, capacity: str) -> DataFrame:
    """Containers, tokens and share of room used, per plan."""
    used = packed.where(F.col("container_id").isNotNull()).groupBy(plan_id, "container_id").agg(F.sum("tokens").alias("_t"))
    by = used.groupBy(plan_id).agg(F.count("*").alias("containers"), F.sum("_t").alias("tokens"), F.max("_t").alias("fullest"))
    caps = plans.select(F.col(plan_id).alias("_p"), F.col(capacity).alias("_c"))
    return by.join(caps, F.col(plan_id) == F.col("_p")).select(
        plan_id, "containers", "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * F.col("_c")), 4).alias("filled")
    )
