"""Distinct counts from mergeable sketches with a known error.

A sketch has 2**p registers. A value's hash picks a register and a rank (the place of its
lowest set bit, geometrically distributed). A register keeps the greatest rank seen and two
indicator bits that say whether each of the next two lower ranks was seen as well, one byte in
all. Sketches merge without loss: the greater rank wins and the other register's ranks set
indicator bits. The count is the maximum-likelihood estimate under independent Poisson arrivals;
its relative standard error is about 0.76 / sqrt(2**p), 1.2 % at p = 12.

A sketch is stored, shuffled and merged as a binary value: three bytes for each filled register
(number and state) while few are filled, else one byte for every register, so 4 KB at most. Every
task merges what it has before anything is shuffled; how much a task holds at once is bounded, and
a group however large arrives as at most one sketch from each task (or from each full buffer of one).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodescan.runtime import small, table_bytes

PRECISION = 12
#: registers a task gathers before it hands its partial sketches on
BUFFER = 4_000_000
#: tasks whose sketches are merged at once where there are more of them
BUNDLE = 2000


def standard_error(p: int = PRECISION) -> float:
    return 0.7608 / float(np.sqrt(2.0**p))


# --- states and binary form ------------------------------------------------------------------------------------


def window(state: np.ndarray) -> np.ndarray:
    """Ranks a register's state tells of, as a bit map."""
    state = state.astype(np.uint64)
    return ((np.uint64(4) + (state & np.uint64(3))) << (state >> np.uint64(2))) >> np.uint64(3)


def state_of(ranks: np.ndarray) -> np.ndarray:
    """Greatest rank times four plus the two indicator bits, of bit maps of ranks (not empty)."""
    # the exponent of a double is exact here: the bits below the third greatest are cut off first
    top = np.frexp(ranks.astype(np.float64))[1].astype(np.uint64)
    top -= (ranks >> (top - np.uint64(1))) == 0
    return ((top << np.uint64(2)) | (((ranks << np.uint64(2)) >> (top - np.uint64(1))) & np.uint64(3))).astype(np.uint8)


def packed(reg: np.ndarray, state: np.ndarray, p: int = PRECISION) -> bytes:
    """Binary form of the filled registers."""
    if 3 * len(reg) < 1 << p:
        return np.ascontiguousarray(np.stack([reg & 255, reg >> 8, state], axis=1).astype(np.uint8)).tobytes()
    dense = np.zeros(1 << p, dtype=np.uint8)
    dense[reg] = state
    return dense.tobytes()


def unpacked(sketch: bytes, p: int = PRECISION) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and states of the filled registers."""
    raw = np.frombuffer(sketch, dtype=np.uint8)
    if len(raw) == 1 << p:
        reg = np.flatnonzero(raw)
        return reg, raw[reg]
    triples = raw.reshape(-1, 3)
    return triples[:, 0].astype(np.int64) | triples[:, 1].astype(np.int64) << 8, triples[:, 2]


def joined(group: np.ndarray, reg: np.ndarray, ranks: np.ndarray, p: int = PRECISION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged (group, register, state) of bit maps of ranks, ordered by group and register."""
    key = group.astype(np.int64) << p | reg.astype(np.int64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, dtype=np.int64)
    whole = np.bitwise_or.reduceat(ranks[order], first) if len(key) else ranks
    return key[first] >> p, key[first] & ((1 << p) - 1), state_of(whole) if len(key) else np.empty(0, dtype=np.uint8)


def sketches_of(group: np.ndarray, reg: np.ndarray, ranks: np.ndarray, p: int = PRECISION) -> Iterator[tuple[int, bytes]]:
    """(group, binary sketch) of bit maps of ranks."""
    group, reg, state = joined(group, reg, ranks, p)
    cuts = np.flatnonzero(np.diff(group)) + 1
    for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)]):
        if stop > start:
            yield int(group[start]), packed(reg[start:stop], state[start:stop], p)


# --- gathering and merging -------------------------------------------------------------------------------------


def register_of(value: Column, p: int = PRECISION) -> tuple[Column, Column]:
    """Register number and the bit of the value's rank, of a non-null value."""
    h = F.xxhash64(value)
    rest = F.shiftrightunsigned(h, p)
    lowest = rest.bitwiseAND(-rest)
    return h.bitwiseAND(F.lit((1 << p) - 1)).cast("int"), F.when(rest == 0, F.lit(1 << (64 - p))).otherwise(lowest)


class _Buffer:
    """Keys met in a task, numbered, with the registers gathered for them since the last flush."""

    def __init__(self, keys: list[str], p: int):
        self.keys, self.p = keys, p
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def numbered(self, batch: pa.RecordBatch) -> np.ndarray:
        """Number of each row's key; only different keys become Python objects."""
        code = np.zeros(batch.num_rows, dtype=np.int64)
        values = []
        for k in self.keys:
            column = _dictionary(batch.column(k))
            values.append(column.dictionary.to_pylist() + [None])
            index = column.indices.fill_null(len(values[-1]) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            code = code * len(values[-1]) + index
        different, inverse = np.unique(code, return_inverse=True)
        numbers = np.empty(len(different), dtype=np.int64)
        for i, c in enumerate(different.tolist()):
            key = []
            for v in reversed(values):
                c, at = divmod(c, len(v))
                key.append(v[at])
            numbers[i] = self.numbers.setdefault(tuple(reversed(key)), len(self.numbers))
        return numbers[inverse]

    def add(self, group: np.ndarray, reg: np.ndarray, ranks: np.ndarray) -> None:
        self.parts.append((group, reg, ranks))
        self.size += len(group)

    def flush(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        keys = list(self.numbers)
        found = list(sketches_of(*(np.concatenate(x) for x in zip(*self.parts)), self.p))
        for at in range(0, len(found), 10_000):
            some = found[at:at + 10_000]
            columns = [pa.array([keys[g][i] for g, _ in some], type=schema.field(k).type) for i, k in enumerate(self.keys)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([s for _, s in some], type=pa.binary())], schema=schema)
        self.clear()


def _dictionary(column: pa.Array) -> pa.DictionaryArray:
    return column if isinstance(column, pa.DictionaryArray) else column.dictionary_encode()


def _within_tasks(rows: DataFrame, keys: list[str], p: int) -> DataFrame:
    """Partial sketches of every task; ``rows`` has either ``reg`` and ``ranks`` or ``sketch`` beside the keys."""
    raw = "reg" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, schema = _Buffer(keys, p), None
        for batch in batches:
            if schema is None:
                schema = pa.schema([*[batch.schema.field(k) for k in keys], pa.field("sketch", pa.binary())])
            if not batch.num_rows:
                continue
            group = buffer.numbered(batch)
            if raw:
                buffer.add(group, batch.column("reg").to_numpy(), batch.column("ranks").to_numpy().view(np.uint64))
            else:
                parts = [unpacked(s, p) for s in batch.column("sketch").to_pylist()]
                sizes = np.asarray([len(r) for r, _ in parts])
                buffer.add(np.repeat(group, sizes), np.concatenate([r for r, _ in parts]), window(np.concatenate([s for _, s in parts])))
            if buffer.size >= BUFFER:
                yield from buffer.flush(schema)
        if schema is not None:
            yield from buffer.flush(schema)

    kinds = {f.name: f.dataType for f in rows.schema}
    return rows.mapInArrow(run, T.StructType([*[T.StructField(k, kinds[k]) for k in keys], T.StructField("sketch", T.BinaryType())]))


def _merger(p: int):
    @F.pandas_udf("binary")
    def merge(lists: pd.Series) -> pd.Series:
        out = []
        for some in lists:
            if len(some) == 1:
                out.append(bytes(some[0]))
                continue
            parts = [unpacked(bytes(s), p) for s in some]
            reg = np.concatenate([r for r, _ in parts])
            out.append(next(iter(sketches_of(np.zeros(len(reg), dtype=np.int64), reg, window(np.concatenate([s for _, s in parts])), p)))[1])
        return pd.Series(out, dtype="object")

    return merge


def merged(rows: DataFrame, keys: list[str], p: int = PRECISION) -> DataFrame:
    """One sketch per group, of partial sketches (keys, sketch) or registers (keys, reg, ranks).

    What a group gathers after the shuffle is one sketch of at most 4 KB from each task. Where the input has thousands of
    tasks, they are first merged in bundles of ``BUNDLE`` tasks, so that no list is longer than that.
    """
    whole = rows if keys else rows.withColumn("_all", F.lit(1))
    by = keys or ["_all"]
    some = _within_tasks(whole.select(*by, *[c for c in ("reg", "ranks", "sketch") if c in whole.columns]), by, p)
    merge = _merger(p)
    if table_bytes(rows) > BUNDLE * (128 << 20):
        bundled = some.withColumn("_bundle", F.floor(F.spark_partition_id() / BUNDLE))
        some = bundled.groupBy(*by, "_bundle").agg(F.collect_list("sketch").alias("_s")).select(*by, merge("_s").alias("sketch"))
    lists = some.groupBy(*by).agg(F.collect_list("sketch").alias("_s"))
    return lists.select(*keys, merge("_s").alias("sketch"))


def partials(df: DataFrame, keys: Iterable[str | Column], value: Column, p: int = PRECISION) -> DataFrame:
    """Sketches of the groups as rows (keys, sketch). Null values count as none."""
    reg, bit = register_of(value, p)
    rows = df.where(value.isNotNull()).select(*keys, reg.alias("reg"), bit.alias("ranks"))
    return merged(rows, [c for c in rows.columns if c not in ("reg", "ranks")], p)


def _tables(p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of each rank; per state its exponent in the likelihood and the ranks it has seen."""
    top = 64 - p + 1
    rho = np.ldexp(1.0, -np.arange(1, top + 1))
    rho[-1] = rho[-2]
    above = np.concatenate([np.cumsum(rho[::-1])[::-1][1:], [0.0]])
    alpha, seen = np.zeros(256), np.zeros((256, top))
    for u in range(1, top + 1):
        for bits in range(4):
            s = 4 * u + bits
            alpha[s] = above[u - 1]
            seen[s, u - 1] = 1
            for j in (1, 2):
                if u - j >= 1:
                    if bits >> (2 - j) & 1:
                        seen[s, u - j - 1] = 1
                    else:
                        alpha[s] += rho[u - j - 1]
    return rho, alpha, seen


def maximum_likelihood(histograms: np.ndarray, p: int = PRECISION) -> np.ndarray:
    """Estimates from the histograms of register states (groups x 256)."""
    m = 1 << p
    rho, alpha, seen = _tables(p)
    filled = histograms.sum(axis=1)
    a, b = histograms @ alpha + (m - filled), histograms @ seen
    low, high = np.full(len(a), -30.0), np.full(len(a), 45.0)
    for _ in range(64):
        mid = (low + high) / 2
        with np.errstate(over="ignore"):
            slope = (b * rho / np.expm1(np.minimum(np.exp(mid)[:, None] * rho, 700))).sum(axis=1) - a
        low, high = np.where(slope > 0, mid, low), np.where(slope > 0, high, mid)
    return np.where(filled > 0, np.exp((low + high) / 2) * m, 0.0)


def _estimator(p: int):
    @F.pandas_udf("double")
    def estimate(sketches: pd.Series) -> pd.Series:
        hist = np.zeros((len(sketches), 256))
        for i, s in enumerate(sketches):
            hist[i] = np.bincount(unpacked(bytes(s), p)[1], minlength=256)
        hist[:, 0] = 0
        return pd.Series(maximum_likelihood(hist, p))

    return estimate


def estimated(sketches: DataFrame, keys: list[str], p: int = PRECISION) -> DataFrame:
    """Keys and ``estimate``, of one sketch per group."""
    return sketches.select(*keys, _estimator(p)("sketch").alias("estimate"))


def distinct_by(df: DataFrame, keys: list[str], value: Column, p: int = PRECISION) -> DataFrame:
    """Estimated number of different non-null values per group, with the error of one standard deviation.

    Groups with null values only, and an empty table, give no row; null keys form a group.
    """
    return estimated(partials(df, keys, value, p), keys, p).withColumn("relative_error", F.lit(standard_error(p)))


def distinct_by_spec(
    df: DataFrame, specs: DataFrame, spec_id: str, dims: list[str], day: str, first: str, last: str, value: Column,
    p: int = PRECISION,
) -> DataFrame:
    """Distinct values for each wanted combination of dimensions and span of days.

    A spec's null dimension means all of them. Result: spec_id, estimate; specs without a row have 0.
    Rows with a null dimension count only where the spec leaves that dimension open.
    Values are merged into one sketch per combination of all dimensions and day first; only these sketches, however
    many rows there are, meet the specs: by their dimensions and a range of days, so that a long span makes no more
    rows of specs. The specs are sent to all tasks if they are small as they are stored; else both sides are shuffled.
    """
    names = [f"_d{i}" for i in range(len(dims))]
    shape = sum((F.when(F.col(d).isNull(), F.lit(1 << i)).otherwise(0) for i, d in enumerate(dims)), F.lit(0))
    wanted = specs.select(
        F.col(spec_id).alias("_spec"), shape.cast("int").alias("_shape"), *[F.coalesce(F.col(d), F.lit("")).alias(n) for d, n in zip(dims, names)],
        F.col(first).alias("_first"), F.col(last).alias("_last"),
    ).where(F.col("_first") <= F.col("_last"))
    base = partials(df.where(F.col(day).isNotNull()), [*[F.col(d).alias(n) for d, n in zip(dims, names)], F.col(day).alias("_day")], value, p)
    views = [
        F.struct(F.lit(s).alias("_shape"), *[(F.lit("") if s >> i & 1 else F.col(n)).alias(n) for i, n in enumerate(names)])
        for s in range(1 << len(dims))
    ]
    on = ["_shape", *names]
    rows = base.select("_day", "sketch", F.explode(F.array(*views)).alias("_v")).select("_v.*", "_day", "sketch")
    hits = rows.join(small(wanted), on).where(F.col("_day").between(F.col("_first"), F.col("_last"))).select("_spec", "sketch")
    found = estimated(merged(hits, ["_spec"], p), ["_spec"], p)
    return specs.select(spec_id).distinct().join(found, F.col(spec_id) == F.col("_spec"), "left").select(
        spec_id, F.coalesce("estimate", F.lit(0.0)).alias("estimate")
    )


def rolled_up(sketches: DataFrame, dims: list[str], p: int = PRECISION) -> DataFrame:
    """Estimates for every combination of the dimensions: dims, ``kept`` (1 for each dimension kept), estimate.

    Each sketch goes into all its combinations at once, and one merge serves all levels.
    """
    levels = range(1 << len(dims))
    views = [
        F.struct(*[(F.col(d) if s >> i & 1 else F.lit(None).cast(sketches.schema[d].dataType)).alias(d) for i, d in enumerate(dims)],
                 F.lit("".join(str(s >> i & 1) for i in range(len(dims)))).alias("kept"))
        for s in levels
    ]
    rows = sketches.select("sketch", F.explode(F.array(*views)).alias("_v")).select("_v.*", "sketch")
    return estimated(merged(rows, [*dims, "kept"], p), [*dims, "kept"], p)
