import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodescan.llm import distinct as D
from lodescan.llm import sampling as S


def test_error_bound_over_sizes(spark):
    for n in (1, 10, 300, 20_000):
        df = spark.range(n).select(F.lit("k").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
        got = D.distinct_by(df, ["k"], F.col("v")).first().estimate
        assert abs(got - n) <= max(0.6, 4 * D.standard_error() * n)


def test_estimator_is_unbiased_within_its_error():
    rng = np.random.default_rng(1)
    p, m = 8, 256
    for n in (50, 2000, 50_000):
        ratios = []
        for _ in range(60):
            regs, ranks = rng.integers(0, m, n), np.minimum(rng.geometric(0.5, n), 64 - p + 1)
            seen = [set() for _ in range(m)]
            for r, k in zip(regs, ranks):
                seen[r].add(int(k))
            hist = np.zeros((1, 256))
            for s in seen:
                if s:
                    u = max(s)
                    hist[0, 4 * u + 2 * (u - 1 in s) + (u - 2 in s)] += 1
            ratios.append(D.maximum_likelihood(hist, p)[0] / n)
        assert abs(np.mean(ratios) - 1) < 0.03 and np.std(ratios) < 1.5 * D.standard_error(p)


@pytest.mark.parametrize("buffer", [50, D.BUFFER])
def test_merging_loses_nothing(spark, monkeypatch, buffer):
    monkeypatch.setattr(D, "BUFFER", buffer)
    df = spark.range(5000).select((F.col("id") % 7).alias("day"), (F.col("id") % 997).cast("string").alias("v"))
    parts = D.partials(df, ["day"], F.col("v"))
    whole = D.partials(df.withColumn("a", F.lit(1)), ["a"], F.col("v")).first().sketch
    again = D.merged(parts.withColumn("a", F.lit(1)).drop("day"), ["a"]).first().sketch
    assert whole == again and parts.agg(F.max(F.length("sketch"))).first()[0] <= 4096
    assert D.merged(parts.drop("day"), []).first().sketch == whole


def test_states_keep_the_greatest_rank_and_two_below():
    ranks = np.asarray([1, 0b10, 0b1011, 0b100100, 1 << 52, (1 << 52) | (1 << 51) | 7], dtype=np.uint64)
    want = [(r.bit_length() << 2) | ((r << 2) >> (r.bit_length() - 1) & 3) for r in ranks.tolist()]
    assert D.state_of(ranks).tolist() == want
    assert D.state_of(D.window(D.state_of(ranks))).tolist() == want
    reg = np.asarray([0, 5, 300, 4095])
    for n in (1, 4):
        back = D.unpacked(D.packed(reg[:n], np.asarray(want[:n])))
        assert back[0].tolist() == reg[:n].tolist() and back[1].tolist() == want[:n]
    full = np.arange(4096)
    assert len(D.packed(full, np.full(4096, 5))) == 4096 and D.unpacked(D.packed(full, np.full(4096, 5)))[1].tolist() == [5] * 4096


def test_bundles_of_tasks_give_the_same(spark, monkeypatch):
    df = spark.range(3000).repartition(6).select((F.col("id") % 3).alias("day"), F.col("id").cast("string").alias("v"))
    want = {r.day: r.sketch for r in D.partials(df, ["day"], F.col("v")).collect()}
    monkeypatch.setattr(D, "table_bytes", lambda df: 1 << 60)
    monkeypatch.setattr(D, "BUNDLE", 2)
    assert {r.day: r.sketch for r in D.partials(df, ["day"], F.col("v")).collect()} == want


def test_nulls_empty_and_case(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b"), ("x", None), ("y", ""), ("y", "")], "k string, v string")
    got = {r.k: round(r.estimate) for r in D.distinct_by(df, ["k"], F.col("v")).collect()}
    assert got == {None: 2, "y": 1}
    assert D.distinct_by(df.limit(0), ["k"], F.col("v")).count() == 0


def _specs(spark, rows):
    return spark.createDataFrame(rows, "id long, u string, d string, first date, last date")


@pytest.mark.parametrize("broadcast", [True, False])
def test_specs_by_dimension_and_span(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(D, "small", lambda df: df)
    rng = random.Random(2)
    rows = [(rng.choice(["u1", "u2", None]), rng.choice(["A", "B"]), f"2017-01-{rng.randrange(1, 10):02d}", str(rng.randrange(300))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "u string, d string, day string, v string").withColumn("day", F.col("day").cast("date"))
    wanted = [(1, "u1", None, 1, 3), (2, None, "A", 2, 2), (3, None, None, 1, 9), (4, "none", None, 1, 9), (5, "u2", "B", 4, 8), (6, None, None, 5, 4)]
    specs = spark.createDataFrame([(i, u, d, f"2017-01-{a:02d}", f"2017-01-{b:02d}") for i, u, d, a, b in wanted], "id long, u string, d string, f string, l string")
    specs = specs.select("id", "u", "d", F.col("f").cast("date").alias("first"), F.col("l").cast("date").alias("last"))
    got = {r.id: r.estimate for r in D.distinct_by_spec(df, specs, "id", ["u", "d"], "day", "first", "last", F.col("v")).collect()}
    for i, u, d, a, b in wanted:
        true = len({v for ru, rd, day, v in rows if (u is None or ru == u) and (d is None or rd == d) and a <= int(day[-2:]) <= b})
        assert abs(got[i] - true) <= max(0.6, 0.05 * true), (i, got[i], true)


def test_rollup(spark):
    df = spark.createDataFrame([("a", "x", "1"), ("a", "y", "2"), ("b", "x", "1")], "p string, q string, v string")
    got = {(r.kept, r.p, r.q): round(r.estimate) for r in D.rolled_up(D.partials(df, ["p", "q"], F.col("v")), ["p", "q"]).collect()}
    assert got[("00", None, None)] == 2 and got[("10", "a", None)] == 2 and got[("01", None, "x")] == 1 and got[("11", "b", "x")] == 1


def test_places_are_uniform():
    rng = S.generator("t")
    hits = np.zeros(12)
    pairs = np.zeros((12, 12))
    for _ in range(6000):
        kept = S.select_places(rng, 12, 4)
        assert len(set(kept)) == 4 and list(kept) == sorted(kept) and kept[0] >= 0 and kept[-1] < 12
        hits[kept] += 1
        for a in kept:
            for b in kept:
                pairs[a, b] += a < b
    assert abs(hits / 6000 - 4 / 12).max() < 0.03
    assert abs(pairs[np.triu_indices(12, 1)] / 6000 - (4 * 3) / (12 * 11)).max() < 0.025
    assert list(S.select_places(rng, 5, 5)) == [0, 1, 2, 3, 4] and len(S.select_places(rng, 5, 0)) == 0
    assert len(S.select_places(rng, 100_000, 3)) == 3 and len(S.select_places(rng, 100, 99)) == 99


def test_quota_split_and_large_populations():
    rng = S.generator(1)
    sizes = [5, 0, 100, 1, 40]
    means = np.zeros(5)
    for _ in range(3000):
        q = S.split_quota(rng, sizes, 20)
        assert sum(q) == 20 and all(a <= b for a, b in zip(q, sizes))
        means += q
    assert np.allclose(means / 3000, [20 * s / 146 for s in sizes], atol=0.25)
    assert 0 <= S.hypergeometric(rng, 10**12, 10**12, 50) <= 50


def _records(spark, rows):
    return spark.createDataFrame(rows, "unit string, rec long, piece int, cells string, population string")


@pytest.mark.parametrize("broadcast", [S.MOST_BROADCAST, 0])
def test_sample_size_and_repeats(spark, monkeypatch, broadcast):
    monkeypatch.setattr(S, "MOST_BROADCAST", broadcast)
    rows = [("u", i, i % 3, "c", "x") for i in range(50)] + [("u", i, 3, "late", "x") for i in range(10)] + [("v", 1, 0, None, None), ("v", 1, 0, None, None), ("w", 5, 0, "c", "x")]
    rows += [("u", None, 0, "c", "x"), (None, 7, None, "c", "x")]
    plans = spark.createDataFrame([("u", 20), ("v", 5), ("v", 3), ("x", 4), (None, 2), ("w", 0)], "unit string, k int")
    got = S.sample_records(_records(spark, rows).drop("population"), plans, "unit", "rec", "piece", "k", leaf_rows=8).collect()
    by = {}
    for r in got:
        by.setdefault(r.unit, []).append(r)
    assert len(by["u"]) == 20 and len({r.rec for r in by["u"]}) == 20 and all(r.piece < 3 for r in by["u"]) and by["u"][0].population == 50
    assert [r.rec for r in by["v"]] == [1] and "w" not in by
    again = S.sample_records(_records(spark, rows[::-1]).drop("population"), plans, "unit", "rec", "piece", "k", leaf_rows=8)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_sample_is_fair_over_pieces(spark):
    df = spark.range(40).select(F.lit("u").alias("unit"), F.col("id").alias("rec"), F.when(F.col("id") < 30, 0).otherwise(1).alias("piece"))
    plans = spark.createDataFrame([("u", 10)], "unit string, k int")
    n = np.zeros(40)
    for seed in range(24):
        for r in S.sample_records(df, plans, "unit", "rec", "piece", "k", seed=seed, leaf_rows=10).select("rec").collect():
            n[r.rec] += 1
    assert n.sum() == 240 and abs(n[30:].sum() / 240 - 0.25) < 4 * math.sqrt(0.25 * 0.75 / 240)
    assert S.sample_records(df.limit(0), plans, "unit", "rec", "piece", "k").count() == 0
