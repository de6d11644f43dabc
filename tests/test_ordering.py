"""Ranks, quantiles, carried sums and the tests that rest on them, against plain numpy and enumeration."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelark.operators import ordering, statistics


def signed_rank(d):
    """(n, w, two-sided p by all patterns of signs)."""
    d = [x for x in d if x]
    size = sorted(abs(x) for x in d)
    rank = {v: np.mean([k + 1 for k, y in enumerate(size) if y == v]) for v in size}
    r = [rank[abs(x)] for x in d]
    a = sum(k for k, x in zip(r, d, strict=True) if x > 0)
    w = min(a, sum(r) - a)
    sums = [sum(k for k, on in zip(r, signs, strict=True) if on) for signs in itertools.product((0, 1), repeat=len(d))]
    return len(d), w, min(1.0, 2 * sum(s <= w + 1e-9 for s in sums) / len(sums))


def test_signed_ranks_with_ties_equal_enumeration(spark):
    rng = np.random.default_rng(3)
    cases = {0: [1, 1, -1, 2], 1: [3], 2: [2, -2, 2, 2, -2, 1], 3: [5, 5, 5, 5, 5]} | {k: rng.integers(-4, 5, rng.integers(2, 13)).tolist() for k in range(4, 30)}
    rows = spark.createDataFrame([(k, float(x), 0.0) for k, d in cases.items() for x in d], "case int, post double, pre double")
    got = {r.case: r for r in statistics.wilcoxon(rows, F.col("post"), F.col("pre"), ("case",)).withColumn("p", statistics.wilcoxon_p_value("w", "n", "ties", "ranks")).collect()}
    for k, d in cases.items():
        if any(d):
            n, w, p = signed_rank(d)
            assert (got[k].n, got[k].w) == (n, w) and math.isclose(got[k].p, p), d
    assert math.isclose(got[0].p, 0.5)


def test_signed_ranks_of_a_large_table(spark):
    rng = np.random.default_rng(5)
    d = np.round(rng.normal(0.02, 1, 20_000), 2)
    rows = spark.createDataFrame([(float(x), 0.0) for x in d], "post double, pre double").repartition(6)
    r = statistics.wilcoxon(rows, F.col("post"), F.col("pre")).withColumn("p", statistics.wilcoxon_p_value("w", "n", "ties", "ranks")).head()
    d = d[d != 0]
    values, place, n = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[place]
    assert r.n == len(d) and math.isclose(r.w, min(rank[d > 0].sum(), rank[d < 0].sum())) and r.ties == (n**3 - n).sum() and r.ranks is None and 0 < r.p < 1


def test_discovery_rates_of_crowded_values(spark):
    rng = np.random.default_rng(7)
    p = np.concatenate([10.0 ** -rng.uniform(3, 12, 3000), np.ones(2000), np.round(rng.uniform(size=500), 2)])
    rows = spark.createDataFrame([(str(k % 2), k, float(x)) for k, x in enumerate(p)] + [("0", -1, None)], "g string, k int, p_value double").repartition(5)
    got = statistics.benjamini_hochberg(rows, within=("g",)).toPandas().sort_values("k")
    assert got.p_value_corrected.isna().sum() == 1 and got.significant.isna().sum() == 1
    for g in ("0", "1"):
        one = got[(got.g == g) & got.p_value.notna()]
        x = one.p_value.to_numpy()
        order = np.argsort(x, kind="stable")
        q = np.minimum.accumulate((x[order] * len(x) / np.arange(1, len(x) + 1))[::-1])[::-1]
        want = np.empty(len(x))
        want[order] = np.minimum(q, 1)
        assert np.allclose(one.p_value_corrected, want)


def test_no_task_holds_all_crowded_values(spark):
    rows = spark.range(40_000).select((F.exp(-F.col("id") / 200.0)).alias("v"), F.col("id"))
    dealt = ordering.with_bucket(rows, "v", ordering.cut_points(rows, "v"))
    assert dealt.groupBy("_bucket").count().agg(F.max("count")).head()[0] < 40_000 / 100


@pytest.mark.parametrize("rest", [1, 40, 5000])
def test_selected_quantiles_equal_percentile(spark, rest):
    rng = np.random.default_rng(11)
    groups = {"normal": rng.normal(size=3000), "steps": rng.integers(0, 3, 2500), "wide": 10.0 ** rng.uniform(-200, 200, 2000) * rng.choice([-1, 1], 2000), "same": np.full(1500, 7.0), "one": [3.0], "two": [1.0, 2.0], "halves": [0.0] * 700 + [1.0] * 700}
    rows = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("normal", None)], "g string, v double").repartition(4).cache()
    shares = [0.0, 0.02, 0.25, 0.5, 0.731, 0.98, 1.0]
    got = {r.g: r.q for r in ordering.selected_quantiles(rows, "v", shares, ("g",), rest).collect()}
    want = {r.g: r.q for r in rows.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
    assert got.keys() == want.keys()
    for g in got:
        assert np.allclose(got[g], want[g], rtol=1e-12, atol=0), g
    whole = ordering.quantiles(rows, "v", [0.5], (), group=10).head().q
    assert math.isclose(whole[0], np.median(np.concatenate([np.asarray(v, float) for v in groups.values()])))


def test_running_sums_over_buckets(spark):
    rng = np.random.default_rng(13)
    rows = [(int(rng.integers(3)), k, float(rng.integers(9))) for k in range(3000)]
    df = spark.createDataFrame(rows, "g int, k int, v double").repartition(5)
    dealt = ordering.with_bucket(df, "k", ordering.cut_points(df, "k", 16))
    got = {r.k: r.upto for r in ordering.running(dealt, ("g",), "_bucket", ["k"], {"upto": F.col("v")}).collect()}
    total = {}
    for g, k, v in rows:
        total[g] = total.get(g, 0) + v
        assert got[k] == total[g]


def test_differences_around_onsets(spark):
    rng = np.random.default_rng(17)
    t = np.concatenate([np.arange(0, 60, 0.25), np.arange(90, 160, 0.25)])  # a gap
    v = rng.normal(size=len(t))
    series = spark.createDataFrame([(float(a), float(b)) for a, b in zip(t, v, strict=True)], "time double, value double")
    onsets = [(p, e, float(x)) for p in range(40) for e, x in enumerate(rng.uniform(-5, 165, 2))]
    got = {r.perm: r.diff for r in statistics.null_differences(series, spark.createDataFrame(onsets, "perm int, event int, onset double"), 2, 3.0, 2.0, 20).collect()}
    want = {}
    for p in range(40):
        mine = []
        for q, _, x in onsets:
            inside = (t >= x - 3) & (t < x + 2)
            if q == p and inside.sum() == 20:
                mine.append((v[inside & (t < x)].mean(), v[inside & (t >= x)].mean()))
        if len(mine) == 2:
            want[p] = np.mean([b for _, b in mine]) - np.mean([a for a, _ in mine])
    assert got.keys() == want.keys() and len(want) > 5 and all(math.isclose(got[p], want[p], abs_tol=1e-9) for p in want)
