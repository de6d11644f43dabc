"""Interval tables against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelark.operators import intervals, ordering, segments


@pytest.fixture(scope="module")
def given():
    rng = np.random.default_rng(1)
    out = [(g, float(a), float(a + rng.choice([0, 0, 1, 2, 5, 30]))) for g in range(3) for a in rng.integers(0, 150, 60)]
    return [*out, (0, 10.0, 5.0), (0, None, 5.0), (1, 3.0, None), (2, 500.0, 900.0), (2, 510.0, 520.0), (2, 600.0, 600.0)]


@pytest.fixture(params=[4, 256])
def tables(spark, given, request, monkeypatch):
    plain = ordering.cut_points
    monkeypatch.setattr(ordering, "cut_points", lambda df, column, buckets=request.param: plain(df, column, buckets))
    return spark.createDataFrame(given, "g int, start double, end double").repartition(3)


def good(given, g):
    return sorted((a, b) for k, a, b in given if k == g and a is not None and b is not None and a <= b)


def test_union(tables, given):
    got = sorted((r.g, r.start, r.end, r.n) for r in intervals.union(tables, ("g",)).collect())
    want = []
    for g in range(3):
        runs = []
        for a, b in good(given, g):
            if runs and a <= runs[-1][1]:
                runs[-1] = [runs[-1][0], max(runs[-1][1], b), runs[-1][2] + 1]
            else:
                runs.append([a, b, 1])
        want += [(g, *r) for r in runs]
    assert got == sorted(want)
    assert intervals.union(tables).agg(F.sum("n")).head()[0] == sum(len(good(given, g)) for g in range(3))


def test_points_inside(spark, tables, given):
    times = [(g, float(t) / 2) for g in range(4) for t in range(-3, 400)] + [(0, None), (2, 600.0), (2, 880.0)]
    rows = spark.createDataFrame(times, "g int, time double")
    got = sorted(((r.g, r.time, r.n_open) for r in intervals.inside(rows, tables, ("g",)).collect()), key=str)
    want = [(g, t, sum(a <= t <= b for a, b in good(given, g)) if t is not None else 0) for g, t in times]
    assert got == sorted(want, key=str)
    assert intervals.covered(rows, tables, ("g",)).count() == sum(n > 0 for _, _, n in want)


@pytest.mark.parametrize("least", [1, 2, 4])
def test_stretches_of_several(tables, given, least):
    got = sorted((r.g, r.start, r.end) for r in intervals.intersection(tables, least, ("g",)).collect())
    want = []
    for g in range(3):
        every = good(given, g)
        for t in sorted({x for ab in every for x in ab}):
            at = sum(a <= t <= b for a, b in every)
            before = sum(a < t <= b for a, b in every)  # open just before t
            if at >= least:
                if before >= least and want and want[-1][0] == g:
                    want[-1][2] = t
                else:
                    want.append([g, t, t])
    assert got == sorted(map(tuple, want))


def test_no_intervals(spark, tables):
    rows = spark.createDataFrame([(0, 1.0)], "g int, time double")
    assert intervals.union(tables.limit(0), ("g",)).count() == 0
    assert [tuple(r) for r in intervals.inside(rows, tables.limit(0), ("g",)).collect()] == [(0, 1.0, 0)]


def test_mask_of_overlapping_runs(spark):
    sig = spark.createDataFrame([("a", "c", k, float(k), 0.0) for k in range(40)], "subject string, channel string, t_idx int, time double, value double")
    runs = [(2.0, 30.0), (5.0, 6.0), (10.0, 10.0), (29.5, 33.0), (36.0, 36.0)]
    found = spark.createDataFrame([("a", "c", a, b) for a, b in runs], "subject string, channel string, start_sec double, end_sec double")
    got = {r.t_idx: r.active for r in segments.mask(sig, found).collect()}
    assert got == {k: int(any(a <= k <= b for a, b in runs)) for k in range(40)}
