"""Hand-made cases and restatements in numpy that don't share the operators' formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelark.functions import scalar
from wavelark.model import Region
from wavelark.operators import correlation, graph, layout, segments, signal, spectral, statistics
from wavelark.sources import files


def make(spark, series, step=1.0):
    """{(subject, channel): values} as a signal."""
    rows = [(s, c, i, float(i * step), float(v)) for (s, c), values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "subject string, channel string, t_idx int, time double, value double")


@pytest.fixture(scope="module")
def noise(spark):
    rng = np.random.default_rng(1)
    return {(s, c): rng.normal(size=40).round(3).tolist() for s in "ab" for c in ("c1", "c2", "c3")} | {("b", "c4"): [0.1] * 40}


def test_crop_bounds(spark):
    sig = make(spark, {("a", "c"): range(11)})
    assert [r.value for r in signal.crop(sig, Region(start_sec=3, end_sec=7)).orderBy("t_idx").collect()] == [3, 4, 5, 6]
    assert [r.value for r in signal.crop(sig, Region(start_sec=3, end_sec=7), closed=True).orderBy("t_idx").collect()] == [3, 4, 5, 6, 7]
    assert [r.time for r in signal.rebase(signal.crop(sig, Region(start_sec=3, end_sec=5)), 0.5).orderBy("t_idx").collect()] == [0.5, 1.5]


def test_z_score_and_constant(spark, noise):
    out = signal.z_score(make(spark, noise)).toPandas()
    for (s, c), v in noise.items():
        got = out[(out.subject == s) & (out.channel == c)].sort_values("t_idx").value
        if c == "c4":
            assert got.isna().all()
        else:
            assert np.allclose(got, (np.array(v) - np.mean(v)) / np.std(v))


def test_robust_range(spark):
    v = list(range(100)) + [10_000]
    got = signal.robust_range(make(spark, {("a", "c"): v, ("a", "k"): [5] * 101}), 0, 1).toPandas()
    a, b = np.percentile(v, 2), np.percentile(v, 98)
    assert np.allclose(got[got.channel == "c"].sort_values("t_idx").value, (np.clip(v, a, b) - a) / (b - a))
    assert (got[got.channel == "k"].value == 0.5).all()


def test_align_wide_long_rate(spark):
    sig = make(spark, {("a", "c1"): range(5), ("a", "c2"): range(5), ("b", "c1"): range(8), ("b", "c2"): range(8)}, 0.1)
    cut = signal.align(sig)
    assert cut.count() == 20
    wide = signal.to_wide(cut, ["c1", "c2"])
    assert wide.columns == ["subject", "c1", "c2", "time"] and wide.count() == 10
    assert signal.to_long(wide, ["c1", "c2"]).count() == 20
    assert all(abs(r.sr - 10) < 1e-9 for r in signal.sampling_rate(sig).collect())


def test_sliding_correlation_against_numpy(spark, noise):
    sig = make(spark, noise)
    got = {(r.a, r.b, r.t_idx): (r.time, r.r) for r in correlation.sliding_pairs(sig, F.concat("subject", "channel"), 10, 3).collect()}
    names = sorted("".join(k) for k in noise)
    value = {"".join(k): np.array(v) for k, v in noise.items()}
    seen = 0
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            for start in range(0, 31, 3):
                x, y = value[a][start : start + 10], value[b][start : start + 10]
                time, r = got[a, b, start]
                seen += 1
                assert time == start + 5
                assert r is None or abs(r) < 1e-6 or "c4" not in a + b
                if "c4" not in a + b:
                    assert math.isclose(r, np.corrcoef(x, y)[0, 1], abs_tol=1e-9)
    assert seen == len(got)


def test_matrix(spark, noise):
    m = {(r.subject, r.ch_a, r.ch_b): r.r for r in correlation.matrix(make(spark, noise)).collect()}
    assert m["a", "c1", "c1"] == 0 and m["a", "c1", "c2"] == m["a", "c2", "c1"]
    assert math.isclose(m["a", "c1", "c2"], np.corrcoef(noise["a", "c1"], noise["a", "c2"])[0, 1], abs_tol=1e-12)
    assert len(m) == 9 + 16


def runs(x, t, least):
    out, start = [], None
    for i in range(1, len(x) + 1):
        up = i < len(x) and x[i] > x[i - 1]
        if up and start is None:
            start = i
        if not up and start is not None:
            if t[i - 1] - t[start] >= least:
                out.append((t[start], t[i - 1], x[i - 1] - x[start]))
            start = None
    return out


def test_trends_mask_density_segments(spark, noise):
    sig = make(spark, noise)
    found = segments.trends(sig, min_duration=1)
    got = {}
    for r in found.collect():
        got.setdefault((r.subject, r.channel), []).append((r.start_sec, r.end_sec, r.height))
    t = np.arange(40.0)
    active = {}
    for k, v in noise.items():
        want = runs(v, t, 1)
        assert np.allclose(sorted(got.get(k, [])), sorted(want)) if want else k not in got
        active[k] = np.array([any(a <= x <= b for a, b, _ in want) for x in t])
    masked = segments.mask(sig, found)
    assert all(active[r.subject, r.channel][r.t_idx] == r.active for r in masked.collect())
    dense = segments.density(masked, 4, 2).collect()
    for r in dense:
        w = slice(r.win * 2, r.win * 2 + 4)
        assert r.ch_count == sum(active[k][w].any() for k in active if k[0] == r.subject)
        assert r.time == r.win * 2 + 1.5
    assert len(dense) == 2 * 19


def test_threshold_segments_ties(spark):
    rows = [("a", i, float(i), v) for i, v in enumerate([0, 3, 5, 5, 1, 4, 4])]
    got = segments.threshold_segments(spark.createDataFrame(rows, "subject string, win int, time double, ch_count long"), 2)
    assert sorted(map(tuple, got.collect())) == [("a", 1.0, 3.0, 2.0, 5), ("a", 5.0, 6.0, 5.0, 4)]
    assert segments.threshold_segments(spark.createDataFrame(rows, "subject string, win int, time double, ch_count long"), 2, 5).count() == 1


def test_sessions_break_at_gap_and_value(spark):
    rows = [("s", t, v) for t, v in [(0, "x"), (9.5, "x"), (19.5, "x"), (22, "x"), (25, "y"), (26, "x"), (30, "x"), (31, None), (35, None)]]
    got = segments.sessions(spark.createDataFrame([(a, float(b), c) for a, b, c in rows], "k string, t double, v string"), ("k",), "t", "v", 10, 3)
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(0.0, 9.5, "x"), (26.0, 30.0, "x"), (31.0, 35.0, "NAN")]


def test_statistics(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5]
    got = {r.channel: r.p_value_corrected for r in statistics.benjamini_hochberg(spark.createDataFrame([(str(i), x) for i, x in enumerate(p)], "channel string, p_value double")).collect()}
    assert np.allclose([got[str(i)] for i in range(5)], [0.025, 0.05, 0.05, 0.025, 0.5])
    d = spark.createDataFrame([(float(a), float(b)) for a, b in [(5, 3), (6, 7), (9, 4), (8, 8), (7, 3)]], "post double, pre double")
    t = statistics.paired_t(d, F.col("post"), F.col("pre")).withColumn("p", statistics.t_p_value("t", "n")).head()
    x = np.array([2, -1, 5, 0, 4.0])
    assert math.isclose(t.t, x.mean() / (x.std(ddof=1) / math.sqrt(5)))
    assert 0.15 < t.p < 0.2
    w = statistics.wilcoxon(d, F.col("post"), F.col("pre")).withColumn("p", statistics.wilcoxon_p_value("w", "n", "ties", "ranks")).head()
    assert (w.n, w.w) == (4, 1.0) and math.isclose(w.p, 0.25)


def test_participation_null_draws_as_many(spark):
    rows = [(f"s{i}", f"c{j}", int((i + j) % 3 == 0)) for i in range(4) for j in range(6)]
    status = spark.createDataFrame(rows, "segment string, channel string, active int")
    null = statistics.participation_null(status, 20).groupBy("perm").agg(F.sum("count").alias("n")).collect()
    assert len(null) == 20 and {r.n for r in null} == {8}


def test_spectrogram_finds_a_sine(spark):
    t = np.arange(300) / 10
    sig = make(spark, {("a", "c"): np.sin(2 * np.pi * 1.25 * t)}, 0.1)
    spec = spectral.spectrogram(sig, 10, 100, 10, 1024, (0.8, 2.0))
    peak = spectral.peak_frequency(spec, sig.groupBy("subject").agg(F.min("time").alias("start"))).collect()
    assert len(peak) == 21 and all(abs(r.freq - 1.25) < 0.02 for r in peak)
    assert {r.freq for r in spectral.peak_frequency(spec, sig.groupBy("subject").agg(F.min("time").alias("start")), 1e6).collect()} == {None}


def test_repair_and_band_pass(spark):
    x = np.sin(np.arange(200) / 9.0)
    jump = x + np.where(np.arange(200) >= 100, 50, 0)
    got = spectral.repair_motion(make(spark, {("a", "c"): jump})).orderBy("t_idx").toPandas().value.to_numpy()
    assert abs((got[150] - got[50]) - (x[150] - x[50])) < 2
    low = spectral.band_pass(make(spark, {("a", "c"): np.sin(np.arange(200)) + 3}, 1), 1.0, None, 0.02, 61).toPandas().value
    assert abs(low.mean() - 3) < 0.1 and low.std() < 0.1


def test_communities_of_two_cliques(spark):
    e = [(a, b) for group in ("abcd", "efgh") for a in group for b in group if a != b] + [("d", "e"), ("e", "d")]
    edges = spark.createDataFrame([("s", a, b, 1.0 if (a, b) not in (("d", "e"), ("e", "d")) else 0.1) for a, b in e], "subject string, ch_a string, ch_b string, r double")
    found = graph.stable_ids(graph.communities(edges))
    assert {r.channel: r.community for r in found.collect()} == {c: 1 for c in "abcd"} | {c: 2 for c in "efgh"}
    assert graph.modularity(edges, found).head().modularity > 0.45


def test_communities_by_joins(spark):
    rng = np.random.default_rng(9)
    edges = []
    for g in range(1):
        of = rng.integers(0, 4, 40)
        for i in range(40):
            for j in range(i):
                if rng.random() < (0.5 if of[i] == of[j] else 0.04):
                    edges.append((f"g{g}", f"n{i:02d}", f"n{j:02d}", float(rng.uniform(0.2, 1))))
    one = spark.createDataFrame(edges, "subject string, ch_a string, ch_b string, r double")
    both = one.union(one.select("subject", F.col("ch_b").alias("ch_a"), F.col("ch_a").alias("ch_b"), "r")).cache()
    score = lambda parts: {r.subject: r.modularity for r in graph.modularity(both, parts).collect()}
    small, large = score(graph.communities(both)), score(graph.communities(both, whole=20).cache())
    assert all(large[g] > 0.97 * small[g] and large[g] > 0.3 for g in small)


def test_colour_and_units(spark):
    import hashlib

    row = spark.sql("select 'HC1' as x").select(scalar.md5_mod(F.col("x"), 20).alias("m"), *scalar.md5_rgb(F.col("x"))).head()
    h = hashlib.md5(b"HC1").hexdigest()
    assert row.m == int(h, 16) % 20 and math.isclose(row[1], int(h[:2], 16) / 255)
    with pytest.raises(Exception, match="unusual distance"):
        spark.sql("select 3.0D as d").select(scalar.unit_scale(F.col("d"))).collect()


def test_layout_order(spark):
    pos = spark.createDataFrame([("l1", 0.9, 0.1), ("l2", 0.8, 0.5), ("m", 0.5, 0.3), ("r1", 0.2, 0.9), ("r2", 0.1, 0.2)], "channel string, x double, y double")
    assert [r.channel for r in layout.y_axis_order(pos).orderBy("y_order").collect()] == ["l1", "l2", "m", "r1", "r2"]


def test_files(spark, tmp_path):
    for name, n in (("HC2.csv", 6), ("HC1.csv", 4)):
        (tmp_path / name).write_text("S1_D1 hbo,S2_D1 hbo,time\n" + "".join(f"{i},{2 * i},{i / 10}\n" for i in range(n)))
    sig = files.read_dataset(spark, [str(tmp_path / "HC2.csv"), str(tmp_path / "HC1.csv")])
    assert sig.count() == 16 and {r.subject for r in sig.select("subject").distinct().collect()} == {"HC1", "HC2"}
    (tmp_path / "m.csv").write_text("start_sec,length_sec\n1,2\n")
    assert tuple(files.read_annotations(spark, str(tmp_path / "m.csv")).head()) == (1.0, 0, 2.0, "None")
    (tmp_path / "n.csv").write_text("TIME,DURATION,LABEL,VALUE\n1,2,on,7\n")
    assert tuple(files.read_annotations(spark, str(tmp_path / "n.csv")).head()) == (1.0, 7, 2.0, "on")
    (tmp_path / "o.csv").write_text("a,b\n1,2\n")
    assert files.read_annotations(spark, str(tmp_path / "o.csv")).count() == 0
    sim = files.simulated(spark, ["x", "y"], 4, 5, 1)
    assert sim.count() == 40


def test_bdf(spark, tmp_path):
    labels, samples = ["A", "B"], np.array([[1, -2, 300], [5, 6, -7]])
    n = 2
    cell = lambda values, size: b"".join(str(v).encode().ljust(size) for v in values)
    head = b"\xffBIOSEMI".ljust(236) + b"1".ljust(8) + b"1".ljust(8) + b"2".ljust(4)
    head += cell(labels, 16) + cell([""] * n, 80) + cell([""] * n, 8) + cell([-8388608] * n, 8) + cell([8388607] * n, 8) + cell([-8388608] * n, 8) + cell([8388607] * n, 8) + cell([""] * n, 80) + cell([3] * n, 8) + cell([""] * n, 32)
    body = b"".join(int(v).to_bytes(3, "little", signed=True) for row in samples for v in row)
    (tmp_path / "x.bdf").write_bytes(head + body)
    got = files.bdf_records(spark, str(tmp_path / "x.bdf")).orderBy("channel", "t_idx").collect()
    assert np.allclose([r.value for r in got], samples.ravel()) and math.isclose(got[1].time, 1 / 3)


def test_streamed_sessions_match_batch(spark, tmp_path):
    import datetime as dt

    from wavelark.streaming import windows

    base = dt.datetime(2024, 1, 1)
    rows = [(u, base + dt.timedelta(seconds=s), v) for u in ("1", "2") for s, v in [(0, "x"), (5, "x"), (9, "x"), (30, "x"), (36, "x"), (40, "y"), (4000, "z")]]
    spark.createDataFrame(rows, "user_id string, ts timestamp, event_type string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id string, ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    q = windows.stream_sessions(stream, "user_id", 10, 3, "10 seconds").writeStream.format("memory").queryName("sessions_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.key, r.end - r.start, r.trigger_value) for r in spark.sql("select * from sessions_out").collect())
    assert got == [("1", 6.0, "x"), ("1", 9.0, "x"), ("2", 6.0, "x"), ("2", 9.0, "x")]


def test_streamed_windows_match_batch(spark, tmp_path):
    import datetime as dt

    from wavelark.streaming import windows

    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(minutes=7 * i), "ab"[i % 2]) for i in range(60)]
    spark.createDataFrame(rows, "ts timestamp, event_type string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    windows.sliding_density(stream, "1 hour", "30 minutes", "10 minutes").writeStream.format("memory").queryName("density_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.sql("select window.start as s, window.end as e, n_events from density_out").collect()
    assert len(got) >= 10
    assert all(r.n_events == sum(r.s <= t < r.e for t, _ in rows) for r in got)


def test_bands_and_resampling(spark):
    t = np.arange(600) / 10
    sig = make(spark, {("a", "c"): np.sin(2 * np.pi * 0.2 * t) + np.sin(2 * np.pi * 2 * t)}, 10)
    kept = spectral.filter_bands(sig, 10.0, [(0.05, 0.5, 0.05, 0.2)]).toPandas().sort_values("t_idx").value.to_numpy()
    assert np.abs(kept - np.sin(2 * np.pi * 0.2 * t))[100:-100].max() < 0.05
    slow = spectral.resample(make(spark, {("a", "c"): np.sin(2 * np.pi * 0.2 * t) + 5}, 10), 10.0, 4.0).toPandas().sort_values("t_idx")
    assert len(slow) == 240 and np.allclose(np.diff(slow.time), 0.25)
    assert np.abs(slow.value - 5 - np.sin(2 * np.pi * 0.2 * slow.time)).max() < 0.05


def test_rates_beside_the_signal(spark, tmp_path):
    for name in ("S1", "S2"):
        (tmp_path / f"{name}.csv").write_text("time,freq\n0,1.1\n1,1.2\n")
    got = files.read_heart_rate(spark, str(tmp_path)).collect()
    assert sorted((r.subject, r.time, r.freq) for r in got) == [("S1", 0.0, 1.1), ("S1", 1.0, 1.2), ("S2", 0.0, 1.1), ("S2", 1.0, 1.2)]


def test_rows_are_numbered_over_tasks(spark, tmp_path):
    spark.range(1000, numPartitions=1).selectExpr("cast(id as string) as value").coalesce(1).write.text(str(tmp_path / "lines"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600b")
    try:
        got = files.numbered(spark.read.text(str(tmp_path / "lines")), "n")
        assert got.rdd.getNumPartitions() > 1
        assert all(r.n == int(r.value) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_discovery_rates_over_buckets(spark):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.random(200) ** 3, [0.5] * 20, [1.0, 0.0]])
    table = spark.createDataFrame([(f"c{k:03}", float(x)) for k, x in enumerate(p)] + [("null", None)], "channel string, p_value double")
    assert [r.p_value_corrected for r in statistics.benjamini_hochberg(table).where("channel = 'null'").collect()] == [None]
    got = statistics.benjamini_hochberg(table).toPandas().sort_values("channel").p_value_corrected.to_numpy()[:-1]
    order = np.argsort(p, kind="stable")
    want = np.empty(len(p))
    want[order] = np.minimum(np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1], 1)
    assert np.allclose(got, want)


def test_streamed_correlations_match_numpy(spark, tmp_path):
    import datetime as dt

    from wavelark.streaming import windows

    base, rng = dt.datetime(2024, 1, 1), np.random.default_rng(5)
    series = {k: rng.normal(size=120) for k in "abc"}
    rows = [(base + dt.timedelta(minutes=i), k, float(v[i])) for k, v in series.items() for i in range(120)]
    spark.createDataFrame(rows, "ts timestamp, key string, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, key string, value double").parquet(str(tmp_path / "in"))
    windows.sliding_correlation(stream, "20 minutes", "10 minutes", "5 minutes").writeStream.format("memory").queryName("corr_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(180)
    got = spark.sql("select window.start as s, window.end as e, a, b, r from corr_out").collect()
    assert len(got) >= 15
    for r in got:
        i, j = (max(0, min(120, int((t - base).total_seconds() // 60))) for t in (r.s, r.e))
        assert r.r == pytest.approx(np.corrcoef(series[r.a][i:j], series[r.b][i:j])[0, 1])


def test_sliding_mean_in_blocks(spark, noise):
    sig = make(spark, {k: v for k, v in noise.items() if k[1] != "c4"} | {("b", "c4"): [0.1] * 40})
    key = F.concat_ws("/", "subject", "channel")
    got = correlation.sliding_mean(sig, key, 10, 3, windows=4).toPandas().set_index("t_idx").score
    want = correlation.sliding_pairs(sig, key, 10, 3).groupBy("t_idx").agg(F.avg(F.coalesce("r", F.lit(0.0))).alias("score")).toPandas().set_index("t_idx").score
    assert sorted(got.index) == sorted(want.index) and np.allclose(got.sort_index(), want.sort_index())
    split = correlation.sliding_mean(sig, key, 10, 3, windows=4, group=2).toPandas().set_index("t_idx").score
    assert sorted(split.index) == sorted(want.index) and np.allclose(split.sort_index(), want.sort_index())


def test_sliding_pairs_in_groups_and_with_gaps(spark, noise):
    key = F.concat_ws("/", "subject", "channel")
    sig = make(spark, noise)
    rows = lambda df: {(r.a, r.b, r.t_idx): (r.time, r.r) for r in df.collect()}
    want = rows(correlation._sliding_rows(sig, key, 10, 3, ()))
    for group, windows in ((64, 64), (2, 3)):
        got = rows(correlation.sliding_pairs(sig, key, 10, 3, windows=windows, group=group))
        assert got.keys() == want.keys()
        for k in got:
            assert got[k][0] == want[k][0] and (got[k][1] is None) == (want[k][1] is None) and (got[k][1] is None or math.isclose(got[k][1], want[k][1], abs_tol=1e-9))
    own = correlation.sliding_pairs(sig, F.col("channel"), 10, 3, ("subject",), group=2)
    assert own.count() == sum(1 for a, b, _ in want if a[0] == b[0])
    gaps = sig.where("t_idx <> 7 or channel <> 'c1'")
    assert rows(correlation.sliding_pairs(gaps, key, 10, 3)).keys() == rows(correlation._sliding_rows(gaps, key, 10, 3, ())).keys()
    mean = {r.t_idx: r.score for r in correlation.sliding_mean(gaps, key, 10, 3).collect()}
    assert len(mean) > 5 and all(-1 <= x <= 1 for x in mean.values())
