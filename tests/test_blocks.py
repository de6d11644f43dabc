"""Blocks of time give what the whole series gives; recursive filters against plain recursion."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelark.operators import blocks, spectral


def signals(spark, series):
    rows = [("a", c, i, i / 4, float(v)) for c, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "subject string, channel string, t_idx int, time double, value double").repartition(4)


def values(df, channel):
    return df.where(F.col("channel") == channel).orderBy("t_idx").toPandas().value.to_numpy()


def recursion(b, a, x, state):
    """Direct form, sample by sample."""
    z, out = list(state), []
    for v in x:
        y = b[0] * v + z[0]
        z = [b[k + 1] * v - a[k + 1] * y + (z[k + 1] if k + 1 < len(z) else 0) for k in range(len(z))]
        out.append(y)
    return np.array(out)


def both_ways(b, a, x):
    n = len(a) - 1
    m = np.zeros((n, n))
    m[:, 0], m[: n - 1, 1:] = -a[1:], np.eye(n - 1)
    still = np.linalg.solve(np.eye(n) - m, b[1:] - a[1:] * b[0])
    y = recursion(b, a, x, still * x[0])
    return recursion(b, a, y[::-1], still * y[-1])[::-1]


@pytest.fixture(scope="module")
def noise():
    rng = np.random.default_rng(2)
    return {"walk": np.cumsum(rng.normal(size=1000)), "short": rng.normal(size=40), "two": [1.0, 2.0], "one": [3.0]}


def test_coefficients():
    for order, cutoff in ((3, 0.1), (2, 0.37), (4, 0.8)):
        b, a = blocks.butterworth(order, cutoff)
        gain = lambda f: abs(np.polyval(b, np.exp(1j * np.pi * f)) / np.polyval(a, np.exp(1j * np.pi * f)))  # noqa: B023, E731
        assert math.isclose(gain(0), 1) and math.isclose(gain(cutoff), math.sqrt(0.5)) and gain(0.999) < 0.02 and (np.abs(np.roots(a)) < 1).all()


@pytest.mark.parametrize("size", [100, 1 << 16])
def test_low_pass_carries_its_state(spark, noise, size):
    got = blocks.low_pass(signals(spark, noise), 4.0, 0.2, size=size).withColumn("value", F.col("low"))
    b, a = blocks.butterworth(3, 0.1)
    for c, x in noise.items():
        assert np.allclose(values(got, c), both_ways(b, a, np.asarray(x, float)), atol=1e-9), c
    assert np.array_equal(values(blocks.low_pass(signals(spark, noise), 4.0, 2.0).withColumn("value", F.col("low")), "walk"), noise["walk"])


def test_filters_in_blocks(spark, noise, monkeypatch):
    sig = signals(spark, noise)
    whole = spectral.band_pass(sig, 4.0, 0.05, 0.4, 31).cache(), spectral.band_pass(sig, 4.0, None, 0.3, 151).cache(), spectral.spectrogram(sig, 4.0, 64, 3, 128).cache()
    want = [values(w, "walk") for w in whole[:2]] + [values(w, "short") for w in whole[:2]]
    frames = whole[2].orderBy("channel", "t", "f").toPandas()
    monkeypatch.setattr(spectral, "BLOCK", 160)
    split = spectral.band_pass(sig, 4.0, 0.05, 0.4, 31), spectral.band_pass(sig, 4.0, None, 0.3, 151)
    assert all(np.allclose(w, g) for w, g in zip(want, [values(s, c) for c in ("walk", "short") for s in split], strict=True))
    x = np.pad(noise["walk"], 15, mode="reflect")
    h = [2 * f / 4 * np.sinc(2 * f / 4 * (np.arange(31) - 15)) for f in (0.4, 0.05)]
    assert np.allclose(want[0], np.convolve(x, (h[0] - h[1]) * np.hamming(31), "valid"))
    got = spectral.spectrogram(sig, 4.0, 64, 3, 128).orderBy("channel", "t", "f").toPandas()
    assert len(got) == len(frames) == 65 * len(range(0, 1000 - 63, 3)) and np.allclose(got.power, frames.power) and np.allclose(got.t, frames.t)


@pytest.mark.parametrize("rate", [None, 4.0])
def test_long_series_are_repaired_alike(spark, noise, rate, monkeypatch):
    jumps = {k: np.asarray(v, float) + (np.arange(len(v)) > len(v) // 2) * 40 for k, v in noise.items()} | {"flat": np.full(50, 2.0)}
    sig = signals(spark, jumps)
    whole = spectral.repair_motion(sig, 4, rate=rate).cache()
    monkeypatch.setattr(spectral, "BLOCK", 128)
    long = spectral.repair_motion(sig, 4, rate=rate, whole=1).cache()
    for c in jumps:
        assert np.allclose(values(whole, c), values(long, c), atol=1e-6), c
    fixed = values(whole, "walk")
    assert abs((fixed[520] - fixed[480]) - (noise["walk"][520] - noise["walk"][480])) < 8
    if rate:  # what lies above the cut-off is untouched
        b, a = blocks.butterworth(3, 0.25)
        fast = lambda x: x - both_ways(b, a, x)
        inner = slice(100, 480)
        assert np.abs(fast(fixed)[inner] - fast(jumps["walk"])[inner]).max() < 1


def test_bands_are_filtered_apart(spark, noise):
    sig = signals(spark, {"walk": noise["walk"]})
    got = spectral.filter_bands(sig, 4.0, [(0.1, 0.3, 0.05, 0.05), (0.5, 0.9, 0.1, 0.1)])
    alone = spectral.filter_bands(sig, 4.0, [(0.5, 0.9, 0.1, 0.1)])
    assert np.allclose(values(got.where("band = 1"), "walk"), values(alone, "walk")) and got.where("band = 0").count() == 1000


def test_places_with_gaps(spark, noise):
    sig = signals(spark, {"walk": noise["walk"]}).where("t_idx % 7 <> 3")
    x = noise["walk"][[i % 7 != 3 for i in range(1000)]]
    n = np.arange(31) - 15
    h = 2 * 0.3 / 4 * np.sinc(2 * 0.3 / 4 * n) * np.hamming(31)
    assert np.allclose(values(spectral.band_pass(sig, 4.0, None, 0.3, 31), "walk"), np.convolve(np.pad(x, 15, mode="reflect"), h / h.sum(), "valid"))
