"""Spectra, optical formulas and signal quality. Filters and transforms run as numpy kernels on blocks of time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavelark.functions.scalar import decibel, pearson
from wavelark.operators import blocks, ordering
from wavelark.operators.blocks import BLOCK
from wavelark.operators.signal import SERIES


def dft_power(sig: DataFrame, bins: list[int], length: int) -> DataFrame:
    """(keys, k, power): squared modulus of single bins of the discrete Fourier transform."""
    each = sig.withColumn("k", F.explode(F.array(*(F.lit(k) for k in bins))))
    angle = F.col("k") * F.col("t_idx") * (2 * np.pi / length)
    return each.groupBy(*SERIES, "k").agg((F.pow(F.sum(F.col("value") * F.cos(angle)), 2) + F.pow(F.sum(F.col("value") * F.sin(angle)), 2)).alias("power"))


def tukey(n: int, share: float = 0.25) -> np.ndarray:
    """A window with cosine edges over `share` of its length."""
    x = np.arange(n) / n  # periodic form
    edge = share / 2
    ramp = 0.5 * (1 - np.cos(2 * np.pi * np.minimum(x, 1 - x) / share))
    return np.where(np.minimum(x, 1 - x) < edge, ramp, 1.0)


def spectrogram(sig: DataFrame, rate: float, frame: int, hop: int = 1, nfft: int = 4096, band: tuple[float, float] | None = None) -> DataFrame:
    """(subject, channel, t, f, power): one-sided power density of frames with the mean taken out. A band keeps only its
    frequencies (ends included), so that the full matrix is never made into rows."""
    nfft = max(nfft, frame)
    size = max(1, BLOCK // 8 // hop) * hop  # a block's frames begin in it
    f = np.fft.rfftfreq(nfft, 1 / rate)
    keep = np.ones(len(f), bool) if band is None else (f >= band[0]) & (f <= band[1])

    def transform(pdf: pd.DataFrame, first: int, end: int, n: int) -> pd.DataFrame:
        x, w = pdf["value"].to_numpy(float), tukey(frame)
        start = np.arange(first, min(end, n - frame + 1), hop)
        if not len(start):
            return pd.DataFrame({"subject": [], "channel": [], "t": [], "f": [], "power": []}, dtype=object)
        frames = np.lib.stride_tricks.sliding_window_view(x, frame)[start - first]
        parts = []
        for a in range(0, len(frames), 1024):
            s = frames[a : a + 1024]
            p = np.abs(np.fft.rfft((s - s.mean(1, keepdims=True)) * w, nfft)) ** 2 / (rate * (w**2).sum())
            p[:, 1 : -1 if nfft % 2 == 0 else None] *= 2
            parts.append(p[:, keep])
        p = np.concatenate(parts)
        return pd.DataFrame({"subject": pdf["subject"].iloc[0], "channel": pdf["channel"].iloc[0], "t": np.repeat((start + frame / 2) / rate, keep.sum()), "f": np.tile(f[keep], len(p)), "power": p.ravel()})

    schema = f"subject {dict(sig.dtypes)['subject']}, channel string, t double, f double, power double"
    return blocks.by_blocks(sig.select("subject", "channel", "t_idx", "value"), transform, schema, size, 0, frame)


def peak_frequency(spec: DataFrame, starts: DataFrame, db_floor: float | None = None) -> DataFrame:
    """(subject, time, freq): the strongest frequency of the channels' mean power, the lowest of equals; null if all are below
    the floor. starts: (subject, start) shifts the frames' times to the record's."""
    mean = spec.groupBy("subject", "t", "f").agg(F.avg("power").alias("p")).withColumn("db", decibel(F.col("p")))
    kept = F.when(F.col("db") >= db_floor, F.col("db")) if db_floor is not None else F.col("db")
    top = F.max(F.when(kept.isNotNull(), F.struct(kept.alias("db"), (-F.col("f")).alias("f"))))
    return mean.groupBy("subject", "t").agg(top.alias("top")).join(starts, "subject").select("subject", (F.col("t") + F.col("start")).alias("time"), (-F.col("top.f")).alias("freq"))


def optical_density(sig: DataFrame, keys=SERIES) -> DataFrame:
    """-ln(|v| / mean |v|) by series; |v| is at least the smallest positive normal number."""
    v = F.greatest(F.abs("value"), F.lit(2.2250738585072014e-308))
    return sig.withColumn("value", -F.ln(v / F.avg(F.abs("value")).over(Window.partitionBy(*keys))))


def beer_lambert(od: DataFrame, extinction: dict[str, tuple[float, float]], distance: float, path_factor: float) -> DataFrame:
    """(subject, channel, t_idx, time, hbo, hbr) from (…, wavelength, value) at two wavelengths, by the 2 x 2 system."""
    (w1, (a, b)), (w2, (c, d)) = extinction.items()
    det, path = a * d - b * c, distance * path_factor
    x, y = F.max(F.when(F.col("wavelength") == w1, F.col("value"))), F.max(F.when(F.col("wavelength") == w2, F.col("value")))
    return od.groupBy("subject", "channel", "t_idx", "time").agg(((d * x - b * y) / (det * path)).alias("hbo"), ((a * y - c * x) / (det * path)).alias("hbr"))


def band_pass(sig: DataFrame, rate: float, low: float | None, high: float | None, taps: int = 101) -> DataFrame:
    """Windowed-sinc filter without delay; the ends see mirrored samples."""
    n = np.arange(taps) - taps // 2
    cut = lambda f: 2 * f / rate * np.sinc(2 * f / rate * n)
    h = (cut(high) if high else (n == 0).astype(float)) - (cut(low) if low else 0)
    h = h * np.hamming(taps)
    if not low:
        h = h / h.sum()

    half, names = taps // 2, sig.columns

    def run(pdf: pd.DataFrame, first: int, end: int, n: int) -> pd.DataFrame:
        own = pdf[(pdf["_at"] >= first) & (pdf["_at"] < end)]
        value = blocks.convolve(blocks.mirrored(pdf, first, end, n, half), h) if n > 1 else own["value"]
        return pd.DataFrame({c: own[c].to_numpy() for c in names}).assign(value=np.asarray(value))

    return blocks.by_blocks(sig, run, ", ".join(f"{c} {k}" for c, k in sig.dtypes), max(BLOCK, taps + 1), half, half)


def filter_bands(sig: DataFrame, rate: float, bands: list[tuple[float | None, float | None, float, float]]) -> DataFrame:
    """sig once for every band, numbered from 0 in the column `band`; the first is what later steps take if none is named. A band is
    (low, high, width of the lower and of the upper transition), in Hz, and filters the given signal, not another band's. The filter's length
    follows from the narrower transition (3.3 periods of it, as a Hamming window needs), the cut-offs lie in the transitions' middle."""
    out = None
    for k, (low, high, lower, upper) in enumerate(bands):
        narrow = min(w for w, f in ((lower, low), (upper, high)) if f)
        taps = int(np.ceil(3.3 / narrow * rate)) | 1
        one = band_pass(sig, rate, low and low - lower / 2, high and high + upper / 2, taps).withColumn("band", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


#: Samples of a series up to which one task repairs it.
WHOLE = 4_000_000


def repair_motion(sig: DataFrame, rounds: int = 50, tune: float = 4.685, rate: float | None = None, cutoff: float = 0.5, whole: int = WHOLE) -> DataFrame:
    """Temporal-derivative repair: robust (Tukey) weights of the derivative take out jumps, and the rest is summed up again. With a rate, only
    what lies below the cut-off (in Hz) is repaired, and what lies above is added back unchanged. Series of up to `whole` samples are one
    task each; longer ones lie in blocks, with the same result."""
    kinds, names = dict(sig.dtypes), sig.columns
    split = blocks.low_pass(sig, rate, cutoff) if rate else sig.withColumn("low", F.col("value"))
    most = sig.groupBy(*SERIES).count().agg(F.max("count")).head()[0] or 0
    if most > whole:
        return _repair_long(split, rounds, tune).select(names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t_idx")
        x, low = pdf["value"].to_numpy(float), pdf["low"].to_numpy(float)
        if len(x) < 3:
            return pdf[names]
        d, w, mu = np.diff(low), np.ones(len(x) - 1), np.inf
        for _ in range(rounds):
            old, mu = mu, (w * d).sum() / max(w.sum(), 1e-300)
            dev = np.abs(d - mu)
            sigma = 1.4826 * np.median(dev)
            if sigma == 0 or abs(mu - old) <= 1e-12 * max(1.0, abs(mu)):
                break
            r = dev / (sigma * tune)
            w = np.where(r < 1, (1 - r**2) ** 2, 0.0)
        y = np.concatenate([[0], np.cumsum(w * (d - mu))])
        return pdf.assign(value=y - y.mean() + low.mean() + x - low)[names]

    return split.groupBy(*SERIES).applyInPandas(run, ", ".join(f"{c} {k}" for c, k in kinds.items()))


def _repair_long(split: DataFrame, rounds: int, tune: float) -> DataFrame:
    """`repair_motion` of series that lie in many tasks. The derivative at a block's first sample takes the last sample of the block before
    from a small table; sums of the repaired derivative are carried from block to block."""
    at = blocks.placed(split).withColumn("_b", F.floor(F.col("_at") / BLOCK))
    ends = at.groupBy(*SERIES, "_b").agg(F.max_by("low", "_at").alias("_end"))
    before = ends.select(*SERIES, (F.col("_b") + 1).alias("_b"), F.col("_end").alias("_before"))
    own = Window.partitionBy(*SERIES, "_b").orderBy("_at")
    steps = at.join(before, [*SERIES, "_b"], "left").withColumn("d", F.col("low") - F.coalesce(F.lag("low").over(own), F.col("_before")))
    changes = steps.where("d is not null").select(*SERIES, "d").persist(StorageLevel.DISK_ONLY)  # read in every round
    scales = blocks.robust_scales(changes, rounds, tune)
    changes.unpersist()
    r = F.abs(F.col("d") - F.col("at")) / (F.col("sigma") * tune)
    w = F.when(F.col("sigma") == float("inf"), 1.0).when(r < 1, F.pow(1 - r * r, 2)).otherwise(0.0)
    moved = steps.join(F.broadcast(scales), list(SERIES), "left").withColumn("_m", F.coalesce(w * (F.col("d") - F.col("mu")), F.lit(0.0)))
    summed = ordering.running(moved, SERIES, "_b", ["_at"], {"_y": F.col("_m")})
    means = summed.groupBy(*SERIES).agg((F.avg("low") - F.avg("_y")).alias("_shift"))
    fixed = F.col("_y") + F.col("_shift") + F.col("value") - F.col("low")
    return summed.join(means, list(SERIES)).withColumn("value", F.when(F.col("_n") < 3, F.col("value")).otherwise(fixed))


def resample_mean(sig: DataFrame, rate: float) -> DataFrame:
    """Means of time buckets of 1 / rate seconds."""
    k = F.floor(F.col("time") * rate).cast("int")
    return sig.groupBy(*SERIES, k.alias("t_idx")).agg(F.avg("value").alias("value")).withColumn("time", F.col("t_idx") / rate)


def resample(sig: DataFrame, rate: float, to: float) -> DataFrame:
    """Each series at a new rate, by its Fourier transform (frequencies above either rate's half are left out). The series is
    taken as periodic; mirrored samples at both ends keep its edges smooth. Time starts where it did."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t_idx")
        x = pdf["value"].to_numpy(float)
        pad = min(len(x) - 1, int(np.ceil(rate)) * 8)
        y = np.pad(x, pad, mode="reflect", reflect_type="odd") if pad > 0 else x
        n = max(1, round(len(y) * to / rate))
        half, bins = np.fft.rfft(y), np.zeros(n // 2 + 1, complex)
        m = min(len(half), len(bins))
        bins[:m] = half[:m]
        z = np.fft.irfft(bins, n) * (n / len(y))
        keep = max(1, round(len(x) * to / rate))
        at = pdf["time"].iloc[0] + np.arange(keep) / to
        # The padded series starts pad / rate earlier; its samples lie n / len(y) as dense.
        z = np.interp((at - pdf["time"].iloc[0] + pad / rate) * rate * n / len(y), np.arange(n), z)
        return pd.DataFrame({"subject": pdf["subject"].iloc[0], "channel": pdf["channel"].iloc[0], "t_idx": np.arange(keep, dtype=np.int32), "time": at, "value": z})

    kind = dict(sig.dtypes)["subject"]
    return sig.select(*SERIES, "t_idx", "time", "value").groupBy(*SERIES).applyInPandas(run, f"subject {kind}, channel string, t_idx int, time double, value double")


def coupling(pairs: DataFrame, window: float | None = None, bad_below: float = 0.8, band: tuple[float, float] | None = None, rate: float = 1.0, taps: int = 101) -> DataFrame:
    """(subject, channel, [win], sci, bad) from (subject, channel, t_idx, time, x, y), x and y being a channel's two wavelengths: their
    correlation, after a band-pass of both (0.7 to 1.5 Hz holds the heart's beat) if a band is given."""
    if band is not None:
        side = lambda c: band_pass(pairs.select("subject", "channel", "t_idx", "time", F.col(c).alias("value")), rate, *band, taps)
        pairs = side("x").withColumnRenamed("value", "x").join(side("y").select("subject", "channel", "t_idx", F.col("value").alias("y")), ["subject", "channel", "t_idx"])
    keys = ["subject", "channel"]
    if window is not None:
        pairs = pairs.withColumn("win", F.floor(F.col("time") / window).cast("int"))
        keys.append("win")
    return pairs.groupBy(*keys).agg(pearson(F.col("x"), F.col("y")).alias("sci")).withColumn("bad", F.col("sci") < bad_below)


def coupling_table(each: DataFrame, windows: list[int], width: float, shift: float = 0.0, threshold: float = 0.8) -> DataFrame:
    """(subject, channel, score_<t>, over_<t>, ...): the coupling of windows (subject, channel, win, sci) as one row a channel, with a column
    a window named by its rounded start after a shift, and whether it is above the threshold. One aggregate with partial sums; order by
    subject and channel for the heat map."""
    pick = lambda k: F.max(F.when(F.col("win") == k, F.col("sci")))
    named = [(k, round(k * width + shift)) for k in windows]
    columns = [c for k, t in named for c in (pick(k).alias(f"score_{t}"), (pick(k) > threshold).alias(f"over_{t}"))]
    return each.groupBy("subject", "channel").agg(*columns)
