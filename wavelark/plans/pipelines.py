"""Analyses from end to end, each a lazy composition of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.model import Region, WindowSpec
from wavelark.operators import correlation, segments, signal, spectral, statistics


def preprocess(raw: DataFrame, rate: float, extinction: dict[str, tuple[float, float]], region: Region | None = None, pad: float = 30.0, band: tuple[float | None, float | None] | None = None, repair: bool = True, z: bool = True, factor: float = 1e6, distance: float = 3.0, path_factor: float = 6.0) -> DataFrame:
    """Raw intensities (subject, channel, wavelength, t_idx, time, value) to a clean signal: a padded crop, optical density,
    motion repair (of what lies below 0.5 Hz), concentration, filter, the exact crop, unit scale and z-score. Steps can be left out."""
    keys = ("subject", "channel")
    sig = raw.withColumn("channel", F.concat_ws("|", "channel", F.col("wavelength").cast("string"))).drop("wavelength")
    if region is not None:
        sig = signal.padded(sig, region, pad).drop("inside")
    sig = spectral.optical_density(sig, keys)
    if repair:
        sig = spectral.repair_motion(sig, rate=rate)
    split = F.split("channel", r"\|")
    od = sig.withColumns({"wavelength": split[1], "channel": split[0]})
    hbo = spectral.beer_lambert(od, extinction, distance, path_factor).select(*keys, "t_idx", "time", F.col("hbo").alias("value"))
    if band is not None:
        hbo = spectral.band_pass(hbo, rate, *band)
    if region is not None:
        hbo = signal.crop(hbo, region, closed=True)
    hbo = signal.scale(hbo, factor)
    return signal.z_score(hbo) if z else hbo


def similarity(sig: DataFrame, selection: DataFrame, window: WindowSpec | None = None, region: Region | None = None, rate: float = 1.0) -> DataFrame:
    """(t_idx, time, score): mean pairwise correlation of the selected series (subject, channel), sliding if a window is given,
    else one score at every sample. Nothing in the region is an error (one small job)."""
    if region is not None:
        sig = signal.crop(sig, region)
        if not sig.limit(1).count():
            raise ValueError("No data in the selected time range")
    sig = sig.join(selection, ["subject", "channel"], "left_semi")
    key = F.concat_ws("/", F.col("subject").cast("string"), "channel")
    if window is not None:
        return correlation.sliding_mean(sig, key, *window.samples(rate))
    return sig.select("t_idx", "time").distinct().join(F.broadcast(correlation.global_mean(sig, key)))


def event_statistics(sig: DataFrame, onsets: DataFrame, window: WindowSpec, rate: float, pre: float = 20.0, post: float = 20.0, n_perm: int = 1000) -> dict[str, DataFrame]:
    """Between-subject correlation around events: epochs, their means, paired tests and a permutation null."""
    series = correlation.between_subjects(sig, *window.samples(rate), rate).select(F.col("time_sec").alias("time"), F.col("correlation").alias("value"))
    samples = round((pre + post) / window.step)
    found = segments.epochs(series, onsets, pre, post, samples)
    means = segments.pre_post(found, pre, post)
    a, b = F.col("post_mean"), F.col("pre_mean")
    return {
        "series": series,
        "epochs": found,
        "means": means,
        "t": statistics.paired_t(means, a, b).withColumn("p", statistics.t_p_value("t", "n")),
        "wilcoxon": statistics.wilcoxon(means, a, b).withColumn("p", statistics.wilcoxon_p_value("w", "n", "ties", "ranks")),
        "null": statistics.onset_null(series, onsets.count(), pre, post, samples, n_perm),
    }


def quality_report(pairs: DataFrame, window: float = 60.0, bad_below: float = 0.8) -> dict[str, DataFrame]:
    """Coupling of two wavelengths over the whole record and by window, and the share of bad windows by channel."""
    each = spectral.coupling(pairs, window, bad_below)
    return {"record": spectral.coupling(pairs, None, bad_below), "windows": each, "bad_share": each.groupBy("subject", "channel").agg(F.avg(F.col("bad").cast("int")).alias("bad_share"))}
