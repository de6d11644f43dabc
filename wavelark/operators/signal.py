"""Operators on a tidy signal (subject, channel, t_idx, time, value). Windows are always by series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavelark.model import Region
from wavelark.operators import ordering

SERIES = ("subject", "channel")


def series(keys=SERIES):
    return Window.partitionBy(*keys).orderBy("t_idx")


def crop(sig: DataFrame, region: Region, closed: bool = False) -> DataFrame:
    """[start, end), or [start, end] if closed; a filter that reaches the scan."""
    t = F.col("time")
    return sig.where((t >= region.start_sec) & ((t <= region.end_sec) if closed else (t < region.end_sec)))


def rebase(sig: DataFrame, shift: float = 0.0, keys=("subject",)) -> DataFrame:
    """Time from the first sample kept, plus a shift."""
    return sig.withColumn("time", F.col("time") - F.min("time").over(Window.partitionBy(*keys)) + shift)


def padded(sig: DataFrame, region: Region, pad: float) -> DataFrame:
    """The region with `pad` seconds more on both sides, as far as the record goes; `inside` marks the region itself."""
    w = Window.partitionBy("subject")
    low, high = F.greatest(F.lit(region.start_sec - pad), F.min("time").over(w)), F.least(F.lit(region.end_sec + pad), F.max("time").over(w))
    wide = sig.withColumns({"low": low, "high": high}).where(F.col("time").between(F.col("low"), F.col("high")))
    return wide.drop("low", "high").withColumn("inside", F.col("time").between(region.start_sec, region.end_sec))


def pick(sig: DataFrame, subjects: list[str] | None = None, channels: list[str] | None = None) -> DataFrame:
    """Series by name; all if none are named. Names without a series are an error, found by one small job."""
    for column, names in (("subject", subjects), ("channel", channels)):
        if names is not None:
            have = {r[0] for r in sig.where(F.col(column).isin(names)).select(column).distinct().collect()}
            if missing := set(names) - have:
                raise ValueError(f"no such {column}: {sorted(missing)}")
            sig = sig.where(F.col(column).isin(names))
    return sig


def scale(sig: DataFrame, factor: float) -> DataFrame:
    return sig.withColumn("value", F.col("value") * factor)


def z_score(sig: DataFrame, keys=SERIES) -> DataFrame:
    """By series, with the population's deviation; null for a constant series."""
    w, v = Window.partitionBy(*keys), F.col("value")
    return sig.withColumn("value", (v - F.avg(v).over(w)) / F.nullif(F.stddev_pop(v).over(w), F.lit(0.0)))


def robust_range(sig: DataFrame, low: float, high: float, lower: float = 0.02, upper: float = 0.98, keys=SERIES) -> DataFrame:
    """Values clipped to two quantiles and spread over [low, high]; the middle for a constant series."""
    q = ordering.quantiles(sig, "value", [lower, upper], keys)
    v, a, b = F.col("value"), F.col("q")[0], F.col("q")[1]
    out = F.when(a == b, F.lit((low + high) / 2)).otherwise(low + (F.least(F.greatest(v, a), b) - a) / F.nullif(b - a, F.lit(0.0)) * (high - low))
    return sig.join(q, list(keys)).withColumn("value", out).drop("q")


def sampling_rate(sig: DataFrame, keys=SERIES) -> DataFrame:
    """1 / median step of time by series; 0 with fewer than two samples."""
    step = sig.withColumn("dt", F.col("time") - F.lag("time").over(series(keys)))
    half = ordering.quantiles(step, "dt", [0.5], keys).select(*keys, F.col("q")[0].alias("dt"))
    rate = F.coalesce(1 / F.nullif(F.col("dt"), F.lit(0.0)), F.lit(0.0)).alias("sr")
    return sig.select(*keys).distinct().join(half, list(keys), "left").select(*keys, rate)


def align(sig: DataFrame, keys=SERIES) -> DataFrame:
    """All series cut to the shortest one's length, on the time axis of the first series by name."""
    lengths = sig.groupBy(*keys).agg(F.count("*").alias("n"))
    n = lengths.agg(F.min("n").alias("n"), F.min(F.struct(*keys)).alias("k"))
    # One row of limits, so the join is a broadcast of one row; the axis is one series.
    cut = sig.join(F.broadcast(n)).where(F.col("t_idx") < F.col("n"))
    axis = cut.where(F.struct(*keys) == F.col("k")).select("t_idx", F.col("time").alias("axis"))
    return cut.join(axis, "t_idx").select(*keys, "t_idx", F.col("axis").alias("time"), "value")


def row_slice(df: DataFrame, order: list[str], start: int, end: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows start to end - 1 in the order given, within each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("row", n.cast("long")).where(F.col("row").between(start, end - 1))


def synthetic_time(df: DataFrame, rate: float, shift: float = 0.0) -> DataFrame:
    return df.withColumn("time", shift + F.col("t_idx") / rate)


def to_wide(sig: DataFrame, names: list[str], keys=("subject",)) -> DataFrame:
    """A column a channel, time last."""
    return sig.groupBy(*keys, "time").pivot("channel", names).agg(F.first("value")).select(*keys, *names, "time")


def to_long(wide: DataFrame, names: list[str], keys=("subject",)) -> DataFrame:
    return wide.unpivot([*keys, "time"], names, "channel", "value")


def smooth(sig: DataFrame, size: int, keys=SERIES, reflect: bool = False) -> DataFrame:
    """Centred moving mean of `size` samples. At the ends the window is shorter, or, with reflect, sees the series mirrored there
    (the last sample twice). t_idx must count from 0."""
    half = size // 2
    mean = F.avg("value").over(series(keys).rowsBetween(-half, size - half - 1))
    if not reflect:
        return sig.withColumn("value", mean)
    n = F.count("*").over(Window.partitionBy(*keys))
    t = F.col("t_idx")
    places = F.array_compact(F.array(t, F.when(t < half, -t - 1), F.when(t >= F.col("_n") - half, 2 * F.col("_n") - 1 - t)))
    wide = sig.withColumn("_n", n.cast("int")).withColumn("t_idx", F.explode(places))
    return wide.withColumn("value", mean).where((t >= 0) & (t < F.col("_n"))).drop("_n")


def must_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join in which every left row must find a partner: a missing one raises when the row is read."""
    joined = left.join(right.withColumn("_there", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit("no partner for "), F.col(key).cast("string"))).cast("boolean")
    return joined.where(F.when(F.col("_there"), True).otherwise(missing)).drop("_there")


def head_tail(df: DataFrame, order: str, n: int, keys: tuple[str, ...]) -> DataFrame:
    """The first and last n rows within the keys, with `count` rows of each key. Each side is a top-n, cut before its shuffle."""
    top = lambda by, name: df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(by))).where(F.col(name) <= n).drop(name)
    both = top(F.col(order), "_a").union(top(F.desc(order), "_b")).distinct()
    return both.join(df.groupBy(*keys).agg(F.count("*").alias("count")), list(keys))


def export_labels(sig: DataFrame) -> DataFrame:
    """TIME, VALUE, LABEL = subject-chNN with NN the channel's 1-based place by name."""
    place = F.dense_rank().over(Window.partitionBy("subject").orderBy("channel"))
    return sig.select(F.col("time").alias("TIME"), F.col("value").alias("VALUE"), F.concat(F.col("subject").cast("string"), F.lit("-ch"), F.lpad(place.cast("string"), 2, "0")).alias("LABEL"))
