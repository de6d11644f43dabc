"""Runs, masks, densities, threshold segments and trigger sessions: gaps and islands on windows by series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelark.functions.scalar import label_rank
from wavelark.operators.signal import SERIES, series


def islands(df: DataFrame, flag: Column, keys, order: str = "t_idx") -> DataFrame:
    """Rows where flag holds, with `island` numbering each unbroken run within the keys."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumns({"_flag": flag, "_rn": F.row_number().over(w)})
    inner = Window.partitionBy(*keys, "_flag").orderBy(order)
    return marked.withColumn("island", F.col("_rn") - F.row_number().over(inner)).where("_flag").drop("_flag", "_rn")


def trends(sig: DataFrame, rising: bool = True, min_duration: float = 1.0, keys=SERIES) -> DataFrame:
    """(keys, start_sec, end_sec, height): maximal runs of rising (or falling) samples; the sample before the first rise
    is not part of a run. Height is the last value less the first."""
    change = F.col("value") - F.lag("value").over(series(keys))
    flag = F.coalesce((change > 0) if rising else (change < 0), F.lit(False))
    runs = islands(sig, flag, keys).groupBy(*keys, "island").agg(F.min("time").alias("start_sec"), F.max("time").alias("end_sec"), (F.max_by("value", "t_idx") - F.min_by("value", "t_idx")).alias("height"))
    return runs.where(F.col("end_sec") - F.col("start_sec") >= min_duration).drop("island")


def with_intervals(df: DataFrame) -> DataFrame:
    return df.withColumns({"center_sec": (F.col("start_sec") + F.col("end_sec")) / 2, "length_sec": F.col("end_sec") - F.col("start_sec")})


def trend_table(found: DataFrame, sig: DataFrame) -> DataFrame:
    """(subject, ch_idx, start_sec, end_sec, center_sec, length_sec, height): runs as they are exported, with a channel's place by name
    among its subject's, from 1."""
    place = F.dense_rank().over(Window.partitionBy("subject").orderBy("channel")).cast("int")
    names = sig.select("subject", "channel").distinct().withColumn("ch_idx", place)
    return with_intervals(found).join(names, ["subject", "channel"]).select("subject", "ch_idx", "start_sec", "end_sec", "center_sec", "length_sec", "height")


def first_of(sig: DataFrame, selection: DataFrame, keys=SERIES) -> DataFrame:
    """The first series by name of a selection (keys): what a single-series analysis of several looks at."""
    one = selection.agg(F.min(F.struct(*keys)).alias("k")).select("k.*")  # one row
    return sig.join(F.broadcast(one), list(keys), "left_semi")


def viewport(found: DataFrame, low: float, high: float) -> DataFrame:
    """Intervals whose centre lies in [low, high]."""
    return with_intervals(found).where(F.col("center_sec").between(low, high))


def mask(sig: DataFrame, found: DataFrame, keys=SERIES) -> DataFrame:
    """(keys, t_idx, time, active): 1 where a sample lies in a run (both ends included). Runs may overlap or hold one another.

    Samples and the runs' ends share one order, in which a running count of open runs replaces the range join."""
    end = lambda t, n, kind: found.select(*keys, F.lit(None).cast("int").alias("t_idx"), F.col(t).alias("time"), F.lit(n).alias("opens"), F.lit(kind).alias("kind"))
    a = sig.select(*keys, "t_idx", "time", F.lit(0).alias("opens"), F.lit(1).alias("kind"))
    w = Window.partitionBy(*keys).orderBy("time", "kind").rowsBetween(Window.unboundedPreceding, 0)
    merged = a.unionByName(end("start_sec", 1, 0)).unionByName(end("end_sec", -1, 2)).withColumn("open", F.sum("opens").over(w)).where("kind = 1")
    return merged.select(*keys, "t_idx", "time", (F.col("open") > 0).cast("int").alias("active"))


def density(masked: DataFrame, size: int, step: int) -> DataFrame:
    """(subject, win, time, ch_count): channels active at any sample of each window of `size` samples; time is the mean of
    the window's first and last sample."""
    w = series()
    frame = w.rowsBetween(0, size - 1)
    each = masked.withColumns({"any": F.max("active").over(frame), "n": F.count("*").over(frame), "at": F.row_number().over(w) - 1, "end": F.last("time").over(frame)})
    each = each.where((F.col("n") == size) & (F.col("at") % step == 0))
    return each.groupBy("subject", (F.col("at") / step).cast("int").alias("win"), ((F.col("time") + F.col("end")) / 2).alias("time")).agg(F.sum("any").alias("ch_count"))


def density_table(dense: DataFrame) -> DataFrame:
    """The density as it is exported: time and ch_count, and the heights' mean and deviation, which are not worked out and stay empty."""
    return dense.withColumns({"height_mean": F.lit(None).cast("double"), "height_std": F.lit(None).cast("double")})


def threshold_segments(dense: DataFrame, threshold: float, min_peak: float | None = None, value: str = "ch_count") -> DataFrame:
    """(subject, start_sec, end_sec, highest_time, highest_value): runs above the threshold; the first of equal peaks
    counts; segments whose peak is below min_peak go."""
    runs = islands(dense, F.col(value) > threshold, ("subject",), "win")
    top = F.max(F.struct(F.col(value).alias("v"), (-F.col("time")).alias("t")))
    found = runs.groupBy("subject", "island").agg(F.min("time").alias("start_sec"), F.max("time").alias("end_sec"), top.alias("top"))
    found = found.select("subject", "start_sec", "end_sec", (-F.col("top.t")).alias("highest_time"), F.col("top.v").alias("highest_value"))
    return found if min_peak is None else found.where(F.col("highest_value") >= min_peak)


def participation(segments: DataFrame, masked: DataFrame) -> DataFrame:
    """(subject, start_sec, channel, active): whether a channel is active at any sample of a segment (ends included).
    Segments of a subject are disjoint, so the one that began last before a sample decides, as in `mask`."""
    own = segments.select("subject", "start_sec", "end_sec").join(masked.select("subject", "channel").distinct(), "subject")
    a = masked.select(*SERIES, "time", "active", F.lit(None).cast("struct<start_sec double, end_sec double>").alias("of"), F.lit(1).alias("kind"))
    b = own.select(*SERIES, F.col("start_sec").alias("time"), F.lit(None).cast("int").alias("active"), F.struct("start_sec", "end_sec").alias("of"), F.lit(0).alias("kind"))
    last = F.last("of", ignorenulls=True).over(Window.partitionBy(*SERIES).orderBy("time", "kind").rowsBetween(Window.unboundedPreceding, 0))
    held = a.unionByName(b).withColumn("of", last).where("kind = 1 and time <= of.end_sec")
    return held.groupBy("subject", F.col("of.start_sec").alias("start_sec"), "channel").agg(F.max("active").alias("active"))


def sessions(events: DataFrame, keys: tuple[str, ...], time: str, value: str, max_gap: float = 10.0, min_duration: float = 3.0) -> DataFrame:
    """(keys, start, end, trigger_value): a trigger joins the session before it if less than max_gap has passed and the value is the same."""
    v = F.coalesce(F.col(value).cast("string"), F.lit("NAN"))
    w = Window.partitionBy(*keys).orderBy(time, "_v")
    e = events.withColumn("_v", v)
    fresh = F.coalesce(((F.col(time) - F.lag(time).over(w) >= max_gap) | (F.lag("_v").over(w) != F.col("_v"))).cast("int"), F.lit(1))
    e = e.withColumn("_fresh", fresh).withColumn("_s", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = e.groupBy(*keys, "_s").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.first("_v").alias("trigger_value")).drop("_s")
    return found.where(F.col("end") - F.col("start") >= min_duration)


def session_json(found: DataFrame) -> DataFrame:
    """Sessions as JSON with three decimals in strings."""
    f = lambda c: F.format_string("%.3f", c)
    return found.select(F.to_json(F.struct(f(F.col("start")).alias("Start"), f(F.col("end")).alias("End"), f(F.col("end") - F.col("start")).alias("Duration"), F.col("trigger_value").alias("Trigger Value"))).alias("json"))


def within_stretches(df: DataFrame, stretches: DataFrame, low: Column, high: Column, width: float, closed: bool = False) -> DataFrame:
    """Each row of df (time) beside each stretch [low, high) that holds it ([low, high] if closed). Time is dealt into buckets of
    `width`, so that this is an equality join with a filter: choose about a stretch's length."""
    bucket = lambda t: F.floor(t / width)
    laid = stretches.withColumns({"_low": low, "_high": high}).withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_low")), bucket(F.col("_high")))))
    inside = (F.col("time") >= F.col("_low")) & ((F.col("time") <= F.col("_high")) if closed else (F.col("time") < F.col("_high")))
    return df.withColumn("_bucket", bucket(F.col("time"))).join(laid, "_bucket").where(inside).drop("_bucket", "_low", "_high")


def epochs(series_: DataFrame, onsets: DataFrame, pre: float, post: float, samples: int) -> DataFrame:
    """(event, label, offset, value): the samples from `pre` before to `post` after each onset (end excluded), of
    complete epochs only."""
    onset = F.col("onset")
    joined = within_stretches(series_, onsets, onset - pre, onset + post, pre + post)
    n = F.count("*").over(Window.partitionBy("event"))
    return joined.withColumn("n", n).where(F.col("n") == samples).select("event", "label", (F.col("time") - F.col("onset")).alias("offset"), "value")


def ranked_events(events: DataFrame, order: list[str], keys: tuple[str, ...], time: str = "start") -> DataFrame:
    """events with `label_rank`, the label's place in a fixed order, and `place`, gapless from 0 within the keys: by rank (labels without
    one last), then by time."""
    ranked = events.withColumn("label_rank", label_rank(F.col("label"), order))
    by = Window.partitionBy(*keys).orderBy(F.col("label_rank").asc_nulls_last(), time)
    return ranked.withColumn("place", F.row_number().over(by) - 1)


def pre_post(found: DataFrame, pre: float, post: float) -> DataFrame:
    """(event, label, pre_mean, post_mean): means over [-pre, 0) and [0, post)."""
    o, v = F.col("offset"), F.col("value")
    return found.groupBy("event", "label").agg(F.avg(F.when((o >= -pre) & (o < 0), v)).alias("pre_mean"), F.avg(F.when((o >= 0) & (o < post), v)).alias("post_mean"))
