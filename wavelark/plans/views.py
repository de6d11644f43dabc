"""Views of the driver's tables as a signal, and the analyses as whole plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavelark.model import Region
from wavelark.operators import correlation, segments, signal

#: Seconds from 1970 to bin 0; seconds a bin; the time axis counts hours.
ORIGIN, BIN = 1704067200, 21600


def epoch(ts: str = "ts"):
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts}) / 1000000D")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", epoch().alias("epoch"))


def signal_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, channel, t_idx, time, value): events summed on a dense grid of 6-hour bins, 0 where there are none."""
    e = events(spark, sf_dir).select((F.col("user_id") % 3).cast("int").alias("subject"), F.col("event_type").alias("channel"), F.floor((F.col("epoch") - ORIGIN) / BIN).cast("int").alias("t_idx"), "value")
    ends = e.agg(F.min("t_idx").alias("lo"), F.max("t_idx").alias("hi"))  # one row: the bins that the events span
    grid = e.select("subject", "channel").distinct().join(F.broadcast(ends)).withColumn("t_idx", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")
    total = e.groupBy("subject", "channel", "t_idx").agg(F.sum("value").alias("v"))
    return grid.join(total, ["subject", "channel", "t_idx"], "left").select("subject", "channel", "t_idx", (F.col("t_idx") * (BIN / 3600)).alias("time"), F.round(F.coalesce("v", F.lit(0.0)), 4).alias("value"))


def trend_plan(sig: DataFrame, size: int = 4, step: int = 1, threshold: float = 2.0, min_duration: float = 6.0) -> dict[str, DataFrame]:
    """The flagship analysis as lazy tables: trends, mask, density, segments, participation."""
    found = segments.trends(sig, min_duration=min_duration)
    masked = segments.mask(sig, found)
    dense = segments.density(masked, size, step)
    high = segments.threshold_segments(dense, threshold)
    return {"trends": found, "mask": masked, "density": dense, "segments": high, "participation": segments.participation(high, masked)}


def trend_map(sig: DataFrame, region: Region, min_duration: float = 6.0) -> DataFrame:
    """(subject, channel, row, start_sec, end_sec, center_sec, size): the trends that a trend map draws, with the channel's row (from 0, by
    name) and the dot's size, 0.1 to 15 by height within the subject."""
    rows = sig.select("subject", "channel").distinct().withColumn("row", F.dense_rank().over(Window.partitionBy("subject").orderBy("channel")) - 1)
    seen = segments.viewport(segments.trends(sig, min_duration=min_duration), region.start_sec, region.end_sec)
    sized = signal.robust_range(seen.withColumnRenamed("height", "value"), 0.1, 15.0, keys=("subject",))
    return sized.join(rows, ["subject", "channel"]).select("subject", "channel", "row", "start_sec", "end_sec", "center_sec", F.col("value").alias("size"))


def epoch_map(found: DataFrame, order: list[str]) -> DataFrame:
    """(row, event, label, offset, value): epochs as the rows of a heat map, by the labels' order and then the event."""
    events = segments.ranked_events(found.select("event", "label").distinct(), order, (), "event")
    return found.join(events.select("event", F.col("place").alias("row")), "event").select("row", "event", "label", "offset", "value")


def waveform_grid(sig: DataFrame, columns: int = 3) -> DataFrame:
    """(subject, channel, row, col, t_idx, time, value): every series with its place in a grid of small plots, spread over [0, 1]."""
    place = F.dense_rank().over(Window.partitionBy("subject").orderBy("channel")) - 1
    cells = sig.select("subject", "channel").distinct().withColumn("place", place)
    cells = cells.select("subject", "channel", F.floor(F.col("place") / columns).cast("int").alias("row"), (F.col("place") % columns).alias("col"))
    return signal.robust_range(sig, 0.0, 1.0).join(cells, ["subject", "channel"])


def rates_in_view(rates: DataFrame, region: Region, low: float = 1.0, high: float = 1.5) -> DataFrame:
    """(subject, time, freq, drawn): the side tables' heart rates beside a region's other figures; drawn are those between the axis's ends."""
    return signal.crop(rates, region, closed=True).withColumn("drawn", F.col("freq").between(low, high))


def connectivity_plan(sig: DataFrame, annotations: DataFrame | None = None) -> dict[str, DataFrame]:
    from wavelark.operators import graph

    within = ("subject",) if annotations is None else ("annotation", "subject")
    edges = correlation.matrix(sig if annotations is None else correlation.by_annotation(sig, annotations), within)
    strong = correlation.strong_edges(edges, within)
    parts = graph.stable_ids(graph.communities(strong, within), within)
    return {"edges": edges, "strong": strong, "communities": parts, "modularity": graph.modularity(strong, parts, within)}
