"""Positions, orders and labels that figures are drawn from. A layout is one small table of sensors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _all():
    """The whole table: a layout is one small table."""
    return Window.partitionBy()


def _spread(c: str, low: float, high: float) -> Column:
    v, a, b = F.col(c), F.min(c).over(_all()), F.max(c).over(_all())
    return low + (v - a) / F.nullif(b - a, F.lit(0.0)) * (high - low)


def normalize_positions(pos: DataFrame, width: float, height: float, x_range=(0.01, 0.99), y_range=(0.05, 0.9), reverse: bool = True) -> DataFrame:
    """x and y spread over their ranges, shrunk by the plots' size, kept inside the margin and mirrored if asked."""
    for c, pad, (low, high) in (("x", width, x_range), ("y", height, y_range)):
        pos = pos.withColumn(c, _spread(c, low, high))
        pos = pos.withColumn(c, F.least(F.greatest(F.col(c) * (1 - 2 * pad) + pad, F.lit(pad)), F.lit(1 - pad)))
    return reverse_xy(pos) if reverse else pos


def reverse_xy(pos: DataFrame) -> DataFrame:
    """max + min - v on both axes."""
    return pos.withColumns({c: F.max(c).over(_all()) + F.min(c).over(_all()) - F.col(c) for c in ("x", "y")})


def y_axis_order(pos: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """pos with side and y_order from 0: left (x above the median) by y and falling x, the midline by x, right by falling
    y and x."""
    middle = pos.agg(F.median("x").alias("m"))
    off = F.col("x") - F.col("m")
    side = F.when(F.abs(off) < tolerance, "midline").when(off < 0, "right").otherwise("left")
    pos = pos.join(F.broadcast(middle)).withColumn("side", side)
    part = F.when(F.col("side") == "left", 0).when(F.col("side") == "midline", 1).otherwise(2)
    one = F.when(part == 0, F.col("y")).when(part == 1, F.col("x")).otherwise(-F.col("y"))
    two = F.when(part == 1, F.lit(0.0)).otherwise(-F.col("x"))
    return pos.withColumn("y_order", F.row_number().over(_all().orderBy(part, one, two, "channel")) - 1).drop("m")


def region_colours(regions: DataFrame, palette: int = 20) -> DataFrame:
    """(region, colour): distinct regions by name, numbered over the palette."""
    return regions.select("region").distinct().withColumn("colour", ((F.dense_rank().over(_all().orderBy("region")) - 1) % palette).cast("int"))


def top_regions(atlas: DataFrame, n: int = 3, least_percent: float = 0.0) -> DataFrame:
    """The n largest regions of each channel, without those below the percentage."""
    r = F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("pct"), "region"))
    return atlas.withColumn("place", r).where((F.col("place") <= n) & (F.col("pct") >= least_percent / 100))


def first_by_name(channels: DataFrame, physical: Column) -> DataFrame:
    """The first row (by pos) of each physical channel."""
    return channels.withColumn("phys", physical).withColumn("n", F.row_number().over(Window.partitionBy("phys").orderBy("pos"))).where("n = 1").drop("n")
