"""Sets of closed intervals as tables, by sweeping over their ends: +1 where one opens, -1 where one closes, and running sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.operators import ordering


def depths(intervals: DataFrame, keys: tuple[str, ...] = (), start: str = "start", end: str = "end") -> DataFrame:
    """(keys, t, opens, closes, before, after) of each distinct end point: intervals that open and close there, and those open just before
    and just after it. Ends at one point are added up first; running sums are carried between buckets of time, so no task sees all points
    of a key. Intervals whose end is before their start, or that have a null end, are none."""
    ends = F.explode(F.array(F.struct(F.col(start).cast("double").alias("t"), F.lit(1).alias("o")), F.struct(F.col(end).cast("double").alias("t"), F.lit(0).alias("o"))))
    points = intervals.where(F.col(start) <= F.col(end)).select(*keys, ends.alias("p")).groupBy(*keys, F.col("p.t").alias("t")).agg(F.sum("p.o").alias("opens"), F.sum(1 - F.col("p.o")).alias("closes"))
    points = ordering.settled(points)
    dealt = ordering.with_bucket(points, "t", ordering.cut_points(points, "t"))
    swept = ordering.running(dealt, keys, "_bucket", ["t"], {"_o": F.col("opens"), "_c": F.col("closes")})
    # Closed intervals: what closes at t is still open there, what opens at t is open there already.
    return swept.select(*keys, "t", "opens", "closes", (F.col("_o") - F.col("opens") - F.col("_c") + F.col("closes")).alias("before"), (F.col("_o") - F.col("_c")).alias("after"), "_bucket")


def union(intervals: DataFrame, keys: tuple[str, ...] = (), start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end, n): the maximal stretches that are covered, intervals that touch being one, and of how many each is made."""
    swept = depths(intervals, keys, start, end)
    runs = ordering.running(swept, keys, "_bucket", ["t"], {"_run": (F.col("before") == 0).cast("long")})
    return runs.groupBy(*keys, "_run").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.sum("opens").alias("n")).drop("_run")


def intersection(intervals: DataFrame, least: int, keys: tuple[str, ...] = (), start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end): the maximal stretches over which at least so many intervals are open; a stretch may be one point."""
    swept = depths(intervals, keys, start, end)
    here = F.col("before") + F.col("opens")  # open at the point itself
    fresh = (here >= least) & (F.col("before") < least)
    runs = ordering.running(swept.where(here >= least), keys, "_bucket", ["t"], {"_run": fresh.cast("long")})
    return runs.groupBy(*keys, "_run").agg(F.min("t").alias("start"), F.max("t").alias("end")).drop("_run")


def inside(rows: DataFrame, intervals: DataFrame, keys: tuple[str, ...] = (), time: str = "time", start: str = "start", end: str = "end", name: str = "n_open") -> DataFrame:
    """rows with the number of their keys' intervals that hold their time (ends included; 0 for none, also for a null time). Rows and
    ends of one time are dealt into the same bucket; counts of open intervals are carried, so an interval is two rows, however long
    it is and whatever it overlaps."""
    ends = F.explode(F.array(F.struct(F.col(start).cast("double").alias("t"), F.lit(1).alias("o"), F.lit(0).alias("kind")), F.struct(F.col(end).cast("double").alias("t"), F.lit(-1).alias("o"), F.lit(2).alias("kind"))))
    points = intervals.where(F.col(start) <= F.col(end)).select(*keys, ends.alias("p")).select(*keys, "p.*").groupBy(*keys, "t", "kind").agg(F.sum("o").alias("o"))
    points = ordering.settled(points)
    cuts = ordering.cut_points(points, "t")
    samples = rows.select(*keys, F.struct(*rows.columns).alias("_row"), F.col(time).cast("double").alias("t"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("o"))
    marks = points.select(*keys, F.lit(None).cast(samples.schema["_row"].dataType).alias("_row"), "t", "kind", "o")
    both = ordering.with_bucket(samples.union(marks), "t", cuts)
    counted = ordering.running(both, keys, "_bucket", ["t", "kind"], {name: F.col("o")}).where("kind = 1")
    return counted.select("_row.*", F.when(F.col("t").isNull(), 0).otherwise(F.col(name)).cast("long").alias(name))


def covered(rows: DataFrame, intervals: DataFrame, keys: tuple[str, ...] = (), time: str = "time", start: str = "start", end: str = "end") -> DataFrame:
    """The rows that lie in any of their keys' intervals."""
    return inside(rows, intervals, keys, time, start, end, "_n").where("_n > 0").drop("_n")
