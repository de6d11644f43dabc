"""Tests and summaries. Random draws come from hashes, so a run can be repeated and checked in any engine."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelark.functions.scalar import hash_uniform
from wavelark.operators import ordering


def participation_count(status: DataFrame) -> DataFrame:
    """(channel, real_count, real_percent) from (segment, channel, active)."""
    return status.groupBy("channel").agg(F.sum("active").cast("long").alias("real_count"), (F.sum("active") * 100.0 / F.count("*")).alias("real_percent"))


def participation_null(status: DataFrame, n_perm: int, seed: int = 42) -> DataFrame:
    """(perm, channel, count): for each permutation and segment as many channels as were active are drawn without
    replacement, and counted by channel."""
    # A segment's channels (some dozens) are one array, so a permutation draws from it in place: no row a permutation and channel is sorted.
    own = status.groupBy("segment").agg(F.collect_list("channel").alias("channels"), F.sum("active").cast("int").alias("k"))
    perms = own.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
    draw = lambda c: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("perm").cast("string"), F.col("segment").cast("string"), c).cast("binary"))
    order = F.array_sort(F.transform("channels", lambda c: F.struct(draw(c).alias("draw"), c.alias("channel"))))
    drawn = perms.select("perm", "k", F.posexplode(order).alias("place", "one"))
    return drawn.groupBy("perm", F.col("one.channel").alias("channel")).agg(F.sum((F.col("place") < F.col("k")).cast("int")).cast("long").alias("count"))


def p_values(real: DataFrame, null: DataFrame) -> DataFrame:
    """real with p_value = (permutations that reach the count + 1) / (permutations + 1)."""
    n = null.join(real.select("channel", "real_count"), "channel").groupBy("channel").agg(F.sum((F.col("count") >= F.col("real_count")).cast("int")).alias("hits"), F.count("*").alias("n"))
    return real.join(n, "channel").withColumn("p_value", (F.col("hits") + 1) / (F.col("n") + 1)).drop("hits", "n")


def benjamini_hochberg(df: DataFrame, p: str = "p_value", within: tuple[str, ...] = (), tie: tuple[str, ...] = (), alpha: float = 0.05) -> DataFrame:
    """df with p_value_corrected and significant: step-up false discovery rates, at most 1. Equal values of p share the rate of the last of
    them, so only distinct values are ordered, in buckets cut at their quantiles; no task sees all rows. A null p takes no part and has
    null rates. `tie` is not needed any more: the order among equal values changes no rate."""
    df = ordering.settled(df)
    each = df.where(F.col(p).isNotNull()).groupBy(*within, p).agg(F.count("*").alias("_n"))
    dealt = ordering.with_bucket(each, p, ordering.cut_points(each, p), "_b")
    upto = ordering.running(dealt, within, "_b", [p], {"_rank": F.col("_n")})
    total = each.groupBy(*within).agg(F.sum("_n").alias("_m"))
    rated = (upto.join(total, list(within)) if within else upto.join(F.broadcast(total))).withColumn("_q", F.col(p) * F.col("_m") / F.col("_rank"))
    after = Window.partitionBy(*within, F.lit(0)).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    least = rated.groupBy(*within, "_b").agg(F.min("_q").alias("_least")).select(*within, "_b", F.min("_least").over(after).alias("_later"))
    own = Window.partitionBy(*within, "_b").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    rates = rated.join(least, [*within, "_b"]).select(*within, p, F.least(F.min("_q").over(own), F.col("_later"), F.lit(1.0)).alias("p_value_corrected"))  # least() skips nulls
    return df.join(rates, [*within, p], "left").select(*df.columns, "p_value_corrected", (F.col("p_value_corrected") < alpha).alias("significant"))


def participation_test(status: DataFrame, n_perm: int = 1000, seed: int = 42) -> DataFrame:
    return benjamini_hochberg(p_values(participation_count(status), participation_null(status, n_perm, seed)))


def paired_t(df: DataFrame, post: Column, pre: Column) -> DataFrame:
    """(n, mean_diff, t) of post - pre; t is null without spread."""
    d = df.select((post - pre).alias("d"))
    return d.agg(F.count("d").alias("n"), F.avg("d").alias("mean_diff"), (F.avg("d") / F.nullif(F.stddev_samp("d") / F.sqrt(F.count("d")), F.lit(0.0))).alias("t"))


#: Pairs up to which the signed-rank null is worked out exactly.
EXACT = 50


def wilcoxon(df: DataFrame, post: Column, pre: Column, within: tuple[str, ...] = ()) -> DataFrame:
    """(within, n, w, ties, ranks): signed-rank statistic, the smaller rank sum; zero differences are dropped and ties share their mean
    rank. ties is the sum of t^3 - t over groups of t equal sizes; ranks, for at most EXACT pairs, are the mean ranks with their counts.
    Equal sizes are added up before they are ordered, in buckets cut at their quantiles, so ranks need no task that sees all rows."""
    d = df.select(*within, (post - pre).alias("d")).where("d <> 0").select(*within, F.abs("d").alias("size"), (F.col("d") > 0).cast("long").alias("up"))
    ranked = ordering.tied_ranks(d, "size", within, {"up": F.col("up")})
    n, up = F.col("n"), F.col("up")
    sums = ranked.groupBy(*within).agg(F.sum("n").alias("n"), F.sum(F.col("rank") * up).alias("a"), F.sum(F.col("rank") * (n - up)).alias("b"), F.sum(n * n * n - n).alias("ties"))
    few = sums.where(F.col("n") <= EXACT).select(*within, F.lit(True).alias("few"))
    held = ranked.join(few, list(within)) if within else ranked.join(F.broadcast(few))
    lists = held.groupBy(*within).agg(F.sort_array(F.collect_list(F.struct("rank", "n"))).alias("ranks"))
    out = sums.join(lists, list(within), "left") if within else sums.join(F.broadcast(lists.where(F.size("ranks") > 0)), how="left")
    return out.where("n > 0").select(*within, "n", F.least("a", "b").alias("w"), "ties", "ranks")


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 300):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * total


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a t statistic of n pairs."""
    return pd.Series([None if pd.isna(x) or k < 2 else _beta_tail((k - 1) / 2, 0.5, (k - 1) / (k - 1 + x * x)) for x, k in zip(t, n, strict=True)])


def signed_rank_p(w: float, ranks: list[tuple[float, int]]) -> float:
    """Two-sided p of a signed-rank statistic, exact with ties: the ways to reach each doubled rank sum, rank by rank."""
    doubled = [round(2 * r) for r, n in ranks for _ in range(n)]
    ways = [1] + [0] * sum(doubled)
    for r in doubled:
        for s in range(len(ways) - 1, r - 1, -1):
            ways[s] += ways[s - r]
    return min(1.0, 2 * sum(ways[: math.floor(2 * w) + 1]) / 2 ** len(doubled))


@F.pandas_udf(T.DoubleType())
def wilcoxon_p_value(w: pd.Series, n: pd.Series, ties: pd.Series, ranks: pd.Series) -> pd.Series:
    """Two-sided p of a signed-rank statistic: exact where the ranks are given, else by the normal distribution, corrected for ties."""

    def one(x: float, k: int, t: float, own) -> float | None:
        if pd.isna(x) or k < 1:
            return None
        if own is not None and len(own):
            return signed_rank_p(x, [(g["rank"], g["n"]) for g in own])
        sd = math.sqrt(k * (k + 1) * (2 * k + 1) / 24 - t / 48)
        return min(1.0, math.erfc(abs(x - k * (k + 1) / 4) / sd / math.sqrt(2)))

    return pd.Series([one(x, int(k), float(t), own) for x, k, t, own in zip(w, n, ties, ranks, strict=True)])


def moments(series_: DataFrame, width: float, coarse: int = 4096) -> DataFrame:
    """(bucket, n, total, samples) of a series (time, value): its samples in buckets of `width` seconds, without gaps between the first and
    the last bucket, with the count and sum of all samples before the bucket. Sums are carried over stretches of `coarse` buckets."""
    held = series_.select((F.floor(F.col("time") / width)).alias("bucket"), "time", "value").groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("time", "value"))).alias("samples"))
    held = ordering.settled(held)
    ends = held.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))  # one row
    every = ends.where("lo is not null").select(F.explode(F.sequence(F.floor(F.col("lo") / coarse), F.floor(F.col("hi") / coarse))).alias("_c"), "lo", "hi").repartition("_c")
    every = every.select(F.explode(F.sequence(F.greatest("lo", F.col("_c") * coarse), F.least("hi", (F.col("_c") + 1) * coarse - 1))).alias("bucket"))
    whole = every.join(held, "bucket", "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<struct<time double, value double>>")))
    sums = {"n": F.size("samples").cast("long"), "total": F.aggregate("samples", F.lit(0.0), lambda a, s: a + s["value"])}
    own = whole.withColumns({"_c": F.floor(F.col("bucket") / coarse), "_n": sums["n"], "_t": sums["total"]})
    upto = ordering.running(own, (), "_c", ["bucket"], {"n": F.col("_n"), "total": F.col("_t")})
    return upto.select("bucket", (F.col("n") - F.col("_n")).alias("n"), (F.col("total") - F.col("_t")).alias("total"), "samples")


def onset_null(series_: DataFrame, n_events: int, pre: float, post: float, samples: int, n_perm: int, seed: int = 42) -> DataFrame:
    """(perm, diff): mean post minus mean pre over events at random onsets; a permutation counts only if all its epochs
    are complete. Onsets are drawn uniformly between the record's ends less the margins."""
    ends = series_.agg((F.min("time") + pre).alias("lo"), (F.max("time") - post).alias("hi"))
    spark = series_.sparkSession
    draws = spark.range(n_perm * n_events).select((F.col("id") / n_events).cast("int").alias("perm"), (F.col("id") % n_events).cast("int").alias("event"))
    draws = draws.join(F.broadcast(ends)).select("perm", "event", (F.col("lo") + hash_uniform(F.lit(seed), F.col("perm"), F.col("event")) * (F.col("hi") - F.col("lo"))).alias("onset"))
    return null_differences(series_, draws, n_events, pre, post, samples)


def null_differences(series_: DataFrame, draws: DataFrame, n_events: int, pre: float, post: float, samples: int) -> DataFrame:
    """(perm, diff) of onsets (perm, event, onset). Each onset asks for the count and sum of all samples before three points of time; each
    point is looked up by equality in a table of carried sums and within one short bucket, so no draw meets an epoch's samples."""
    width = (pre + post) / max(1, samples) * 8
    points = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.col("onset") + d).alias("x")) for k, d in enumerate((-pre, 0.0, post)))))
    asked = draws.select("perm", "event", points.alias("p")).select("perm", "event", "p.*").withColumn("bucket", F.floor(F.col("x") / width))
    table = ordering.settled(moments(series_, width))
    ends = table.agg(F.min("bucket").alias("_lo"), F.max("bucket").alias("_hi"))  # one row: points beyond the record ask its ends
    asked = asked.join(F.broadcast(ends)).withColumn("bucket", F.least(F.greatest("bucket", "_lo"), "_hi")).drop("_lo", "_hi")
    before = F.filter("samples", lambda s: s["time"] < F.col("x"))
    met = asked.join(table, "bucket").select("perm", "event", "k", (F.col("n") + F.size(before)).alias("n"), (F.col("total") + F.aggregate(before, F.lit(0.0), lambda a, s: a + s["value"])).alias("total"))
    pick = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    each = met.groupBy("perm", "event").agg(*(pick(c, k).alias(f"{c}{k}") for c in ("n", "total") for k in range(3))).where(F.col("n2") - F.col("n0") == samples)
    mean = lambda a, b: (F.col(f"total{b}") - F.col(f"total{a}")) / F.nullif(F.col(f"n{b}") - F.col(f"n{a}"), F.lit(0))
    each = each.select("perm", mean(0, 1).alias("a"), mean(1, 2).alias("b"))
    return each.groupBy("perm").agg(F.count("*").alias("k"), (F.avg("b") - F.avg("a")).alias("diff")).where(F.col("k") == n_events).drop("k")


def two_sided(null: DataFrame, real: float) -> DataFrame:
    """(n_valid, null_mean, null_std, p_value)."""
    return null.agg(F.count("*").alias("n_valid"), F.avg("diff").alias("null_mean"), F.stddev_pop("diff").alias("null_std"), ((F.sum((F.abs("diff") >= abs(real)).cast("int")) + 1) / (F.count("*") + 1)).alias("p_value"))


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """(bin, n) of equal bins from the least to the greatest value; the greatest falls into the last bin."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.least(F.floor((F.col(value) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    return df.join(F.broadcast(ends)).groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
