"""Order statistics of whole tables without a task that sees all rows: buckets cut at sampled quantiles, sums carried from
bucket to bucket, ranks of ties, and exact quantiles."""

from __future__ import annotations

import math
import tempfile

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets that a table is dealt into; they are cut at quantiles of the values, so that crowded values are dealt finely.
BUCKETS = 256
#: A group of at most so many rows is one task's work for Spark's own `percentile`; beyond it, ranks are selected in rounds.
GROUP = 4_000_000
#: Rows that are sorted at the end of a selection.
REST = 50_000


def settled(df: DataFrame) -> DataFrame:
    """df from files in spark.checkpoint.dir: what several later steps or rounds read is worked out once, and lost executors cost none of
    it. A local session without that setting gets a temporary folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None and context.master.startswith("local"):
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="wavelark-"))
    return df.checkpoint()


def cut_points(df: DataFrame, column: str, buckets: int = BUCKETS) -> list[float]:
    """At most buckets - 1 ascending values that cut a numeric column into about equal parts: one aggregate, one row to the driver."""
    shares = F.array(*(F.lit(k / buckets) for k in range(1, buckets)))
    row = df.agg(F.percentile_approx(F.col(column).cast("double"), shares, 20 * buckets).alias("q")).head()
    return sorted({x for x in row.q or [] if not math.isnan(x)})


def with_bucket(df: DataFrame, column: str, points: list[float], name: str = "_bucket") -> DataFrame:
    """df with the number of the bucket that a value lies in; null and NaN get a last one of their own. Equal values share a bucket."""
    edges = [-math.inf, *([p for p in points if math.isfinite(p)] or [0.0]), math.inf]
    return Bucketizer(splits=edges, inputCol=f"{name}_in", outputCol=name, handleInvalid="keep").transform(df.withColumn(f"{name}_in", F.col(column).cast("double"))).drop(f"{name}_in")


def carried(df: DataFrame, keys: tuple[str, ...], bucket: str, sums: dict[str, Column]) -> DataFrame:
    """df with, under each name, the sum of an expression over all earlier buckets of the row's keys. The buckets' own sums are a small
    table (keys x buckets)."""
    each = df.groupBy(*keys, bucket).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    before = Window.partitionBy(*keys, F.lit(0)).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(bucket).alias("_kb"), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums))
    same = F.col(bucket) == F.col("_kb")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(each, same, "left").drop("_kb", *(f"_k{i}" for i in range(len(keys))))


def running(df: DataFrame, keys: tuple[str, ...], bucket: str, order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """df with running sums (the row itself included) in an order of which the buckets are consecutive stretches. Windows are as large
    as a bucket of a key."""
    w = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = carried(df, keys, bucket, {f"_before_{n}": c for n, c in sums.items()})
    return out.withColumns({n: F.col(f"_before_{n}") + F.sum(c).over(w) for n, c in sums.items()}).drop(*(f"_before_{n}" for n in sums))


def tied_ranks(df: DataFrame, value: str, keys: tuple[str, ...], counts: dict[str, Column]) -> DataFrame:
    """(keys, value, n, rank, counts) of each distinct value: its rows, their mean rank from 1 within the keys, and sums of expressions
    over them. Equal values are added up before they are ordered, so that a value of many rows is one row; nulls take no part."""
    each = settled(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), *(F.sum(c).alias(k) for k, c in counts.items())))
    dealt = with_bucket(each, value, cut_points(df, value))
    upto = running(dealt, keys, "_bucket", [value], {"_upto": F.col("n")})
    return upto.withColumn("rank", F.col("_upto") - (F.col("n") - 1) / 2).drop("_bucket", "_upto")


def quantiles(df: DataFrame, value: str, shares: list[float], keys: tuple[str, ...], group: int = GROUP) -> DataFrame:
    """(keys, q array<double>): exact quantiles with linear interpolation, as `percentile` gives them. One count finds the largest group.
    Up to `group` rows Spark's aggregate holds a group's values; beyond it their ranks are selected."""
    most = df.where(F.col(value).isNotNull()).groupBy(*keys).count().agg(F.max("count")).head()[0] or 0
    if most <= group:
        return df.groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, shares))).alias("q"))
    return selected_quantiles(df, value, shares, keys, group)


def selected_quantiles(df: DataFrame, value: str, shares: list[float], keys: tuple[str, ...], rest: int = REST) -> DataFrame:
    """`quantiles` by selection. Each wanted rank has a bracket of values. A round takes two values near the rank from a sketch of its
    bracket and counts exactly what lies below, on, between and above them; the part that holds the rank is the next bracket. When
    at most `rest` rows are left, they are sorted. So a task holds a sketch or `rest` values, whatever a group's size; a few
    numbers a key and rank are collected each round, so keys should number in the thousands at most. df is read in each
    round: keep it if it is costly."""
    spark, own = df.sparkSession, [f"_k{i}" for i in range(len(keys))]
    data = df.where(F.col(value).isNotNull()).select(*(F.col(k).alias(c) for k, c in zip(keys, own, strict=True)), F.col(value).cast("double").alias("_v"))
    kinds = [f"{c} {k}" for c, k in data.dtypes if c != "_v"]
    at = lambda r: tuple(r[c] for c in own)
    size = {at(r): r["n"] for r in data.groupBy(*own).agg(F.count("*").alias("n")).collect()}
    wanted = {(k, f(s * (n - 1))) for k, n in size.items() for s in shares for f in (math.floor, math.ceil)}
    found: dict = {}
    open_ = {(k, r): (-math.inf, math.nan, 0, size[k]) for k, r in wanted}  # lowest and highest value (NaN is above all), rows below, rows inside

    def beside(brackets, more: str, rows):
        """The data beside the brackets that hold it."""
        table = spark.createDataFrame([(*k, r, lo, hi, *rows(k, r)) for (k, r), (lo, hi, _, _) in brackets.items()], ", ".join([*kinds, "_r long, _lo double, _hi double", more]))
        named = table.select(*(F.col(c).alias(f"{c}_") for c in own), *table.columns[len(own) :])
        same = F.col("_v").between(F.col("_lo"), F.col("_hi"))
        for c in own:
            same &= F.col(c).eqNullSafe(F.col(f"{c}_"))
        return data.join(F.broadcast(named), same).groupBy(*own, "_r")

    while open_:
        small = {b: v for b, v in open_.items() if v[3] <= rest}
        big = {b: v for b, v in open_.items() if v[3] > rest}
        if small:
            grouped = beside(small, "_skip int", lambda k, r: (r - small[k, r][2],))
            found |= {(at(x), x["_r"]): x["x"] for x in grouped.agg(F.get(F.sort_array(F.collect_list("_v")), F.first("_skip")).alias("x")).collect()}
        open_ = {}
        if not big:
            break
        part = lambda k, r: (r - big[k, r][2]) / (big[k, r][3] - 1)
        # Spark's sketch takes constant shares only, so it gives an even grid; the wanted share lies between two of its points.
        grid = [k / 1000 for k in range(1001)]
        sketch = {(at(x), x["_r"]): x["q"] for x in beside(big, "_x int", lambda k, r: (0,)).agg(F.percentile_approx("_v", F.array(*map(F.lit, grid)), 10_000).alias("q")).collect()}
        near = {(k, r): (sketch[k, r][max(0, math.floor(part(k, r) * 1000) - 1)], sketch[k, r][min(1000, math.ceil(part(k, r) * 1000) + 1)]) for k, r in big}
        v, a, b = F.col("_v"), F.first("_a"), F.first("_b")
        parts = {"lt": v < F.col("_a"), "a": v == F.col("_a"), "mid": (v > F.col("_a")) & (v < F.col("_b")), "b": (v == F.col("_b")) & (F.col("_b") > F.col("_a")), "gt": v > F.col("_b")}
        counts = [F.count_if(c).alias(n) for n, c in parts.items()]
        ends = [f(F.when(parts[n], v)).alias(f"{n}_{w}") for n in ("lt", "mid", "gt") for w, f in (("lo", F.min), ("hi", F.max))]
        for x in beside(big, "_a double, _b double", lambda k, r: near[k, r]).agg(a.alias("va"), b.alias("vb"), *counts, *ends).collect():
            key, below = (at(x), x["_r"]), big[at(x), x["_r"]][2]
            for name in parts:
                if key[1] < below + x[name]:
                    break
                below += x[name]
            if name in "ab":
                found[key] = x[f"v{name}"]
            else:
                open_[key] = (x[f"{name}_lo"], x[f"{name}_hi"], below, x[name])

    def one(k, s):
        h = s * (size[k] - 1)
        low, high = found[k, math.floor(h)], found[k, math.ceil(h)]
        return low if low == high else low * (math.ceil(h) - h) + high * (h - math.floor(h))

    names = ", ".join([*(f"{k} {dict(data.dtypes)[c]}" for k, c in zip(keys, own, strict=True)), "q array<double>"])
    return spark.createDataFrame([(*k, [one(k, s) for s in shares]) for k in size], names)
