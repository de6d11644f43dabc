"""Pairwise correlations. Pairs are a < b by name, joined on the sample number."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelark.functions.scalar import clip_low, pearson
from wavelark.operators import ordering
from wavelark.operators.segments import within_stretches

SAMPLE = ("t_idx", "time")


def pairs(sig: DataFrame, key: Column, within: tuple[str, ...] = ()) -> DataFrame:
    """(within, t_idx, time, a, b, x, y): two series' values at each sample, a < b."""
    one = sig.select(*within, *SAMPLE, key.alias("a"), F.col("value").alias("x"))
    two = sig.select(*within, "t_idx", key.alias("b"), F.col("value").alias("y"))
    return one.join(two, [*within, "t_idx"]).where("a < b")


def global_pairs(sig: DataFrame, key: Column, within: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, r), 0 if either series is constant."""
    return pairs(sig, key, within).groupBy(*within, "a", "b").agg(F.coalesce(pearson(F.col("x"), F.col("y")), F.lit(0.0)).alias("r"))


#: Series of a group, and windows of a block: what one task has at a time is two groups' samples of a block.
SERIES_GROUP, WINDOWS = 64, 64


def _grid(sig: DataFrame, key: Column, within: tuple[str, ...]) -> tuple[DataFrame, int] | None:
    """(within, _key, t_idx, time, value, _at), with _at counting from the first sample, and the most series that a part has; None if any
    series lacks a sample that another one of its part has. One aggregate, a row a part and one row to the driver."""
    named = sig.select(*within, key.alias("_key"), *SAMPLE, "value")
    each = named.groupBy(*within, "_key").agg(F.min("t_idx").alias("lo"), F.max("t_idx").alias("hi"), F.count("value").alias("n"), F.count_distinct("t_idx").alias("m"), F.count("*").alias("k"))
    parts = each.groupBy(*within).agg(F.min("lo").alias("_low"), F.count("*").alias("keys"), ((F.min("lo") == F.max("lo")) & (F.min("hi") == F.max("hi")) & F.min((F.col("n") == F.col("hi") - F.col("lo") + 1) & (F.col("m") == F.col("n")) & (F.col("k") == F.col("n")))).alias("whole"))
    told = parts.agg(F.min("whole").alias("whole"), F.max("keys").alias("keys")).head()
    if not told.whole:
        return None
    low = parts.select(*within, "_low")
    at = named.join(low, list(within)) if within else named.join(F.broadcast(low))
    return at.withColumn("_at", F.col("t_idx") - F.col("_low")).drop("_low"), told.keys


def _blocks(at: DataFrame, size: int, step: int, windows: int) -> DataFrame:
    """Each sample once for every block of `windows` windows that has it."""
    span = windows * step
    first = F.greatest(F.floor((F.col("_at") - (size - 1)) / span), F.lit(0))
    return at.withColumn("_block", F.explode(F.sequence(first, F.floor(F.col("_at") / span)))).withColumn("_block", F.col("_block").cast("int"))


def _units(pdf: pd.DataFrame, size: int, step: int, windows: int) -> tuple[np.ndarray, np.ndarray, pd.DataFrame, np.ndarray]:
    """(names, windows' starts, samples of the first series, unit windows (series, windows, size)) of a block: each window less its mean, at
    length 1, or 0 if it is constant."""
    pdf = pdf.sort_values(["_key", "_at"])
    names = pdf["_key"].unique()
    axis = pdf.iloc[: len(pdf) // len(names)]
    first = int(axis["_at"].iloc[0])
    start = np.arange(pdf["_block"].iloc[0] * windows * step, int(axis["_at"].iloc[-1]) - size + 2, step)
    start = start[start < (pdf["_block"].iloc[0] + 1) * windows * step]
    x = pdf["value"].to_numpy(float).reshape(len(names), -1)
    if not len(start):
        return names, start, axis, np.zeros((len(names), 0, size))
    view = np.lib.stride_tricks.sliding_window_view(x, size, 1)[:, start - first]
    view = np.where((view.max(-1) == view.min(-1))[..., None], 0.0, view - view.mean(-1, keepdims=True))
    norm = np.sqrt((view**2).sum(-1, keepdims=True))
    return names, start - first, axis, np.divide(view, norm, out=np.zeros_like(view), where=norm > 0)


def sliding_pairs(sig: DataFrame, key: Column, size: int, step: int, within: tuple[str, ...] = (), windows: int = WINDOWS, group: int = SERIES_GROUP) -> DataFrame:
    """(within, a, b, t_idx, time, r) of each window of `size` samples that starts at a multiple of `step`; time is that of
    the sample in its middle. r is null if either side is constant.

    Series without gaps are dealt into groups, and time into blocks that overlap by a window: the windows of two groups in a block are
    correlated as matrices, so no pair's samples become rows. Series with gaps meet on the samples that both have, row by row."""
    found = _grid(sig, key, within)
    if found is None:
        return _sliding_rows(sig, key, size, step, within)
    at, keys = found
    n = -(-keys // group)
    g = F.pmod(F.hash("_key"), F.lit(n)).cast("int")
    dealt = _blocks(at, size, step, windows).withColumns({"_g": g, "_o": F.explode(F.sequence(F.lit(0), F.lit(n - 1)))}).withColumns({"_ga": F.least("_g", "_o"), "_gb": F.greatest("_g", "_o")})
    kinds = dict(dealt.dtypes)
    part = [*within, "_block", "_ga", "_gb"]
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in within), f"a {kinds['_key']}", f"b {kinds['_key']}", "t_idx int", "time double", "r double"])

    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names, start, axis, unit = _units(pdf, size, step, windows)
        own = pdf.drop_duplicates("_key").set_index("_key")["_g"].loc[names].to_numpy()
        one, two = np.flatnonzero(own == keys[-2]), np.flatnonzero(own == keys[-1])
        i, j = np.meshgrid(one, two, indexing="ij")
        keep = names[i] < names[j] if keys[-2] == keys[-1] else np.ones(i.shape, bool)
        i, j = i[keep], j[keep]
        if not len(start) or not len(i):
            return pd.DataFrame({c: [] for c in [*within, "a", "b", "t_idx", "time", "r"]}, dtype=object)
        r = np.matmul(unit[one].transpose(1, 0, 2), unit[two].transpose(1, 2, 0))[:, keep]  # windows, pairs
        moving = (unit**2).sum(-1) > 0
        r = np.where((moving[i] & moving[j]).T, r, np.nan)
        a, b = np.where(names[i] < names[j], names[i], names[j]), np.where(names[i] < names[j], names[j], names[i])
        each = len(i)
        out = {"a": np.tile(a, len(start)), "b": np.tile(b, len(start)), "t_idx": np.repeat(axis["t_idx"].to_numpy()[start], each), "time": np.repeat(axis["time"].to_numpy()[start + size // 2], each), "r": r.ravel()}
        out = pd.DataFrame({**dict(zip(within, keys, strict=False)), **out})
        out["r"] = out["r"].astype(object).where(out["r"].notna(), None)
        return out

    return dealt.groupBy(*part).applyInPandas(run, schema)


def _sliding_rows(sig: DataFrame, key: Column, size: int, step: int, within: tuple[str, ...]) -> DataFrame:
    w = Window.partitionBy(*within, "a", "b").orderBy("t_idx")
    frame = w.rowsBetween(0, size - 1)
    p = pairs(sig, key, within).withColumns({"n": F.count("*").over(frame), "at": F.row_number().over(w) - 1, "mid": F.lead("time", size // 2).over(w), "r": pearson(F.col("x"), F.col("y"), frame)})
    return p.where((F.col("n") == size) & (F.col("at") % step == 0)).select(*within, "a", "b", "t_idx", F.coalesce("mid", "time").alias("time"), "r")


def sliding_mean(sig: DataFrame, key: Column, size: int, step: int, windows: int = WINDOWS, group: int = SERIES_GROUP) -> DataFrame:
    """(t_idx, time, score): the mean over all pairs, with 0 for constant ones.

    The sum over all pairs of unit windows is the square of their sum, less the diagonal: so groups of series give their sums, a block's
    sums are added up, and no pair is ever made. Series with gaps are paired as in `sliding_pairs`."""
    found = _grid(sig, key, ())
    if found is None:
        return _sliding_rows(sig, key, size, step, ()).groupBy("t_idx", "time").agg(F.avg(F.coalesce("r", F.lit(0.0))).alias("score"))
    at, keys = found
    n = -(-keys // group)
    dealt = _blocks(at, size, step, windows).withColumn("_g", F.pmod(F.hash("_key"), F.lit(n)))

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        names, start, axis, unit = _units(pdf, size, step, windows)
        return pd.DataFrame({"block": pdf["_block"].iloc[0], "t_idx": axis["t_idx"].to_numpy()[start], "time": axis["time"].to_numpy()[start + size // 2] if len(start) else [], "total": pd.Series(list(unit.sum(0)), dtype=object), "own": (unit**2).sum((0, 2)), "n": len(names)})

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.groupby(["t_idx", "time"], as_index=False).agg(total=("total", "sum"), own=("own", "sum"), n=("n", "sum"))
        out = out[out["n"] > 1]
        every = out["total"].map(lambda x: float((np.asarray(x) ** 2).sum())) - out["own"]
        return pd.DataFrame({"t_idx": out["t_idx"], "time": out["time"], "score": every / (out["n"] * (out["n"] - 1))})

    schema = "block int, t_idx int, time double, total array<double>, own double, n long"
    if n == 1:
        return dealt.groupBy("_block").applyInPandas(lambda pdf: score(sums(pdf)), "t_idx int, time double, score double")
    return dealt.groupBy("_block", "_g").applyInPandas(sums, schema).groupBy("block").applyInPandas(score, "t_idx int, time double, score double")


def global_mean(sig: DataFrame, key: Column) -> DataFrame:
    return global_pairs(sig, key).agg(F.avg("r").alias("score"))


def between_subjects(sig: DataFrame, size: int, step: int, rate: float) -> DataFrame:
    """(time_sec, correlation): channel means of subjects, correlated pair by pair in sliding windows, averaged and
    clipped at 0. Time is nominal: start + window number x step + half a window. Null if any pair is constant."""
    mean = sig.groupBy("subject", *SAMPLE).agg(F.avg("value").alias("value"))
    r = sliding_pairs(mean, F.col("subject"), size, step)
    each = r.groupBy("t_idx").agg(F.when(F.count("r") == F.count("*"), F.avg("r")).alias("r"), F.min("time").alias("mid"))
    first = each.agg((F.min("mid") - (size // 2) / rate).alias("start"))  # one row
    return each.join(F.broadcast(first)).select((F.col("start") + F.floor(F.col("t_idx") / step) * (step / rate) + size / rate / 2).alias("time_sec"), clip_low(F.col("r")).alias("correlation"))


def matrix(sig: DataFrame, within: tuple[str, ...] = ("subject",)) -> DataFrame:
    """(within, ch_a, ch_b, r): both triangles from one computed half, and a diagonal of 0."""
    half = pairs(sig, F.col("channel"), within).groupBy(*within, "a", "b").agg(pearson(F.col("x"), F.col("y")).alias("r"))
    both = F.explode(F.array(F.struct(F.col("a").alias("ch_a"), F.col("b").alias("ch_b")), F.struct(F.col("b").alias("ch_a"), F.col("a").alias("ch_b"))))
    mirrored = half.select(*within, both.alias("p"), "r").select(*within, "p.ch_a", "p.ch_b", "r")
    diagonal = sig.select(*within, F.col("channel").alias("ch_a"), F.col("channel").alias("ch_b")).distinct().withColumn("r", F.lit(0.0))
    return mirrored.unionByName(diagonal)


def by_annotation(sig: DataFrame, annotations: DataFrame, width: float = 60.0) -> DataFrame:
    """sig once for each annotation (annotation, start, end) whose closed stretch holds the sample."""
    return within_stretches(sig, annotations, F.col("start"), F.col("end"), width, closed=True).drop("start", "end")


def strong_edges(edges: DataFrame, within: tuple[str, ...] = ("subject",), quantile: float = 0.75) -> DataFrame:
    """Edges with r > 0 and at least the quantile of the positive entries (both triangles counted)."""
    cut = ordering.quantiles(edges.where("r > 0"), "r", [quantile], within).select(*within, F.col("q")[0].alias("threshold"))
    return edges.join(cut, list(within)).where((F.col("r") > 0) & (F.col("r") >= F.col("threshold")))
