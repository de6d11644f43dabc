"""Long series in blocks of time: halos for windows of samples, and states carried from block to block for recursive filters."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavelark.operators import ordering
from wavelark.operators.signal import SERIES

#: Samples of a block.
BLOCK = 1 << 16
#: Samples of a recursive filter that are worked out as one product of matrices.
STEP = 128


def placed(sig: DataFrame, keys=SERIES) -> DataFrame:
    """sig with `_at`, a sample's place in its series from 0, and `_n`, the series' length. Where t_idx is gapless (one aggregate tells),
    places need no sort."""
    ends = sig.groupBy(*keys).agg(F.min("t_idx").alias("_lo"), F.count("*").alias("_n"), (F.max("t_idx") - F.min("t_idx") + 1).alias("_m"), F.count_distinct("t_idx").alias("_d"))
    whole = ends.agg(F.min((F.col("_n") == F.col("_m")) & (F.col("_n") == F.col("_d")))).head()[0]
    at = sig.join(ends.select(*keys, "_lo", "_n"), list(keys))
    if whole is not False:
        return at.withColumn("_at", (F.col("t_idx") - F.col("_lo")).cast("long")).drop("_lo")
    return at.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("t_idx")).cast("long") - 1).drop("_lo")


def by_blocks(sig: DataFrame, run: Callable[[pd.DataFrame, int, int, int], pd.DataFrame], schema: str, size: int, before: int, after: int, keys=SERIES) -> DataFrame:
    """run(samples in order, first, end, length) of each block [first, end) of each series, the samples being those from first - before to
    end + after as far as the series goes. A sample is sent once for every block that has it."""
    at = placed(sig, keys)
    low, high = F.greatest(F.lit(0), F.floor((F.col("_at") - after) / size)), F.floor((F.col("_at") + before) / size)
    last = F.floor((F.col("_n") - 1) / size)
    dealt = at.withColumn("_block", F.explode(F.sequence(low, F.least(high, last))))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        first, n = int(pdf["_block"].iloc[0]) * size, int(pdf["_n"].iloc[0])
        return run(pdf, first, min(first + size, n), n)

    return dealt.groupBy(*keys, "_block").applyInPandas(one, schema)


def mirrored(pdf: pd.DataFrame, first: int, end: int, n: int, half: int) -> np.ndarray:
    """The values from first - half to end + half of a series of n samples that is mirrored at its ends (the end samples once). Of a series
    of at most `half` samples, as many as there are, and zeros beyond."""
    x, low = pdf["value"].to_numpy(float), int(pdf["_at"].iloc[0])
    pad = min(half, n - 1)
    left, right = max(0, half - first), max(0, end + half - n)
    out = np.pad(x[max(0, first - half) - low : min(n, end + half) - low], (min(left, pad), min(right, pad)), mode="reflect") if n > 1 else x
    return np.pad(out, (left - min(left, pad), right - min(right, pad))) if n > 1 else np.pad(x, half)


def convolve(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The part of the convolution where h lies within x; long ones by Fourier transforms."""
    if len(h) < 64:
        return np.convolve(x, h, "valid")
    n = 1 << (len(x) + len(h) - 2).bit_length()
    return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(h, n), n)[len(h) - 1 : len(x)]


def butterworth(order: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of a digital low-pass; cutoff as a share of half the sampling rate. The analogue prototype's poles lie evenly on the
    left half circle; the bilinear transform, with the frequency warped beforehand, makes it digital."""
    warped = 2 * math.tan(math.pi * cutoff / 2)
    poles = warped * np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    a = np.real(np.poly((2 + poles) / (2 - poles)))
    b = np.poly(-np.ones(order)) * a.sum() / 2**order  # 1 at frequency 0
    return b, a


class Recursive:
    """A recursive filter with a state: y = s[0] + b[0] x, and s follows from s and x. Stretches of STEP samples are products of matrices."""

    def __init__(self, b: np.ndarray, a: np.ndarray):
        k = len(a) - 1
        self.b0, self.a = b[0], np.zeros((k, k))
        self.a[:, 0], self.b = -a[1:], b[1:] - a[1:] * b[0]
        self.a[: k - 1, 1:] = np.eye(k - 1)
        self.still = np.linalg.solve(np.eye(k) - self.a, self.b)  # the state that a constant 1 leads to
        powers = [np.eye(k)]
        for _ in range(STEP):
            powers.append(powers[-1] @ self.a)
        self.over = powers[STEP]
        self.out = np.array([p[0] for p in powers[:STEP]])  # what a state adds to each sample
        self.into = np.array([p @ self.b for p in powers[STEP - 1 :: -1]])  # what each sample adds to the state
        h = np.concatenate([[self.b0], self.out[: STEP - 1] @ self.b])
        self.response = np.array([np.concatenate([h[: j + 1][::-1], np.zeros(STEP - 1 - j)]) for j in range(STEP)])

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(filtered samples, state behind them)."""
        whole = len(x) // STEP
        rows = x[: whole * STEP].reshape(whole, STEP)
        gained, states = rows @ self.into, np.empty((whole, len(state)))
        for k in range(whole):
            states[k] = state
            state = self.over @ state + gained[k]
        tail = []
        for v in x[whole * STEP :]:
            tail.append(state[0] + self.b0 * v)
            state = self.a @ state + self.b * v
        return np.concatenate([(rows @ self.response.T + states @ self.out.T).ravel(), tail]), state

    def over_all(self, n: int) -> np.ndarray:
        return np.linalg.matrix_power(self.a, n)


def packed(sig: DataFrame, size: int, keys=SERIES) -> DataFrame:
    """(keys, block, n, values array<double>): each series in blocks, one row a block."""
    at = placed(sig, keys).withColumn("block", F.floor(F.col("_at") / size))
    lists = at.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct("_at", "value"))).alias("x"))
    return lists.select(*keys, "block", F.size("x").alias("n"), F.col("x.value").cast("array<double>").alias("values"))


def _directed(blocks: DataFrame, one: Recursive, keys, forward: bool) -> DataFrame:
    """Blocks filtered in one direction. Each block tells the state that it leads to from none; states are carried over these few numbers; then
    each block is filtered from its own."""
    kinds = ", ".join(f"{c} {k}" for c, k in blocks.dtypes)
    near = 0 if forward else -1

    def tell(frames):
        for pdf in frames:
            ends = [one.run(np.asarray(v, float)[:: 1 if forward else -1], np.zeros(len(one.b)))[1] for v in pdf["values"]]
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "block": pdf["block"], "n": pdf["n"], "near": [v[near] for v in pdf["values"]], "gained": pd.Series(ends, index=pdf.index, dtype=object)})

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, states = pdf.sort_values("block", ascending=forward), []
        state = one.still * pdf["near"].iloc[0]
        for n, gained in zip(pdf["n"], pdf["gained"], strict=True):
            states.append(state)
            state = one.over_all(int(n)) @ state + gained
        return pd.DataFrame({**{k: pdf[k] for k in keys}, "block": pdf["block"], "state": pd.Series(states, index=pdf.index, dtype=object)})

    def apply(frames):
        for pdf in frames:
            out = [one.run(np.asarray(v, float)[:: 1 if forward else -1], np.asarray(s, float))[0][:: 1 if forward else -1] for v, s in zip(pdf["values"], pdf["state"], strict=True)]
            yield pdf.drop(columns="state").assign(values=pd.Series(out, index=pdf.index, dtype=object))

    own = ", ".join(f"{k} {dict(blocks.dtypes)[k]}" for k in keys)
    told = blocks.mapInPandas(tell, f"{own}, block long, n int, near double, gained array<double>")
    states = told.groupBy(*keys).applyInPandas(carry, f"{own}, block long, state array<double>")
    return blocks.join(states, [*keys, "block"]).select(*blocks.columns, "state").mapInPandas(apply, kinds)


def low_pass(sig: DataFrame, rate: float, cutoff: float = 0.5, order: int = 3, size: int = BLOCK, keys=SERIES) -> DataFrame:
    """sig with `low`, its values below a frequency: a Butterworth filter run forwards and then backwards, each begun as if the first sample
    had always been there. Above half the sampling rate, low is the value itself."""
    share = 2 * cutoff / rate
    if share >= 1:
        return sig.withColumn("low", F.col("value"))
    one = Recursive(*butterworth(order, share))
    blocks = _directed(_directed(packed(sig, size, keys), one, keys, True), one, keys, False)
    low = blocks.select(*keys, F.posexplode("values").alias("_k", "low"), (F.col("block") * size).alias("_from")).select(*keys, (F.col("_from") + F.col("_k")).alias("_at"), "low")
    return placed(sig, keys).join(low, [*keys, "_at"]).drop("_at", "_n")


def robust_scales(steps: DataFrame, rounds: int, tune: float, keys=SERIES) -> DataFrame:
    """(keys, mu, sigma) of steps (keys, d): the mean under Tukey's weights and the scale of what it leaves, round by round until the means
    settle. Sums are partial aggregates and medians exact selections, so a series may lie in many tasks; two numbers a
    series are collected each round."""
    spark = steps.sparkSession
    kinds = ", ".join(f"{k} {dict(steps.dtypes)[k]}" for k in keys)
    at = lambda r: tuple(r[k] for k in keys)
    state = {at(r): (math.inf, 0.0, False) for r in steps.select(*keys).distinct().collect()}
    weights = {k: None for k in state}  # mu and sigma that made the present weights
    for _ in range(rounds):
        if all(done for _, _, done in state.values()):
            break
        known = F.broadcast(spark.createDataFrame([(*k, *(weights[k] or (0.0, math.inf))) for k in state], f"{kinds}, _mu double, _s double"))
        r = F.abs(F.col("d") - F.col("_mu")) / (F.col("_s") * tune)
        w = F.when(F.col("_s") == math.inf, 1.0).when(r < 1, F.pow(1 - r * r, 2)).otherwise(0.0)
        mean = {at(x): x["mu"] for x in steps.join(known, list(keys)).groupBy(*keys).agg((F.sum(w * F.col("d")) / F.greatest(F.sum(w), F.lit(1e-300))).alias("mu")).collect()}
        now = {k: mean[k] if not done else mu for k, (mu, _, done) in state.items()}
        told = F.broadcast(spark.createDataFrame([(*k, m) for k, m in now.items()], f"{kinds}, _mu double"))
        away = steps.join(told, list(keys)).select(*keys, F.abs(F.col("d") - F.col("_mu")).alias("dev"))
        scale = {at(x): 1.4826 * x["q"][0] for x in ordering.quantiles(away, "dev", [0.5], tuple(keys)).collect()}
        for k, (old, _, done) in list(state.items()):
            if done:
                continue
            settled = scale[k] == 0 or abs(now[k] - old) <= 1e-12 * max(1.0, abs(now[k]))
            state[k] = (now[k], scale[k], settled)
            if not settled:
                weights[k] = (now[k], scale[k])
    return spark.createDataFrame([(*k, state[k][0], *(weights[k] or (0.0, math.inf))) for k in state], f"{kinds}, mu double, at double, sigma double")
