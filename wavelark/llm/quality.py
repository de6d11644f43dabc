"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated.

Each text is summed up by a fixed list of statistics. Random cosines of the standardised statistics approximate a
Gaussian kernel; every partition sums its share of the normal equations, Spark adds the shares up, and the
solution is the ridge score. Isotonic regression on rows that the ridge did not see turns scores into
probabilities.

Nulls and edge cases: a null text counts as empty and gets the score of its statistics (all zero); null labels
take no part; several labels of an id count as their mean; ids may be null or repeated; other columns are ignored; an empty table gives an
empty result; without labels every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .store import Scratch, limit_batches

#: Random features, and ridge.
FEATURES, RIDGE = 256, 1e-2
_BINS = 4096

_CLASSES = {
    "upper": range(65, 91),
    "digit": range(48, 58),
    "comma_stop": b".,",
    "bang": b"!?",
    "symbol": b"#$%&*@^~+=<>{}[]\\_/",
    "bar": b"|",
    "line": b"\n",
    "space": [0x20, *range(9, 14)],
    "high": range(128, 256),
}
_KIND = {name: np.isin(np.arange(256), list(of)).astype(np.int32) for name, of in _CLASSES.items()}
_NAMES = ("log_bytes", "log_words", *_CLASSES, "word_mean", "word_sd", "word_max", "distinct", "top", "again", "pairs", "log_lines", "line_words", "same_lines", "glued")
SIZE = len(_NAMES)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of SIZE numbers for each text of a slice."""
    h, first, starts, ends = tokens.words(data, offsets)
    size, count = np.diff(offsets), np.diff(first)
    out = np.zeros((len(size), SIZE))
    some, letters = np.maximum(size, 1), np.concatenate([[0], np.cumsum(ends - starts)])
    squares = np.concatenate([[0], np.cumsum((ends - starts) ** 2)])
    many = np.maximum(count, 1)
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(count)
    for k, table in enumerate(_KIND.values()):
        total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        out[:, 2 + k] = np.sqrt((total[offsets[1:]] - total[offsets[:-1]]) / some)
    k = 2 + len(_KIND)
    mean = (letters[first[1:]] - letters[first[:-1]]) / many
    out[:, k], out[:, k + 1] = mean, np.sqrt(np.maximum((squares[first[1:]] - squares[first[:-1]]) / many - mean**2, 0))
    glued = np.concatenate([[0], np.cumsum(_KIND["symbol"][data[ends - 1]] | _KIND["bang"][data[ends - 1]])]) if len(ends) else np.zeros(1)
    pair = tokens.mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h
    breaks = np.flatnonzero(data == 10)
    edge = np.searchsorted(breaks, offsets)
    for d in np.flatnonzero(count).tolist():
        a, b = first[d], first[d + 1]
        s = np.sort(h[a:b])
        cuts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
        p = np.sort(pair[a : b - 1])
        cut = np.unique(np.searchsorted(starts[a:b], breaks[edge[d] : edge[d + 1]]))
        n, cut = b - a, np.concatenate([[0], cut[(cut > 0) & (cut < b - a)]])
        place = np.arange(n) - np.repeat(cut, np.diff(np.append(cut, n)))
        lines = len(np.unique(np.add.reduceat(h[a:b] * (2 * place + 1).astype(np.uint64), cut)))
        out[d, k + 2 : k + 9] = np.log1p((ends[a:b] - starts[a:b]).max()), (len(cuts) - 1) / n, np.diff(cuts).max() / n, (h[a + 1 : b] == h[a : b - 1]).sum() / n, (1 + (p[1:] != p[:-1]).sum()) / n if n > 1 else 1.0, np.log1p(len(cut)), np.log1p(n / len(cut))
        out[d, k + 9], out[d, k + 10] = 1 - lines / len(cut), (glued[b] - glued[a]) / n
    return out


def _columns(texts: pa.Array) -> np.ndarray:
    parts = [statistics(data, offsets) for _, _, data, offsets in tokens.slices(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, SIZE))


class Model:
    """score(statistics) -> probability of label 1."""

    def __init__(self, centre, spread, features: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.centre, self.spread = np.asarray(centre, float), np.maximum(np.asarray(spread, float), 1e-6)
        self.w, self.b = rng.normal(0, 1 / np.sqrt(SIZE), (SIZE, features)), rng.uniform(0, 2 * np.pi, features)
        self.beta, self.x, self.y = np.zeros(features + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def lift(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.centre) / self.spread, -6, 6)
        return np.column_stack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones(len(z))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.lift(stats) @ self.beta, 0, 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.x, self.y)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: for ascending x, non-decreasing means; (x, fitted y) of the blocks' ends."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x.tolist(), y.tolist(), weight.tolist(), strict=True):
        blocks.append([b, w, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, n, _, high = blocks.pop()
            p = blocks[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + m * n) / (p[1] + n), p[1] + n, high
    at = [v for m, _, low, high in blocks for v in ((low, m), (high, m))]
    return np.array([a for a, _ in at]), np.array([m for _, m in at])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", features: int = FEATURES, ridge: float = RIDGE) -> Model:
    """The model of all labelled rows in docs. Of every four, three solve the ridge and one calibrates."""
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scratch = Scratch(spark, "quality")

    def measure(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in _columns(batch.column(1))], pa.binary())], names=["id", "y", "stats"])
        tokens.give_back()

    # Only labelled texts are measured.
    held = texts.join(scratch.small(known, "labels"), "id").select("id", "text", "y")
    rows = scratch.table(held.mapInArrow(measure, f"id {dict(texts.dtypes)['id']}, y double, stats binary").withColumn("part", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(4))), "rows")

    def moments(batches):
        total = np.zeros((3, SIZE))
        for batch in batches:
            z = np.array([np.frombuffer(s.as_buffer()) for s in batch.column("stats")])
            if len(z):
                total += np.stack([np.full(SIZE, len(z)), z.sum(0), (z**2).sum(0)])
        yield pa.record_batch([pa.array(np.arange(SIZE)), *(pa.array(t) for t in total)], names=["k", "n", "s", "q"])

    m = rows.mapInArrow(moments, "k long, n double, s double, q double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("k").collect()  # SIZE rows
    n = max(m[0].n if m else 0, 1)
    centre = np.array([r.s / n for r in m]) if m else np.zeros(SIZE)
    model = Model(centre, np.sqrt(np.maximum([r.q / n for r in m] - centre**2, 0)) if m else np.ones(SIZE), features)
    if not m or not m[0].n:
        return model
    upper = np.triu_indices(features + 1)
    shared = spark.sparkContext.broadcast(model)

    def normal(batches):
        a, b = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
        for batch in batches:
            stats = np.array([np.frombuffer(s.as_buffer()) for s in batch.column("stats")]).reshape(-1, SIZE)
            lifted, y = shared.value.lift(stats), batch.column("y").to_numpy()
            weight = np.where(y > 0.5, 1.0, 3.0)
            a += (lifted * weight[:, None]).T @ lifted
            b += (lifted * weight[:, None]).T @ y
        yield pa.record_batch([pa.array(np.arange(len(upper[0]) + features + 1)), pa.array(np.concatenate([a[upper], b]))], names=["k", "v"])

    # A fixed number of sums, whatever the number of rows.
    sums = np.zeros(len(upper[0]) + features + 1)
    parts = rows.where("part < 3").coalesce(64).mapInArrow(normal, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    sums[parts.k] = parts.v
    a, b = np.zeros((features + 1, features + 1)), sums[len(upper[0]) :]
    a[upper] = sums[: len(upper[0])]
    a = a + np.triu(a, 1).T
    model.beta = np.linalg.solve(a + ridge * np.eye(features + 1), b)
    shared = spark.sparkContext.broadcast(model)

    def raw(batches):
        for batch in batches:
            stats = np.array([np.frombuffer(s.as_buffer()) for s in batch.column("stats")]).reshape(-1, SIZE)
            yield pa.record_batch([pa.array(np.rint(shared.value.raw(stats) * _BINS).astype(np.int32)), batch.column("y")], names=["bin", "y"])

    curve = rows.where("part = 3").mapInArrow(raw, "bin int, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").toPandas()  # _BINS + 1 rows at most
    scratch.only()
    if len(curve):
        model.x, model.y = isotonic(curve.bin.to_numpy() / _BINS, curve.y.to_numpy(), curve.n.to_numpy())
    return model


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score as a further column; a narrow pass."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.append_column(score_col, pa.array(shared.value.score(_columns(batch.column(place))), pa.float64()))
        tokens.give_back()

    limit_batches(docs.sparkSession)
    if score_col in docs.columns:
        raise ValueError(f"docs has a column {score_col} already; name another one")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))
