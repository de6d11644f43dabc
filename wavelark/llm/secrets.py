"""Secret scan: fixed patterns, and a character convolutional network over every other candidate in its context.

Base kinds (letters of `assign` in either case): see PATTERNS; a match that is too short is dropped, and the
search goes on behind it. Every further run of 12 or more of the characters that keys are made of is a candidate for the
network (of a run that base spans touch, what they leave, if that is long enough). It sees INSIDE characters of the run with CONTEXT
characters on both sides; over a longer run such views slide, and the best one counts. It is trained on all of the corpus's own labelled
findings, base matches against other runs; each is
shown with and without its context, and findings also in other runs' contexts, so that the shape of the value counts too. Values, not views, are dealt to training and
calibration. The views are dealt to tasks of TASK_VIEWS; several tasks train side by side on a share of theirs, and their weights are averaged
ROUNDS times, until each view was learned. The threshold is the highest that still finds RECALL of all the calibration's findings.

Nulls and edge cases: a null or empty text has no findings; ids may be null or repeated; whole texts are read,
however long; other columns are ignored; without positives to learn from the network adds nothing; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .store import Scratch, limit_batches

#: Fixed values: (kind, pattern, group whose length counts, least length).
PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),  # a run of 16 or more is the whole run, as [0-9a-f]+ would match it
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
SHORTEST = 12

#: Steps of a training by one task, of BATCH views each; views that a task is dealt; times that several tasks' weights are averaged.
STEPS, BATCH = 1200, 64
TASK_VIEWS, ROUNDS = STEPS * BATCH, 4
#: The rarer class is repeated up to this share of a task's views; weights balance the rest.
LEAST_SHARE = 0.25
#: Logits are counted in steps of 1 / _FINE up to _FAR on both sides; weights are averaged in steps of 1 / _WEIGHT.
_FINE, _FAR, _WEIGHT = 64, 64, 1 << 20
#: Further views of a finding, in other contexts.
AGAIN = 3
RECALL = 0.97
CONTEXT, INSIDE, HOP, WIDTH, DIMS, FILTERS = 20, 40, 20, 5, 8, 16
#: Characters of texts that are scanned at once.
_SLICE = 1 << 19
_GAP = "\0" * (CONTEXT + INSIDE)

SPAN = "struct<kind string, start int, end int, score float>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in PATTERNS, end) in code points, in that order."""
    out = []
    for k, (_, pattern, group, least) in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def other_candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What base spans (sorted) leave of each run, where that is long enough."""
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][2] <= a:
            k += 1
        at, j = a, k
        while j < len(taken) and taken[j][0] < b:
            if taken[j][0] - at >= SHORTEST:
                out.append((at, taken[j][0]))
            at, j = max(at, taken[j][2]), j + 1
        if b - at >= SHORTEST:
            out.append((at, b))
    return out


def _joined(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts with gaps that no pattern crosses between them, each text's place, and the character numbers: 0 is nothing, 1
    any character outside ASCII."""
    whole = _GAP + _GAP.join(texts) + _GAP
    size = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    return whole, len(_GAP) + np.concatenate([[0], np.cumsum(size + len(_GAP))]), np.where(raw < 128, raw, 1).astype(np.uint8)


def _views(codes: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(views, which span each belongs to): CONTEXT characters before a window of the span, INSIDE of it, and CONTEXT after it."""
    a, b = np.array(spans, np.int64).reshape(-1, 2).T
    more = np.maximum(0, -(-(b - a - INSIDE) // HOP))
    of = np.repeat(np.arange(len(a)), more + 1)
    step = np.arange(len(of)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
    start = np.minimum(a[of] + step * HOP, np.maximum(a, b - INSIDE)[of])
    end = np.minimum(start + INSIDE, b[of])
    out = np.empty((len(of), 2 * CONTEXT + INSIDE), np.uint8)
    out[:, :CONTEXT] = codes[start[:, None] + np.arange(-CONTEXT, 0)]
    out[:, CONTEXT:-CONTEXT] = np.where(np.arange(INSIDE) < (end - start)[:, None], codes[start[:, None] + np.arange(INSIDE)], 0)
    out[:, -CONTEXT:] = codes[end[:, None] + np.arange(CONTEXT)]
    return out, of


def _slices(texts: pa.Array):
    """(first row, texts) of slices of about _SLICE characters."""
    held, low, size = [], 0, 0
    for k, value in enumerate(texts):
        held.append(value.as_py() or "")
        size += len(held[-1]) + len(_GAP)
        if size >= _SLICE:
            yield low, held
            held, low, size = [], k + 1, 0
    if held:
        yield low, held


class CharCNN:
    """Embedding, one convolution, ReLU, maximum over places, and a dense unit; trained by Adam in numpy."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, 0.3, (128, DIMS)), "w": rng.normal(0, 0.2, (WIDTH * DIMS, FILTERS)), "b": np.zeros(FILTERS), "v": rng.normal(0, 0.2, FILTERS), "c": np.zeros(1)}
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _taps(self) -> list[np.ndarray]:
        """The embedding and each tap of the filters folded into one table of characters."""
        return [self.p["e"] @ self.p["w"][j * DIMS : (j + 1) * DIMS] for j in range(WIDTH)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        taps, places, out = self._taps(), x.shape[1] - WIDTH + 1, []
        for low in range(0, len(x), 512):
            part = x[low : low + 512]
            high = taps[0][part[:, :places]]
            for j in range(1, WIDTH):
                high += taps[j][part[:, j : places + j]]
            out.append(np.maximum(high.max(1) + self.p["b"], 0) @ self.p["v"] + self.p["c"][0])
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -60, 60)))

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.004, seed: int = 7) -> None:
        """Whole passes over x, as many as the steps need."""
        rng, m, s, step = np.random.default_rng(seed), {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        places = x.shape[1] - WIDTH + 1
        for _ in range(-(-steps * batch // len(x))):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                k = order[i : i + batch]
                part, taps = x[k], self._taps()
                high = taps[0][part[:, :places]]
                for j in range(1, WIDTH):
                    high += taps[j][part[:, j : places + j]]
                at = high.argmax(1)
                top = np.take_along_axis(high, at[:, None, :], 1)[:, 0] + self.p["b"]
                out = np.maximum(top, 0) @ self.p["v"] + self.p["c"][0]
                d = ((1 / (1 + np.exp(-np.clip(out, -60, 60))) - y[k]) * weight[k] / len(k)).astype(np.float32)
                dtop = d[:, None] * self.p["v"] * (top > 0)
                g = {"v": np.maximum(top, 0).T @ d, "c": d.sum(keepdims=True), "b": dtop.sum(0), "w": np.zeros_like(self.p["w"]), "e": np.zeros_like(self.p["e"])}
                rows, lanes = np.arange(len(k))[:, None], np.arange(FILTERS)
                for j in range(WIDTH):
                    one = slice(j * DIMS, (j + 1) * DIMS)
                    table = np.bincount((part[rows, at + j].astype(np.int64) * FILTERS + lanes).ravel(), dtop.ravel(), 128 * FILTERS).reshape(128, FILTERS).astype(np.float32)
                    g["w"][one] = self.p["e"].T @ table
                    g["e"] += table @ self.p["w"][one].T
                step += 1
                for n, grad in g.items():
                    m[n] = 0.9 * m[n] + 0.1 * grad
                    s[n] = 0.999 * s[n] + 0.001 * grad**2
                    self.p[n] = self.p[n] - rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(s[n] / (1 - 0.999**step)) + 1e-8)

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def set_flat(self, values: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = values[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size

    def calibrate(self, z: np.ndarray, y: np.ndarray, n: np.ndarray, least: float) -> None:
        """Platt scaling of standardised logits, n of each, by short Newton steps; the threshold is the score of the logit `least`."""
        w, total = np.array([1.0, 0.0]), n.sum()
        centre = (n * z).sum() / total
        spread = max(np.sqrt((n * (z - centre) ** 2).sum() / total), 1e-6)
        good = (n * y).sum()
        t = np.where(y > 0, (good + 1) / (good + 2), 1 / (total - good + 2))
        a = np.column_stack([(z - centre) / spread, np.ones(len(z))])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = (a * (n * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
            w = w - np.clip(np.linalg.solve(h, a.T @ (n * (p - t)) + 1e-2 * (w - [1.0, 0.0])), -1, 1)
        slope = max(float(w[0]), 1e-3)  # a score rises with its logit, whatever the findings
        self.scale, self.shift = slope / spread, float(w[1]) - slope * centre / spread
        self.threshold = float(1 / (1 + np.exp(-np.clip(self.scale * np.float32(least) + self.shift, -60, 60))))


def _findings(batches):
    """(label, value, view): the views of all findings, each once in a slice."""
    for batch in batches:
        for _, texts in _slices(batch.column(0)):
            whole, _, codes = _joined(texts)
            taken = base_spans(whole)
            values = [PATTERNS[0][1].match(whole, a).span(2) if k == 0 else (a, b) for a, k, b in taken]
            for label, spans in ((1, values), (0, other_candidates(whole, taken))):
                if not spans:
                    continue
                views, of = _views(codes, spans)
                hashes = np.array([zlib.crc32(whole[a:b].encode("utf-8", "surrogatepass")) for a, b in spans], np.int64)[of]
                kept = dict(zip(map(bytes, views), hashes.tolist(), strict=True))
                yield pa.record_batch([pa.array([label] * len(kept), pa.int32()), pa.array(list(kept.values()), pa.int64()), pa.array(list(kept), pa.binary())], names=["label", "value", "view"])
    tokens.give_back()


def _lessons(table: pa.Table, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(views, labels) of a task's findings (label, value, view), with and without their contexts. Secrets that no pattern finds stand
    among other words and have other lengths, so base matches' characters are also shown in other runs' contexts, AGAIN times, in random lengths."""
    rows = sorted(zip(*(table[c].to_pylist() for c in ("label", "value", "view")), strict=True))
    seen, y = np.frombuffer(b"".join(v for _, _, v in rows), np.uint8).reshape(len(rows), -1), np.array([label for label, _, _ in rows], np.float32)
    blind = seen.copy()
    blind[:, :CONTEXT], blind[:, -CONTEXT:] = 0, 0
    shape = np.unique(np.column_stack([blind, y.astype(np.uint8)]), axis=0)  # repeated views would only repeat a lesson
    blind, of = shape[:, :-1], shape[:, -1].astype(np.float32)
    value, place = blind[of > 0][:, CONTEXT:-CONTEXT], seen[y == 0]
    shown, rng = seen[:0], np.random.default_rng(seed)
    if len(value) and len(place):
        shown = place[rng.integers(0, len(place), AGAIN * len(value))].copy()
        for k, row in enumerate(shown):
            both = np.concatenate([value[k % len(value)], value[rng.integers(0, len(value))], value[rng.integers(0, len(value))]])
            both = both[both > 0][: rng.integers(SHORTEST, INSIDE + 1)]
            row[CONTEXT:-CONTEXT] = 0
            row[CONTEXT : CONTEXT + len(both)] = both
    return np.concatenate([seen, blind, shown]), np.concatenate([y, of, np.ones(len(shown), np.float32)])


def _trained(net: CharCNN, steps: int):
    """(k, p): the weights after a task's findings, times the task's views, in whole steps, so that their sum is the same in any order;
    the last is the number of views."""

    def run(table):
        x, y = _lessons(table, 3)
        n = len(x)
        rare = np.flatnonzero((y > 0) == ((y > 0).mean() < 0.5))
        if len(rare) and (lack := int(LEAST_SHARE * n) - len(rare)) > 0:
            x, y = np.concatenate([x, x[np.resize(rare, lack)]]), np.concatenate([y, y[np.resize(rare, lack)]])
        own = CharCNN()
        own.set_flat(net.flat())
        own.train(x, y, steps)
        p = np.append(np.rint(own.flat().astype(float) * _WEIGHT).astype(np.int64) * n, n)
        return pa.table({"k": np.arange(len(p)), "p": p})

    return run


def _judged(net: CharCNN):
    def run(table):
        x, y = _lessons(table, 5)
        z = np.clip(net.logits(x), -_FAR, _FAR).astype(np.float32)
        return pa.table({"y": pa.array(y.astype(np.int32)), "bin": pa.array(np.floor(z * _FINE).astype(np.int32)), "z": pa.array(z)})

    return run


def fit(docs: DataFrame, text_col: str = "text", recall: float = RECALL) -> CharCNN | None:
    """The network fitted on all documents' findings; None without findings of both classes."""
    scratch = Scratch(docs.sparkSession, "secrets")
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null")
    seen = scratch.table(texts.mapInArrow(_findings, "label int, value long, view binary").distinct(), "findings")
    count = {(r.label, r.held): r.n for r in seen.groupBy("label", (F.col("value") % 4 == 0).alias("held")).agg(F.count("*").alias("n")).collect()}  # 4 rows
    if min(count.get((1, False), 0), count.get((0, False), 0)) < 5 or not count.get((1, True)) or not count.get((0, True)):
        scratch.only()
        return None
    tasks = lambda held: max(1, round(2 * (count[0, held] + count[1, held]) / TASK_VIEWS))
    dealt = lambda held: F.pmod(F.xxhash64("view"), F.lit(tasks(held))).alias("task")
    rounds = 1 if tasks(False) == 1 else ROUNDS  # a full task's share is one pass of more steps than are asked for
    net, learned = CharCNN(), seen.where("value % 4 <> 0")
    for k in range(rounds):
        share = learned.where(F.pmod(F.xxhash64("view", F.lit(1)), F.lit(rounds)) == k)
        step = share.groupBy(dealt(False)).applyInArrow(_trained(net, STEPS if rounds == 1 else STEPS // (2 * rounds)), "k long, p long")
        sums = np.array([r.p for r in step.groupBy("k").agg(F.sum("p").alias("p")).orderBy("k").collect()], float)  # as many as weights
        if len(sums):
            net.set_flat(sums[:-1] / sums[-1] / _WEIGHT)
    scores = scratch.table(seen.where("value % 4 = 0").groupBy(dealt(True)).applyInArrow(_judged(net), "y int, bin int, z float"), "scores")
    bins = scores.groupBy("y", "bin").agg(F.count("*").alias("n"), F.avg("z").alias("z")).orderBy("y", "bin").toPandas()  # 4 * _FAR * _FINE rows at most
    # The logit that leaves 1 - recall of the findings below it: first its bin, then its place in the bin.
    good = bins[bins.y == 1]
    rank, ends = int(np.floor((1 - recall) * good.n.sum())), np.cumsum(good.n.to_numpy())
    at = int(np.searchsorted(ends, rank, "right"))
    inside = scores.where((F.col("y") == 1) & (F.col("bin") == int(good.bin.iloc[at]))).groupBy("z").agg(F.count("*").alias("n")).orderBy("z").toPandas()
    least = inside.z.iloc[int(np.searchsorted(np.cumsum(inside.n.to_numpy()), rank - (ends[at] - good.n.iloc[at]), "right"))]
    scratch.only()
    net.calibrate(bins.z.to_numpy(), bins.y.to_numpy(), bins.n.to_numpy(), float(least))
    net.learned = count[0, False] + count[1, False], count[0, True] + count[1, True]
    return net


def spans_of(taken: list[tuple[int, int, int]], scored: list[tuple[int, int, float]]) -> list[dict]:
    found = [(a, k, b, 1.0) for a, k, b in taken] + [(a, len(PATTERNS), b, s) for a, b, s in scored]
    kinds = [p[0] for p in PATTERNS] + ["model"]
    return [{"kind": kinds[k], "start": a, "end": b, "score": s} for a, k, b, s in sorted(found)]


def _scan(texts: pa.Array, net: CharCNN | None) -> list[list[dict]]:
    out = []
    for _, held in _slices(texts):
        whole, starts, codes = _joined(held)
        base = base_spans(whole)
        runs = other_candidates(whole, base) if net else []
        scored = []
        for low in range(0, len(runs), 8192):
            part = runs[low : low + 8192]
            views, of = _views(codes, part)
            best = np.maximum.reduceat(net.score(views), np.searchsorted(of, np.arange(len(part))))
            scored += [(*part[k], float(best[k])) for k in np.flatnonzero(best >= net.threshold).tolist()]
        found = spans_of(base, scored)
        at = np.searchsorted(starts, [f["start"] for f in found], "right") - 1
        mine: list[list[dict]] = [[] for _ in held]
        for k, f in zip(at.tolist(), found, strict=True):
            mine[k].append(f | {"start": f["start"] - int(starts[k]), "end": f["end"] - int(starts[k])})
        out += mine
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", net: CharCNN | None = None) -> DataFrame:
    """(doc_id, findings array<struct<kind, start, end, score>>) of every row, by start and then kind."""
    model = docs.sparkSession.sparkContext.broadcast(net or fit(docs, text_col))

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(_scan(batch.column(1), model.value), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float32())])))], names=["doc_id", "findings"])
        tokens.give_back()

    limit_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, findings array<{SPAN}>")


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every finding in the text replaced by the mark; all rows and columns stay."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col))
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            out = []
            for value, found in zip(batch.column(place), _scan(batch.column(place), model.value), strict=True):
                text, parts, at = value.as_py(), [], 0
                for f in found:
                    if f["end"] > at:
                        parts += [text[at : f["start"]], mark] if f["start"] >= at else []
                        at = f["end"]
                out.append("".join([*parts, text[at:]]) if found else text)
            yield batch.set_column(place, batch.schema.field(place).name, pa.array(out, pa.string()))
        tokens.give_back()

    limit_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
