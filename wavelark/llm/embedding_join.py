"""Near duplicates among vectors of a label, by an epsilon grid order join.

A cosine of c or more is a distance of at most eps = sqrt(2 - 2c) between unit vectors. Vectors are sorted by their label and by the
cells of a grid of width eps over their leading principal dimensions. The sequence is cut into blocks, and blocks into ever larger
intervals, each with its box in those dimensions and its ball in all. From the whole sequence down, pairs of
intervals are joined with their parts level by level: a pair whose boxes or balls are provably farther apart than eps is skipped, one whose
balls provably lie within eps of each other is counted as a whole, and the rest is split; pairs of blocks that remain are compared
exactly, in double precision on the given vectors. Whatever the axes, nothing is lost: they only decide how much is skipped.

Equal vectors of a label are one member of the sequence with a number of copies. A pair of blocks gives one row for each member that has
links in it (how many vectors it links with, and one member that it is connected with), never its pairs of vectors.

Nulls and edge cases: a vector that is null, empty, zero, or has a null or non-finite part links with nothing, nor does one with a null label
or id; it keeps its row (component_id is its id, null if that is null). Only vectors of equal length are compared. Each row is a vector,
also where ids repeat. Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .neighbours import usable
from .store import Scratch, components, small

#: Members of a block; parts of an interval; leading dimensions that are used.
BLOCK, FAN, LEADING = 512, 8, 8
#: Vectors from which the principal dimensions are taken (those of least hash); they only steer what is skipped.
SAMPLE = 4096
#: Vectors are broadcast up to so many bytes; pairs of blocks that a task compares.
BROADCAST_BYTES, PAIRS = 32 << 20, 16
#: Rounding allowed for in bounds.
_SLACK = 1e-7


def _rows(column: pa.Array, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the rows of each length of a binary column."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        yield at, np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), kind).reshape(len(at), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class _Axes:
    """Leading principal dimensions for vectors of one length; vectors of other lengths use their first dimensions."""

    def __init__(self, sample: np.ndarray):
        self.size = sample.shape[1]
        x = sample - sample.mean(0) if len(sample) else sample
        self.axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :LEADING].copy() if self.size else np.zeros((0, 0))

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.axes if x.shape[1] == self.size else x[:, :LEADING]


def _ball(centre: np.ndarray, points: np.ndarray, radii: np.ndarray | float = 0.0) -> float:
    return float((np.sqrt(((points - centre) ** 2).sum(1)) + radii).max())


_NODE = "g string, i long, lo long, n long, weight long, low array<double>, high array<double>, centre array<double>, radius double"
_NAMES = [c.split()[0] for c in _NODE.split(", ")]


def _nodes(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.float64())] * 3, pa.float64()]
    return [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]


def _pack(axes: _Axes, kind: str):
    """A block's bounds, copies and vectors from its members, array<struct<pos, copies, raw>> in order."""

    def run(batches):
        for batch in batches:
            out, copies, raws = [], [], []
            for g, i, members in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw = b"".join(m["raw"] for m in members)
                x = unit(np.frombuffer(raw, kind).reshape(len(members), -1))
                y, centre, own = axes.project(x), x.mean(0), np.array([m["copies"] for m in members], np.int64)
                out.append((g, i, members[0]["pos"], len(members), int(own.sum()), y.min(0), y.max(0), centre, _ball(centre, x)))
                copies.append(own.tobytes())
                raws.append(raw)
            yield pa.record_batch([*_nodes(out), pa.array(copies, pa.binary()), pa.array(raws, pa.binary())], names=[*_NAMES, "copies", "raw"])
        tokens.give_back()

    return run


def _merge(batches):
    """An interval's bounds from those of its parts, array<struct<lo, n, weight, low, high, centre, radius>> in order."""
    for batch in batches:
        out = []
        for g, i, parts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            n = np.array([p["n"] for p in parts])
            low, high, centres = (np.array([p[c] for p in parts]) for c in ("low", "high", "centre"))
            centre = (centres * n[:, None]).sum(0) / n.sum()
            out.append((g, i, parts[0]["lo"], int(n.sum()), sum(p["weight"] for p in parts), low.min(0), high.max(0), centre, _ball(centre, centres, np.array([p["radius"] for p in parts]))))
        yield pa.record_batch(_nodes(out), names=_NAMES)


def _judge(eps: float):
    """(g, a, b, near) of pairs of intervals that aren't provably apart; near: all their members lie within eps."""

    def run(batches):
        for batch in batches:
            keep, near = [], []
            sides = [[batch.column(k).to_pylist() for k in range(at, at + 4)] for at in (3, 7)]
            for k, (la, ha, ca, ra, lb, hb, cb, rb) in enumerate(zip(*sides[0], *sides[1], strict=True)):
                gap = np.maximum(0, np.maximum(np.subtract(lb, ha), np.subtract(la, hb)))
                apart = float(np.sqrt(np.square(np.subtract(ca, cb)).sum()))
                if np.sqrt((gap * gap).sum()) <= eps + _SLACK and apart - ra - rb <= eps + _SLACK:
                    keep.append(k)
                    near.append(apart + ra + rb <= eps - _SLACK)
            kept = pa.array(keep, pa.int64())
            yield pa.record_batch([*(batch.column(k).take(kept) for k in range(3)), pa.array(near, pa.bool_())], names=["g", "a", "b", "near"])

    return run


def _roots(linked: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The least node that each row and column of a matrix of links is connected with; columns count on after the rows, or are the rows."""
    n, m = linked.shape
    rows, cols = np.arange(n), np.arange(m) + (0 if same else n)
    none = n + m
    while True:
        new = np.minimum(cols, np.where(linked, rows[:, None], none).min(0))
        rows_new = np.minimum(rows, np.where(linked, new, none).min(1))
        if same:
            new = rows_new = np.minimum(new, rows_new)
        if (new == cols).all() and (rows_new == rows).all():
            return rows, cols
        rows, cols = rows_new, new


def _compare(cosine: float, kind: str):
    """(pos, other, links) of the members of two blocks that have links between them."""

    def run(batches):
        for batch in batches:
            out = []
            for lo_a, copies_a, raw_a, lo_b, copies_b, raw_b in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                own_a, own_b = np.frombuffer(copies_a, np.int64), np.frombuffer(copies_b, np.int64)
                same = lo_a == lo_b
                x = unit(np.frombuffer(raw_a, kind).reshape(len(own_a), -1))
                y = x if same else unit(np.frombuffer(raw_b, kind).reshape(len(own_b), -1))
                linked = x @ y.T >= cosine
                if same:
                    np.fill_diagonal(linked, False)
                r, c = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
                if not len(r):
                    continue
                linked = linked[np.ix_(r, c)]
                rows, cols = _roots(linked, same)
                place = np.concatenate([lo_a + r, lo_b + c])
                weight = linked.astype(np.float64)
                out.append((lo_a + r, place[rows], (weight @ own_b[c]).astype(np.int64)))
                if not same:
                    out.append((lo_b + c, place[cols], (own_a[r] @ weight).astype(np.int64)))
            pos, other, n = (np.concatenate(p) for p in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 3
            yield pa.record_batch([pa.array(pos, pa.int64()), pa.array(other, pa.int64()), pa.array(n, pa.int64())], names=["pos", "other", "links"])
        tokens.give_back()

    return run


def _sequence(scratch: Scratch, members: DataFrame, axes: _Axes, eps: float, kind: str) -> DataFrame:
    """members (g, same, raw, first, copies) in grid order: (pos, g, same, raw, first, copies), pos being gapless from 0."""

    def cells(batches):
        for batch in batches:
            found: list = [None] * batch.num_rows
            for at, x in _rows(batch.column(2), kind):
                for k, c in zip(at.tolist(), np.floor(axes.project(unit(x)) / eps).astype(np.int32).tolist(), strict=True):
                    found[k] = c
            yield pa.record_batch([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    placed = members.select("g", "same", "raw", "first", "copies").mapInArrow(cells, "g string, same string, raw binary, first long, copies long, cells array<int>")
    order = ["g", "cells", "same"]
    ordered = scratch.table(placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("cells"), "ordered")
    part = F.shiftright("at", 33)
    counts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row a task
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = scratch.small(counts.select("part", (before - F.shiftleft("part", 33)).alias("shift")), "offsets")
    return ordered.join(offsets, part == F.col("part")).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _intervals(scratch: Scratch, blocks: DataFrame, count: int) -> list[DataFrame]:
    """The blocks' bounds, and those of the intervals over them up to one that holds all."""
    levels = [blocks.select(_NAMES)]
    while count > 1:
        count = -(-count // FAN)
        parts = F.array_sort(F.collect_list(F.struct("lo", "n", "weight", "low", "high", "centre", "radius"))).alias("parts")
        above = levels[-1].groupBy("g", (F.col("i") / FAN).cast("long").alias("i")).agg(parts)
        levels.append(scratch.table(above.mapInArrow(_merge, _NODE), f"level{len(levels)}"))
    return levels


def _descend(scratch: Scratch, levels: list[DataFrame], eps: float) -> tuple[DataFrame, list[DataFrame]]:
    """(pairs (g, a, b) of blocks to compare, and of each level the pairs (g, level, a, b) of intervals within eps of each other)."""
    bounds = ["low", "high", "centre", "radius"]
    pairs, dense = levels[-1].select("g", F.col("i").alias("a"), F.col("i").alias("b")), []
    for level in range(len(levels) - 1, -1, -1):
        side = lambda name: small(levels[level]).select("g", ((F.col("i") / FAN).cast("long") if level < len(levels) - 1 else F.col("i")).alias(name), F.col("i").alias(f"{name}_"), *(F.col(c).alias(f"{name}_{c}") for c in bounds))  # noqa: E731, B023
        split = pairs.join(side("a"), ["g", "a"]).join(side("b"), ["g", "b"]).where("a <> b or a_ <= b_")
        judged = split.select("g", F.col("a_").alias("a"), F.col("b_").alias("b"), *(f"a_{c}" for c in bounds), *(f"b_{c}" for c in bounds)).mapInArrow(_judge(eps), "g string, a long, b long, near boolean")
        judged = scratch.table(judged, f"pairs{level}")
        dense.append(judged.where("near").select("g", F.lit(level).alias("level"), "a", "b"))
        pairs = judged.where("not near").select("g", "a", "b")
    return pairs, dense


def _whole(levels: list[DataFrame], dense: list[DataFrame], blocks: DataFrame) -> DataFrame:
    """(pos, other, links) that follow from pairs of intervals of which all members are linked. links counts a member's own copies too
    where an interval is paired with itself; `own` says so."""
    found = None
    for level, pairs in zip(range(len(levels) - 1, -1, -1), dense, strict=True):
        node = lambda name: levels[level].select("g", F.col("i").alias(name), F.col("weight").alias(f"{name}_weight"), F.col("lo").alias(f"{name}_lo"))  # noqa: E731, B023
        both = pairs.join(node("a"), ["g", "a"]).join(node("b"), ["g", "b"])
        one = both.select("g", F.col("a").alias("i"), F.col("b_weight").alias("links"), F.col("b_lo").alias("to"), (F.col("a") == F.col("b")).cast("long").alias("own"))
        two = both.where("a <> b").select("g", F.col("b").alias("i"), F.col("a_weight").alias("links"), F.col("a_lo").alias("to"), F.lit(0).cast("long").alias("own"))
        # The members of an interval are connected by any one partner, so one of its partners' members is enough here; a partner
        # leads to this interval's first member in its own row.
        sums = one.union(two).groupBy("g", "i").agg(F.sum("links").alias("links"), F.min("to").alias("to"), F.sum("own").alias("own"))
        under = blocks.select("g", (F.col("i") / FAN**level).cast("long").alias("i"), "lo", "n").join(sums, ["g", "i"])
        rows = under.select(F.explode(F.sequence("lo", F.col("lo") + F.col("n") - 1)).alias("pos"), F.col("to").alias("other"), "links", "own")
        # Further partners: their first members are linked with all members of this interval.
        more = both.select(F.col("a_lo").alias("pos"), F.col("b_lo").alias("other"), F.lit(0).cast("long").alias("links"), F.lit(0).cast("long").alias("own"))
        found = rows.union(more) if found is None else found.union(rows).union(more)
    return found


def near_vectors(rows: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: other vectors of its label with this cosine or more, the smallest id that is
    reached by links, and whether that is its own."""
    scratch, eps = Scratch(rows.sparkSession, "embedding-join"), float(np.sqrt(2 - 2 * cosine))
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec"), F.col(label_col).cast("string").alias("label"))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec"))
    kind = "<f4" if dict(given.dtypes)["vec"] == "array<float>" else "<f8"

    def pack(batches):
        for batch in batches:
            column = batch.column(2)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind) + np.array(0, kind)  # -0.0 becomes 0.0
            ends = np.cumsum(column.value_lengths().to_numpy()).tolist()
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([flat[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())], names=["id", "g", "raw"])

    group = F.concat_ws("/", F.size("vec").cast("string"), "label")
    packed = given.where(good).select("id", group.alias("g"), "vec").mapInArrow(pack, "id long, g string, raw binary").withColumn("same", F.md5("raw"))
    packed = scratch.table(packed, "packed")
    members = scratch.table(packed.groupBy("g", "same").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("raw").alias("raw")), "members")
    size = members.groupBy(F.octet_length("raw").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).head()
    sample = members.where(F.octet_length("raw") == size.n).orderBy(F.xxhash64("g", "same")).limit(SAMPLE).select("raw").toArrow()["raw"].combine_chunks() if size else pa.array([], pa.binary())
    axes = _Axes(unit(np.frombuffer(b"".join(sample.to_pylist()), kind).reshape(len(sample), -1)) if len(sample) else np.zeros((0, 0)))

    sequence = _sequence(scratch, members, axes, eps, kind)
    block = (F.col("pos") / BLOCK).cast("long").alias("i")
    lists = sequence.groupBy("g", block).agg(F.array_sort(F.collect_list(F.struct("pos", "copies", "raw"))).alias("members"))
    blocks = scratch.table(lists.mapInArrow(_pack(axes, kind), f"{_NODE}, copies binary, raw binary"), "blocks")
    levels = _intervals(scratch, blocks, (blocks.agg(F.max("i")).head()[0] or 0) + 1)
    pairs, dense = _descend(scratch, levels, eps)

    held = small(blocks.select("g", "i", "lo", "copies", "raw"), BROADCAST_BYTES)
    side = lambda name: held.select("g", F.col("i").alias(name), F.col("lo").alias(f"{name}_lo"), F.col("copies").alias(f"{name}_copies"), F.col("raw").alias(f"{name}_raw"))
    dealt = pairs.repartition(max(1, -(-pairs.count() // PAIRS)), "g", "a", "b")
    both = dealt.join(side("a"), ["g", "a"]).join(side("b"), ["g", "b"]).select("a_lo", "a_copies", "a_raw", "b_lo", "b_copies", "b_raw")
    compared = both.mapInArrow(_compare(cosine, kind), "pos long, other long, links long").withColumn("own", F.lit(0).cast("long"))
    found = scratch.table(compared.union(_whole(levels, dense, blocks)), "found")

    roots = components(scratch, found.select(F.col("pos").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("pos").agg(F.sum("links").alias("links"), F.sum("own").alias("own"))
    named = scratch.table(sequence.select("pos", "g", "same", "first", "copies").join(links, "pos", "left").join(roots.withColumnRenamed("node", "pos"), "pos", "left").withColumn("root", F.coalesce("root", "pos")), "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    result = scratch.table(named.join(least, "root").select("g", "same", (zero("links") - zero("own") * F.col("copies") + F.col("copies") - 1).alias("n_links"), "component_id"), "result")
    scratch.only("packed", "result")
    linked = packed.select("id", "g", "same").join(result, ["g", "same"]).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    alone = given.where(~good).select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
