"""Approximate nearest neighbours: a graph built by NN-descent, and greedy search on it.

Equal vectors are one vertex. The graph starts thin and random: each vertex knows the few others that share one of its
hash groups. In each round of NN-descent every vertex introduces its neighbours, in both directions, to each other, by Spark
joins; a pair is measured if one of its two edges is new, and replaces what was farther. Rounds go on until
fewer than SETTLED of all edges are new. A hub's list is dealt into blocks, so no vertex gathers an unbounded list.
A search starts at the query's own vertex; each step opens all unopened vertices among the nearest EF found so far and measures
their neighbours, until none is left to open. The EF nearest are measured again on the original vectors in double precision.

Graph and search are steered by 32-bit copies, centred on the dimensions' medians and divided by the median extent, so neither the
scale of the data, nor a shift, nor single outliers matter. Within a list, distances are taken from the list's own mean.

Nulls and edge cases: a vector that is null, zero, or has a null or non-finite part takes no part; an id that is
null neither; of vectors of different lengths those of the commonest length take part (of equally common ones the longest); of rows with equal ids
the vector whose bytes come first counts, once; rows of equal vectors are all candidates; other columns are ignored; an empty table
gives an empty result; with fewer candidates than asked for, all that are reached are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .store import Scratch, size_of, small

#: Edges of a vertex; hash groups that give the first of them; share of new edges at which descent ends, and rounds at most.
DEGREE, GROUPS, SETTLED, ROUNDS = 24, 4, 0.01, 40
#: Members of a block of a list; pairs a list tells each member at most (nearer ones first; others come up in later rounds).
BLOCK, TOLD = 48, 6
#: Vertices that a search keeps.
EF = 256
#: Descent broadcasts vectors up to so many bytes; a search broadcasts queries and opened ids up to SIDE_BYTES, and larger vectors than
#: BUCKET_BYTES are written in buckets by vertex for it, so that its joins don't shuffle them again.
BROADCAST_BYTES, SIDE_BYTES, BUCKET_BYTES = 32 << 20, 8_000_000, 64 << 20
_EDGES = "v long, w long, d float, fresh boolean"


def _matrix(column: pa.Array, kind=np.float32) -> np.ndarray:
    """The rows of a binary column without nulls, all of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, 1), kind)
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(n, -1)


def _packed(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    ends = np.arange(len(x) + 1, dtype=np.int32) * (x.strides[0] if len(x) else 0)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(x.tobytes())])


def _squares(x: np.ndarray) -> np.ndarray:
    """Squared distances of a list's members, taken from its mean."""
    x = x - x.mean(0)
    own = (x * x).sum(1)
    return np.maximum(own[:, None] + own - 2 * (x @ x.T), 0)


def usable(vector: Column) -> Column:
    """Not null, not zero, and all parts finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def vertices(scratch: Scratch, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(v, exact, near) of each distinct vector, v being its smallest id: the vector, and its copy for steering; and (id, v) of each
    id. rows: (id, vec)."""
    lengths = rows.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).head()
    size = lengths.n if lengths else 0

    def pack(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            yield pa.record_batch([batch.column(0), _packed(flat + 0.0)], names=["id", "exact"])  # -0.0 becomes 0.0

    one = rows.where(F.size("vec") == size).mapInArrow(pack, "id long, exact binary") if size else rows.select("id", F.lit(b"").alias("exact")).limit(0)
    packed = scratch.table(one.groupBy("id").agg(F.min("exact").alias("exact")), "packed")
    first = scratch.table(packed.groupBy("exact").agg(F.min("id").alias("v")), "first")
    part = lambda k: F.element_at("vec", k + 1).cast("double")
    centre = np.array(rows.where(F.size("vec") == size).agg(*(F.percentile_approx(part(k), 0.5, 1000) for k in range(size))).head(), float) if size else np.zeros(0)

    def extent(batches):
        for batch in batches:
            yield pa.record_batch([pa.array(np.abs(_matrix(batch.column(0), np.float64) - centre).max(1))], names=["x"])

    scale = (first.select("exact").mapInArrow(extent, "x double").agg(F.percentile_approx("x", 0.5, 1000)).head()[0] if size else 1.0) or 1.0

    def steer(batches):
        for batch in batches:
            x = _matrix(batch.column(1), np.float64)
            near = np.clip(x / scale - centre / scale, -1e15, 1e15) if len(x) else x
            yield pa.record_batch([batch.column(0), batch.column(1), _packed(near.astype(np.float32))], names=["v", "exact", "near"])

    full = first.select("v", "exact").mapInArrow(steer, "v long, exact binary, near binary")
    return scratch.table(full, "vectors"), packed.join(first, "exact").select("id", "v")


def _introduce(batches):
    """Edges between members of a list (all array<struct<m, fresh, far, near>>) that are nearer than the ends' farthest edge."""
    for batch in batches:
        every = batch.column(0)
        flat, ends = every.flatten(), np.concatenate([[0], np.cumsum(every.value_lengths().to_numpy())])
        m, fresh, far = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        x, out = _matrix(flat.field(3)), []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            order = a + np.lexsort((~fresh[a:b], m[a:b]))  # of a member told twice, the row that is new
            order = order[np.concatenate([[True], m[order][1:] != m[order][:-1]])]
            new, id_ = fresh[order], m[order]
            if len(order) < 2 or not new.any():
                continue
            d = _squares(x[order])
            d[~(new[:, None] | new) | (d >= far[order][:, None])] = np.inf
            np.fill_diagonal(d, np.inf)
            if len(order) > TOLD + 1:
                k = np.argpartition(d, TOLD, 1)[:, :TOLD]
                d = np.take_along_axis(d, k, 1)
                i, j = np.nonzero(d < np.inf)
                out.append((id_[i], id_[k[i, j]], d[i, j]))
            else:
                i, j = np.nonzero(d < np.inf)
                out.append((id_[i], id_[j], d[i, j]))
        v, w, d = (np.concatenate(c) for c in zip(*out, strict=True)) if out else ([], [], [])
        yield pa.record_batch([pa.array(v, pa.int64()), pa.array(w, pa.int64()), pa.array(d, pa.float32()), pa.array(np.ones(len(v), bool))], names=["v", "w", "d", "fresh"])
    tokens.give_back()


def _nearest(edges: DataFrame, degree: int) -> DataFrame:
    """(v, far, all array<struct<d, w, fresh>>) of the edges (v, w, d, fresh): the nearest ones. One shuffle, by vertex."""
    once = edges.repartition("v").groupBy("v", "w").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    best = F.slice(F.array_sort(F.collect_list(F.struct("d", "w", "fresh"))), 1, degree)
    whole = once.groupBy("v").agg(best.alias("all"))
    return whole.select("v", F.when(F.size("all") < degree, float("inf")).otherwise(F.element_at("all.d", -1)).cast("float").alias("far"), "all")


def build_graph(scratch: Scratch, vectors: DataFrame, rounds: int = ROUNDS, degree: int = DEGREE, settled: float = SETTLED) -> DataFrame:
    """(v, far, all array<struct<d, w, fresh>>): each vertex's nearest others found, d being the squared distance of the copies."""
    near = vectors.select(F.col("v").alias("m"), "near")
    side = F.broadcast if size_of(near) <= BROADCAST_BYTES else lambda df: df
    near = side(near)
    few = max(1, round(vectors.count() / (degree // GROUPS + 1)))
    seeds = vectors.select(F.col("v").alias("m"), "near", F.explode(F.sequence(F.lit(1), F.lit(GROUPS))).alias("s")).withColumn("g", F.pmod(F.xxhash64("s", "m"), F.lit(few)))
    member = F.struct("m", F.lit(True).alias("fresh"), F.lit(float("inf")).cast("float").alias("far"), "near")
    begun = seeds.groupBy("s", "g").agg(F.collect_list(member).alias("all")).select("all").mapInArrow(_introduce, _EDGES)
    graph = scratch.table(_nearest(begun, degree), "graph0")
    for step in range(1, rounds + 1):
        edges = graph.select("v", F.inline("all"))
        lists = edges.select(F.col("v").alias("u"), F.col("w").alias("m"), "fresh").union(edges.select(F.col("w").alias("u"), F.col("v").alias("m"), "fresh"))
        # One shuffle of ids by u counts and deals the lists: a hub's is dealt into blocks of about BLOCK members by their hash.
        blocks = F.greatest(F.lit(1), F.round(F.count("*").over(Window.partitionBy("u")) / BLOCK)).cast("int")
        dealt = lists.withColumn("block", F.pmod(F.xxhash64("u", "m"), blocks))
        known = dealt.join(near, "m").join(side(graph.select(F.col("v").alias("m"), "far")), "m")
        told = known.groupBy("u", "block").agg(F.collect_list(F.struct("m", "fresh", "far", "near")).alias("all")).where(F.exists("all", lambda x: x["fresh"])).select("all")
        held = edges.select("v", "w", "d", F.lit(False).alias("fresh"))
        graph = scratch.table(_nearest(told.mapInArrow(_introduce, _EDGES).union(held), degree), f"graph{step}")
        scratch.drop(f"graph{step - 1}")
        new = graph.agg(F.sum(F.size(F.filter("all", lambda e: e["fresh"]))).alias("new"), F.sum(F.size("all")).alias("n")).head()
        if (new.new or 0) <= settled * (new.n or 0):
            break
    return graph


def _advance(ef: int):
    """A search's next state from the unseen vertices that its opened ones lead to, with their distances. State: (of, w, d, opened, seen)."""

    def run(key, found, state):
        row = state.slice(0, 1).to_pydict()
        w, d, seen = np.array(row["w"][0], np.int64), np.array(row["d"][0], np.float32), np.array(row["seen"][0], np.int64)
        opened = np.ones(len(w), bool)
        if found.num_rows:
            more = found["w"].to_numpy()
            w, d, opened, seen = np.concatenate([w, more]), np.concatenate([d, found["d"].to_numpy()]), np.concatenate([opened, np.zeros(len(more), bool)]), np.concatenate([seen, more])
            order = np.lexsort((w, d))[:ef]
            w, d, opened = w[order], d[order], opened[order]
        return pa.table({"q": state["of"].slice(0, 1), "w": pa.array([w.tolist()], pa.list_(pa.int64())), "d": pa.array([d.tolist()], pa.list_(pa.float32())), "opened": pa.array([opened.tolist()], pa.list_(pa.bool_())), "seen": pa.array([seen.tolist()], pa.list_(pa.int64()))})

    return run


def _measure(kind, root: bool):
    """(q, w, d) of (q, w, the vector of w, the vector of q)."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(2), kind) - _matrix(batch.column(3), kind)
            d = (x * x).sum(1)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.sqrt(d) if root else d)], names=["q", "w", "d"])
        tokens.give_back()

    return run


def search(scratch: Scratch, graph: DataFrame, vectors: DataFrame, starts: DataFrame, ef: int = EF) -> DataFrame:
    """(q, w): the ef vertices nearest to each vertex q of starts (q) that greedy search finds, itself included. Only the queries'
    vectors and the opened ids are broadcast, if they are few; the vertices' vectors and lists stay with the executors, and no vector
    is shuffled to its query: distances are."""
    few = min(BROADCAST_BYTES, SIDE_BYTES)
    near = vectors.select(F.col("v").alias("w"), "near")
    if size_of(near) > BUCKET_BYTES:
        near = scratch.bucketed(near, "near", "w", BUCKET_BYTES)
    next_ = scratch.table(graph.select(F.col("v").alias("at"), F.col("all.w").alias("next")), "next")
    asked = small(scratch.table(starts.join(vectors.select(F.col("v").alias("q"), F.col("near").alias("own")), "q"), "sought"), few)
    empty = "q long, w array<long>, d array<float>, opened array<boolean>, seen array<long>"
    state = starts.select("q", F.array("q").alias("w"), F.array(F.lit(0.0).cast("float")).alias("d"), F.array(F.lit(False)).alias("opened"), F.array("q").alias("seen"))
    state, step = scratch.table(state, "state0"), 0
    while n := state.agg(F.sum(F.size(F.filter("opened", lambda x: ~x)))).head()[0]:
        step += 1
        opening = state.select("q", F.explode(F.filter("w", lambda x, i: ~F.get("opened", i))).alias("at"))
        led = next_.join(F.broadcast(opening) if 16 * n <= few else opening, "at").select("q", F.explode("next").alias("w"))
        unseen = led.groupBy("q").agg(F.collect_set("w").alias("w")).join(state.select("q", "seen"), "q").select("q", F.explode(F.array_except("w", "seen")).alias("w"))
        found = unseen.join(near, "w").join(asked, "q").select("q", "w", "near", "own").mapInArrow(_measure(np.float32, False), "q long, w long, d float")
        state = scratch.table(found.groupBy("q").cogroup(state.withColumnRenamed("q", "of").groupBy("of")).applyInArrow(_advance(ef), empty), f"state{step}")
        scratch.drop(f"state{step - 1}")
    return state.select("q", F.explode("w").alias("w"))


def nearest_neighbours(rows: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", ef: int = EF, rounds: int = ROUNDS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `queries` (a condition on the column id) marks, its k nearest others found,
    by Euclidean distance in double precision; ties go to the smaller id."""
    scratch = Scratch(rows.sparkSession, "neighbours")
    good = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    vectors, member = vertices(scratch, good)
    member = scratch.table(member, "member")
    asked = scratch.table(member.where(queries).select("id", F.col("v").alias("q")), "asked")
    graph = build_graph(scratch, vectors, rounds)
    beam = search(scratch, graph, vectors, asked.select("q").distinct(), max(ef, k + 1))

    exact = vectors.select(F.col("v").alias("w"), "exact")
    own = small(scratch.table(asked.select("q").distinct().join(vectors.select(F.col("v").alias("q"), F.col("exact").alias("own")), "q"), "own"), min(BROADCAST_BYTES, SIDE_BYTES))
    pairs = beam.join(exact, "w").join(own, "q").select("q", "w", "exact", "own")
    measured = scratch.table(pairs.mapInArrow(_measure(np.float64, True), "q long, w long, d double"), "measured")
    scratch.only("member", "asked", "measured")
    # Of each vertex's rows the k + 1 smallest ids are enough for any query, its own row included.
    some = member.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1).select(F.col("v").alias("w"), F.col("id").alias("vec_id"))
    found = asked.join(measured, "q").join(some, "w").where("vec_id <> id")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("d", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("query_id"), "rank", "vec_id", F.col("d").alias("score"))
