"""Communities of weighted graphs: small graphs by Louvain in numpy, a graph a group, large ones by joins on their edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavelark.operators import ordering


def louvain(weights: np.ndarray) -> np.ndarray:
    """A community number for each node: local moves in node order until none gains, then the same on the merged graph."""
    node = np.arange(len(weights))
    w = weights.astype(float)
    while True:
        total, degree, label = w.sum(), w.sum(1), np.arange(len(w))
        if total <= 0:
            return node
        moved, again = False, True
        while again:
            again = False
            for i in range(len(w)):
                own = label[i]
                label[i] = -1
                near = np.unique(np.append(label[(w[i] > 0) & (label >= 0)], own))
                gain = [w[i][label == c].sum() - degree[i] * degree[label == c].sum() / total for c in near]
                stay = gain[int(np.flatnonzero(near == own)[0])]
                best = int(np.argmax(gain))
                label[i] = near[best] if gain[best] > stay + 1e-12 else own
                again |= label[i] != own
            moved |= again
        _, label = np.unique(label, return_inverse=True)
        node = label[node]
        if not moved:
            return node
        one = np.eye(label.max() + 1)[label]
        w = one.T @ w @ one


#: Nodes of a graph that one task works out as a matrix.
WHOLE = 2000


def communities(edges: DataFrame, within: tuple[str, ...] = ("subject",), whole: int = WHOLE) -> DataFrame:
    """(within, channel, community) of the edges (within, ch_a, ch_b, r), both directions given or one. One count finds the largest graph: up to
    `whole` nodes each graph is one task; beyond it all graphs are worked out by joins."""
    kinds = dict(edges.dtypes)
    ends = edges.select(*within, F.col("ch_a").alias("u")).union(edges.select(*within, "ch_b")).distinct()
    if (ends.groupBy(*within).count().agg(F.max("count")).head()[0] or 0) > whole:
        return communities_by_joins(edges, within, whole=whole)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.array(sorted(set(pdf["ch_a"]) | set(pdf["ch_b"])))
        w = np.zeros((len(names), len(names)))
        a, b = np.searchsorted(names, pdf["ch_a"]), np.searchsorted(names, pdf["ch_b"])
        w[a, b] = pdf["r"]
        w = np.maximum(w, w.T)
        np.fill_diagonal(w, 0)
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in within}, "channel": names, "community": louvain(w)})

    schema = ", ".join(f"{c} {kinds[c]}" for c in within)
    return edges.groupBy(*within).applyInPandas(run, f"{schema}, channel string, community long")


def _finished(links: DataFrame, loops: DataFrame, on: list[str]) -> DataFrame:
    """(on, u, c) of graphs (on, u, v, w) that have become small, with loops (on, u, loop): Louvain in numpy, a graph a task."""
    kinds = dict(links.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.array(sorted(set(pdf["u"])))
        w = np.zeros((len(names), len(names)))
        w[np.searchsorted(names, pdf["u"]), np.searchsorted(names, pdf["v"])] = pdf["w"]
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in on}, "u": names, "c": names[_firsts(louvain(w))]})

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in on), f"u {kinds['u']}, c {kinds['u']}"])
    whole = links.unionByName(loops.select(*on, "u", F.col("u").alias("v"), F.col("loop").alias("w")))
    return whole.groupBy(*on).applyInPandas(run, schema)


def _firsts(label: np.ndarray) -> np.ndarray:
    """The first node of each node's community."""
    _, first, place = np.unique(label, return_index=True, return_inverse=True)
    return first[place]


def _moved(links: DataFrame, labels: DataFrame, weight: DataFrame, on: list[str], rounds: int) -> DataFrame:
    """labels (on, u, c, k, wants) after rounds of moves along links (on, u, v, w)."""
    for turn in range(rounds):
        total = labels.groupBy(*on, "c").agg(F.sum("k").alias("total"))
        into = links.join(labels.select(*on, F.col("u").alias("v"), "c"), [*on, "v"]).groupBy(*on, "u", "c").agg(F.sum("w").alias("into"))
        near = into.union(labels.select(*on, "u", "c", F.lit(0.0))).groupBy(*on, "u", "c").agg(F.sum("into").alias("into"))
        own = labels.select(*on, "u", F.col("c").alias("own"), "k")
        scored = near.join(own, [*on, "u"]).join(total, [*on, "c"]).join(weight, on)
        gain = F.col("into") - F.col("k") * (F.col("total") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / F.col("m2")
        best = scored.withColumn("gain", gain).groupBy(*on, "u").agg(F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"), F.max("gain").alias("most"), F.min_by("c", F.struct(-F.col("gain"), "c")).alias("to"))
        moves = labels.join(best, [*on, "u"], "left")
        wants = F.coalesce(F.col("most") > F.col("stay") + 1e-12, F.lit(False))
        now = F.pmod(F.xxhash64("u", F.lit(turn)), F.lit(2)) == 0
        labels = ordering.settled(moves.select(*on, "u", F.when(wants & now, F.col("to")).otherwise(F.col("c")).alias("c"), "k", wants.alias("wants")))
        if not labels.where("wants").limit(1).count():
            break
    return labels


def communities_by_joins(edges: DataFrame, within: tuple[str, ...] = ("subject",), rounds: int = 16, levels: int = 12, whole: int = WHOLE) -> DataFrame:
    """`communities` for graphs of any size. In a round, a join of edges and labels tells each node its weight towards every community
    near it; of the nodes that would gain by a move, a hashed half move, so that neighbours rarely swap places. Without moves left,
    communities become nodes and the next level begins, until no graph has more than `whole` nodes; the rest is `louvain`. All steps are joins and partial sums; hubs' edges are
    added up before they are shuffled."""
    on = list(within)
    both = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    once = edges.where("ch_a <> ch_b and r > 0").groupBy(*on, F.least("ch_a", "ch_b").alias("a"), F.greatest("ch_a", "ch_b").alias("b")).agg(F.max("r").alias("w"))
    given = links = ordering.settled(once.select(*on, both.alias("p"), "w").select(*on, "p.u", "p.v", "w"))
    every = edges.select(*on, F.col("ch_a").alias("u")).union(edges.select(*on, "ch_b")).distinct()
    member = every.select(*on, F.col("u").alias("channel"), F.col("u").alias("c"))
    loops = every.select(*on, "u", F.lit(0.0).alias("loop"))
    weight = links.groupBy(*on).agg(F.sum("w").alias("m2"))  # a row a graph; contraction keeps it
    for _ in range(levels):
        degree = links.groupBy(*on, "u").agg(F.sum("w").alias("k"))
        labels = ordering.settled(loops.join(degree, [*on, "u"], "left").select(*on, "u", F.col("u").alias("c"), (F.coalesce("k", F.lit(0.0)) + F.col("loop")).alias("k"), F.lit(False).alias("wants")))
        labels = _moved(links, labels, weight, on, rounds)
        merged = labels.select(*on, F.col("u").alias("_u"), F.col("c").alias("_c"))
        member = ordering.settled(member.join(merged, [*(member[c] == merged[c] for c in on), member["c"] == merged["_u"]]).select(*(member[c] for c in on), "channel", F.col("_c").alias("c")))
        sizes = labels.agg(F.count("*").alias("n"), F.count_distinct(*on, "c").alias("m")).head()
        if sizes.n == sizes.m:
            break
        to = lambda side: labels.select(*on, F.col("u").alias(side), F.col("c").alias(f"c{side}"))  # noqa: E731, B023
        joined = links.join(to("u"), [*on, "u"]).join(to("v"), [*on, "v"]).groupBy(*on, F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w"))
        kept = loops.join(to("u"), [*on, "u"]).groupBy(*on, F.col("cu").alias("u")).agg(F.sum("loop").alias("loop"))
        joined = ordering.settled(joined)
        inner = joined.where("u = v").select(*on, "u", F.col("w").alias("more"))
        loops = ordering.settled(kept.join(inner, [*on, "u"], "left").select(*on, "u", (F.col("loop") + F.coalesce("more", F.lit(0.0))).alias("loop")))
        links = joined.where("u <> v")
        if loops.groupBy(*on).count().agg(F.max("count")).head()[0] <= whole:
            merged = ordering.settled(_finished(links, loops, on)).select(*on, F.col("u").alias("_u"), F.col("c").alias("_c"))
            member = member.join(merged, [*(member[c] == merged[c] for c in on), member["c"] == merged["_u"]]).select(*(member[c] for c in on), "channel", F.col("_c").alias("c"))
            break
    # Single nodes may still gain by a move between the communities found.
    degree = given.groupBy(*on, "u").agg(F.sum("w").alias("k"))
    last = member.select(*on, F.col("channel").alias("u"), "c").join(degree, [*on, "u"], "left").select(*on, "u", "c", F.coalesce("k", F.lit(0.0)).alias("k"), F.lit(False).alias("wants"))
    member = _moved(given, ordering.settled(last), weight, on, rounds).select(*on, F.col("u").alias("channel"), "c")
    number = member.select(*on, "c").distinct().withColumn("community", F.dense_rank().over(Window.partitionBy(*on).orderBy("c")).cast("long") - 1)
    return member.join(number, [*on, "c"]).select(*on, "channel", "community")


def stable_ids(partition: DataFrame, within: tuple[str, ...] = ("subject",), min_size: int = 1) -> DataFrame:
    """(within, channel, community): groups numbered from 1 by their smallest member; groups below min_size get 0."""
    g = Window.partitionBy(*within, "community")
    named = partition.withColumns({"first": F.min("channel").over(g), "n": F.count("*").over(g)})
    number = F.dense_rank().over(Window.partitionBy(*within).orderBy("first"))
    return named.withColumn("id", number).select(*within, "channel", F.when(F.col("n") < min_size, 0).otherwise(F.col("id")).cast("int").alias("community"))


def modularity(edges: DataFrame, partition: DataFrame, within: tuple[str, ...] = ("subject",)) -> DataFrame:
    """(within, modularity) of an undirected graph whose edges are given in both directions."""
    p = lambda name, c: partition.select(*within, F.col("channel").alias(name), F.col("community").alias(c))
    e = edges.join(p("ch_a", "ca"), [*within, "ch_a"]).join(p("ch_b", "cb"), [*within, "ch_b"])
    inner = e.groupBy(*within).agg(F.sum("r").alias("m2"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("r")).otherwise(0.0)).alias("inside"))
    degree = e.groupBy(*within, "ca").agg(F.sum("r").alias("k")).groupBy(*within).agg(F.sum(F.col("k") * F.col("k")).alias("k2"))
    return inner.join(degree, list(within)).select(*within, (F.col("inside") / F.col("m2") - F.col("k2") / (F.col("m2") * F.col("m2"))).alias("modularity"))
