"""What the two passage finders share: one text of each, verification with both texts at hand, and merged spans."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .store import Scratch

def one_of_each_text(scratch: Scratch, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """texts (id, text) without further copies of a text, and (id, first) of the copies left out."""
    key = scratch.table(texts.select("id", F.xxhash64("text").alias("h"), F.crc32("text").alias("c"), F.octet_length("text").alias("n")), "texts")
    same = ["h", "c", "n"]
    first = key.groupBy(same).agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select(*same, "first")
    copies = scratch.table(key.join(scratch.small(first, "groups"), same).where("id <> first").select("id", "first", "n"), "copies")
    return texts.join(scratch.small(copies.select("id").distinct(), "copied"), "id", "left_anti"), copies


def _merged(rows: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans (id, a, b), those of an id that overlap or touch as one."""
    out: list[tuple[int, int, int]] = []
    for i, a, b in sorted(rows):
        if out and out[-1][0] == i and a <= out[-1][2]:
            out[-1] = (i, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((i, a, b))
    return out


def verified(scratch: Scratch, texts: DataFrame, pairs: DataFrame, unit: Callable, check: Callable) -> DataFrame:
    """(id, a, b): word spans of either side of the pairs (x, y, anchors array<struct<i int, j int>>). unit(word hashes) is made once
    for each text of a batch; check(unit of x, unit of y, anchors) gives passages (x0, x1, y0, y1). Anchors are places that may
    correspond, and may have further fields. A batch's spans are merged, so that a text of many pairs has few rows."""
    ids = scratch.small(pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct(), "paired")
    held = texts.join(ids, "id", "left_semi")
    side = lambda name: held.select(F.col("id").alias(name), F.col("text").alias(f"{name}_text"))

    def run(batches):
        for batch in batches:
            both = pa.concat_arrays([pc.fill_null(batch.column(k), "").cast(pa.large_string()) for k in (3, 4)]).dictionary_encode()
            of = both.indices.to_numpy()
            units = []
            for _, _, data, offsets in tokens.slices(both.dictionary):
                h, first, _, _ = tokens.words(data, offsets)
                units += [unit(h[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            out, n = [], batch.num_rows
            for k, (x, y, anchors) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)):
                flat = anchors.values
                at = np.column_stack([flat.field(f).to_numpy() for f in range(flat.type.num_fields)])
                for x0, x1, y0, y1 in check(units[of[k]], units[of[n + k]], at):
                    out += [(x, x0, x1), (y, y0, y1)]
            yield pa.record_batch([pa.array(c, pa.int32() if k else pa.int64()) for k, c in enumerate(zip(*_merged(out), strict=True) if out else [[]] * 3)], names=["id", "a", "b"])
        tokens.give_back()

    return pairs.join(side("y"), "y").join(side("x"), "x").select("x", "y", "anchors", "x_text", "y_text").mapInArrow(run, "id long, a int, b int")


def joined(scratch: Scratch, both: DataFrame, texts: DataFrame, copies: DataFrame, least: int) -> DataFrame:
    """(doc_id, start_word, end_word): each document's spans (id, a, b), those that overlap or touch as one. Every document that
    has a copy, of `least` words or more, is a passage as a whole."""
    # Copies: count the words where the text is; only ids and places are shuffled.
    twin = scratch.small(copies.select("id").union(copies.select("first")).distinct(), "twins")

    def count(batches):
        for batch in batches:
            n = np.concatenate([np.zeros(0, np.int64), *(np.diff(tokens.words(data, offsets)[1]) for _, _, data, offsets in tokens.slices(batch.column(1)))])
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(np.zeros(len(n), np.int32)), pa.array(n.astype(np.int32))], names=["id", "a", "b"])

    whole = texts.join(twin, "id", "left_semi").mapInArrow(count, "id long, a int, b int").where(F.col("b") >= least)
    spans = both.union(whole).distinct()
    before = Window.partitionBy("id").orderBy("a", "b")
    far = F.max("b").over(before.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("fresh", F.coalesce((F.col("a") > far).cast("int"), F.lit(1))).withColumn("run", F.sum("fresh").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(F.col("id").alias("doc_id"), "run").agg(F.min("a").alias("start_word"), F.max("b").alias("end_word")).drop("run")
