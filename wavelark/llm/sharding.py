"""Balanced label propagation: shards of equal row counts that keep linked documents together.

Law `rows`: the shards' row counts differ by at most one. Documents are linked if their texts are equal. The
linked documents start in shards evenly, in an order that keeps a group's members next to each other, so that at most one group
is cut at each border of two shards; in each round a group's members ask for the shard that holds
most of them, and quotas decide how many may go. Rounds with room quotas let documents into shards that have
room; rounds with exchange quotas let equal numbers change places between two shards. Rounds go on until neither kind moves
anything: each move adds to the sum over groups and shards of the squared number of members, so they come to an end.
Documents without links fill the shards up to their exact counts in the end.

All steps are joins and aggregates on DataFrame functions. Quotas are cut on a histogram of the wishes whose
size is fixed (shards x levels x buckets), so no step ranks a whole shard in one task.

Nulls and edge cases: a null text has size 16, CRC 0 and no links; equal empty texts are linked; ids may be
null or repeated (each row is placed by itself, and rows that are equal whole may change places); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch, small

#: Rows are ranked within buckets of about so many rows, 256 at least, whose offsets come from their counts.
BUCKET_ROWS = 200_000


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")


def _ranked(scratch: Scratch, rows: DataFrame, by: list[str], name: str, total: int) -> DataFrame:
    """rows with `rank`, gapless from 0 within each value of `by`; no sort of more than a bucket's rows. total: rows of the whole table."""
    rows = rows.withColumn("bucket", _bucket(max(256, -(-total // BUCKET_ROWS))))
    counts = rows.groupBy(*by, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*by, F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.table(counts.select(*by, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), name)
    within = F.row_number().over(Window.partitionBy(*by, "bucket").orderBy("uid")) - 1
    return rows.withColumn("within", within).join(small(offsets), [*by, "bucket"]).withColumn("rank", (F.col("within") + F.col("offset")).cast("long")).drop("within", "offset", "bucket")


def _grouped(scratch: Scratch, linked: DataFrame, total: int) -> DataFrame:
    """linked (uid, g) with `rank`, gapless from 0, a group's members next to each other. Groups are dealt into pieces by their
    members' keys, so a hot group is no task's own, and what is summed in order is a bucket's pieces."""
    n = max(256, -(-total // BUCKET_ROWS))
    rows = linked.withColumns({"bucket": F.pmod(F.xxhash64("g"), F.lit(n)).cast("int"), "piece": _bucket(n)})
    upto = Window.partitionBy("bucket").orderBy("g", "piece").rowsBetween(Window.unboundedPreceding, -1)
    cells = scratch.table(rows.groupBy("bucket", "g", "piece").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))), "group_cells")
    buckets = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.table(cells.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", F.coalesce(F.sum("n").over(buckets), F.lit(0)).alias("offset")), "group_offsets")
    start = cells.join(small(offsets), "bucket").select("g", "piece", (F.col("before") + F.col("offset")).alias("start"))
    within = F.row_number().over(Window.partitionBy("g", "piece").orderBy("uid")) - 1
    return rows.withColumn("within", within).join(start, ["g", "piece"]).select("uid", "g", (F.col("within") + F.col("start")).cast("long").alias("rank"))


def _granted(scratch: Scratch, wishes: DataFrame, quota: DataFrame, on: str, total: int) -> DataFrame:
    """The wishes (uid, g, c, from, to) that fit the quota (on, q) of a shard: larger groups first, then by bucket. Of the
    cell of the histogram that crosses the quota, so many rows as there is room for."""
    cell = {"level": -F.floor(F.log2("c")).cast("int"), "part": F.pmod(F.xxhash64("g"), F.lit(32)).cast("int"), "piece": _bucket(16)}
    asked = scratch.table(wishes.withColumns(cell), "asked")
    keys = [on, *cell]
    upto = Window.partitionBy(on).orderBy(*cell).rowsBetween(Window.unboundedPreceding, 0)
    cells = asked.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("sum", F.sum("n").over(upto)).join(F.broadcast(quota), on).where("sum - n < q")
    cells = asked.join(scratch.small(cells.select(*keys, (F.col("q") - F.col("sum") + F.col("n")).alias("room"), "n"), "cells"), keys)
    part = _ranked(scratch, cells.where("room < n"), [on], "crossing", total).where("rank < room")
    return cells.where("room >= n").select("uid", "to").union(part.select("uid", "to"))


def balanced_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, group) of every row; group is null without links."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).alias("crc"), F.when(text.isNotNull(), F.xxhash64(text)).alias("key")
    )
    # A row's key comes from its content, so the result doesn't depend on how the table is dealt; equal rows are numbered.
    every = rows.groupBy("doc_id", "size", "crc", "key").agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1), "n")))
    whole = ["doc_id", "size", "crc", "key", "copy"]
    base = scratch.table(every.select(F.struct(F.xxhash64(*whole).alias("h"), F.xxhash64(F.lit(1), *whole).alias("k")).alias("uid"), "doc_id", "size", "crc", "key"), "base")
    total = base.count()
    target = {j: total // shards + (j < total % shards) for j in range(shards)}
    same = ["key", "crc", "size"]
    groups = base.where("key is not null").groupBy(same).agg(F.count("*").alias("c")).where("c > 1").select(*same, F.xxhash64(*same).alias("g"))
    linked = scratch.table(base.join(scratch.small(groups, "groups"), same).select("uid", "g"), "linked")
    # The first shards get one more where it doesn't come out even, as in target, so none starts above its target.
    least, more = divmod(linked.count(), shards)
    start = F.expr(f"cast(if(rank < {more * (least + 1)}L, rank div {least + 1}L, {more}L + (rank - {more * (least + 1)}L) div {max(1, least)}L) as int)")
    state = scratch.table(_grouped(scratch, linked, total).select("uid", "g", start.alias("shard")), "state0")
    scratch.drop("linked", "group_cells", "group_offsets")

    idle, step, held = 0, 0, "state0"
    while idle < 2:
        step += 1
        counts = state.groupBy("g", "shard").agg(F.count("*").alias("c"))
        load = {r.shard: r.n for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row a shard
        room = {j: target[j] - load.get(j, 0) for j in range(shards)}
        exchange = step % 2 == 0 or max(room.values()) <= 0
        score = F.struct(F.col("c"), F.xxhash64("g", "shard").alias("h"), F.col("shard").alias("to"))
        goals = counts if exchange else counts.where(F.col("shard").isin([j for j in room if room[j] > 0]))
        best = goals.groupBy("g").agg(F.max(score).alias("best"))
        wish = counts.join(best, "g").where(F.col("best") > score).select("g", "shard", F.col("best.c").alias("c"), F.col("best.to").alias("to"))
        wishes = scratch.table(state.join(wish, ["g", "shard"]).select("uid", "g", "c", F.col("shard").alias("from"), "to"), "wishes")
        if exchange:
            asked = wishes.groupBy("from", "to").agg(F.count("*").alias("n"))
            back = asked.select(F.col("to").alias("from"), F.col("from").alias("to"), F.col("n").alias("m"))
            # A pair's two directions must grant the same number, so whole wishes are ranked within the pair.
            q = scratch.table(asked.join(back, ["from", "to"]).select("from", "to", F.least("n", "m").alias("q")), "quota")
            ranked = _ranked(scratch, wishes, ["from", "to"], "swaps", total).join(F.broadcast(q), ["from", "to"]).where("rank < q")
            moves = ranked.select("uid", "to")
        else:
            quota = spark.sql(" union all ".join(f"select {j} as to, {room[j]}L as q" for j in range(shards)))
            moves = _granted(scratch, wishes, quota, "to", total)
        moves = scratch.table(moves, f"moves{step}")
        moved = moves.count()
        idle = 0 if moved else idle + 1
        if moved:
            state = scratch.table(state.join(moves, "uid", "left").select("uid", "g", F.coalesce("to", "shard").alias("shard")), f"state{step}")
            scratch.drop(held)
            held = f"state{step}"
        scratch.drop(f"moves{step}")

    load = {r.shard: r.n for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    ends, end = [], 0
    for j in range(shards):
        end += target[j] - load.get(j, 0)
        ends.append(end)
    single = base.select("uid").join(state, "uid", "left_anti")
    place = sum(((F.col("rank") >= F.lit(e)).cast("int") for e in ends), F.lit(0))
    single = _ranked(scratch, single, [], "single_offsets", total).select("uid", F.lit(None).cast("long").alias("g"), place.alias("shard"))
    placed = scratch.table(state.select("uid", "g", "shard").union(single), "placed")
    slots = _ranked(scratch, placed, ["shard"], "slot_offsets", total).withColumnRenamed("rank", "slot")
    scratch.only("base", "placed", "slot_offsets")
    return base.join(slots, "uid").select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("g").alias("group"))
