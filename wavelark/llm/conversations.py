"""Conversation structure repair: the cheapest edits that make a conversation's roles read `(system? (user assistant)+)?`.

Edits of a row: Keep (0), Rerole to user or assistant (2), Delete (3; required for blank and duplicate rows); a kept or reroled row
that is truncated adds 1; an empty user or assistant row may be Inserted anywhere (2).

The search goes by layers of cost. A layer has a bitset for each of the grammar's four states: bit i is set if a repair of the rows
from i on, begun in that state, costs at most the layer's number. A layer follows from earlier ones by shifts and masks, and
the first one that holds bit 0 of the entry state gives the cost; walking the bits forward, always by the edit whose initial
comes first, gives the least audit among the cheapest.

Rows are put in order by a range sort, so a long conversation lies in many tasks. Blocks of at most BLOCK rows of a conversation are
searched on their own. Where a conversation has several, each block's costs from every state to every state are
combined from the last block to the first, and the states at the blocks' borders from the first to the last: only some tens of
bytes a block are brought together.

Order: by turn (null first), equal turns by role and then by a hash of the text. A fault is the first that holds: blank (nothing but
space and \\t-\\r), duplicate (role and text occur earlier in the conversation), truncated (the last character that is none of
those is not one of `.!?`).

Nulls and edge cases: a null role or text is one space; a null conv_id is a conversation like any other; equal rows are
repeats (the later ones duplicates); texts may be empty or very long; roles may be any string, of which the first character counts;
further columns are ignored, whatever their names; a conversation without rows costs nothing; an empty table gives empty results.
"""

from __future__ import annotations

import functools
import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .store import Scratch

#: Rows of a conversation that are searched together; a power of two.
BLOCK = 1024

_WHITE = " \t\n\x0b\x0c\r"
#: The grammar: state -> {role initial: next state}; accepting states; what may be inserted; roles by initial.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_ACCEPT = (0, _NEVER := 1 << 40, _NEVER, 0)
_MADE = ("u", "u", "a", "u")
_ROLES = {"u": "user", "a": "assistant"}
_STATES = range(4)


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults dealt by crc32 of `conv_id:turn` modulo 20, nulls being one space: 0 drops a row, 1
    empties its text, 2 takes out its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1)))
    kept = rows.where(fault != 0).select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(name("role")).alias("role"), text.alias("text"), copies.alias("_copy"))
    return kept.drop("_copy")


@functools.lru_cache(maxsize=2)
def _layers(initials: str, faults: str, ahead: tuple[int, ...], entries: tuple[int, ...]) -> list[list[int]]:
    """The layers up to the first that holds bit 0 of every entry state. faults: `.` none, `t` truncated, `d` to be deleted; ahead: what
    the rest costs from each state behind the last row."""
    n = len(initials)
    whole = (1 << n) - 1
    where = lambda f, x=None: sum(1 << i for i in range(n) if faults[i] == f and (x is None or initials[i] == x))
    keep, keep_cut = ({x: where(f, x) for x in "sua"} for f in ".t")
    change, change_cut = where("."), where("t")
    layers: list[list[int]] = []
    back = lambda k, q: layers[-k][q] if len(layers) >= k else 0
    while not layers or not all(layers[-1][q] & 1 for q in entries):
        c, now = len(layers), []
        for q in _STATES:
            made = _NEXT[q][_MADE[q]]
            bits = back(1, q) | back(2, made) | (back(3, q) >> 1 & whole) | (back(2, made) >> 1 & change) | (back(3, made) >> 1 & change_cut)
            for x, to in _NEXT[q].items():
                bits |= back(1, to) >> 1 & keep_cut[x]
            now.append(bits | (ahead[q] <= c) << n)
        fresh = list(now)
        while any(fresh):  # rows that are kept cost nothing: follow the new bits back along them
            more = [0] * 4
            for q in _STATES:
                for x, to in _NEXT[q].items():
                    more[q] |= fresh[to] >> 1 & keep[x]
                more[q] &= ~now[q]
                now[q] |= more[q]
            fresh = more
        layers.append(now)
    return layers


@functools.lru_cache(maxsize=8_000)
def trace(initials: str, faults: str, ahead: tuple[int, ...], entry: int) -> tuple[int, str, int]:
    """(cost of these rows, their least audit among the cheapest repairs of all, state behind them) from a state."""
    entries = tuple(_STATES) if ahead != _ACCEPT else (entry,)
    layers = _layers(initials, faults, ahead, entries)
    c = begin = next(k for k, x in enumerate(layers) if x[entry] & 1)
    holds = lambda cost, q, i: cost >= 0 and layers[cost][q] >> i & 1
    i, q, audit = 0, entry, []
    while i < len(initials) or c < ahead[q]:
        made = _NEXT[q][_MADE[q]]
        cut = i < len(initials) and faults[i] == "t"
        if i < len(initials) and holds(c - 3, q, i + 1):
            c, i, edit = c - 3, i + 1, "D"
        elif holds(c - 2, made, i):
            c, q, edit = c - 2, made, "I"
        elif faults[i] != "d" and initials[i] in _NEXT[q] and holds(c - cut, _NEXT[q][initials[i]], i + 1):
            c, q, i, edit = c - cut, _NEXT[q][initials[i]], i + 1, "K"
        else:
            c, q, i, edit = c - 2 - cut, made, i + 1, "R"
        audit.append(edit)
    return begin - c, "".join(audit), q


def costs(initials: str, faults: str) -> list[int]:
    """Least costs of these rows from state p (first index) to state q, as one list of 16."""
    out = [_NEVER] * 16
    kept = any(x == "s" and f != "d" for x, f in zip(initials, faults, strict=True))
    for q, entries in enumerate([(0,), (0, 1) if kept else (1,), tuple(_STATES), tuple(_STATES)]):
        layers = _layers(initials, faults, tuple(0 if q == k else _NEVER for k in _STATES), entries)
        for p in entries:
            out[4 * p + q] = next(k for k, x in enumerate(layers) if x[p] & 1)
    return out


def _costs(batches):
    for batch in batches:
        rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array([costs(*r) for r in rows], pa.list_(pa.int64()))], names=["conv_id", "block", "costs"])


def _suffixes(pdf: pd.DataFrame) -> pd.DataFrame:
    """What the rest of a conversation costs behind each of its blocks, from each state."""
    pdf = pdf.sort_values("block", ascending=False)
    ahead, out = list(_ACCEPT), []
    for m in pdf["costs"]:
        out.append(ahead)
        ahead = [min(m[4 * p + q] + ahead[q] for q in _STATES) for p in _STATES]
    return pd.DataFrame({"block": pdf["block"], "ahead": out})


def _traces(batches):
    """A row for each block and entry state (for a conversation of one block, the first only)."""
    for batch in batches:
        out = []
        for conv, block, initials, faults, ahead in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            for entry in _STATES if ahead else (0,):
                out.append((conv, block, entry, *trace(initials, faults, tuple(ahead or _ACCEPT), entry)))
        kinds = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names=["conv_id", "block", "entry", "cost", "audit", "leaves"])


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state in which each block of a conversation is entered."""
    leaves = {(b, p): q for b, p, q in zip(pdf["block"], pdf["entry"], pdf["leaves"], strict=True)}
    blocks, state, out = sorted(set(pdf["block"])), 0, []
    for b in blocks:
        out.append(state)
        state = leaves[b, state]
    return pd.DataFrame({"block": blocks, "entry": pd.Series(out, dtype="int32")})


def _edited(batches):
    """(conv_id, block, edit, turn, role, text) of every edit in order, and (conv_id, block, None, ...) where a block begins. A block's
    audit and entry state come before its rows."""
    conv, block, audit, at, q = None, None, "", 0, 0

    def inserted():
        nonlocal at, q
        while at < len(audit) and audit[at] == "I":
            role, q = _ROLES[_MADE[q]], _NEXT[q][_MADE[q]]
            at += 1
            yield conv, block, "I", None, role, ""

    for batch in batches:
        for c, b, lead, turn, role, text in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            yield from inserted()
            if lead is not None:
                conv, block, audit, at, q = c, b, text, 0, lead
                yield conv, block, None, None, None, None
                continue
            edit = audit[at]
            at += 1
            if edit == "R":
                role = _ROLES[_MADE[q]]
            if edit in "KR":
                q = _NEXT[q][role[:1]]
            yield conv, block, edit, turn, role, text
    yield from inserted()


class Repair:
    """The repair of a table's conversations: `summary`, and two ways to read the repaired rows."""

    def __init__(self, rows: DataFrame):
        """rows: conv_id, turn, role, text; further columns are ignored."""
        self.scratch = scratch = Scratch(rows.sparkSession, "conversations")
        name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
        rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), name("role").alias("role"), name("text").alias("text"))
        self.kind = dict(rows.dtypes)["conv_id"]
        trimmed = F.rtrim(F.col("text"), F.lit(_WHITE))
        initial = F.left("role", F.lit(1))
        marked = rows.select("*", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"), F.md5(F.concat_ws(":", F.coalesce(F.octet_length(F.col("conv_id").cast("string")), F.lit(-1)), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.octet_length("role"), "role", "text").cast("binary")).alias("same"))
        # The place orders the whole table: the range's number in the upper bits, the row within it in the lower 33. Equal rows may be dealt apart.
        order = ["conv_id", "turn", "role", "hash"]
        dealt = marked.withColumns({"hash": F.xxhash64("text"), "salt": F.monotonically_increasing_id()}).repartitionByRange(*order, "salt").sortWithinPartitions(*order).drop("hash", "salt")
        self.ordered = scratch.table(dealt.withColumn("place", F.monotonically_increasing_id()), "ordered")
        firsts = self.ordered.where("not blank").groupBy("same").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last").select("same", "first")
        fault = F.when(F.col("blank"), "b").when(F.col("first") < F.col("place"), "r").when(F.col("cut"), "t").otherwise(".")
        light = self.ordered.select("conv_id", "turn", "initial", "place", "blank", "cut", "same").join(scratch.small(firsts, "firsts"), "same", "left")
        self.faulty = scratch.table(light.select("conv_id", "turn", "place", "initial", fault.alias("fault")), "faulty")
        row = F.array_sort(F.collect_list(F.struct("place", "initial", F.when(F.col("fault").isin("b", "r"), "d").otherwise(F.col("fault")).alias("fault"))))
        word = lambda c: F.array_join(F.col(f"rows.{c}"), "").alias(c)
        blocks = self.faulty.groupBy("conv_id", _block(F.col("place")).alias("block")).agg(row.alias("rows")).select("conv_id", "block", word("initial"), word("fault"))
        self.blocks = self._search(scratch.table(blocks, "blocks"))

    def _search(self, blocks: DataFrame) -> DataFrame:
        """(conv_id, block, initial, entry, cost, audit) of each block, as the cheapest repair of its conversation has it."""
        scratch, kind = self.scratch, self.kind
        many = blocks.groupBy("conv_id").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo <> hi").select(F.col("conv_id").alias("c"))
        split = blocks.join(scratch.small(many, "many"), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
        # A block of the place has rows of several conversations, so both name a block.
        here = ["conv_id", "block"]
        both = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["block"] == b["block"])
        summed = split.select(*here, "initial", "fault").mapInArrow(_costs, f"conv_id {kind}, block long, costs array<long>")
        ahead = summed.groupBy("conv_id").applyInPandas(_keyed(_suffixes), f"conv_id {kind}, block long, ahead array<long>")
        ahead = scratch.small(ahead, "ahead")
        known = blocks.join(ahead, both(blocks, ahead), "left").select(*(blocks[c] for c in (*here, "initial", "fault")), "ahead")
        traced = scratch.table(known.mapInArrow(_traces, f"conv_id {kind}, block long, entry int, cost long, audit string, leaves int"), "traced")
        lone = traced.join(scratch.small(many, "many"), F.col("conv_id").eqNullSafe(F.col("c")), "left_anti")
        chain = traced.join(scratch.small(many, "many"), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
        entry = scratch.small(chain.select(*here, "entry", "leaves").groupBy("conv_id").applyInPandas(_keyed(_entries), f"conv_id {kind}, block long, entry int"), "entries")
        chosen = chain.join(entry, both(chain, entry) & (chain["entry"] == entry["entry"]), "left_semi").union(lone).drop("leaves")
        text = chosen.join(blocks, both(chosen, blocks)).select(*(chosen[c] for c in chosen.columns), "initial")
        return scratch.table(text, "chosen")

    @property
    def summary(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation that has rows. gaps: turns missing
        between the least and the greatest; illegal: neighbours whose role initials are not su, ua or au."""
        count = lambda f: F.sum((F.col("fault") == f).cast("long"))
        turns = self.faulty.groupBy("conv_id", "turn").agg(count("b").alias("b"), count("r").alias("r"), count("t").alias("t"))
        span = (F.max("turn").cast("decimal(20,0)") - F.min("turn").cast("decimal(20,0)") + 1 - F.count("turn")).try_cast("long")
        gaps = F.when(F.max("turn").isNull(), 0).otherwise(span)
        stats = turns.groupBy("conv_id").agg(gaps.cast("long").alias("gaps"), F.sum("b").alias("blank"), F.sum("r").alias("duplicate"), F.sum("t").alias("truncated"))
        joined = self.blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "initial", "audit"))).alias("all"), F.sum("cost").alias("cost"))
        roles = F.array_join("all.initial", "")
        illegal = F.length(roles) - 1 - F.regexp_count(roles, F.lit("(?=su|ua|au)"))
        ends = joined.select(F.col("conv_id").alias("c"), illegal.cast("long").alias("illegal"), "cost", F.array_join("all.audit", "").alias("audit"))
        return stats.join(ends, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")

    def _stream(self, key: str) -> DataFrame:
        """Rows in order, each block's audit and entry state before it, dealt by the block or by the conversation."""
        none = lambda kind: F.lit(None).cast(kind)
        rows = self.ordered.select("conv_id", _block(F.col("place")).alias("block"), none("int").alias("lead"), "turn", "role", "text", "place")
        audits = self.blocks.select("conv_id", "block", F.col("entry").alias("lead"), none("long").alias("turn"), none("string").alias("role"), F.col("audit").alias("text"), F.lit(-1).cast("long").alias("place"))
        order = ["block", "conv_id"] if key == "block" else ["conv_id", "block"]
        return rows.union(audits).repartition(key).sortWithinPartitions(*order, "place").drop("place")

    def rows(self) -> DataFrame:
        """(conv_id, block, n, edit, turn, role, text): every edit, deletions included, dealt by block; the order within a
        conversation is (block, n). What stays is `edit <> 'D'`."""
        kinds = [_arrow(self.kind), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        names = ["conv_id", "block", "n", "edit", "turn", "role", "text"]
        batch = lambda out: pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

        def run(batches):
            out, n = [], 0
            for conv, block, edit, turn, role, text in _edited(batches):
                if edit is None:
                    n = 0
                    continue
                out.append((conv, block, n, edit, turn, role, text))
                n += 1
                if len(out) == 1024:
                    yield batch(out)
                    out = []
            yield batch(out)
            tokens.give_back()

        return self._stream("block").mapInArrow(run, f"conv_id {self.kind}, block long, n long, edit string, turn long, role string, text string")

    def digests(self) -> DataFrame:
        """(conv_id, repaired_sha256): SHA-256 of a conversation's repaired `role:text` rows, joined by newlines. A digest is worked out
        from the first row to the last, so here one task reads a whole conversation, row by row."""
        kind = _arrow(self.kind)

        def run(batches):
            out, conv, h, lead = [], None, None, b""
            for c, _, edit, _, role, text in _edited(batches):
                if edit is None and (h is None or c != conv):
                    if h is not None:
                        out.append((conv, h.hexdigest()))
                    conv, h, lead = c, hashlib.sha256(), b""
                elif edit is not None and edit != "D":
                    h.update(lead + f"{role}:{text}".encode())
                    lead = b"\n"
            if h is not None:
                out.append((conv, h.hexdigest()))
            yield pa.record_batch([pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out], pa.string())], names=["conv_id", "repaired_sha256"])
            tokens.give_back()

        return self._stream("conv_id").mapInArrow(run, f"conv_id {self.kind}, repaired_sha256 string")


def _block(place: Column) -> Column:
    return F.shiftright(place, BLOCK.bit_length() - 1)


def _arrow(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))


def _keyed(run):
    """run with the group's key put before its columns."""
    return lambda key, pdf: run(pdf).assign(conv_id=key[0]).pipe(lambda out: out[["conv_id", *out.columns[:-1]]])
