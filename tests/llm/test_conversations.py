import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from wavelark.llm import conversations, queries
from wavelark.llm.conversations import Repair, damage

LEGAL = re.compile(r"(s?(ua)+)?")
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})


def cheapest(initials, faults):
    """(cost, least audit) by a search over single edits in the order of cost and audit."""
    heap, seen = [(0, "", 0, 0)], set()
    while True:
        cost, audit, i, q = heapq.heappop(heap)
        if (i, q) in seen:
            continue
        seen.add((i, q))
        if i == len(initials) and q in (0, 3):
            return cost, audit
        made = AFTER[q]["a" if q == 2 else "u"]
        steps = [(2, "I", i, made)]
        if i < len(initials):
            cut = faults[i] == "t"
            steps.append((3, "D", i + 1, q))
            if faults[i] != "d":
                steps.append((2 + cut, "R", i + 1, made))
                if initials[i] in AFTER[q]:
                    steps.append((cut, "K", i + 1, AFTER[q][initials[i]]))
        for c, e, j, p in steps:
            heapq.heappush(heap, (cost + c, audit + e, j, p))


def restated(rows):
    """The contract's result for rows (conv_id, turn, role, text), as a dict by conv_id."""
    out, convs = {}, defaultdict(list)
    text = lambda x: " " if x is None else str(x)
    for conv, turn, role, body in rows:
        convs.setdefault(conv, [])
        fault = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        role, body = text(role), text(body)
        body = "" if fault == 1 else re.sub("[.!?]", "", body) if fault == 2 else body
        convs[conv] += [(turn, "user" if fault == 4 else role, body)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    for conv, all_ in convs.items():
        all_.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        turns = [t for t, _, _ in all_ if t is not None]
        faults, seen = [], set()
        for _, role, body in all_:
            solid = re.sub(r"[\x20\x09-\x0D]", "", body)
            faults.append("b" if not solid else "r" if (role, body) in seen else "t" if solid[-1] not in ".!?" else ".")
            seen.add((role, body))
        initials = [role[:1] for _, role, _ in all_]
        cost, audit = cheapest(initials, ["d" if f in "br" else f for f in faults])
        kept, rest, q = [], list(all_), 0
        for e in audit:
            row = rest.pop(0) if e != "I" else (None, None, "")
            role = row[1] if e == "K" else {"u": "user", "a": "assistant"}["a" if q == 2 else "u"]
            if e != "D":
                kept.append((role, row[2]))
                q = AFTER[q][role[0]]
        assert LEGAL.fullmatch("".join(r[0] for r, _ in kept))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in "brt"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, place int, block string, fault string, same int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(4), []
    texts = ["One.", "Two two!", "three", "four?  \n", "", " \t\x0b", "five ", None, "sechs …", "x" * 5000 + "."]
    for conv in [*range(300), None, -5]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            role = rng.choice(["system", "tool", "", None, "User", "superuser"]) if rng.random() < 0.1 else role
            body = rng.choice(texts) if rng.random() < 0.5 else f"Reply {conv} {turn}{rng.choice('.!? x')}"
            out.append((conv, None if rng.random() < 0.02 else turn + rng.choice([0, 0, 0, 3]), role, body))
    for turn in range(700):  # a long conversation
        out.append((1000, turn, "system" if turn == 0 else ("assistant", "user")[turn % 2], f"Text {turn % 650}{'.' if rng.random() < 0.8 else ''}"))
    whole = next(k for k in range(2000, 2100) if zlib.crc32(f"{k}: ".encode()) % 20 > 4)  # two rows without a turn, told apart by role
    out += [(3000, 2**62, "user", "Far."), (3000, -(2**62), "assistant", "Away.")]
    once = {(r[0], r[1]): r for r in out}  # of equal turns one row, so that their order is fixed
    clean = [*once.values(), (whole, None, "user", "a."), (whole, None, "assistant", "b.")]
    return clean + [clean[5]] * 3


@pytest.mark.parametrize("block", [1024, 4])
def test_repair_equals_a_plain_search(spark, rows, block, monkeypatch, tmp_path):
    monkeypatch.setattr(conversations, "BLOCK", block)
    table(spark, rows).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.queries()["op13_conversation_repair"](spark, str(tmp_path)).collect()
    want = restated(rows)
    assert len(got) == len(want) == len({r.conv_id for r in got})
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == want[r.conv_id], r.conv_id


def test_repaired_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 16)
    fixed = Repair(damage(table(spark, rows)))
    audits = {r.conv_id: r.audit for r in fixed.summary.collect()}
    by = defaultdict(list)
    for r in fixed.rows().collect():
        by[r.conv_id].append((r.block, r.n, r.edit, r.role, r.text))
    assert {c: "".join(e for _, _, e, _, _ in sorted(v)) for c, v in by.items()} == {c: a for c, a in audits.items() if a}
    for v in by.values():
        assert LEGAL.fullmatch("".join(role[0] for _, _, e, role, _ in sorted(v) if e != "D"))


def test_search_over_block_borders():
    rng = random.Random(6)
    for _ in range(1500):
        n = rng.randint(0, 10)
        initials, faults = "".join(rng.choice("suax") for _ in range(n)), "".join(rng.choice("...td") for _ in range(n))
        assert conversations.trace(initials, faults, conversations._ACCEPT, 0)[:2] == cheapest(initials, faults)
        k = rng.randint(0, n)
        a, b = (initials[:k], faults[:k]), (initials[k:], faults[k:])
        ahead = tuple(conversations.trace(*b, conversations._ACCEPT, q)[0] for q in range(4))
        first = conversations.trace(*a, ahead, 0)
        assert first[1] + conversations.trace(*b, conversations._ACCEPT, first[2])[1] == cheapest(initials, faults)[1]
        m = conversations.costs(*a)
        assert min(m[q] + ahead[q] for q in range(4)) == cheapest(initials, faults)[0]


def test_no_rows(spark, tmp_path):
    none = table(spark, []).limit(0)
    assert Repair(none).summary.count() == Repair(none).rows().count() == Repair(none).digests().count() == 0
    gone = next(k for k in range(99) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    table(spark, [(gone, 0, "user", "Only row.")]).write.parquet(f"{tmp_path}/conversations.parquet")
    row = queries.queries()["op13_conversation_repair"](spark, str(tmp_path)).collect()[0]
    assert tuple(row[c] for c in COLUMNS) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and row.conv_id == gone
