"""Byte-level BPE encoding and decoding with a public vocabulary's ranks.

A piece is merged by a segment tree over its byte positions: a leaf holds the rank of the pair that starts at a live
position, with the position in its low bits, so the root is the leftmost pair of least rank. A merge writes
three leaves (the pair itself, its live neighbour to the left, and the part that died) and their paths to the
root. Short pieces run through one array of trees, a row each; a longer piece has a tree of its own.

The pattern's matches never cross a space that a non-space follows, so texts are cut there first, and each
distinct cut of a slice is matched and merged once. A worker remembers short cuts from slice to slice; the memory is
bounded in entries and bytes, and only the vocabulary outlives a task.

Nulls and edge cases: a null text counts as empty and has no ids; whole texts are encoded, however long; ids may
be null or repeated; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .store import limit_batches

#: Distinct cuts that a worker remembers, of at most so many characters (some 70 MB in all); when there are more, those of the present slice stay.
REMEMBER, SHORT = 200_000, 48
_NONE = np.int64(1 << 60)
_LONGEST = 64
#: Leaves of the trees that are merged in one array.
_TREES = 1 << 18

_SPACE_BEFORE_SPACE, _CUT = re.compile(r" \s| \Z"), re.compile(r" (?=\S)")


class Encoder:
    """ranks: the bytes of a file with a base64 token and its rank a line."""

    def __init__(self, ranks: bytes, pattern: str):
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.pattern = regex.compile(pattern)
        size = max(self.rank.values()) + 1
        self.bytes = [b""] * size
        for token, r in self.rank.items():
            self.bytes[r] = token
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in self.bytes])])
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        pairs = {}
        for token, r in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.pairs = pairs
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair_key.tolist()], np.int64)
        self.forget()

    def forget(self) -> None:
        self.first: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.piece: dict[str, bytes] = {}

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << np.int64(32) | b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], _NONE)

    def _merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Pieces of at most `width` bytes (a power of two), each a row of trees."""
        rows = len(pieces)
        raw = np.zeros((rows, width), np.uint8)
        size = np.array([len(p) for p in pieces])
        raw[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.byte_id[raw]
        alive = np.arange(width) < size[:, None]
        after = np.tile(np.arange(1, width + 1), (rows, 1))
        after[np.arange(rows), size - 1] = width
        before = np.tile(np.arange(-1, width - 1), (rows, 1))
        tree = np.full((rows, 2 * width), _NONE)
        place = np.arange(width - 1)
        found = self._ranks(ids[:, :-1], ids[:, 1:])
        tree[:, width : 2 * width - 1] = np.where(alive[:, 1:] & (found < _NONE), found * width + place, _NONE)
        k = width // 2
        while k:
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
            k //= 2
        act = np.arange(rows)

        def write(r, leaf, value):
            node = leaf + width
            tree[r, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        while True:
            root = tree[act, 1]
            act, root = act[root < _NONE], root[root < _NONE]
            if not len(act):
                break
            i, merged = root % width, root // width
            j = after[act, i]
            k = after[act, j]
            ids[act, i] = merged
            after[act, i] = k
            alive[act, j] = False
            has = k < width
            before[act[has], k[has]] = i[has]
            right = np.full(len(act), _NONE)
            right[has] = self._ranks(merged[has], ids[act[has], k[has]])
            write(act, j, _NONE)
            write(act, i, np.where(right < _NONE, right * width + i, _NONE))
            p = before[act, i]
            has = p >= 0
            if has.any():
                r, p, i = act[has], p[has], i[has]
                left = self._ranks(ids[r, p], ids[r, i])
                write(r, p, np.where(left < _NONE, left * width + p, _NONE))
        flat, ends = ids[alive].astype(np.int32).tobytes(), np.cumsum(alive.sum(1)).tolist()
        return [flat[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _merge_long(self, piece: bytes) -> bytes:
        n, get = len(piece), self.pairs.get
        width = 1 << (n - 1).bit_length()
        none = 1 << 60
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        key = lambda a, b, i: none if (r := get(ids[a] << 32 | ids[b])) is None else r * width + i
        tree = [none] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = key(i, i + 1, i)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1" * n)

        def write(leaf: int, value: int) -> None:
            k = width + leaf
            tree[k] = value
            while k > 1:
                k >>= 1
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    break
                tree[k] = low

        while tree[1] < none:
            merged, i = divmod(tree[1], width)
            j = after[i]
            k = after[j]
            ids[i], after[i], alive[j] = merged, k, 0
            if k < n:
                before[k] = i
            write(j, none)
            write(i, key(i, k, i) if k < n else none)
            if before[i] >= 0:
                write(before[i], key(before[i], i, before[i]))
        return np.array([x for x, on in zip(ids, alive, strict=True) if on], np.int32).tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids (as bytes of int32) of each piece; a piece that is a token itself has that id."""
        out: list[bytes] = [b""] * len(pieces)
        todo: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if (r := self.rank.get(p)) is not None:
                out[k] = r.to_bytes(4, "little")
            elif len(p) > _LONGEST:
                out[k] = self._merge_long(p)
            else:
                todo.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(k)
        for width, at in todo.items():
            rows = _TREES // width
            for low in range(0, len(at), rows):
                part = at[low : low + rows]
                for k, ids in zip(part, self._merge_many([pieces[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def _known(self, memory: dict[str, bytes], cuts: set[str], lead: str) -> dict[str, bytes]:
        """The ids of each of these cuts, with `lead` before it."""
        here = {c: memory[c] for c in cuts & memory.keys()}
        new = [(c, self.pattern.findall(lead + c)) for c in cuts - here.keys()]
        pieces = {p for _, found in new for p in found}
        ids = {p: self.piece[p] for p in pieces & self.piece.keys()}
        fresh = list(pieces - ids.keys())
        fresh_ids = dict(zip(fresh, self.encode_pieces([p.encode() for p in fresh]), strict=True))
        ids |= fresh_ids
        if len(self.piece) + len(fresh) > REMEMBER:
            self.piece.clear()
        self.piece.update((p, x) for p, x in fresh_ids.items() if len(p) <= SHORT)
        get = ids.__getitem__
        learnt = {c: b"".join(map(get, found)) for c, found in new}
        if len(memory) + len(learnt) > REMEMBER:
            memory.clear()
            memory.update((c, x) for c, x in here.items() if len(c) <= SHORT)
        memory.update((c, x) for c, x in learnt.items() if len(c) <= SHORT)
        return here | learnt

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [t.split(" ") if _SPACE_BEFORE_SPACE.search(t) is None else _CUT.split(t) for t in texts]
        first = self._known(self.first, {p[0] for p in parts}, "")
        spaced = self._known(self.spaced, {c for p in parts for c in p[1:]}, " ").__getitem__
        return [np.frombuffer(first[p[0]] + b"".join(map(spaced, p[1:])), np.int32) for p in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.starts[ids + 1] - self.starts[ids]
        at = np.repeat(self.starts[ids] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(ids) else np.zeros(0, np.int64)
        return self.blob[at + np.arange(len(at))].tobytes()


_encoders: dict[int, Encoder] = {}


def _shared(ranks, pattern: str) -> Encoder:
    """One encoder a worker and vocabulary, kept between tasks."""
    raw = ranks.value
    key = hash((raw, pattern))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(raw, pattern)
    return _encoders[key]


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) of every row: the text's ids, and the bytes that the ids give.

    path: a file of ranks, read by Spark's reader and sent to the workers (a vocabulary is about 1 MB)."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(_read(spark, path))

    def run(batches):
        coder = _shared(ranks, pattern)
        for batch in batches:
            for low, high, data, offsets in tokens.slices(batch.column(1), 1 << 20):
                raw = data.tobytes()
                ends = offsets.tolist()
                ids = coder.encode([raw[a:b].decode() for a, b in zip(ends[:-1], ends[1:], strict=True)])
                decoded = [coder.decode(x) for x in ids]
                yield pa.record_batch([batch.column(0)[low:high], tokens.lists(ids, pa.int32()), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])
        coder.forget()
        tokens.give_back()

    limit_batches(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, ids array<int>, decoded binary")


def _read(spark, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path if "://" in path else f"file://{path}").select("content").head()[0])


def digests(coded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
