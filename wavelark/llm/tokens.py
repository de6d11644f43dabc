"""Words and word shingles of whole texts as 64-bit hashes, worked out for a slice of texts at once.

A text's bytes are read in place from the Arrow buffer. Words are runs of bytes other than the separators,
which are all ASCII, so a word is the same run of characters.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in slices of about so many bytes (a longer text makes a slice of its own).
SLICE_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_STEPS = [np.uint64(x | 1) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)

_powers = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 2 * SLICE_BYTES), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def give_back() -> None:
    """Hands memory that a finished task has freed back to the system: the worker lives on, and others need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _STEPS[0]
    x = (x ^ (x >> np.uint64(27))) * _STEPS[1]
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, text offsets in them) for slices of a string column; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + limit, "right")) - 1)
        yield low, high, data[ends[low] : ends[high]], ends[low : high + 1] - ends[low]
        low = high


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lower-cased, first word of each text and one past the last, byte start, byte end)."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if not n:
        return none.astype(np.uint64), np.zeros(len(offsets), np.int64), none, none
    inside = ~separators[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edge = offsets[offsets < n]
    begin[edge] = inside[edge]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return none.astype(np.uint64), np.zeros(len(offsets), np.int64), none, none
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    last = offsets[offsets > 0] - 1
    stop[last] = inside[last]
    ends = np.flatnonzero(stop) + 1
    value = _LOWER[data]
    value *= inside
    value *= _power(_BASE, n)
    sums = np.add.reduceat(value, starts)
    sums *= _power(int(_INVERSE), n)[starts]
    return mix(sums + (ends - starts).astype(np.uint64) * _STEPS[2]), np.searchsorted(starts, offsets), starts, ends


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of `size` words, first run of each text). Fewer words make one run of all; no words none."""
    count = np.diff(first)
    runs = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(runs)])
    if not start[-1]:
        return np.zeros(0, np.uint64), start
    at = np.arange(start[-1]) + np.repeat(first[:-1] - start[:-1], runs)
    end = np.repeat(first[1:], runs) if (count[runs > 0] < size).any() else None
    total = np.zeros(len(at), np.uint64)
    for j in range(size):
        here = hashes[np.minimum(at + j, len(hashes) - 1)] if end is not None or j else hashes[at]
        if end is not None:
            here = np.where(at + j < end, here, np.uint64(0))
        total += here * _STEPS[j % 8] * np.uint64(2 * (j // 8) + 1)
    return mix(total), start


def sets(hashes: np.ndarray, start: np.ndarray) -> Iterator[np.ndarray]:
    """Each text's distinct runs in ascending order."""
    for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
        s = np.sort(hashes[a:b])
        if b - a > 1:
            keep = np.empty(b - a, bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            s = s[keep]
        yield s


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column from one array a row."""
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0), kind))
