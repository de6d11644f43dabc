"""Repeated passages by a sparse suffix array over words.

Of each text the suffixes at minimisers are retained: word places whose GRAM-word hash is least in some window of
WINDOW such places, chosen by content alone, so equal passages keep equal suffixes. Every run of `least` equal words has
the least place of its first WINDOW places with REACH words or more to its right. The retained suffixes are sorted and compared by
their first REACH words; only those that another document has too are matches, and are extended left and right: every run
of `least` words that holds the place within its first WINDOW words is sorted by its fingerprint (96 bits) and compared with its
neighbours of equal rank. Where one of them is of another document the run is repeated, and repeated runs that overlap or touch are
one passage. A match is so extended against every document and not only against its two neighbours in the order of
suffixes, whose common words to the left may end earlier than another's do: comparing neighbours alone lost passages.

Equal texts count once and are passages as a whole.

Nulls and edge cases: null, empty and short texts have no passages; a null id takes no part; rows with equal ids
count as one document; passages that only one document repeats are reported if `within` is set; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import passages, tokens
from .store import Scratch

GRAM, WINDOW, REACH = 8, 24, 24
#: REACH + WINDOW - 1 <= least must hold.
LEAST = 50
_HIGH = np.uint64((1 << 64) - 1)


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each place on (a power-of-two ladder; places too near the end hold rubbish)."""
    out, have, shift = None, h, 1
    at = 0
    while size:
        if size & 1:
            part = np.zeros_like(h)
            part[: len(h) - at] = have[at:]
            out = part if out is None else tokens.mix(out * np.uint64(0xD6E8FEB86659FD93) + part)
            at += shift
        size >>= 1
        nxt = np.zeros_like(h)
        nxt[: max(0, len(h) - shift)] = have[shift:]
        have = tokens.mix(have * np.uint64(0x9E3779B97F4A7C15) + nxt)
        shift *= 2
    return out


def _slide(x: np.ndarray, window: int, pick: np.ufunc, fill: np.uint64) -> np.ndarray:
    """The least or greatest of each window of that length, by block-wise running extremes."""
    m = -len(x) % window
    x = np.concatenate([x, np.full(m, fill, x.dtype)]).reshape(-1, window)
    left, right = pick.accumulate(x, 1).ravel(), pick.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    return pick(right[: len(left) - window + 1], left[window - 1 :])


def least_places(value: np.ndarray, window: int) -> np.ndarray:
    """Which places are the least of some window of that length (ties: all)."""
    n = len(value)
    if n < window:
        return np.zeros(n, bool)
    low = _slide(value, window, np.minimum, _HIGH)[: n - window + 1]
    pad = np.zeros(window - 1, np.uint64)
    return _slide(np.concatenate([pad, low, pad]), window, np.maximum, np.uint64(0))[:n] == value


def _grams(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of GRAM words at each place, the place's text, and the words from there to the text's end."""
    gram = _runs(h, GRAM)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    left = first[1:][doc] - np.arange(len(h))
    gram[left < GRAM] = _HIGH
    return gram, doc, left


def _suffixes(batches):
    for batch in batches:
        out = []
        for low, _, data, offsets in tokens.slices(batch.column(1)):
            h, first, _, _ = tokens.words(data, offsets)
            if len(h) < REACH:
                continue
            gram, doc, left = _grams(h, first)
            pick = np.flatnonzero(least_places(gram, WINDOW) & (left >= REACH))
            out.append((_runs(h, REACH)[pick], low + doc[pick], pick - first[:-1][doc[pick]]))
        near, row, at = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        ids = batch.column(0).cast(pa.int64()).to_numpy()
        yield pa.record_batch([pa.array(near.view(np.int64)), pa.array(ids[row]), pa.array(at.astype(np.int32))], names=["near", "id", "at"])


def _ranked(least: int):
    """(key, more, id, at) of each different run of `least` words whose least place is shared; at are all its places."""

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0).cast(pa.int64()).to_numpy(), []
            for low, _, data, offsets in tokens.slices(batch.column(1)):
                h, first, _, _ = tokens.words(data, offsets)
                if len(h) < least:
                    continue
                gram, doc, left = _grams(h, first)
                size, lists = np.diff(first), batch.column(2)[low : low + len(first) - 1]
                text = np.repeat(np.arange(len(size)), lists.value_lengths().to_numpy())
                at = lists.flatten().to_numpy()
                inside = at < size[text]
                alone = np.ones(len(h), np.uint64)
                alone[first[:-1][text[inside]] + at[inside]] = 0
                # The last bit of the least hash says whether its place is shared.
                ahead = _slide(gram & ~np.uint64(1) | alone, WINDOW, np.minimum, _HIGH)[: len(h) - WINDOW + 1]
                pick = np.flatnonzero((ahead & np.uint64(1) == 0) & (left[: len(ahead)] >= least))
                out.append((_runs(h, least)[pick], _runs(tokens.mix(h ^ np.uint64(0xA0761D6478BD642F)), least)[pick] >> np.uint64(32), low + doc[pick], pick - first[:-1][doc[pick]]))
            if not out:
                continue
            key, more, row, at = (np.concatenate(c) for c in zip(*out, strict=True))
            order = np.lexsort((at, more, key, row))
            key, more, row, at = key[order], more[order], row[order], at[order].astype(np.int32)
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (more[1:] != more[:-1]) | (row[1:] != row[:-1])])) if len(key) else np.zeros(0, np.int64)
            places = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer((np.append(new, len(at)) * 4).astype(np.int32).tobytes()), pa.py_buffer(at.tobytes())])
            yield pa.record_batch([pa.array(key[new].view(np.int64)), pa.array(more[new].astype(np.uint32).view(np.int32)), pa.array(ids[row[new]]), places], names=["key", "more", "id", "at"])
        tokens.give_back()

    return run


def _spans(least: int):
    """(id, a, b): each document's runs of `least` words, those that overlap or touch as one."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, lists in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at = np.unique(np.frombuffer(b"".join(lists.as_py()), np.int32))
                cut = np.flatnonzero(np.diff(at) > least)
                out += [(doc, a, b + least) for a, b in zip(at[np.append(0, cut + 1)].tolist(), at[np.append(cut, len(at) - 1)].tolist(), strict=True)]
            yield pa.record_batch([pa.array(c, pa.int32() if k else pa.int64()) for k, c in enumerate(zip(*out, strict=True) if out else [[]] * 3)], names=["id", "a", "b"])

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, within: bool = False) -> DataFrame:
    """(doc_id, start_word, end_word): maximal runs of `least` words or more that another document holds too or, with `within`, that
    the same document holds at another place."""
    if least < REACH + WINDOW - 1:
        raise ValueError(f"least must be {REACH + WINDOW - 1} or more")
    scratch = Scratch(docs.sparkSession, "suffix_dedup")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    single, copies = passages.one_of_each_text(scratch, texts)
    rows = scratch.table(single.mapInArrow(_suffixes, "near long, id long, at int"), "suffixes")
    # Both sides of the join on hot beginnings are written tables, so that adaptive execution can split a hot one's share.
    groups = scratch.table(rows.groupBy("near").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("n > 1" if within else "lo <> hi").select("near"), "groups_near")
    matched = scratch.table(rows.join(groups, "near", "left_semi").select("id", "at"), "matched")
    shared = scratch.table(matched.groupBy("id").agg(F.collect_list("at").alias("at")), "shared")
    scratch.drop("suffixes", "groups_near", "matched")
    # A text has a row for each different run, so a group has no more rows than documents.
    ranks = single.join(shared, "id").select("id", "text", "at").mapInArrow(_ranked(least), "key long, more int, id long, at binary")
    one = Window.partitionBy("key", "more")
    repeated = ranks.withColumns({"lo": F.min("id").over(one), "hi": F.max("id").over(one)}).where("lo <> hi or octet_length(at) > 4" if within else "lo <> hi")
    spans = scratch.table(repeated.groupBy("id").agg(F.collect_list("at").alias("at")).mapInArrow(_spans(least), "id long, a int, b int"), "spans")
    scratch.only("spans", "copies")
    return passages.joined(scratch, spans, texts, copies, least)
