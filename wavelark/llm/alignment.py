"""Cross-tokenizer alignment: which tokens of one vocabulary cover the same bytes as which tokens of another.

A is a byte-level BPE file of the `tokenizers` library, B a model file of `sentencepiece`. Both encode a space and the text. The byte
offsets where tokens of both end (cumulative sums of token lengths, intersected) cut the tokens into groups; tokens
whose byte ranges overlap are linked. A pair of ids is counted once for each document that holds it linked.

Neither tokenizer merges over a space that stands between two characters that aren't white space, so texts are cut before such
spaces, and a worker aligns each distinct cut once: the new cuts of a slice of texts in one pass of array operations. Each document's
distinct pairs are written with their number of links; the counts meet in two shuffles, by pair and salt and then by pair. The
table of counts goes to all workers if it holds at most COUNTS_BYTES; beyond that, the documents' pairs are joined with it by a
shuffle. Either way gives the same result.

Nulls and edge cases: a null or empty text, and one whose tokens of A or of B don't give back its bytes (a text with U+2581, which B
reads as a space), has no tokens, so all numbers are 0 and the digest is empty; texts are read whole, however long; each row is a document, so
that equal rows and rows with equal or null ids count on their own; strings of special tokens are plain text; further columns are
ignored; an empty table gives empty results.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .bpe import _read
from .store import Scratch, limit_batches, size_of

#: The table of counts is sent to the workers up to so many bytes.
COUNTS_BYTES = 64 << 20
#: Parts into which a pair's counts are dealt before they are added up.
SALTS = 16
#: Cuts that a worker remembers, and their links (some 200 MB in all); when there are more, it starts anew.
REMEMBER, LINKS = 400_000, 4_000_000
#: Cuts that are handed to the tokenizers as one text.
JOINED = 256
_ODD, _CUT = re.compile(r" \s| \Z|\A "), re.compile(r"(?<=[^ ]) (?=\S)")


def _byte_of() -> dict[str, int]:
    """Byte-level BPE writes a byte as a character: printable Latin-1 as itself, the others as the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(other)}


class _Vocabulary:
    """The bytes of each id."""

    def __init__(self, words: list[bytes]):
        self.length = np.array([len(w) for w in words], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.blob = np.frombuffer(b"".join(words), np.uint8)

    def bytes(self, ids: np.ndarray) -> np.ndarray:
        size = self.length[ids]
        return self.blob[np.repeat(self.start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of so many values, of which some may be empty."""
    total, end = np.concatenate([[0], np.cumsum(values)]), np.cumsum(count)
    return total[end] - total[end - count]


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[k], start[k] + 1, ..., so many for each k."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def links(ends_a: np.ndarray, size_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and B tokens whose byte ranges overlap, every pair once."""
    first = np.searchsorted(ends_b, ends_a - size_a, "right")
    count = np.searchsorted(ends_b, ends_a, "left") - first + 1
    return np.repeat(np.arange(len(ends_a)), count), _spread(first, count)


class Aligner:
    """Both tokenizers, and the alignments of the cuts met so far. sides: whether each cut's ids and groups are kept too."""

    def __init__(self, raw_a: bytes, raw_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(raw_a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=raw_b)
        made, byte = json.loads(raw_a), _byte_of()
        words = {i: bytes(byte[c] for c in w) for w, i in made["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in made.get("added_tokens", [])}
        pieces = range(self.b.get_piece_size())
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.words, self.pieces = _Vocabulary([words.get(i, b"") for i in range(max(words) + 1)]), _Vocabulary([piece(i) for i in pieces])
        # What a token writes in the groups' text: A's are followed by a comma or a bar, B's by a comma, a semicolon or nothing.
        self.marks = [np.array([f"{i}{m}" for i in range(n)], object) for n, m in ((len(self.words.length), ","), (len(self.words.length), "|"), (len(pieces), ","), (len(pieces), ";"), (len(pieces), ""))]
        self.sides = False
        self.forget()

    def forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.known: dict[str, int] = {}
        self.text: list[str] = []
        self.pair: dict[int, int] = {}
        self.n_a = self.n_b = self.n_groups = self.n_links = self.at = self.link = none
        self.bad = np.zeros(0, bool)
        self.side: list[tuple[np.ndarray, ...]] = []

    def _joined(self, parts: list[str]) -> tuple[list[str], list[str], list[np.ndarray]]:
        """(cuts of which many were encoded at once, cuts left over, [ids of A, of B, tokens of A and of B of each cut]). Cuts that begin and
        end with a solid character are joined by spaces; a text whose cuts don't all end with tokens of both is left over."""
        held, left, out = [], [p for p in parts if p[0].isspace() or p[-1].isspace()], []
        solid = [p for p in parts if not (p[0].isspace() or p[-1].isspace())]
        chunks = [solid[k : k + JOINED] for k in range(0, len(solid), JOINED)]
        texts = [" ".join(c) for c in chunks]
        both = zip(chunks, self.a.encode_batch([" " + t for t in texts], add_special_tokens=False), self.b.encode(texts, num_threads=1) if texts else [], strict=True)
        for chunk, a, b in both:
            ends, ids, counts = np.cumsum([len(p.encode()) + 1 for p in chunk]), [], []
            for x, vocabulary in ((a.ids, self.words), (b, self.pieces)):
                ids.append(np.array(x, np.int64))
                upto = np.cumsum(vocabulary.length[ids[-1]])
                place = np.searchsorted(upto, ends)
                if upto[-1] != ends[-1] or (upto[place] != ends).any():
                    break
                counts.append(np.diff(place + 1, prepend=0))
            if len(counts) == 2:
                held += chunk
                out.append((*ids, *counts))
            else:
                left += chunk
        return held, left, [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else [[]] * 4)]

    def learn(self, parts: list[str]) -> None:
        """Aligns cuts that aren't known: all of them as one sequence of bytes."""
        held, parts, (joined_a, joined_b, held_a, held_b) = self._joined(parts)
        a = [e.ids for e in self.a.encode_batch([" " + p for p in parts], add_special_tokens=False)]
        b = self.b.encode(parts, num_threads=1) if parts else []
        parts = held + parts
        size = np.array([len(p.encode()) + 1 for p in parts], np.int64)
        n_a, n_b = (np.concatenate([h, np.array([len(x) for x in xs], np.int64)]) for h, xs in ((held_a, a), (held_b, b)))
        all_a, all_b = (np.concatenate([j, np.fromiter(chain.from_iterable(xs), np.int64)]) for j, xs in ((joined_a, a), (joined_b, b)))
        data = np.frombuffer((" " + " ".join(parts)).encode(), np.uint8)
        good = (_sums(self.words.length[all_a], n_a) == size) & (_sums(self.pieces.length[all_b], n_b) == size)
        kept = lambda: (all_a[np.repeat(good, n_a)], all_b[np.repeat(good, n_b)], data[np.repeat(good, size)])
        ids_a, ids_b, read = kept()
        wrong = np.flatnonzero((self.words.bytes(ids_a) != read) | (self.pieces.bytes(ids_b) != read))
        if len(wrong):
            good[np.flatnonzero(good)[np.searchsorted(np.cumsum(size[good]), wrong, "right")]] = False
            ids_a, ids_b, read = kept()
        size, n_a, n_b = size * good, n_a * good, n_b * good
        len_a, len_b = self.words.length[ids_a], self.pieces.length[ids_b]
        ends_a, ends_b = np.cumsum(len_a), np.cumsum(len_b)
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        n_groups = np.bincount(np.searchsorted(np.cumsum(size), cuts), minlength=len(parts)).astype(np.int64)
        left, right = links(ends_a, len_a, ends_b)
        n_links = np.bincount(np.repeat(np.arange(len(parts)), n_a)[left], minlength=len(parts)).astype(np.int64)
        pairs, place = np.unique(ids_a[left] << 32 | ids_b[right], return_inverse=True)
        code = np.array([self.pair.setdefault(p, len(self.pair)) for p in pairs.tolist()], np.int64)
        link = code[place] if len(pairs) else place.astype(np.int64)

        # The groups' text: a group's A tokens, then its B tokens, each with what follows it.
        last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
        end = np.zeros(len(ids_b), bool)
        end[(np.cumsum(n_b) - 1)[n_b > 0]] = True
        place_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)
        place_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")
        written = np.empty(len(ids_a) + len(ids_b), object)
        comma_a, bar, comma_b, semicolon, nothing = self.marks
        written[place_a] = np.where(last_a, bar[ids_a], comma_a[ids_a])
        written[place_b] = np.where(end, nothing[ids_b], np.where(last_b, semicolon[ids_b], comma_b[ids_b]))
        written, ends = written.tolist(), np.cumsum(n_a + n_b).tolist()
        self.text += ["".join(written[x:y]) for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        if self.sides:
            first_group = np.cumsum(n_groups) - n_groups
            ends = np.cumsum(n_a), np.cumsum(n_b)
            for k in range(len(parts)):
                sa, sb = slice(ends[0][k] - n_a[k], ends[0][k]), slice(ends[1][k] - n_b[k], ends[1][k])
                self.side.append((ids_a[sa], ids_b[sb], group_a[sa] - first_group[k], group_b[sb] - first_group[k]))
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts)), strict=True))
        self.at = np.concatenate([self.at, len(self.link) + np.cumsum(n_links) - n_links])
        more = lambda old, new: np.concatenate([old, new])
        self.n_a, self.n_b, self.n_groups, self.n_links, self.link, self.bad = more(self.n_a, n_a), more(self.n_b, n_b), more(self.n_groups, n_groups), more(self.n_links, n_links), more(self.link, link), more(self.bad, ~good)

    def cuts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the texts' cuts one after the other, how many each text has). A text whose bytes don't come back has none."""
        if len(self.known) > REMEMBER or len(self.link) > LINKS:
            self.forget()
        parts = [[] if not t else t.split(" ") if _ODD.search(t) is None else _CUT.split(t) for t in texts]
        if new := set(chain.from_iterable(parts)) - self.known.keys():
            self.learn(list(new))
        number = lambda: np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64)
        count = np.array([len(p) for p in parts], np.int64)
        at = number()
        failed = np.flatnonzero(_sums(self.bad[at].astype(np.int64), count))
        if len(failed):  # such texts are tried whole, as the tokenizers would read them
            if new := [t for t in dict.fromkeys(texts[k] for k in failed) if t not in self.known]:
                self.learn(new)
            for k in failed:
                parts[k] = [] if self.bad[self.known[texts[k]]] else [texts[k]]
            count, at = np.array([len(p) for p in parts], np.int64), number()
        return at, count

    def pairs(self, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs, links of each, pairs of each text): the distinct pairs of texts with these cuts."""
        n = self.n_links[at]
        key = np.sort(np.repeat(np.repeat(np.arange(len(count)), count), n) * len(self.pair) + self.link[_spread(self.at[at], n)])
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, times = key[first], np.diff(first, append=len(key))
        pair = np.fromiter(self.pair, np.int64, len(self.pair))
        return pair[key % max(1, len(pair))], times, np.bincount(key // max(1, len(pair)), minlength=len(count))


_aligners: dict[int, Aligner] = {}


def _shared(models) -> Aligner:
    """One aligner a worker and pair of files, kept between tasks without its memory."""
    raw = models.value
    key = hash(raw)
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(*raw)
    return _aligners[key]


def _texts(column: pa.Array):
    """(first row, end row, texts) of slices of a column."""
    for low, high, data, offsets in tokens.slices(column, 1 << 20):
        raw, ends = data.tobytes(), offsets.tolist()
        yield low, high, [raw[a:b].decode() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _models(docs: DataFrame, path_a: str, path_b: str):
    spark = docs.sparkSession
    limit_batches(spark)
    return spark.sparkContext.broadcast((_read(spark, path_a), _read(spark, path_b)))


def alignments(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a, b, group_a, group_b) of every row: the ids of both tokenizers, and each token's group, numbered from 0."""
    models = _models(docs, path_a, path_b)

    def run(batches):
        both = _shared(models)
        both.sides = True
        both.forget()
        for batch in batches:
            for low, high, texts in _texts(batch.column(1)):
                at, count = both.cuts(texts)
                out, end = [[], [], [], []], np.cumsum(count).tolist()
                for e, n in zip(end, count.tolist(), strict=True):
                    cut = at[e - n : e]
                    begin = np.cumsum(both.n_groups[cut]) - both.n_groups[cut]
                    rows = [both.side[k] for k in cut.tolist()]
                    for side in range(4):
                        part = [r[side] + (g if side > 1 else 0) for r, g in zip(rows, begin.tolist(), strict=True)]
                        out[side].append(np.concatenate(part).astype(np.int32) if part else np.zeros(0, np.int32))
                yield pa.record_batch([batch.column(0)[low:high], *(tokens.lists(o, pa.int32()) for o in out)], names=["doc_id", "a", "b", "group_a", "group_b"])
        both.sides = False
        both.forget()
        tokens.give_back()

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, a array<int>, b array<int>, group_a array<int>, group_b array<int>")


def _flat(parts: np.ndarray, count: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(parts, kind))


def pair_counts(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """(pair, docs, best) of rows (pairs array<long>): of each pair of ids (A's in the upper 32 bits), in how many documents it is linked,
    and whether no other pair of its A id is in more."""
    each = rows.select(F.explode("pairs").alias("pair"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    dealt = each.groupBy("pair", "salt").agg(F.count("*").alias("docs"))
    pairs = scratch.table(dealt.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.shiftright("pair", 32)), "pairs")
    most = pairs.groupBy("a").agg(F.max("docs").alias("most"))
    counts = scratch.table(pairs.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "counts")
    scratch.drop("pairs")
    return counts


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row: tokens, groups and links; links whose pair is the
    most frequent of its A id; the sum of the links' counts; SHA-256 of the groups written as `a1,a2|b1;a3|b2,b3`."""
    scratch, models = Scratch(docs.sparkSession, "alignment"), _models(docs, path_a, path_b)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind, numbers = dict(texts.dtypes)["doc_id"], ["n_a", "n_b", "n_groups", "n_links"]

    def align(batches):
        both = _shared(models)
        both.forget()
        for batch in batches:
            for low, high, part in _texts(batch.column(1)):
                at, count = both.cuts(part)
                names, ends = list(map(both.text.__getitem__, at.tolist())), np.cumsum(count).tolist()
                digest = [hashlib.sha256(";".join(names[e - n : e]).encode()).hexdigest() if n else "" for e, n in zip(ends, count.tolist(), strict=True)]
                pair, times, n = both.pairs(at, count)
                sums = [pa.array(_sums(getattr(both, c)[at], count)) for c in numbers]
                yield pa.record_batch([batch.column(0)[low:high], *sums, pa.array(digest), _flat(pair, n, pa.int64()), _flat(times, n, pa.int32())], names=["doc_id", *numbers, "groups_sha256", "pairs", "times"])
        both.forget()
        tokens.give_back()

    longs = ", ".join(f"{c} long" for c in numbers)
    rows = texts.mapInArrow(align, f"doc_id {kind}, {longs}, groups_sha256 string, pairs array<long>, times array<int>")
    rows = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    counts = pair_counts(scratch, rows)
    columns = ["doc_id", *numbers, "n_best", "count_sum", "groups_sha256"]
    if size_of(counts) <= COUNTS_BYTES:
        held = counts.toArrow()
        order = np.argsort(held["pair"].to_numpy())
        table = docs.sparkSession.sparkContext.broadcast(tuple(held[c].to_numpy()[order] for c in ("pair", "docs", "best")))

        def look_up(batches):
            pair, number, best = table.value
            for batch in batches:
                at, times = np.searchsorted(pair, batch.column(6).flatten().to_numpy()), batch.column(7).flatten().to_numpy().astype(np.int64)
                count = batch.column(6).value_lengths().to_numpy().astype(np.int64)
                sums = [pa.array(_sums(values * times, count)) for values in (best[at].astype(np.int64), number[at])]
                yield pa.record_batch([*(batch.column(k) for k in range(5)), *sums, batch.column(5)], names=columns)
            tokens.give_back()

        scratch.only("rows")
        kinds = f"doc_id {kind}, {longs}, n_best long, count_sum long, groups_sha256 string"
        return rows.select("doc_id", *numbers, "groups_sha256", "pairs", "times").mapInArrow(look_up, kinds)
    # A pair that most documents hold is hot: both sides are written tables, so that adaptive execution can split its share.
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = (F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)), F.sum(F.col("times") * F.col("docs")))
    added = scratch.table(each.join(counts, "pair").groupBy("row").agg(*(s.alias(c) for s, c in zip(sums, ("n_best", "count_sum"), strict=True))), "added")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    scratch.only("rows", "added")
    return rows.join(added, "row", "left").select("doc_id", *numbers, zero("n_best"), zero("count_sum"), "groups_sha256")
