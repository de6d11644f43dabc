import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from wavelark.llm import alignment, queries

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


class Plain:
    """Both libraries on whole texts, and groups found byte by byte."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}

    def tokens(self, text):
        whole = (" " + text).encode()
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()) for i in self.b.encode(text)]
        return None if not text or b"".join(w for _, w in a) != whole or b"".join(w for _, w in b) != whole else (a, b)


def restated(texts):
    plain, found = Plain(), []
    for text in texts:
        if not text or (both := plain.tokens(text)) is None:
            found.append(None)
            continue
        spans = []
        for side in both:
            at, s = 0, []
            for i, w in side:
                s.append((at, at + len(w), i))
                at += len(w)
            spans.append(s)
        common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        for high in common:
            groups.append([[i for s, e, i in side if low < e <= high] for side in spans])
            low = high
        where, pairs = defaultdict(list), Counter()
        for s, e, i in spans[1]:
            for k in range(s, e):
                where[k].append((s, i))
        for s, e, i in spans[0]:
            pairs.update((i, j) for _, j in {x for k in range(s, e) for x in where[k]})
        found.append((len(both[0]), len(both[1]), groups, pairs))
    docs = Counter(p for f in found if f for p in f[3])
    most = defaultdict(int)
    for (i, _), n in docs.items():
        most[i] = max(most[i], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, pairs = f
        digest = hashlib.sha256(";".join("|".join(",".join(map(str, side)) for side in g) for g in groups).encode()).hexdigest()
        out.append((n_a, n_b, len(groups), sum(pairs.values()), sum(m for p, m in pairs.items() if docs[p] == most[p[0]]), sum(m * docs[p] for p, m in pairs.items()), digest))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    out = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() if t and len(t) < 3000][:150]
    odd = ["", None, " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "\n\n a", "x▁y", "▁", "a ▁ b c", "<|endoftext|> and <s> </s> <unk> <0x0A>", "\x00\x01 \x1c\x1d x", " nbsp 　wide em", "it's we'll I'd", "日本語 テキスト", "🤝🏽 é ﬁ ①", "ſtraße İ", "a" * 5000, "ab " * 3000, "\t\tdef f(x):\n\t\treturn  x", "\r\n\r\n", "a\u0085b \u0085 c", "…— “q”"]
    signs = ["a", "B", " ", " ", "\n", "é", "▁", "\t", "1", "'s", "。", "🤝", "\x1f", " ", ".", "ing"]
    odd += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    return out + odd + out[:3]


SCHEMA = "doc_id long, text string, pairs int, row string, a string"


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_alignment_equals_the_libraries(spark, texts, limit, monkeypatch, tmp_path):
    monkeypatch.setattr(alignment, "COUNTS_BYTES", limit)
    spark.createDataFrame([(i, t, 1, "x", "y") for i, t in enumerate(texts)], SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.queries()["op11_token_alignment"](spark, str(tmp_path)).collect()}
    want = restated(texts)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, repr(texts[i])[:200]
    assert sum(w[0] == 0 for w in want) >= 5


def test_repeated_and_null_ids(spark):
    rows = [(None, "same text", 1, "", ""), (7, "same text", 1, "", ""), (7, "same text", 1, "", ""), (8, None, 1, "", "")]
    got = sorted(tuple(r) for r in alignment.align_documents(spark.createDataFrame(rows, SCHEMA), A, B).drop("doc_id").collect())
    assert got == sorted(restated([r[1] for r in rows]))
    empty = spark.createDataFrame([], SCHEMA)
    assert alignment.align_documents(empty, A, B).count() == alignment.alignments(empty, A, B).count() == 0


def test_groups_of_tokens(spark, texts):
    plain = Plain()
    rows = spark.createDataFrame([(i, t, 1, "", "") for i, t in enumerate(texts)], SCHEMA)
    for r in alignment.alignments(rows, A, B).collect():
        both = plain.tokens(texts[r.doc_id]) if texts[r.doc_id] else None
        assert (r.a, r.b) == (([i for i, _ in both[0]], [i for i, _ in both[1]]) if both else ([], []))
        if not both:
            continue
        ends = [np.cumsum([len(w) for _, w in side]) for side in both]
        for g in range(max(r.group_a) + 1):
            assert ends[0][np.flatnonzero(np.array(r.group_a) == g)[-1]] == ends[1][np.flatnonzero(np.array(r.group_b) == g)[-1]]
        assert max(r.group_a) == max(r.group_b) == len(set(ends[0].tolist()) & set(ends[1].tolist())) - 1


def test_a_worker_that_forgets(spark, texts, monkeypatch):
    raw = [open(p, "rb").read() for p in (A, B)]
    both, small = alignment.Aligner(*raw), alignment.Aligner(*raw)
    given = [t or "" for t in texts]
    at, count = both.cuts(given)
    monkeypatch.setattr(alignment, "REMEMBER", 5)
    for k, t in enumerate(given):
        cut, _ = small.cuts([t])
        assert [small.text[c] for c in cut.tolist()] == [both.text[c] for c in at[sum(count[:k]) : sum(count[: k + 1])].tolist()]
