import time

import numpy as np
import pytest
from brute import jaccard_classes, repeated, words
from pyspark.sql import functions as F

from wavelark.llm import compact_windows, decontaminate, ngram_join, store, suffix_dedup, tokens


@pytest.mark.parametrize(("size", "num", "den", "orders"), [(3, 9, 10, 3), (5, 4, 5, 2), (5, 4, 5, 1)])
def test_ngram_join_equals_brute_force(documents, corpus, size, num, den, orders):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(documents, shingle=size, similarity=(num, den), orders=orders).collect()}
    assert got == jaccard_classes(corpus, size, num, den)


def test_ngram_join_in_small_blocks(documents, corpus, monkeypatch):
    for name, value in (("PAIRED", 2), ("FEW", 400), ("MANY", 700), ("HEAVY_COUNT", 8)):
        monkeypatch.setattr(ngram_join, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(documents, shingle=3, similarity=(9, 10)).collect()}
    assert got == jaccard_classes(corpus, 3, 9, 10)


def test_ngram_join_deals_blocks_in_parts(documents, corpus, monkeypatch):
    for name, value in (("PAIRED", 2), ("FEW", 400), ("MANY", 700)):
        monkeypatch.setattr(ngram_join, name, value)
    dealt, real = [], ngram_join.Scratch.table

    def table(self, df, name):
        out = real(self, df, name)
        if name == "dealt":
            dealt.append(out.agg(F.sum("n")).head()[0])
        elif name.startswith("block_links"):
            dealt.append(name)
        return out

    monkeypatch.setattr(ngram_join.Scratch, "table", table)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(documents, shingle=3, similarity=(9, 10)).collect()}
    want = jaccard_classes(corpus, 3, 9, 10)
    assert got == want
    assert dealt[0] > 2 * sum(n for n, _ in want.values()) and dealt[0] <= (len(dealt) - 1) * sum(n for n, _ in want.values()), dealt


def test_written_tables_leave_no_shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {str(f) for f in [f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllFiles())] if f.startswith("shuffle")}
    before, scratch = files(), store.Scratch(spark, "cleaned")
    table = scratch.table(spark.range(20_000).groupBy((F.col("id") % 7_000).alias("k")).count(), "counts")
    for _ in range(100):  # files are removed in the background
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and table.count() == 7_000
    assert spark.conf.get(store._CLEANUP, None) is None
    scratch.only()


def test_ngram_join_odd_rows(spark, empty):
    assert ngram_join.ngram_jaccard_join(empty).count() == 0
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, None), (5, "")]
    got = sorted(ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(3, 3), (3, 3), (5, 5), (7, 3), (9, 9)]
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_words_follow_the_separators(corpus):
    import pyarrow as pa

    texts = list(corpus.values()) + ["a\x0bB\x1cc d  e"]
    for _, _, data, offsets in tokens.slices(pa.array(texts)):
        _, first, starts, ends = tokens.words(data, offsets)
        assert np.diff(first).tolist() == [len(words(t)) for t in texts]
        raw = data.tobytes()
        assert [raw[a:b].decode().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for a, b in zip(starts, ends, strict=True)] == [w for t in texts for w in words(t)]


def test_find_items(spark, documents, corpus):
    rng = np.random.default_rng(2)
    items = {k: " ".join(corpus[k].split()[5:35]) for k in range(5)} | {10: "nothing like it in any document at all here or there", 11: None, 12: "too short", 13: "two words", 14: "", 15: corpus[20].split()[3]}
    half = items[2].split()
    half[3] = "changed"
    items[20] = " ".join(half)
    items[21] = " ".join(rng.permutation(items[3].split()).tolist())
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    # An item of fewer than five words is one run of all of them.
    got = {(r.doc_id, r.item_id): r.shared / r.item_shingles for r in decontaminate.find_items(documents, bench).collect()}
    runs = lambda t, n: {tuple(w[i : i + n]) for w in [words(t)] for i in range(len(w) - n + 1)}
    want = {}
    for i, t in corpus.items():
        for k, q in items.items():
            n = min(5, len(words(q)))
            s = runs(q, n) if n else set()
            if s and len(s & runs(t, n)) >= 0.8 * len(s):
                want[i, k] = len(s & runs(t, n)) / len(s)
    assert got == pytest.approx(want) and len(got) >= 5
    assert decontaminate.find_items(documents.limit(0), bench).count() == 0


def covered(rows, ids):
    out = {i: set() for i in ids}
    for r in rows:
        out[r.doc_id].update(range(r.start_word, r.end_word))
    return out


def test_suffix_dedup(documents, corpus, empty):
    got = covered(suffix_dedup.repeated_passages(documents).collect(), corpus)
    want = repeated(corpus, 50)
    assert {i for i in got if got[i]} == {i for i in want if want[i]}
    assert all(got[i] <= want[i] for i in want)
    assert sum(len(want[i] - got[i]) for i in want) <= 0.01 * sum(map(len, want.values()))
    assert suffix_dedup.repeated_passages(empty).count() == 0


def test_compact_windows(documents, corpus, empty):
    got = covered(compact_windows.near_passages(documents).collect(), corpus)
    exact = repeated(corpus, 54)
    assert all(got[i] for i in exact if exact[i])
    own = [i for i in range(12, 60) if not exact[i]]
    assert own and not any(got[i] for i in own)
    assert compact_windows.near_passages(empty).count() == 0


def test_cartesian_tree_spans():
    rng = np.random.default_rng(3)
    for _ in range(30):
        v = rng.integers(1, 40, 200).astype(np.uint64)
        v[[0, 77, 199]] = 0
        got = sorted(zip(*(x.tolist() for x in compact_windows.tree_spans(v, 7)), strict=True))
        want = []
        for c in range(200):
            if v[c]:
                a, b = c, c
                while v[a - 1] > v[c]:
                    a -= 1
                while v[b + 1] >= v[c]:
                    b += 1
                if b - a + 1 >= 7:
                    want.append((c, a, b))
        assert got == sorted(want)


def test_extra_columns_and_ids(documents):
    clash = documents.withColumn("n", F.lit("x")).withColumn("id", F.lit(1)).withColumn("token", F.lit(2))
    assert ngram_join.ngram_jaccard_join(clash).count() == documents.count()
    suffix_dedup.repeated_passages(clash).count()


def test_windows_reach_as_far_as_they_go():
    import pyarrow as pa

    text = " ".join(f"w{i}" for i in range(1500))
    batch = pa.record_batch([pa.array([1]), pa.array([text])], names=["id", "text"])
    rows = pa.Table.from_batches(compact_windows._windows(46)(iter([batch]))).to_pandas()
    h, first, _, _ = next(([*tokens.words(data, offsets)] for _, _, data, offsets in tokens.slices(batch.column(1))))
    s, _ = tokens.shingles(h, first, compact_windows.SHINGLE)
    for kind, own in rows.groupby(rows.key & compact_windows._KIND):
        value = tokens.mix(s + np.uint64((kind + 1) * 0xA0761D6478BD642F & (1 << 64) - 1)) & np.uint64(~compact_windows._KIND & (1 << 64) - 1)
        for r in own.itertuples():
            lower = np.flatnonzero(value < value[r.c])
            assert (r.a, r.b) == (r.c - max(lower[lower < r.c], default=-1) - 1, min(lower[lower > r.c], default=len(value)) - r.c - 1)
    assert rows.a.max() > 127 and rows.b.max() > 127


def test_compact_windows_go_on_behind_an_edit(spark):
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 10**9, n)]
    texts = {}
    for parts in ((1000, 20, 154), (154, 20, 1000), (600, 12, 90), (400, 30, 60), (700, 1, 8, 1, 70)):  # shared and edited by turns
        x, y = [], []
        for k, n in enumerate(parts):
            w = word(n)
            x, y = x + w, y + (word(n) if k % 2 else w)
        texts |= {len(texts): x, len(texts) + 1: y}
    i, a, z = len(texts), word(200), word(200)
    texts |= {i: a + z, i + 1: a + word(150) + z}  # words put in on one side only
    texts = {k: " ".join(w) for k, w in texts.items()}
    got = covered(compact_windows.near_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect(), texts)
    want = repeated(texts, 50)
    missed = {k: len(want[k] - got[k]) for k in texts if want[k] - got[k]}
    assert not missed, f"{sum(missed.values())} of {sum(map(len, want.values()))} words: {missed}"
    assert got[i] == set(range(400)) and got[i + 1] == {*range(200), *range(350, 550)}


def test_stretches_are_the_longest_ones():
    rng = np.random.default_rng(4)
    for _ in range(200):
        hit = np.repeat(rng.random(12) < 0.5, rng.integers(1, 9, 12))
        total = np.concatenate([[0], np.cumsum(np.where(hit, 1.0, -2.0))])

        def longest(low, high, hit=hit, total=total):
            fit = [(j - i, -i, j) for i in range(low, high) for j in range(i + 1, high + 1) if hit[i] and hit[j - 1] and total[j] >= total[i]]
            n, i, j = max(fit, default=(0, 0, 0))
            return [] if n < 5 else [*longest(low, -i), (-i, j), *longest(j, high)]

        assert compact_windows._stretches(hit, 2.0, 5) == longest(0, len(hit))


def test_suffix_dedup_is_whole(spark):
    rng = np.random.default_rng(9)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 10**9, n)]
    line, left, texts = word(36), [word(30) for _ in range(6)], {}
    for k in range(60):  # one hot line, before which some have words in common and behind which others have
        texts[k] = word(int(rng.integers(0, 40))) + (left[k % 6] if k % 2 else []) + line + (left[(k // 6) % 6] if k % 3 else []) + word(int(rng.integers(0, 40)))
    texts |= {60: ["ha"] * 300, 61: word(20) + ["ha"] * 70 + word(20), 62: line * 3, 63: word(49), 64: word(50)}
    texts |= {65: texts[64] + word(1), 66: texts[63] + word(1)}
    texts = {k: " ".join(w) for k, w in texts.items()}
    got = covered(suffix_dedup.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect(), texts)
    want = repeated(texts, 50)
    missed, wrong = (sum(len(a[k] - b[k]) for k in texts) for a, b in ((want, got), (got, want)))
    assert (missed, wrong) == (0, 0), f"{missed} of {sum(map(len, want.values()))} words missed, {wrong} wrong"


def test_suffix_dedup_equals_brute_force(documents, corpus):
    twins = [i for i in corpus if corpus[i] is not None and list(corpus.values()).count(corpus[i]) > 1]
    got, want = covered(suffix_dedup.repeated_passages(documents).collect(), corpus), repeated(corpus, 50)
    assert {i: got[i] for i in corpus if i not in twins} == {i: want[i] for i in corpus if i not in twins}


@pytest.mark.parametrize(("families", "copies"), [(15, 2), (8, 6), (3, 20)])
def test_near_passages_of_families(spark, families, copies):
    rng = np.random.default_rng(copies)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 10**9, n)]
    passages, texts = {}, {}
    for _ in range(families):
        base = word(120)
        for _ in range(copies):
            p = list(base)
            for at in rng.choice(120, int(rng.integers(0, 4)), replace=False):
                p[at] = word(1)[0]
            passages[len(texts)] = (int(rng.integers(10, 60)), p)
            texts[len(texts)] = " ".join([*word(passages[len(texts)][0]), *p, *word(40)])
    five = {i: {tuple(p[k : k + 5]) for k in range(116)} for i, (_, p) in passages.items()}
    want = {i for i in texts if any(j != i and len(five[i] & five[j]) >= 0.8 * len(five[i] | five[j]) for j in texts if i // copies == j // copies)}
    got = covered(compact_windows.near_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect(), texts)
    found = {i for i in want if len(got[i] & set(range(passages[i][0], passages[i][0] + 120))) >= 60}
    assert len(want) >= 10 and len(found) >= 0.9 * len(want), (len(found), len(want))


def test_near_passages_stay_when_another_document_leads(spark):
    rng = np.random.default_rng(6)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 10**9, n)]
    texts = {}
    for _ in range(60):  # the second resembles the first and the third; the first and the third have no passage in common
        base = word(60)
        for edit in (15, None, 45):
            p = [w if k != edit else word(1)[0] for k, w in enumerate(base)]
            texts[len(texts)] = " ".join([*word(30), *p, *word(30)])
    found = lambda some: {r.doc_id for r in compact_windows.near_passages(spark.createDataFrame([(i, t) for i, t in texts.items() if i in some], "doc_id long, text string")).collect()}
    whole, third = found(set(texts)), {i for i in found({i for i in texts if i % 3}) if i % 3 == 2}
    assert len(third) >= 30 and third <= whole, (len(third), len(third - whole))


def test_a_common_line_makes_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(12)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 10**9, n)]
    line, base, texts = word(16), word(60), {}
    for k in range(80):  # all hold the line, and but for two of them nothing else
        texts[k] = " ".join([*(base[:30] if k in (40, 70) else word(30)), *line, *(base[30:] if k in (40, 70) else word(60))])
    sizes, real = [], compact_windows.passages.verified

    def verified(scratch, single, pairs, unit, check):
        sizes.append(pairs.count())
        return real(scratch, single, pairs, unit, check)

    monkeypatch.setattr(compact_windows.passages, "verified", verified)
    got = {r.doc_id for r in compact_windows.near_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {40, 70} and sum(sizes[1:]) <= 10, (got, sizes)  # a pair of any two would be 3,000


def test_a_common_line_a_little_shorter_than_a_passage_makes_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(14)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 10**9, n)]
    line = word(46)  # 42 shingles; with 4 misses beside them they would outweigh, but no stretch from hit to hit is long enough
    texts = {k: " ".join([*word(30), *line, *word(60)]) for k in range(80)}
    sizes, real = [], compact_windows.passages.verified

    def verified(scratch, single, pairs, unit, check):
        sizes.append(pairs.count())
        return real(scratch, single, pairs, unit, check)

    monkeypatch.setattr(compact_windows.passages, "verified", verified)
    assert compact_windows.near_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).count() == 0
    assert sum(sizes[1:]) == 0, sizes


def test_coverable_places_from_hit_to_hit():
    rng = np.random.default_rng(15)
    for _ in range(100):
        hit = np.repeat(rng.random(12) < 0.6, rng.integers(1, 9, 12))
        value = np.where(hit, 1.0, np.where(rng.random(len(hit)) < 0.3, 0.0, -2.0))
        want = np.zeros(len(hit), bool)
        for a in range(len(hit)):
            for b in range(a + 5, len(hit) + 1):
                if hit[a] and hit[b - 1] and value[a:b].sum() >= 0:
                    want[a:b] = True
        assert (compact_windows._coverable(value, 5, hit) == want).all()


def test_coverable_places():
    rng = np.random.default_rng(13)
    for _ in range(100):
        value = np.where(np.repeat(rng.random(12) < 0.6, rng.integers(1, 9, 12)), 1.0, -2.0)
        want = np.zeros(len(value), bool)
        for a in range(len(value)):
            for b in range(a + 5, len(value) + 1):
                if value[a:b].sum() >= 0:
                    want[a:b] = True
        assert (compact_windows._coverable(value, 5) == want).all()


def test_suffix_dedup_within_a_document(spark):
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 10**9, n)]
    a, b = word(70), word(49)
    texts = {0: " ".join([*a, *word(30), *a, *word(5)]), 1: " ".join([*b, *word(30), *b]), 2: " ".join(word(300))}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = sorted((r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.repeated_passages(table, within=True).collect())
    assert got == [(0, 0, 70), (0, 100, 170)] and suffix_dedup.repeated_passages(table).count() == 0
