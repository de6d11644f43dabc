"""The registered queries, with their production parameters, against plain restatements of their contracts."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from brute import jaccard_classes, repeated

from wavelark.llm import queries

KINDS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)


@pytest.fixture(scope="module")
def texts(corpus):
    rng = random.Random(3)
    out = dict(corpus)
    for k in range(40):
        hexa, caps = "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(10, 40))), "".join(rng.choice("ABCDEFG234567") for _ in range(rng.randint(8, 24)))
        out[len(out)] = f"Some text é {k} with {rng.choice(['token', 'API_KEY', 'passwd'])}{rng.choice(['=', ': ', chr(34) + ' = '])}{caps} and {hexa}, AKIA{caps} tail"
    out[len(out)] = "word " * 60_000  # a very long text
    return out


@pytest.fixture(scope="module")
def tables(spark, texts, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(1)
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", 1) for i, t in texts.items()] + [(None, "a text without an id", None, None, None, None, None), (3, texts[3], "en", "s", 1, "x", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, score int").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, " ".join(str(texts[k]).split()[3:40])) for k in range(6)] + [(9, None), (10, "three short words")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, int(zlib.crc32(str(texts[i]).encode()) % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    x = rng.normal(size=(500, 24))
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(f"{d}/embeddings.parquet")
    pages = ["http://a.b.net/x", "https://www.EXAMPLE.net/en/1?x", "http://m.example.com/de/", "no scheme", None, "", "http://x.org/fr/y#z", "http://x.org/fr", "ftp://h?q", "http://net/", "a://b://c/d"]
    spark.createDataFrame([(i, u, "") for i, u in enumerate(pages)] + [(0, "http://again.org/", "")], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d, x, pages


def run(spark, tables, name):
    return queries.queries()[name](spark, tables[0]).toPandas()


def test_op1(spark, tables, texts):
    got = run(spark, tables, "op1_ngram_jaccard_join")
    want = jaccard_classes(texts, 3, 9, 10)
    known = got[got.doc_id.notna()]
    assert {(int(r.doc_id), r.n_shingles, int(r.component_id)) for r in known.itertuples()} == {(i, n, c) for i, (n, c) in want.items()}
    assert len(got) == len(texts) + 2 and got[got.doc_id.isna()].component_id.isna().all()


def test_op2(spark, tables):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{tables[0]}/{name}.parquet/*.parquet'")
    want = con.sql(queries.oracle_sql()["op2_decontaminate"]).df()
    got = run(spark, tables, "op2_decontaminate")
    key = ["doc_id", "item_id", "item_shingles", "shared"]
    assert len(want) > 5 and sorted(map(tuple, got[key].astype(int).values.tolist())) == sorted(map(tuple, want[key].astype(int).values.tolist()))


def test_op3(spark, tables, texts):
    got = run(spark, tables, "op3_balanced_shards")
    n = got.groupby("shard").size()
    assert len(got) == len(texts) + 2 and set(n.index) <= set(range(40)) and (got.law == "rows").all() and got.grown_shard.isna().all()
    assert n.max() - n.reindex(range(40), fill_value=0).min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    for r in got[got.doc_id.notna()].itertuples():
        raw = (texts[int(r.doc_id)] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))


def test_op4(spark, tables):
    got, x = run(spark, tables, "op4_nearest_neighbours"), tables[1]
    hit = 0
    for q in range(0, 500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and np.allclose(mine.score, d[mine.vec_id]) and (np.diff(mine.score) >= 0).all()
        hit += len(set(np.argsort(d)[:10]) & set(mine.vec_id))
    assert hit >= 45 and got.query_id.nunique() == 5


def test_op5_and_op9(spark, tables, texts):
    want = repeated({i: t for i, t in texts.items()}, 50)
    twins = {i for i in texts if texts[i] is not None and list(texts.values()).count(texts[i]) > 1}
    got = {i: set() for i in texts}
    for r in run(spark, tables, "op5_suffix_dedup").itertuples():
        got[r.doc_id].update(range(r.start_word, r.end_word))
    assert {i: got[i] for i in texts if i not in twins} == {i: want[i] for i in texts if i not in twins}
    near = set(run(spark, tables, "op9_compact_windows").doc_id)
    assert {i for i in texts if len(want[i]) > 53} <= near


def test_op6_round_trip(spark, tables, texts):
    got = run(spark, tables, "op6_byte_level_bpe")
    assert len(got) == len(texts) + 2
    for r in got[got.doc_id.notna()].itertuples():
        assert r.decoded_sha256 == hashlib.sha256((texts[int(r.doc_id)] or "").encode()).hexdigest()


def test_op7(spark, tables, texts):
    got = run(spark, tables, "op7_quality_classifier")
    assert len(got) == len(texts) + 2 and got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    known = got[got.doc_id.notna()]
    assert all(bool(r.held_out) == (zlib.crc32(str(int(r.doc_id)).encode()) % 4 == 2) for r in known.itertuples())


def test_op8_base_columns(spark, tables, texts):
    got = run(spark, tables, "op8_secret_scan")
    assert len(got) == len(texts) + 2 and got.n_hex.sum() > 5 and got.n_access.sum() > 5 and got.n_assign.sum() > 5
    for r in got[got.doc_id.notna()].itertuples():
        text = texts[int(r.doc_id)] or ""
        found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, group, least) in enumerate(KINDS) for m in p.finditer(text) if len(m.group(group)) >= least]
        base = ",".join(s for _, _, s in sorted(found))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in found) for j in range(3))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("model")] == [s for s in base.split(",") if s]


def test_op10(spark, tables):
    got, rules = run(spark, tables, "op10_url_filter"), (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
    pages = list(enumerate(tables[2])) + [(0, "http://again.org/")]
    assert len(got) == len(pages)
    for i, url in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m.group(1).lower(), m.group(2)) if m else ("", "")
        fit = sorted(((len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), reverse=True)
        row = next(r for r in got[got.page_id == i].itertuples() if r.host == host and r.path == path)
        assert row.rule == (fit[0][1] if fit else None) and (not fit or row.verdict == fit[0][2]) and row.verdict in ("allow", "block")
