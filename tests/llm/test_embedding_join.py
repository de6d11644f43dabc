import numpy as np
import pytest
from brute import classes
from pyspark.sql import functions as F

from wavelark.llm import embedding_join, queries

SCHEMA = "vec_id long, embedding array<{kind}>, label int, g string, pos long, root string"


def table(spark, rows, kind="double"):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA.format(kind=kind))


def restated(rows, cosine):
    """(n_links, component) of each row, by all pairs."""
    ok = [k for k, (i, v, g) in enumerate(rows) if i is not None and g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for n, a in enumerate(ok):
        for b in ok[:n]:
            x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if rows[a][2] == rows[b][2] and len(x) == len(y):
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links.append((b, a))
    root = classes(range(len(rows)), links)
    least = {}
    for k in range(len(rows)):
        if rows[k][0] is not None:
            least[root[k]] = min(rows[k][0], least.get(root[k], rows[k][0]))
    degree = [0] * len(rows)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    return [(i, degree[k], None if i is None else least[root[k]], None if i is None else least[root[k]] == i) for k, (i, _, _) in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    rng, out = np.random.default_rng(3), []
    add = lambda v, g: out.append((len(out), np.asarray(v).tolist(), g))
    for g in range(3):
        for v in rng.normal(size=(60, 12)):
            add(v, g)
        centre = rng.normal(size=12)
        for v in centre + 0.05 * rng.normal(size=(80, 12)):  # a tight group: whole intervals lie within eps
            add(v, g)
        for t in np.linspace(0, 2, 70):  # a chain: linked through each other only
            add([np.cos(t), np.sin(t)] + [0.0] * 10, g)
        for v in centre + 0.25 * rng.normal(size=(60, 12)):
            add(v, g)
        for _ in range(15):
            add(centre, g)
            add(3 * centre, g)
    for v in rng.normal(size=(30, 5)):  # another length
        add(v, 1)
        add(v * 1e-200, 1)
        add(v * 1e200, 1)
    for v, g in [([], 1), (None, 1), ([0.0] * 12, 1), ([1.0, None] * 6, 1), ([float("nan")] * 12, 1), ([float("inf")] + [1.0] * 11, 1), ([1.0] * 12, None), ([-0.0, 1.0], 2), ([0.0, 1.0], 2)]:
        out.append((len(out), v, g))
    return [*out, (5, out[7][1], 0), (5, out[5][1], 0), (None, out[3][1], 0)]


@pytest.mark.parametrize(("block", "fan"), [(512, 8), (16, 2), (7, 3)])
def test_join_equals_all_pairs(spark, rows, block, fan, monkeypatch):
    monkeypatch.setattr(embedding_join, "BLOCK", block)
    monkeypatch.setattr(embedding_join, "FAN", fan)
    got = embedding_join.near_vectors(table(spark, rows).repartition(4), 0.98).collect()
    assert sorted(map(tuple, got), key=str) == sorted(restated(rows, 0.98), key=str)
    assert max(r.n_links for r in got) > 80


def test_join_without_broadcasts(spark, rows, monkeypatch):
    monkeypatch.setattr(embedding_join, "BLOCK", 16)
    monkeypatch.setattr(embedding_join, "BROADCAST_BYTES", 0)
    got = embedding_join.near_vectors(table(spark, rows), 0.9).collect()
    assert sorted(map(tuple, got), key=str) == sorted(restated(rows, 0.9), key=str)


def test_query_on_floats(spark, rows, tmp_path):
    small = [(i, v and [None if x is None else float(np.float32(x)) for x in v], g) for i, v, g in rows if v is None or len(v) != 5]
    table(spark, small, "float").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.queries()["op12_embedding_join"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(restated(small, 0.98), key=str)


def test_tight_intervals_are_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "BLOCK", 16)
    seen = []
    plain = embedding_join._whole
    monkeypatch.setattr(embedding_join, "_whole", lambda levels, dense, blocks: seen.append(sum(d.count() for d in dense)) or plain(levels, dense, blocks))
    rng = np.random.default_rng(1)
    x = np.ones(8) + 0.01 * rng.normal(size=(600, 8))
    got = embedding_join.near_vectors(table(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])).collect()
    assert all((r.n_links, r.component_id, r.kept) == (599, 0, r.vec_id == 0) for r in got) and len(got) == 600
    assert seen == [1]


def test_far_blocks_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "BLOCK", 32)
    seen = []
    plain = embedding_join._descend
    monkeypatch.setattr(embedding_join, "_descend", lambda *a: (found := plain(*a), seen.append(found[0].count()))[0])
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = np.repeat(centres, 32, 0) + 0.02 * rng.normal(size=(1280, 16))
    got = embedding_join.near_vectors(table(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]))
    assert got.agg(F.min("n_links")).head()[0] >= 31
    assert seen[0] < 40 * 41 / 2 / 3


def test_no_rows(spark):
    assert embedding_join.near_vectors(table(spark, []).limit(0)).count() == 0
    got = embedding_join.near_vectors(table(spark, [(4, None, 1), (None, [1.0], 1)])).collect()
    assert sorted(map(tuple, got), key=str) == [(4, 0, 4, True), (None, 0, None, None)]
