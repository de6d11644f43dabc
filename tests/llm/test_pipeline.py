import os

import pytest

import corpus_pipeline
from brute import jaccard_classes

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == corpus_pipeline.STAGES[-1][0]:
            assert {r.doc_id for r in docs.collect()} == set(before)
            continue
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert after.keys() <= before.keys()
        if name == "ngram_jaccard_join":
            assert set(after) == {i for i, (_, c) in jaccard_classes(before, 5, 4, 5).items() if c == i}
        if name == "secret_scans":
            assert after.keys() == before.keys()
        before = after


def test_odd_rows_in_every_stage(spark, tmp_path):
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    good, item, long = text(80), text(30), text(30_000)
    near = good.replace(good.split()[40], "changed", 1)
    rows = [(5, good), (None, near), (7, near), (7, f"{text(40)} {item} {text(40)}"), (None, f"{text(20)} {item}"), (8, None), (9, ""), (10, long), (11, long + " token=abcDEF1234567890"), (5, good), (12, text(50)), (12, text(60))]
    columns = "doc_id long, text string, lang string, source string, n_chars long, key string, score double, k int"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 0.5, 1) for i, t in rows], columns)
    spark.createDataFrame([(1, item), (None, text(30)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1) for i in (5, 7, 12)] + [(None, 0), (99, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = {name: stages[name](spark, docs, str(tmp_path)) for name in list(stages)[:4]}
    assert all(df.columns == docs.columns for df in kept.values())
    of = lambda name: sorted(((r.doc_id, r.text) for r in kept[name].collect()), key=str)
    assert len(of("quality_classifier")) == len(rows)
    assert of("ngram_jaccard_join") == sorted((r for r in rows if r != (None, near) and r != (7, near) and r[0] != 11), key=str)
    assert of("benchmark_decontamination") == sorted((r for r in rows if item not in (r[1] or "")), key=str)
    assert [t for i, t in of("secret_scans") if i == 11] == [long + " [SECRET]"] and len(of("secret_scans")) == len(rows)
    assert stages["byte_level_bpe"](spark, docs, str(tmp_path)).where("doc_id = 8 or doc_id = 9").agg({"n_tokens": "sum"}).head()[0] == 0
    for name, stage in stages.items():
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_whole_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
