import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import make

from wavelark.model import Region, WindowSpec
from wavelark.plans import pipelines
from wavelark.sources import dataset, files, optional


@pytest.fixture(scope="module")
def sim(spark):
    return files.simulated(spark, ["A", "B", "C"], 4, 10, 30).cache()


def test_similarity(spark, sim):
    first = sim.select("subject", "channel").where("channel = 'ch001'").distinct()
    got = pipelines.similarity(sim, first, WindowSpec(2, step=1), Region(center_sec=15, length_sec=10), 10)
    assert got.count() == 9
    flat = pipelines.similarity(sim, first, region=Region(center_sec=15, length_sec=10))
    assert flat.select("score").distinct().count() == 1 and flat.count() == 100
    with pytest.raises(ValueError, match="No data"):
        pipelines.similarity(sim, first, region=Region(start_sec=100, end_sec=200))


def test_preprocess_and_quality(spark):
    rng = np.random.default_rng(0)
    base = 100 + np.cumsum(rng.normal(size=300)) * 0.1
    raw = make(spark, {("a", "S1_D1"): base}).withColumn("wavelength", F.lit("760")).union(make(spark, {("a", "S1_D1"): base * 1.1}).withColumn("wavelength", F.lit("850")))
    out = pipelines.preprocess(raw, 1.0, {"760": (1.5, 3.8), "850": (2.5, 1.8)}, Region(start_sec=50, end_sec=200), 20, (0.01, 0.2)).toPandas()
    assert out.time.min() == 50 and out.time.max() == 200 and abs(out.value.mean()) < 1e-9 and math.isclose(out.value.std(ddof=0), 1)
    pairs = make(spark, {("a", "c"): base}).select("subject", "channel", "time", F.col("value").alias("x"), (F.col("value") * 2).alias("y"))
    report = pipelines.quality_report(pairs)
    assert report["windows"].count() == 5 and report["bad_share"].head().bad_share == 0


def test_event_statistics(spark, sim):
    onsets = spark.createDataFrame([(0, "on", 8.0), (1, "on", 15.0), (2, "off", 100.0)], "event int, label string, onset double")
    got = pipelines.event_statistics(sim, onsets, WindowSpec(2, step=1), 10, 5, 5, 10)
    assert got["means"].count() == 2 and got["t"].head().n == 2 and got["series"].where("correlation < 0").count() == 0


def test_dataset_folder_and_cache(spark, tmp_path):
    (tmp_path / "hbo").mkdir()
    (tmp_path / "marker").mkdir()
    for name in ("b.csv", "a.csv"):
        (tmp_path / "hbo" / name).write_text("c1,c2,time\n" + "".join(f"{i},{i},{i}\n" for i in range(5)))
    (tmp_path / "marker" / "marker.csv").write_text("start_sec,length_sec\n1,2\n")
    sig, marks = dataset.load(spark, str(tmp_path))
    assert sig.count() == 20 and marks.count() == 1
    one = dataset.cached(spark, str(tmp_path), str(tmp_path / "cache"))
    assert one.count() == 20 and dataset.cached(spark, str(tmp_path), str(tmp_path / "cache")).count() == 20
    assert len(list((tmp_path / "cache").iterdir())) == 1


def test_exports(spark):
    trig = spark.createDataFrame([(2.0, 7), (1.0, 5)], "onset double, code int")
    assert [tuple(r) for r in dataset.events_table(trig, 10).collect()] == [(1, 10, 5), (2, 20, 7)]
    s = spark.createDataFrame([("a", 1.0, 3.0, 2.0, 5)], "subject string, start_sec double, end_sec double, highest_time double, highest_value long")
    st = spark.createDataFrame([("a", 1.0, "c1", 1), ("a", 1.0, "c2", 0)], "subject string, start_sec double, channel string, active int")
    assert tuple(dataset.segments_table(s, st, ["c1", "c2"]).head()) == ("a", 1.0, 3.0, 2.0, 2.0, 2.0, 5, 1, 0)
    with pytest.raises(Exception, match="unknown channel"):
        dataset.display_names(spark.createDataFrame([("zz",)], "channel string"), spark.createDataFrame([("c1", 4)], "channel string, channel_idx int")).collect()


def test_triggers(spark, sim):
    t = spark.createDataFrame([(5.0, 1), (6.0, 1), (9.0, 2), (12.0, 2)], "onset double, code int")
    got = files.crop_between_triggers(sim, t, 1, 2).agg(F.min("time").alias("a"), F.max("time").alias("b")).head()
    assert 5 <= got.a < 5.2 and 11.8 < got.b <= 12
    with pytest.raises(ValueError, match="missing"):
        files.crop_between_triggers(sim, t, 1, 3)
    with pytest.raises(ValueError, match="not after"):
        files.crop_between_triggers(sim, t, 2, 1)


def test_optional_readers_say_what_is_missing(spark):
    for read, args, module in ((optional.read_snirf, ("x.snirf",), "h5py"), (optional.read_matlab, ("x.mat", ["a"], ["c"]), "scipy")):
        try:
            __import__(module)
        except ImportError:
            with pytest.raises(ImportError, match=module):
                read(spark, *args)
