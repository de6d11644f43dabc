"""Streamed runs and masks equal the batch operators', with rows that come late and out of order."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelark.operators import segments
from wavelark.streaming import windows

BASE = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
SCHEMA = "subject string, channel string, ts timestamp, value double"


@pytest.fixture(scope="module")
def samples():
    rng = np.random.default_rng(4)
    return [(s, c, k, float(np.round(v, 3))) for s in "ab" for c in ("x", "y") for k, v in enumerate(np.cumsum(rng.normal(size=120)))]


def streamed(spark, samples, folder, name, **options):
    """Batches of 30 samples; within 40 seconds rows are dealt out of order, over the borders of batches."""
    rng = np.random.default_rng(5)
    late = sorted(samples, key=lambda r: r[2] + rng.uniform(0, 40))
    end = [(s, c, 1000, 0.0) for s in "ab" for c in ("x", "y")]  # moves the watermark past all others
    for b, part in enumerate([*(late[k : k + 120] for k in range(0, len(late), 120)), end, [(s, c, 1001, -1.0) for s, c, _, _ in end]]):
        rows = [(s, c, BASE + dt.timedelta(seconds=k), v) for s, c, k, v in part]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in/{b:02d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    out = windows.stream_trends(stream, ("subject", "channel"), 2.0, "60 seconds", **options)
    out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination(240)
    return spark.table(name)


def batch(spark, samples):
    base = BASE.timestamp()
    return spark.createDataFrame([(s, c, k, base + k, v) for s, c, k, v in samples], "subject string, channel string, t_idx int, time double, value double")


@pytest.mark.parametrize("rising", [True, False])
def test_runs(spark, samples, tmp_path, rising):
    got = streamed(spark, samples, str(tmp_path), f"runs_{rising}", rising=rising).where(F.col("end_sec") < BASE.timestamp() + 119)
    want = segments.trends(batch(spark, samples), rising, 2.0).where(F.col("end_sec") < BASE.timestamp() + 119)
    key = lambda df: sorted((r.subject, r.channel, r.start_sec, r.end_sec, round(r.height, 6)) for r in df.collect())
    assert len(key(want)) > 5 and key(got) == key(want)


def test_mask_and_density(spark, samples, tmp_path):
    got = streamed(spark, samples, str(tmp_path), "masked", mask=True).where(F.col("time") < BASE.timestamp() + 110)
    sig = batch(spark, samples)
    want = segments.mask(sig, segments.trends(sig, True, 2.0)).where(F.col("time") < BASE.timestamp() + 110)
    key = lambda df: sorted((r.subject, r.channel, r.time, r.active) for r in df.collect())
    assert key(got) == key(want) and sum(r[3] for r in key(got)) > 20
    rows = got.select(F.timestamp_seconds("time").alias("ts"), F.concat("subject", "channel").alias("event_type"), "active")
    dense = windows.sliding_density(rows, "10 seconds", "5 seconds", "1 second", active=F.col("active") == 1)
    for r in dense.collect():
        inside = [x for x in key(want) if r.window.start.timestamp() <= x[2] < r.window.end.timestamp()]
        assert r.n_events == len(inside) and r.n_active == len({x[:2] for x in inside if x[3]})
