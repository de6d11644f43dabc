"""Generated BDF+ files: samples, annotations and crops from the file alone, over several partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelark.sources import bdf

RATES = {"Fp1": 8, "Cz": 4}
NOTES = 30  # samples of the annotation channel in a record: 90 bytes


def write(path, records, notes, seconds=2.0, kind=b"BDF+C", starts=None, told=None, seed=0):
    """A file of so many records; notes: {record: bytes after its time}. The samples, by channel."""
    rng = np.random.default_rng(seed)
    data = {c: rng.integers(-(1 << 23), 1 << 23, (records, n)) for c, n in RATES.items()}
    labels = [*RATES, "BDF Annotations"]
    cell = lambda values, size: b"".join(str(v).encode().ljust(size) for v in values)
    head = b"\xffBIOSEMI".ljust(192) + kind.ljust(44) + str(records if told is None else told).encode().ljust(8) + f"{seconds:g}".encode().ljust(8) + b"3".ljust(4)
    head += cell(labels, 16) + cell([""] * 3, 80) + cell([""] * 3, 8) + cell([-1000, 0, -1], 8) + cell([1000, 50, 1], 8) + cell([-8388608] * 3, 8) + cell([8388607] * 3, 8) + cell([""] * 3, 80) + cell([*RATES.values(), NOTES], 8) + cell([""] * 3, 32)
    body = b""
    for r in range(records):
        for c in RATES:
            body += b"".join(int(v).to_bytes(3, "little", signed=True) for v in data[c][r])
        at = starts[r] if starts else r * seconds
        body += (f"+{at:g}".encode() + b"\x14\x14\0" + notes.get(r, b"")).ljust(3 * NOTES, b"\0")
    path.write_bytes(head + body)
    scale = {"Fp1": (-1000, 2000), "Cz": (0, 50)}
    return {c: (v.ravel() + 8388608) * (scale[c][1] / 16777215) + scale[c][0] for c, v in data.items()}


@pytest.fixture(scope="module")
def file(tmp_path_factory):
    folder = tmp_path_factory.mktemp("bdf")
    notes = {1: b"+3.25\x14start\x14\0", 2: b"+4.5\x150.5\x14go\x14also\x14\0-1\x14early\x14\0", 7: b"+15\x14start\x14\0+15.75\x14 stop \x14\0", 20: b"+41.5\x14stop\x14\0"}
    return folder / "s1.bdf", write(folder / "s1.bdf", 24, notes)


def test_samples_over_partitions(spark, file):
    path, data = file
    df = bdf.read_bdf(spark, str(path), split=500)
    assert df.rdd.getNumPartitions() > 5
    for c, want in data.items():
        got = df.where(F.col("channel") == c).orderBy("t_idx").toPandas()
        assert np.allclose(got.value, want) and np.allclose(got.time, np.arange(len(want)) * 2.0 / RATES[c]) and set(got.subject) == {"s1"}
    assert {r.channel for r in df.select("channel").distinct().collect()} == set(RATES)


def test_annotations(spark, file):
    got = sorted(tuple(r) for r in bdf.read_annotations(spark, str(file[0]), split=500).fillna(-9).collect())
    assert got == [("s1", -1.0, -9.0, "early"), ("s1", 3.25, -9.0, "start"), ("s1", 4.5, 0.5, "also"), ("s1", 4.5, 0.5, "go"), ("s1", 15.0, -9.0, "start"), ("s1", 15.75, -9.0, "stop"), ("s1", 41.5, -9.0, "stop")]


@pytest.mark.parametrize("split", [400, 1 << 20])
def test_crop_between_triggers(spark, file, split):
    path, data = file
    got = bdf.between_triggers(spark, str(path), "start", "stop", ["Fp1"], split).orderBy("t_idx").toPandas()
    t = np.arange(len(data["Fp1"])) / 4
    inside = (t >= 3.25) & (t <= 41.5)
    assert np.allclose(got.value, data["Fp1"][inside]) and np.allclose(got.time, t[inside] - 3.25) and got.t_idx.tolist() == list(range(inside.sum()))
    with pytest.raises(ValueError, match="missing"):
        bdf.between_triggers(spark, str(path), "start", "never")
    with pytest.raises(ValueError, match="not after"):
        bdf.between_triggers(spark, str(path), "stop", "start")


def test_only_the_records_of_a_span_are_planned(file):
    reader = bdf.BdfReader({"path": str(file[0]), "spans": '{"s1": [10.0, 13.0]}', "split": "1"})
    assert [(p.first, p.n) for p in reader.partitions()] == [(5, 1), (6, 1)]


def test_folder_gaps_and_unknown_length(spark, tmp_path):
    data = {k: write(tmp_path / f"{k}.bdf", 6, {0: b"+1\x14a\x14\0", 5: b"+9\x14b\x14\0"}, told=-1, seed=k) for k in (1, 2)}
    got = bdf.between_triggers(spark, str(tmp_path), "a", "b")
    assert {(r.subject, r["count"]) for r in got.groupBy("subject").count().collect()} == {("1", 33 + 17), ("2", 33 + 17)}
    assert np.allclose(got.where("subject = '2' and channel = 'Cz'").orderBy("t_idx").toPandas().value, data[2]["Cz"][2:19])
    starts = [0.0, 2.0, 10.0]
    write(tmp_path / "gap.bdf", 3, {}, kind=b"BDF+D", starts=starts)
    got = bdf.read_bdf(spark, str(tmp_path / "gap.bdf"), ["Cz"], split=1).orderBy("t_idx").toPandas()
    assert np.allclose(got.time, np.concatenate([s + np.arange(4) / 2 for s in starts]))
