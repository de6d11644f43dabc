"""BDF and BDF+ recordings as a Spark data source: 24-bit samples and time-stamped annotation lists.

A file's records are of one size, so its byte range is dealt into partitions of whole records; each task seeks to its own
and reads no more. The header is read once, when the partitions are planned. Files are opened by path, or, for other stores, by
Arrow's file systems.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wavelark.operators import signal

#: Label of the channel whose bytes are annotation lists.
ANNOTATIONS = "BDF Annotations"
#: Bytes of a partition.
SPLIT = 32 << 20
_SAMPLES = "subject string, channel string, t_idx int, time double, value double"
_LISTS = "subject string, onset double, duration double, text string"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path and not path.startswith("file://"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file://").removeprefix("file:"))


@dataclass
class Layout:
    """What a header says. Records without a number in the header are counted by the file's size."""

    labels: list[str]
    low: list[float]
    high: list[float]
    digital_low: list[float]
    digital_high: list[float]
    per: list[int]
    seconds: float
    records: int
    start: int
    gaps: bool

    @property
    def record_bytes(self) -> int:
        return 3 * sum(self.per)

    @classmethod
    def read(cls, file: BinaryIO, size: int) -> Layout:
        fixed = file.read(256)
        n = int(fixed[252:256])
        rest = file.read(256 * n)
        if len(fixed) + len(rest) < 256 * (n + 1):
            raise ValueError("the header is cut off")

        def cells(at: int, width: int) -> list[str]:
            return [rest[at * n + k * width : at * n + (k + 1) * width].decode("latin-1").strip() for k in range(n)]

        numbers = lambda at: [float(x) for x in cells(at, 8)]
        per, start, told = [int(x) for x in cells(216, 8)], 256 * (n + 1), int(fixed[236:244])
        there = (size - start) // (3 * sum(per))
        return cls(cells(0, 16), numbers(104), numbers(112), numbers(120), numbers(128), per, float(fixed[244:252]), there if told < 0 else min(told, there), start, fixed[192:197] == b"BDF+D")


def annotation_lists(raw: bytes) -> Iterator[tuple[float, float | None, str]]:
    """(onset, duration, text) of a channel's bytes in one record. Each list is an onset, perhaps a duration after 0x15, texts that each end
    with 0x14, and a zero byte; the list without a text that opens a record tells its time."""
    for part in raw.split(b"\0"):
        fields = part.split(b"\x14")
        head, _, length = fields[0].partition(b"\x15")
        if head[:1] in (b"+", b"-"):
            for text in fields[1:-1] or [b""]:
                yield float(head), float(length) if length else None, text.decode("utf-8", "replace").strip()


@dataclass
class Records(InputPartition):
    path: str
    subject: str
    layout: Layout
    first: int
    n: int


class BdfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.what = options["path"], options.get("what", "samples")
        self.split = int(options.get("split", SPLIT))
        self.channels = json.loads(options["channels"]) if "channels" in options else None
        self.spans = json.loads(options.get("spans", "{}"))

    def partitions(self) -> list[InputPartition]:
        store, path = _store(self.path)
        info = store.get_file_info(path)
        files = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(path)) if f.is_file and f.path.lower().endswith(".bdf")]
        out: list[InputPartition] = []
        for f in sorted(files, key=lambda f: f.path):
            with store.open_input_file(f.path) as file:
                layout = Layout.read(file, f.size)
            subject, low, high = os.path.basename(f.path).split(".")[0], 0, layout.records
            if subject in self.spans and not layout.gaps:  # records outside the span aren't read
                a, b = self.spans[subject]
                low, high = max(0, int(a // layout.seconds)), min(high, int(b // layout.seconds) + 1)
            each = max(1, self.split // layout.record_bytes)
            prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
            out += [Records(prefix + f.path, subject, layout, k, min(each, high - k)) for k in range(low, high, each)]
        return out

    def read(self, part: Records) -> Iterator[pa.RecordBatch]:
        lay = part.layout
        store, path = _store(part.path)
        with store.open_input_file(path) as file:
            file.seek(lay.start + part.first * lay.record_bytes)
            raw = np.frombuffer(file.read(part.n * lay.record_bytes), np.uint8).reshape(part.n, lay.record_bytes)
        ends = np.cumsum([3 * p for p in lay.per])
        piece = lambda k: raw[:, ends[k] - 3 * lay.per[k] : ends[k]]
        notes = [k for k, name in enumerate(lay.labels) if name == ANNOTATIONS]
        if self.what == "annotations":
            rows = [(part.subject, *x) for r in range(part.n) for k in notes for x in annotation_lists(piece(k)[r].tobytes()) if x[2]]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.string()))], names=["subject", "onset", "duration", "text"])
            return
        began = None
        if lay.gaps and notes:  # the first list of a record tells when it began
            began = np.array([next(annotation_lists(piece(notes[0])[r].tobytes()))[0] for r in range(part.n)])
        for k, name in enumerate(lay.labels):
            if k in notes or self.channels is not None and name not in self.channels:
                continue
            low = piece(k).reshape(-1, 3).astype(np.int32)
            value = low[:, 0] | low[:, 1] << 8 | low[:, 2] << 16
            value = np.where(value >= 1 << 23, value - (1 << 24), value)
            value = (value - lay.digital_low[k]) * ((lay.high[k] - lay.low[k]) / (lay.digital_high[k] - lay.digital_low[k])) + lay.low[k]
            at = part.first * lay.per[k] + np.arange(len(value))
            time = at * (lay.seconds / lay.per[k]) if began is None else np.repeat(began, lay.per[k]) + at % lay.per[k] * (lay.seconds / lay.per[k])
            for a in range(0, len(value), 65_536):
                s = slice(a, a + 65_536)
                n = len(at[s])
                yield pa.record_batch([pa.array([part.subject] * n), pa.array([name] * n), pa.array(at[s].astype(np.int32)), pa.array(time[s]), pa.array(value[s])], names=["subject", "channel", "t_idx", "time", "value"])


class Bdf(DataSource):
    """Options: path (a file, or a folder of .bdf files), what (samples or annotations), channels and spans (JSON), split (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "bdf"

    def schema(self) -> str:
        return _LISTS if self.options.get("what") == "annotations" else _SAMPLES

    def reader(self, schema) -> DataSourceReader:
        return BdfReader({k: v for k, v in self.options.items()})


def _load(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(Bdf)
    reader = spark.read.format("bdf")
    for name, value in options.items():
        if value is not None:
            reader = reader.option(name, value if isinstance(value, str) else json.dumps(value))
    return reader.load(path)


def read_bdf(spark: SparkSession, path: str, channels: list[str] | None = None, spans: dict[str, tuple[float, float]] | None = None, split: int = SPLIT) -> DataFrame:
    """(subject, channel, t_idx, time, value) of a file or a folder of files; the file's name tells the subject. spans: seconds of a
    subject's file of which only the records are read."""
    return _load(spark, path, channels=channels, spans=spans, split=str(split))


def read_annotations(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(subject, onset, duration, text): what the annotation channels say, times of records left out."""
    return _load(spark, path, what="annotations", split=str(split))


def between_triggers(spark: SparkSession, path: str, first: str, last: str, channels: list[str] | None = None, split: int = SPLIT) -> DataFrame:
    """Each file from its first annotation `first` to its last `last`, both ends included, with time and t_idx from 0. A file
    without one of them, or with them out of order, is an error. A row a file is collected to tell the readers which records they need."""
    notes = read_annotations(spark, path, split)
    told = notes.groupBy("subject").agg(F.min(F.when(F.col("text") == first, F.col("onset"))).alias("a"), F.max(F.when(F.col("text") == last, F.col("onset"))).alias("b")).collect()
    if not told:
        raise ValueError(f"trigger {first} is missing")
    for r in told:
        if r.a is None or r.b is None:
            raise ValueError(f"{r.subject}: trigger {first if r.a is None else last} is missing")
        if r.b <= r.a:
            raise ValueError(f"{r.subject}: the last trigger is not after the first")
    spans = {r.subject: (r.a, r.b) for r in told}
    sig = read_bdf(spark, path, channels, spans, split)
    ends = F.broadcast(spark.createDataFrame([(k, a, b) for k, (a, b) in spans.items()], "subject string, a double, b double"))
    cut = sig.join(ends, "subject").where(F.col("time").between(F.col("a"), F.col("b"))).drop("a", "b")
    from0 = cut.groupBy("subject", "channel").agg(F.min("t_idx").alias("_first"))  # a row a series
    return signal.rebase(cut.join(from0, ["subject", "channel"]).withColumn("t_idx", F.col("t_idx") - F.col("_first")).drop("_first"))
