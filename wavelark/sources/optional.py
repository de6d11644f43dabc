"""Readers of formats whose libraries are optional. Without the library, a call says what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelark.model import Region
from wavelark.operators import signal

_SCHEMA = "subject string, channel string, t_idx int, time double, value double"


def _rows(subject, names, time, data):
    """Batches of a (samples x channels) matrix."""
    import numpy as np
    import pyarrow as pa

    n = len(time)
    for k, name in enumerate(names):
        yield pa.record_batch([pa.array([subject] * n), pa.array([name] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.asarray(time, float)), pa.array(np.asarray(data[:, k], float))], names=["subject", "channel", "t_idx", "time", "value"])


def read_snirf(spark: SparkSession, path: str) -> DataFrame:
    """Raw intensities of SNIRF files, channels named S<source>_D<detector> <wavelength number>. Files that lack optional
    nodes are read all the same, and never changed."""
    try:
        import h5py  # noqa: F401
    except ImportError as e:
        raise ImportError("reading SNIRF needs h5py") from e

    def parse(batches):
        import io

        import h5py

        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with h5py.File(io.BytesIO(raw.as_py()), "r") as f:
                    block = f["nirs"]["data1"]
                    lists = [block[k] for k in sorted((k for k in block if k.startswith("measurementList")), key=lambda k: int(k[15:]))]
                    names = [f"S{int(m['sourceIndex'][()])}_D{int(m['detectorIndex'][()])} {int(m['wavelengthIndex'][()])}" for m in lists]
                    yield from _rows(name, names, block["time"][()].ravel(), block["dataTimeSeries"][()])

    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/.]+)[^/]*$", 1), "content").mapInArrow(parse, _SCHEMA)


def read_matlab(spark: SparkSession, path: str, labels: list[str | None], names: list[str], crops: dict[str, Region] | None = None, shift: float = 0.0) -> DataFrame:
    """Subjects of a `Homer_Data` struct: scaled by 1,000, cropped (ends included) where a region is given, with time
    from the first sample kept plus the shift, and z-scored. A label of None leaves a subject out."""
    try:
        import scipy.io  # noqa: F401
    except ImportError as e:
        raise ImportError("reading MATLAB files needs scipy") from e

    def parse(batches):
        import io

        import scipy.io

        for batch in batches:
            for raw in batch.column(0):
                data = scipy.io.loadmat(io.BytesIO(raw.as_py()), squeeze_me=True, struct_as_record=False)["Homer_Data"]
                for label, one in zip(labels, data, strict=False):
                    if label is not None:
                        yield from _rows(label, names, one.t, one.d)

    sig = spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, _SCHEMA)
    for label, region in (crops or {}).items():
        sig = sig.where((F.col("subject") != label) | F.col("time").between(region.start_sec, region.end_sec))
    return signal.z_score(signal.rebase(signal.scale(sig, 1e3), shift))
