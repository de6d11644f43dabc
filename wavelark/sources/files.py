"""Readers and writers of the toolkit's file formats. Files are read by Spark; headers decide the columns."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavelark.operators import signal


def file_label(path: Column) -> Column:
    """A file's name up to its first dot."""
    return F.regexp_extract(path, r"([^/.]+)[^/]*$", 1)


def numbered(df: DataFrame, name: str = "t_idx") -> DataFrame:
    """df with the rows of its files numbered from 0 in file order: each scan task counts its own, and offsets come from the
    tasks' counts."""
    df = df.withColumn("_at", F.monotonically_increasing_id())  # the task in the upper bits, its row in the lower 33
    task = F.shiftright("_at", 33)
    counts = df.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))  # a row a task
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_task", before.alias("_before"))
    row = F.col("_before") + F.col("_at") - F.shiftleft(F.col("_task"), 33)
    return df.withColumn("_task", task).join(F.broadcast(offsets), "_task").withColumn(name, row.cast("int")).drop("_at", "_task", "_before")


def read_subject(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """One wide CSV (a column a channel, `time` by name or else last) as a tidy signal in file order."""
    wide = spark.read.csv(path, header=True, inferSchema=False)
    time = "time" if "time" in wide.columns else wide.columns[-1]
    names = [c for c in wide.columns if c != time]
    numbers = wide.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in names), F.col(f"`{time}`").cast("double").alias("time"))
    numbers = numbered(numbers)
    subject = label or PurePosixPath(path).name.split(".")[0]
    return numbers.unpivot(["t_idx", "time"], names, "channel", "value").select(F.lit(subject).alias("subject"), "channel", "t_idx", "time", "value")


def read_dataset(spark: SparkSession, paths: list[str], align: bool = True) -> DataFrame:
    """Several subjects' files, cut to the shortest and put on the first one's time axis."""
    parts = [read_subject(spark, p) for p in sorted(paths)]
    if not parts:
        raise ValueError("no files")
    sig = parts[0]
    for p in parts[1:]:
        sig = sig.unionByName(p)
    return signal.align(sig) if align else sig


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(start, value, duration, label) from either form of annotation file; empty if the file has neither's columns."""
    raw = spark.read.csv(path, header=True)
    if {"TIME", "DURATION", "LABEL", "VALUE"} <= set(raw.columns):
        return raw.select(F.col("TIME").cast("double").alias("start"), F.col("VALUE").cast("int").alias("value"), F.col("DURATION").cast("double").alias("duration"), F.col("LABEL").alias("label"))
    if {"start_sec", "length_sec"} <= set(raw.columns):
        return raw.select(F.col("start_sec").cast("double").alias("start"), F.lit(0).alias("value"), F.col("length_sec").cast("double").alias("duration"), F.lit("None").alias("label"))
    return spark.createDataFrame([], "start double, value int, duration double, label string")


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True).select(F.col("start_sec").cast("double"), F.col("length_sec").cast("double"))
    return raw.withColumn("end_sec", F.col("start_sec") + F.col("length_sec")).withColumn("center_sec", (F.col("start_sec") + F.col("end_sec")) / 2)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Saved segments; start and end follow from centre and length, channels starting with `ch` make the status array."""
    raw = spark.read.csv(path, header=True)
    number = lambda c: F.col(c).cast("double")
    status = F.array(*(F.col(c).cast("int") == 1 for c in raw.columns if c.startswith("ch")))
    half = number("length_sec") / 2
    return raw.select((number("center_sec") - half).alias("start_sec"), (number("center_sec") + half).alias("end_sec"), number("center_sec").alias("center_sec"), number("length_sec").alias("length_sec"), number("highest_time").alias("highest_time"), number("highest_value").alias("highest_value"), status.alias("channel_status"))


def read_heart_rate(spark: SparkSession, folder: str) -> DataFrame:
    """(subject, time, freq) of a folder's side tables, a CSV a subject; the file's name tells the subject."""
    raw = spark.read.csv(folder, header=True, pathGlobFilter="*.csv")
    return raw.select(file_label(F.input_file_name()).alias("subject"), F.col("time").cast("double"), F.col("freq").cast("double"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True)
    return raw.select("channel_name", *(F.col(c).cast("double") for c in ("x", "y", "z")), F.col("channel_idx").cast("int"))


def metadata_with_index(sensors: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Sensors (pos, channel_name, x, y, z) with channel_idx from the dictionary, or else their place from 1."""
    if dictionary is None:
        return sensors.withColumn("channel_idx", (F.col("pos") + 1).cast("int"))
    d = dictionary.select("channel_name", F.col("channel_idx").cast("int").alias("_idx"))
    return sensors.join(d, "channel_name", "left").withColumn("channel_idx", F.coalesce("_idx", (F.col("pos") + 1).cast("int"))).drop("_idx")


def atlas_blocks(lines: DataFrame) -> DataFrame:
    """(channel, region, pct) from lines (line, head, region, pct): a head such as `CH1 (S1-D1)` opens a block that blank
    heads continue; rows without a region or number go."""
    opened = F.when(F.startswith("head", F.lit("CH")), F.replace(F.regexp_extract("head", r"\(([^)]*)\)", 1), F.lit("-"), F.lit("_")))
    w = Window.partitionBy(F.lit(0)).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)  # one atlas file
    filled = lines.withColumn("channel", F.last(opened, ignorenulls=True).over(w)).withColumn("pct", F.expr("try_cast(pct as double)"))
    return filled.where("channel is not null and region <> '' and pct is not null").select("channel", "region", "pct")


def vendor_export(spark: SparkSession, path: str, rate: float, shift: float = 0.0, preamble: int = 4, columns: int = 48, factor: float = 5.56) -> DataFrame:
    """A vendor's GBK export: preamble lines, a header, no time column; names and time are made, values scaled, z-scored."""
    lines = spark.read.option("encoding", "GBK").text(path, wholetext=False)
    rows = numbered(lines, "n").where(F.col("n") >= preamble)
    header = [c.strip() for c in rows.where(F.col("n") == preamble).head().value.split(",")[:columns]]
    names = [c.replace("-", "_") + " hbo" for c in header]
    body = rows.where(F.col("n") > preamble).select((F.col("n") - preamble - 1).alias("t_idx"), *(F.expr(f"try_cast(split(value, ',')[{k}] as double)").alias(c) for k, c in enumerate(names)))
    sig = signal.synthetic_time(body.unpivot(["t_idx"], names, "channel", "value"), rate, shift)
    sig = sig.select(F.lit(PurePosixPath(path).name.split(".")[0]).alias("subject"), "channel", "t_idx", "time", "value")
    return signal.z_score(signal.scale(sig, factor))


def bdf_records(spark: SparkSession, path: str, channels: list[str] | None = None) -> DataFrame:
    """(channel, t_idx, time, value) of a 24-bit BDF file; see `bdf` for subjects, annotations and crops."""
    from wavelark.sources import bdf

    return bdf.read_bdf(spark, path, channels).drop("subject")


def crop_between_triggers(sig: DataFrame, triggers: DataFrame, first: int, last: int) -> DataFrame:
    """From the first `first` code to the last `last` code (onset, code), both ends included; an error if either is
    missing or they are out of order. One row of bounds is read."""
    ends = triggers.agg(F.min(F.when(F.col("code") == first, F.col("onset"))).alias("a"), F.max(F.when(F.col("code") == last, F.col("onset"))).alias("b")).head()
    if ends.a is None or ends.b is None:
        raise ValueError(f"trigger {first if ends.a is None else last} is missing")
    if ends.b <= ends.a:
        raise ValueError("the last trigger is not after the first")
    return sig.where(F.col("time").between(ends.a, ends.b))


def simulated(spark: SparkSession, labels: list[str], channels: int, rate: float, duration: float, seed: int = 123) -> DataFrame:
    """0.5 sin(t + phase of the channel) + 0.05 noise on an inclusive time grid of int(duration x rate) samples."""
    n = int(duration * rate)
    step = duration / (n - 1) if n > 1 else 0.0
    base = spark.range(len(labels) * channels * n).select((F.col("id") / (channels * n)).cast("int").alias("s"), ((F.col("id") / n) % channels).cast("int").alias("c"), (F.col("id") % n).cast("int").alias("t_idx"))
    phase = F.col("c") * (6.283185307179586 / channels)
    value = 0.5 * F.sin(F.col("t_idx") * step + phase) + 0.05 * F.randn(seed)
    return base.select(F.get(F.array(*map(F.lit, labels)), F.col("s")).alias("subject"), F.format_string("ch%03d", F.col("c") + 1).alias("channel"), "t_idx", (F.col("t_idx") * step).alias("time"), value.alias("value"))


def write_wide(sig: DataFrame, names: list[str], path: str) -> None:
    """One folder a subject of wide CSV, time last."""
    signal.to_wide(sig, names).write.partitionBy("subject").mode("overwrite").csv(path, header=True)


def write_table(df: DataFrame, path: str, sep: str = ",", append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("sep", sep).csv(path, header=True)
