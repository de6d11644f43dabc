"""Dataset folders, a cache of read signals, and the small exports of results."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavelark.sources import files


def list_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """(path, length, changed) by Spark's reader, so any store that Spark reads will do."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", "length", F.col("modificationTime").alias("changed"))


def resolve(spark: SparkSession, folder: str, raw: bool = False) -> list[str]:
    """The subject files of a dataset, by name (some dozens)."""
    return sorted(r.path for r in list_files(spark, f"{folder}/{'hbo_raw' if raw else 'hbo'}").select("path").collect())


def load(spark: SparkSession, folder: str, marker: str = "marker/marker.csv", raw: bool = False) -> tuple[DataFrame, DataFrame]:
    """(signal, annotations) of a dataset folder."""
    return files.read_dataset(spark, resolve(spark, folder, raw)), files.read_annotations(spark, f"{folder}/{marker}")


def cached(spark: SparkSession, folder: str, cache: str, raw: bool = False) -> DataFrame:
    """The signal from a Parquet copy whose name follows the files' paths, sizes and times; made if it isn't there."""
    found = sorted(map(tuple, list_files(spark, f"{folder}/{'hbo_raw' if raw else 'hbo'}").selectExpr("path", "length", "cast(changed as string)").collect()))
    path = f"{cache}/{hashlib.md5(repr(found).encode()).hexdigest()}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        files.read_dataset(spark, [f[0] for f in found]).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def events_table(triggers: DataFrame, rate: float) -> DataFrame:
    """`Event Number`, `Time (samples)`, `Event ID` from (onset, code)."""
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("onset", "code"))  # one recording's triggers
    return triggers.select(n.alias("Event Number"), F.round(F.col("onset") * rate).cast("long").alias("Time (samples)"), F.col("code").alias("Event ID"))


def sessions_table(found: DataFrame, subject_idx: int) -> DataFrame:
    """Sessions as text columns with three decimals."""
    f = lambda c: F.format_string("%.3f", c)
    return found.select(F.lit(subject_idx).alias("Subject Index"), f(F.col("start")).alias("Start (s)"), f(F.col("end")).alias("End (s)"), f(F.col("end") - F.col("start")).alias("Duration (s)"), F.col("trigger_value").alias("Trigger Value"))


def segments_table(segments: DataFrame, status: DataFrame, channels: list[str]) -> DataFrame:
    """Segments with the derived times and a 0/1 column a channel."""
    wide = status.groupBy("subject", "start_sec").pivot("channel", channels).agg(F.max("active"))
    s = segments.withColumns({"length_sec": F.col("end_sec") - F.col("start_sec"), "center_sec": (F.col("start_sec") + F.col("end_sec")) / 2})
    return s.join(wide, ["subject", "start_sec"], "left").select("subject", "start_sec", "end_sec", "length_sec", "center_sec", "highest_time", "highest_value", *(F.coalesce(c, F.lit(0)).alias(f"ch{k + 1}") for k, c in enumerate(channels)))


def correlation_json(size_sec: float, step_sec: float, rate: float, subjects: list[str]) -> str:
    """The sidecar of a sliding correlation: what was really used."""
    import json

    return json.dumps({"window_sec": size_sec, "step_sec": step_sec, "sampling_rate": rate, "subjects": sorted(subjects)})


def statistics_json(stats: DataFrame) -> DataFrame:
    """One JSON line a row, numbers rounded to six places."""
    cols = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in stats.dtypes]
    return stats.select(F.to_json(F.struct(*cols)).alias("json"))


def display_names(bad: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Channels marked bad under their display names CH<idx>; an unknown channel raises when its row is read."""
    d = dictionary.select("channel", F.col("channel_idx").cast("string").alias("_i"))
    missing = F.raise_error(F.concat(F.lit("unknown channel "), F.col("channel"))).cast("string")
    return bad.join(d, "channel", "left").withColumn("display", F.when(F.col("_i").isNotNull(), F.concat(F.lit("CH"), F.col("_i"))).otherwise(missing)).drop("_i")
