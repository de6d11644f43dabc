"""Tables written to the folder that driver and executors share, and joins chosen by a checked size."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most so many bytes (1,000,000 rows of one long) are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 8_000_000
#: Bytes of an Arrow batch sent to a Python worker.
BATCH_BYTES = 4 << 20

#: Spark's setting that removes a query's shuffle files at its end. Else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is set, a local session gets a temporary one; a cluster's executors
    would not see each other's files there, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="wavelark-")
    return _own[app]


def limit_batches(spark: SparkSession) -> None:
    """Batches for Python end by bytes too, so that very long texts don't add up in one. A lower limit of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key, None)
    if held is None or not held.isdigit() or int(held) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


@contextlib.contextmanager
def _cleaned(spark: SparkSession):
    """What is run inside leaves no shuffle files: the written table is what later steps read. The session's own setting is put back."""
    held = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if held is None else spark.conf.set(_CLEANUP, held)


class Scratch:
    """Intermediate tables of one operator call. Each cuts the lineage: later stages, and stages that are
    run again after an executor was lost, start from the files."""

    def __init__(self, spark: SparkSession, name: str):
        self.names: set[str] = set()
        self.listed: dict[str, str] = {}
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        limit_batches(spark)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with _cleaned(self.spark):
            df.write.mode("overwrite").parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def small(self, df: DataFrame, name: str) -> DataFrame:
        """The written table, with a broadcast hint if it is small."""
        return small(self.table(df, name))

    def bucketed(self, df: DataFrame, name: str, key: str, bucket_bytes: int) -> DataFrame:
        """The written table in buckets of about so many bytes by `key`: joins on it don't shuffle it again."""
        n = max(1, -(-size_of(df) // bucket_bytes))
        table = f"{self.root.rsplit('/', 1)[1]}_{name}".replace("-", "_")
        with _cleaned(self.spark):
            df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", f"{self.root}/{name}").mode("overwrite").saveAsTable(table)
        self.names.add(name)
        self.listed[name] = table
        return self.spark.table(table)

    def only(self, *names: str) -> None:
        """Removes all tables of this call but those that its result still reads."""
        self.drop(*(self.names - set(names)))

    def drop(self, *names: str) -> None:
        """Removes tables of this call that nothing reads any more."""
        self.names -= set(names)
        jvm = self.spark.sparkContext._jvm
        for name in names:
            if name in self.listed:
                self.spark.sql(f"drop table if exists {self.listed.pop(name)}")
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def size_of(df: DataFrame) -> int:
    """About how many bytes the rows hold, by one aggregate with partial sums."""
    size = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = size + 8 + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith("array"):
            size = size + 8 + 8 * F.greatest(F.size(name), F.lit(0))
        else:
            size = size + 8
    return df.agg(F.sum(size)).head()[0] or 0


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df (a written table) with a broadcast hint if its rows hold at most `limit` bytes; otherwise as it is, for a shuffle."""
    return F.broadcast(df) if size_of(df) <= limit else df


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (a, b): root is the smallest node that can be reached.

    Labels flow along links and then jump to the label of their label, so chains shorten by half a round.
    All steps are joins and aggregates with partial sums; nothing is gathered in one place. The table that is joined on
    hot labels is written before, so that adaptive execution can split a giant component's share.
    """
    both = scratch.table(links.select("a", "b").where("a <> b").union(links.select("b", "a").where("a <> b")).distinct(), "both")
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels0")
    step = 0
    while True:
        step += 1
        seen = both.join(small(labels), both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        near = labels.join(seen, labels.node == seen.a).select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        near = scratch.table(near, f"near{step}")
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        new = scratch.table(near.join(small(jump), "mid").select("node", "old", F.least("mid", "far").alias("root")), f"labels{step}")
        scratch.drop(f"labels{step - 1}", f"near{step}")
        labels = new.select("node", "root")
        if new.where("root <> old").limit(1).count() == 0:
            scratch.drop("both")
            return labels
