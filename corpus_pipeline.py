"""A corpus pipeline: five stages, each over all that its predecessor kept.

The stages' functions take (spark, docs, sf_dir); what each returns is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.

Nulls and edge cases, in every stage: a null or empty text is a document like any other (it has a score, no near copies, no test
items, no secrets and no ids); a null doc_id is a document too, told apart by its text; documents with one id and different texts
are different documents; rows that are equal in id and text stay or go together; further columns are kept, whatever their
names; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelark.llm import bpe, quality
from wavelark.llm.decontaminate import find_items
from wavelark.llm.ngram_join import ngram_jaccard_join
from wavelark.llm.secrets import redact_secrets
from wavelark.llm.store import Scratch

#: A document goes if its calibrated probability of good quality is below this.
LEAST_QUALITY = 0.5


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have: longer than any it has."""
    return name + "_" * max(map(len, docs.columns), default=0)


def _without(docs: DataFrame, key: str, gone: DataFrame, name: str) -> DataFrame:
    """docs without the rows whose key is in gone (key)."""
    gone = Scratch(docs.sparkSession, "pipeline").small(gone, name)
    return docs.join(gone, key, "left_anti").drop(key)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = _unused(docs, "score")
    return quality.score_quality(docs, model, score_col=score).where(F.col(score) >= LEAST_QUALITY).select(docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the document with the smallest doc_id stays; one without an id
    stays only if no other has one."""
    key = _unused(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = ngram_jaccard_join(keyed, id_col=key).select(F.col("doc_id").alias("k"), F.col("component_id").alias("group"))
    names = keyed.select(F.col(key).alias("k"), "doc_id").join(found.distinct(), "k")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")
    first = names.groupBy("group").agg(F.min(order).alias("first"), F.max("k").alias("last")).where("group <> last")
    gone = names.join(first.select("group", F.col("first.k").alias("stays")), "group").where("k <> stays").select(F.col("k").alias(key)).distinct()
    return _without(keyed, key, gone, "doubles").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    key = _unused(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = find_items(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    return _without(keyed, key, found.select(F.col("doc_id").alias(key)).distinct(), "leaks").select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the secrets in its text are replaced by a mark, and n_chars follows."""
    out = redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining texts' token ids; decoded texts are checked against them by digest."""
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_join),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scan),
    ("byte_level_bpe", byte_level_bpe),
]

#: The classifier's, network's and encoder's results can't be stated in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        scratch.only(name)  # the predecessor's rows are no longer read
    return docs
