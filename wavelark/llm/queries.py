"""The registered queries of this subpackage: thin callers of the operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), shingle=3, similarity=(9, 10))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_items

    return find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import balanced_shards

    return balanced_shards(_table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest_neighbours

    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"))


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    return bpe.digests(bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = _table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = quality.fit(docs, _table(spark, sf_dir, "labels").where(~held))
    return quality.score_quality(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    found = F.col("findings")
    base = F.filter(found, lambda f: f["kind"] != "model")
    spans = lambda fs: F.array_join(F.transform(fs, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(found, lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(_table(spark, sf_dir, "documents")).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(spans(base).cast("binary"), 256).alias("base_sha256"), spans(found).alias("spans"))


def op9_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .compact_windows import near_passages

    return near_passages(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import align_documents

    return align_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_join import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import Repair, damage

    given = _table(spark, sf_dir, "conversations")
    fixed = Repair(damage(given))
    nothing = {c: F.lit(0).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    out = given.select("conv_id").distinct()
    for part in (fixed.summary, fixed.digests()):
        part = part.withColumnRenamed("conv_id", "c")
        out = out.join(part, out.conv_id.eqNullSafe(part.c), "left").drop("c")
    return out.select("conv_id", *(F.coalesce(c, value).alias(c) for c, value in nothing.items()))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_decontaminate": op2_decontaminate,
        "op3_balanced_shards": op3_balanced_shards,
        "op4_nearest_neighbours": op4_nearest_neighbours,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_byte_level_bpe": op6_byte_level_bpe,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_secret_scan": op8_secret_scan,
        "op9_compact_windows": op9_compact_windows,
        "op10_url_filter": op10_url_filter,
        "op11_token_alignment": op11_token_alignment,
        "op12_embedding_join": op12_embedding_join,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    from . import decontaminate

    return {"op2_decontaminate": decontaminate.ORACLE_SQL}
