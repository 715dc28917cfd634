"""One query for each operator, over its whole table; SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language, line_dedup, near_dedup, oracles, packing, quality, secrets, sharding, topk, toxicity


def tokenizer_path() -> str:
    """The vocabulary that the queries use; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path(), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged, with its counts."""
    out = quality.quality(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op4_two_pass_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole, in sixteen shards of equal counts."""
    out = sharding.shard(_table(spark, sf_dir, "documents"), 16)
    size = F.coalesce(F.octet_length("doc.text"), F.lit(0)).cast("bigint") + 1
    crc = F.crc32(F.coalesce(F.col("doc.text"), F.lit("")).cast("binary"))
    return out.select("doc.doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of two-word shingles are at least 80 % alike."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best partners of each query vector."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), 10)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that an earlier one has alike: counts, and a digest of the text that is left."""
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "lines.n_lines", "lines.n_dropped", F.length("lines.clean_text").cast("bigint").alias("n_chars"), F.sha2("lines.clean_text", 256).alias("text_sha256"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts, a digest of the base spans, and all spans."""
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    counts = [secrets.count_of("base", name).alias(f"n_{name}") for name in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("all")).alias("spans"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels outside the held-out part."""
    out = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "spans")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the texts outside the held-out part."""
    return language.language_id(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_bpe_round_trip,
        op3_quality_rules,
        op4_two_pass_sharding,
        op5_minhash_near_dedup,
        op6_exact_top_k,
        op7_line_dedup,
        op8_secret_scans,
        op9_toxicity,
        op10_language_id,
    )
}
ORACLES: dict[str, str] = {op3_quality_rules.__name__: oracles.OP3, op5_minhash_near_dedup.__name__: oracles.OP5, op6_exact_top_k.__name__: oracles.OP6}
