"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score_toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    scored = score_toxicity(docs, fit(docs, labels.filter(~held)))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", "n_matches")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from .tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), P.path("piece_bpe_32k.model"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .debruijn import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .forest import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), ranks=P.path("byte_bpe_50k.tiktoken"), pattern=P.PATTERN)


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_decontamination, op3_token_counts, op4_substring_dedup, op5_suffix_dedup, op6_embedding_dedup, op7_quality, op8_packing, op9_minhash_dedup, op10_license_scan)}


def oracle_sql() -> dict[str, str]:
    from .licenses import license_sql
    from .oracle import ORACLE

    return ORACLE | {"op10_license_scan": license_sql()}
