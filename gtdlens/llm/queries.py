"""The registered queries of the corpus operators: each takes (session, table folder) and reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gtdlens.llm import (
    language,
    lines,
    merkle,
    near_dups,
    neighbours,
    oracle,
    packing,
    piece_model,
    quality,
    shards,
    substrings,
    token_counts,
    toxicity,
    whitening,
)
from gtdlens.llm.common import documents


def op1_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return substrings.dedup_digest(documents(spark, d), window=20)


def op2_multiprobe_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{d}/embeddings.parquet"), every=20, k=20)


def op3_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    return piece_model.encode_texts(documents(spark, d), public_tokenizers.path("piece_bpe_32k.model"))


def op4_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return lines.line_digest(documents(spark, d), bounded=True)


def op5_language_id(spark: SparkSession, d: str) -> DataFrame:
    return language.identify(documents(spark, d))


def op6_minhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near_dups.near_duplicates(documents(spark, d), shingle=4, percent=80)


def op7_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality(documents(spark, d))


def op8_length_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(documents(spark, d))


def op9_kd_sharding(spark: SparkSession, d: str) -> DataFrame:
    return shards.sharded(documents(spark, d), shards=8)


def op10_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, d), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op11_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet"))


def op12_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    return merkle.merkle_digest(documents(spark, d))


def op13_embedding_whitening(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{d}/embeddings.parquet"))


REGISTERED = (
    op1_substring_dedup,
    op2_multiprobe_neighbours,
    op3_sentencepiece,
    op4_line_dedup,
    op5_language_id,
    op6_minhash_near_dedup,
    op7_quality_rules,
    op8_length_packing,
    op9_kd_sharding,
    op10_token_counts,
    op11_toxicity,
    op12_merkle_manifest,
    op13_embedding_whitening,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in REGISTERED}


def oracle_sql() -> dict[str, str]:
    return oracle.statements()
