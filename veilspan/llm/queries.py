"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann_multiprobe, binary_dedup, bpe_matrix, divergence, filter_audit, ngram_jaccard, packing, pii_terms, ppm, sharding, token_counts, token_files, toxicity
from .common import table


def vocabulary(name: str) -> str:
    """Where a vocabulary file is; $VEILSPAN_TOKENIZERS may name another folder."""
    import public_tokenizers

    folder = os.environ.get("VEILSPAN_TOKENIZERS")
    return f"{folder}/{name}" if folder else public_tokenizers.path(name)


def pattern() -> str:
    """The pre-token pattern of the rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_multiprobe.nearest(table(spark, sf_dir, "embeddings"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 2)


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.ngram_components(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_matrix.encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), pattern())


def op8_binary_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op9_pii_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_terms.personal_data(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assignments(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_multiprobe": op1_multiprobe,
    "op2_token_files": op2_token_files,
    "op3_ppm": op3_ppm,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_binary_dedup": op8_binary_dedup,
    "op9_pii_terms": op9_pii_terms,
    "op10_token_counts": op10_token_counts,
    "op11_filter_audit": op11_filter_audit,
    "op12_divergence": op12_divergence,
    "op13_sharding": op13_sharding,
}

ORACLE_SQL: dict[str, str] = {
    "op6_ngram_jaccard": ngram_jaccard.ORACLE,
    "op8_binary_dedup": binary_dedup.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_divergence": divergence.ORACLE,
    "op13_sharding": sharding.ORACLE,
}
