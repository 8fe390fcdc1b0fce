"""Registered queries of the operators: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from churnspark.llm import (alignment, decontaminate, exact_dedup, licenses, lines, lm, manifest, mix, near_dup, quality, token_counts, token_file,
                            urls)
from churnspark.llm.common import read


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items contained in documents."""
    return decontaminate.contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def tokenizer_path() -> str:
    """File of the word BPE tokenizer (installed with the public tokenizers, never copied)."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: start, length and checksum of each document's ids."""
    return token_file.round_trip(read(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source."""
    return lines.dedup_lines(read(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mixture takes of every document."""
    return mix.taken(read(spark, sf_dir, "documents"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every draw of the mixture."""
    return mix.shards(read(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document."""
    return lm.scores(read(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdict of every document."""
    return quality.quality(read(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named or quoted in every document."""
    return licenses.scan(read(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document (two-word shingles, 80%)."""
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"), k=2, percent=80)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or reputation verdict of every page url."""
    return urls.judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram piece count of every document."""
    import public_tokenizers
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the byte-level and the sentencepiece tokens of every document."""
    import public_tokenizers
    return alignment.align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and tampered fold of every document in the Merkle manifest."""
    return manifest.manifest(read(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row that stays of every document's group of equal texts."""
    return exact_dedup.dedup(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1,
    "op2_token_file": op2,
    "op3_line_dedup": op3,
    "op4_mix_sources": op4,
    "op4_mix_shards": op4_shards,
    "op5_lm_scores": op5,
    "op6_quality_rules": op6,
    "op7_licenses": op7,
    "op8_near_dup": op8,
    "op9_url_filter": op9,
    "op10_token_counts": op10,
    "op11_tokenizer_alignment": op11,
    "op12_merkle_manifest": op12,
    "op13_exact_dedup": op13,
}
