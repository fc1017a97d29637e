"""Registered corpus queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fill_in_middle, language_id, license_scan, media, near_dedup, packing, pii, quality_classifier, quality_rules, sentencepiece_scan, source_divergence, substring_dedup, token_counts
from .shared import documents

Query = Callable[[SparkSession, str], DataFrame]


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts.attribute(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.round_trip(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir), labels(spark, sf_dir)).withColumn("llr", F.round("llr", 6))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), k=4, percent=80)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(documents(spark, sf_dir))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op9_media_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(documents(spark, sf_dir)).drop("n_chunks")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(fill_in_middle.transform(documents(spark, sf_dir)))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergences(documents(spark, sf_dir))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.dedup(documents(spark, sf_dir)))


def queries() -> dict[str, Query]:
    return {f.__name__: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_quality_rules": quality_rules.oracle_sql(), "op6_minhash_near_dedup": near_dedup.oracle_sql(4, 80),
        "op9_media_chunking": media.oracle_sql(), "op10_license_scan": license_scan.oracle_sql(),
        "op11_fill_in_middle": fill_in_middle.oracle_sql(), "op12_source_divergence": source_divergence.oracle_sql(),
        "op13_substring_dedup": substring_dedup.oracle_sql(),
    }
