"""The operators applied to their whole tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import chat, decontaminate, language, licenses, packing, quality, secrets, simhash, tokens, toxicity
from sluice.llm.common import read


def op1_bit_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_divergence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(read(spark, sf_dir, "documents"))


def op3_markov_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read(spark, sf_dir, "documents"), secrets.train(secrets.samples(spark)))


def op4_cross_parsing_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(read(spark, sf_dir, "documents"))


def op5_transcript_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(read(spark, sf_dir, "conversations"))


def op6_optimal_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(read(spark, sf_dir, "documents"))


def op7_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_license_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(read(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bit_packed_tokens": op1_bit_packed_tokens,
    "op2_divergence_quality": op2_divergence_quality,
    "op3_markov_secret_scan": op3_markov_secret_scan,
    "op4_cross_parsing_language_id": op4_cross_parsing_language_id,
    "op5_transcript_hmm": op5_transcript_hmm,
    "op6_optimal_length_buckets": op6_optimal_length_buckets,
    "op7_counterfactual_toxicity": op7_counterfactual_toxicity,
    "op8_fm_index_decontamination": op8_fm_index_decontamination,
    "op9_license_tfidf": op9_license_tfidf,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
}
ORACLES: dict[str, str] = {}
