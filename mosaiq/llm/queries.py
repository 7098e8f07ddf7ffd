"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mosaiq.llm import chat_format, common, decontaminate, jaccard, license_scan, lm_score, merkle, oracles, packing, phrases, quality, sharding, span_dedup, topk, toxicity


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.bound_batches(spark)
    return common.read_table(spark, sf_dir, name)


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(read_table(spark, sf_dir, "documents"))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_documents(read_table(spark, sf_dir, "documents"))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.digest(read_table(spark, sf_dir, "documents"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digest(read_table(spark, sf_dir, "conversations"))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(read_table(spark, sf_dir, "documents"))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(read_table(spark, sf_dir, "documents"))


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": _op1,
        "op2_lm_scoring": _op2,
        "op3_exact_top_k": _op3,
        "op4_ngram_jaccard_join": _op4,
        "op5_sentence_span_dedup": _op5,
        "op6_benchmark_decontamination": _op6,
        "op7_chat_formatting": _op7,
        "op8_balanced_shards": _op8,
        "op9_quality_classifier": _op9,
        "op10_license_scan": _op10,
        "op11_merkle_manifest": _op11,
        "op12_toxicity": _op12,
        "op13_phrase_collocations": _op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_top_k": oracles.TOP_K,
        "op4_ngram_jaccard_join": oracles.JACCARD,
        "op5_sentence_span_dedup": span_dedup.ORACLE,
        "op6_benchmark_decontamination": decontaminate.ORACLE,
        "op7_chat_formatting": chat_format.ORACLE,
        "op10_license_scan": license_scan.oracle(),
        "op11_merkle_manifest": merkle.oracle(),
        "op13_phrase_collocations": phrases.ORACLE,
    }
