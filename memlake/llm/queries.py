"""The training-data queries: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from memlake.llm import bpe, license_scan, line_dedup, outliers, packing, quality, sharding, simhash, suffix_dedup, weighted_sampling
from memlake.llm.common import documents

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_report(documents(spark, sf_dir))


def op3_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.fingerprint_neighbours(documents(spark, sf_dir))


def op4_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digests(documents(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(documents(spark, sf_dir), BYTE_BPE, public_tokenizers.PATTERN)


def op6_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.verdicts(documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir)).drop("spans")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(documents(spark, sf_dir))


def op9_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("version")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), WORD_BPE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_simhash, op3_weighted_sampling, op4_histogram_sort, op5_byte_bpe, op6_robust_outliers, op7_license_scan, op8_line_dedup, op9_quality_bayes, op10_best_fit_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op8_line_dedup": line_dedup.ORACLE}
