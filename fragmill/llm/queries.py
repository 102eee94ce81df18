"""The registered query of each operator, over its whole tables, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fragmill.llm import decontam, ftrl, hilbert, langid, minhash, mixing, pulearn, suffix, tiff, urlfilter
from fragmill.llm.runtime import table


def op1_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op1(table(spark, sf_dir, "documents"))


def op2_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.op2(table(spark, sf_dir, "documents"))


def op3_temporal_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.op3(table(spark, sf_dir, "pages"))


def op4_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pulearn.op4(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ftrl.op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.op6(table(spark, sf_dir, "documents"))


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.op7(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.op8(table(spark, sf_dir, "documents"))


def op9_aho_corasick_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op9(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_bitmask_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op10(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pivotal_mixing": op1_pivotal_mixing,
    "op2_tiff_pages": op2_tiff_pages,
    "op3_temporal_url_filters": op3_temporal_url_filters,
    "op4_pu_quality": op4_pu_quality,
    "op5_ftrl_toxicity": op5_ftrl_toxicity,
    "op6_suffix_repeats": op6_suffix_repeats,
    "op7_hilbert_sharding": op7_hilbert_sharding,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_aho_corasick_decontamination": op9_aho_corasick_decontamination,
    "op10_bitmask_language_id": op10_bitmask_language_id,
}

ORACLE: dict[str, str] = {
    "op3_temporal_url_filters": urlfilter.ORACLE,
    "op9_aho_corasick_decontamination": decontam.ORACLE,
}
