"""The queries of the ten operators and their SQL, for the entry module to add."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from loomspan.llm import decontaminate, extract, jaccard, language, mixing, quality, secrets, spans, token_counts, token_ids
from loomspan.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sampling(table(spark, sf_dir, "documents"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.token_ids(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op6_secret_scan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With classes for keys of one case and of 16 characters on."""
    return secrets.secret_scan(table(spark, sf_dir, "documents"), classes=secrets.KEY_CLASSES)


def op7_extract_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_content(table(spark, sf_dir, "pages"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.substring_dedup(table(spark, sf_dir, "documents"))


def op9_substring_dedup_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated run of several sentences, to its last sentence."""
    return spans.substring_dedup(table(spark, sf_dir, "documents"), ends=True)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_token_counts, op2_language_id, op3_mixing, op4_token_ids, op5_decontaminate, op6_secret_scan, op6_secret_scan_keys, op7_extract_content, op8_jaccard_join, op9_substring_dedup, op9_substring_dedup_runs, op10_quality_rules, pipeline)}
ORACLE_SQL: dict[str, str] = {"op3_mixing": mixing.mixing_sql(), "op6_secret_scan": secrets.secret_sql(), "op8_jaccard_join": jaccard.jaccard_sql(), "op9_substring_dedup": spans.dedup_sql(), "op9_substring_dedup_runs": spans.dedup_sql(ends=True)}
