"""The operators as queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, langid, line_crf, merkle, periodic_runs, pii, quality_rules, secret_scan, simhash
from . import substring_dedup, token_files, url_filter
from .common import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(table(spark, sf_dir, "documents"), VOCABULARY)


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_digests(table(spark, sf_dir, "documents"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_documents(table(spark, sf_dir, "documents"))


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digests(table(spark, sf_dir, "documents"))


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(table(spark, sf_dir, "documents"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_digests(table(spark, sf_dir, "documents"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(table(spark, sf_dir, "documents"), TOKENIZER)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"))


def proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substrings,
    "op2_quality_rules": rules,
    "op3_secret_scan": secrets,
    "op4_url_filter": urls,
    "op5_simhash": near_duplicates,
    "op6_decontaminate": benchmark_leaks,
    "op7_byte_bpe": tokens,
    "op8_language_id": languages,
    "op9_personal_data": personal_data,
    "op10_line_crf": quality,
    "op11_token_files": token_blocks,
    "op12_periodic_runs": runs,
    "op13_merkle": proofs,
}

ORACLE: dict[str, str] = {"op4_url_filter": url_filter.oracle()}
