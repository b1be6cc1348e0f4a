"""The queries opN_<name>: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, html_text, quality, secrets, simhash, substring_dedup, suffix_dedup, token_counts, toxicity
from .common import load


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(decontamination.find_phrases(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(quality.clean_lines(load(spark, sf_dir, "documents")))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(load(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.find_secrets(load(spark, sf_dir, "documents")))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(suffix_dedup.remove_covered(load(spark, sf_dir, "documents")))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(substring_dedup.remove_repeated(load(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_decontamination, op3_quality, op4_html, op5_simhash, op6_secrets, op7_suffix_dedup, op8_substring_dedup, op9_toxicity, op10_token_counts)}
ORACLE_SQL: dict[str, str] = {"op2_decontamination": decontamination.ORACLE_SQL, "op3_quality": quality.ORACLE_SQL, "op6_secrets": secrets.ORACLE_SQL, "op7_suffix_dedup": suffix_dedup.ORACLE_SQL, "op8_substring_dedup": substring_dedup.ORACLE_SQL}
