"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .common import load
from .conversations import prefix_trie
from .decontamination import contamination_report
from .licenses import find_licenses
from .lines import line_report
from .mixing import mixing_report
from .neardup import near_duplicates
from .quality import quality_report
from .secrets import secrets_report
from .substrings import substring_report
from .tokens import token_report
from .topk import exact_top_k
from .toxicity import toxicity_report
from .whitening import whiten

VOCABULARY = "byte_bpe_50k.json"

Query = Callable[[SparkSession, str], DataFrame]


def op1_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing_report(load(spark, folder, "documents"))


def op2_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return exact_top_k(load(spark, folder, "embeddings"))


def op3_token_output(spark: SparkSession, folder: str) -> DataFrame:
    return token_report(load(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination_report(load(spark, folder, "documents"), load(spark, folder, "benchmark"))


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_report(load(spark, folder, "documents"))


def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(load(spark, folder, "documents"))


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return find_licenses(load(spark, folder, "documents"))


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_report(load(spark, folder, "documents"), load(spark, folder, "labels"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_report(load(spark, folder, "documents"))


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets_report(load(spark, folder, "documents"))


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(load(spark, folder, "embeddings"))


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_report(load(spark, folder, "documents"), load(spark, folder, "labels"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(load(spark, folder, "conversations"))


def queries() -> dict[str, Query]:
    own = (
        op1_source_mixing, op2_exact_top_k, op3_token_output, op4_decontamination, op5_substring_dedup, op6_near_duplicates, op7_license_scan,
        op8_quality_classifier, op9_line_dedup, op10_secret_scan, op11_embedding_whitening, op12_toxicity, op13_prefix_trie,
    )
    return {fn.__name__: fn for fn in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_source_mixing": oracles.mixing(),
        "op2_exact_top_k": oracles.top_k(),
        "op4_decontamination": oracles.decontamination(),
        "op5_substring_dedup": oracles.substrings(),
        "op6_near_duplicates": oracles.near_duplicates(),
        "op7_license_scan": oracles.licenses(),
        "op13_prefix_trie": oracles.prefix_trie(),
    }
