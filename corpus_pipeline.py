"""Corpus pipeline: from raw documents to encoded training data.

``STAGES`` names the stages in order. Each takes (spark, docs, folder of tables), works on all
that its predecessor kept and returns a DataFrame; all but the last return the columns of the
documents. Between stages the rows are written as Parquet and read again, so that a lost
executor costs one stage at most.

Tables without rows pass through as such; without labels nothing is rejected; without a
benchmark nothing is contaminated. Nulls in any column are kept as they are: a null text is an
empty document, which is in no group of duplicates, is not contaminated, and which the mix
takes like any other document of no words. Rows that repeat a document leave with the near
duplicates.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gearledger.llm.common import load, prepare, settle
from gearledger.llm.decontamination import decontaminate
from gearledger.llm.mixing import mix
from gearledger.llm.neardup import drop_near_duplicates
from gearledger.llm.quality import keep_good
from gearledger.llm.tokens import token_report

VOCABULARY = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    prepare(spark)
    return drop_near_duplicates(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate(docs, load(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source takes it."""
    prepare(spark)
    return mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files; place, size and checksum of every document in them."""
    prepare(spark)
    return token_report(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_free", benchmark_free),
    ("mixture", mixture),
    ("token_output", token_output),
]

# Classifier, sketches and tokenizer have no SQL; tests/llm holds the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
