"""From raw documents to token files: language, near-duplicates, benchmark passages, source weights, token ids.

Every stage takes all rows that the stage before has kept, as a Parquet table; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwright.llm import common, decontaminate, language, minhash, mixing, tokens

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that are in no language: without a letter, or most words of which no learned language explains.  A null lang is filled."""
    return language.known_language(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word shingles, Jaccard 0.8) the document with the smallest doc_id stays."""
    return minhash.one_of_each(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under windows of benchmark items are cut out; documents stay."""
    return decontaminate.clean_documents(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows; a row per document as read back."""
    return tokens.token_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: Language inference, MinHash and the tokenizer have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir))
    return docs
