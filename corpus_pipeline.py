"""The corpus pipeline: each stage works on what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievebase.llm import edit_decontam, mixing, ngram_join, quality_rules, rans_tokens
from sievebase.llm.common import arrow_config, materialize, read, vocabulary_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the adaptive thresholds reject go."""
    return quality_rules.keep_documents(docs)


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near-copies stays: five-word shingles, a likeness of 80 percent or more."""
    return ngram_join.one_of_each(docs, ngram_join.Likeness(width=5, percent=80))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return edit_decontam.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target shares: documents repeat or are left out."""
    return mixing.mixed_documents(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32 of each document as often as it is taken."""
    return rans_tokens.token_files(docs, vocabulary_file())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard", copies_stage),
    ("edit_decontam", benchmark_stage),
    ("source_mix", mixing_stage),
    ("rans_tokens", tokens_stage),
]

#: SQL has no tokenizer and no edit search at these lengths; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written and read again."""
    arrow_config(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
