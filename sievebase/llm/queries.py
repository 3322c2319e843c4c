"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievebase.llm import edit_decontam, fill_middle, hilbert_shards, html_main, lang_mixture, maxent_lm, merkle_manifest, mixing, ngram_join
from sievebase.llm import quality_rules, rans_tokens, secret_forest, site_quality, statements
from sievebase.llm.common import arrow_config, read, vocabulary_file

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Four-word shingles, a likeness of 85 percent or more."""
    return ngram_join.jaccard_components(read(spark, sf, "documents"))


def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Base counts, verdict and broken rules of every document."""
    out = quality_rules.quality_rules(read(spark, sf, "documents"))
    return out.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", F.array_join("broken", ",").alias("broken"))


def op3_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf, "documents"))


def op4_maxent_lm(spark: SparkSession, sf: str) -> DataFrame:
    return maxent_lm.score(read(spark, sf, "documents"), lang_mixture.held_out(F.col("doc_id"), 10))


def op5_hilbert_shards(spark: SparkSession, sf: str) -> DataFrame:
    return hilbert_shards.hilbert_shards(read(spark, sf, "documents"))


def op6_site_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts are sources and paths the languages below them: documents carry no address."""
    return site_quality.site_quality(read(spark, sf, "documents"), read(spark, sf, "labels"))


def op7_secret_forest(spark: SparkSession, sf: str) -> DataFrame:
    return secret_forest.secret_findings(read(spark, sf, "documents"))


def op8_edit_decontam(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark item that a document holds, with up to eight percent edits."""
    return edit_decontam.find_leaks(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


def op9_rans_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return rans_tokens.token_files(read(spark, sf, "documents"), vocabulary_file())


def op10_lang_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """Learned from four fifths of the documents, applied to all."""
    docs = read(spark, sf, "documents")
    out = lang_mixture.held_out(F.col("doc_id"), 5)
    langs, tables = lang_mixture.learn(docs.filter(~out))
    found = lang_mixture.identify(docs, langs, tables)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "langs", "shares")


def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Digests and proofs of all rows, a part of them tampered with."""
    return merkle_manifest.verified_rows(merkle_manifest.dataset_manifest(read(spark, sf, "documents")))


def op12_html_main(spark: SparkSession, sf: str) -> DataFrame:
    return html_main.extract(read(spark, sf, "pages"))


def op13_fill_middle(spark: SparkSession, sf: str) -> DataFrame:
    return fill_middle.fim_digests(read(spark, sf, "documents"))


def _configured(query: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        arrow_config(spark)
        return query(spark, sf)

    return run


def llm_queries() -> dict[str, Query]:
    found = [op1_ngram_jaccard, op2_quality_rules, op3_source_mix, op4_maxent_lm, op5_hilbert_shards, op6_site_quality, op7_secret_forest, op8_edit_decontam, op9_rans_tokens, op10_lang_mixture, op11_merkle_manifest, op12_html_main, op13_fill_middle]
    return {q.__name__: _configured(q) for q in found}


def llm_statements() -> dict[str, str]:
    """DuckDB statements for the queries that SQL can express."""
    return statements.llm_statements()
