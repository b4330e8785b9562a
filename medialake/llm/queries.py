"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontamination, divergence, extraction, fingerprints, jaccard_join, oracles, packing, retrieval_packing, secret_scans, sharding, token_counts, toxicity, vector_codes, warc
from .common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), limit=1024)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.verdicts(toxicity.scored(docs, toxicity.fit(docs, labels)))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.digests(secret_scans.secrets(table(spark, sf_dir, "documents")))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), room=1024, end_id=2)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.verdicts(decontamination.contamination(docs, items))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(table(spark, sf_dir, "documents"), shards=16)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least=0)


def op11_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_packing.packed(table(spark, sf_dir, "documents"), room=1024, end_id=0)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=10, top_terms=10)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_token_counts": op2_token_counts,
        "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
        "op4_toxicity": op4_toxicity,
        "op5_secret_scans": op5_secret_scans,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_benchmark_decontamination": op7_benchmark_decontamination,
        "op8_document_fingerprints": op8_document_fingerprints,
        "op9_sharding": op9_sharding,
        "op10_warc": op10_warc,
        "op11_retrieval_packing": op11_retrieval_packing,
        "op12_source_divergence": op12_source_divergence,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
