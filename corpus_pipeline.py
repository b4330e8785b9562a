"""From raw documents to packed training sequences: five stages, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from medialake.llm import decontamination, jaccard_join, packing, secret_scans, toxicity
from medialake.llm.common import scratch, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score as toxic."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by shingles (five words, 0.8)."""
    return jaccard_join.one_of_each(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents contaminated by benchmark items."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents and replaces the secrets in their texts."""
    cleaned = secret_scans.redacted(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of at most 1024."""
    return packing.packed(docs, room=1024, end_id=2)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", one_of_near_copies),
    ("benchmark_decontamination", without_benchmarks),
    ("secret_scans", without_secrets),
    ("best_fit_packing", packed),
]

#: SQL can express neither the fitted scores nor the tokenizer; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; all columns of documents go through the filtering stages.

    Rows without an id and repeated rows: near copies keep each row without an id, and one of the rows of an id. Null
    texts stay, as empty ones; an empty table gives no rows; very long texts go through whole. Ties: of a group of near
    copies the smallest id stays, a score at the threshold is toxic, pieces of equal length are ranked by their place.
    Columns whose names the operators use themselves pass through the filtering stages as they are; the last stage
    returns its own columns alone.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{scratch(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
