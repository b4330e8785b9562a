"""The registered queries of the catalogue engine, with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..batches import small_batches
from . import albums, contents, copies, deeds, listings, records, scalars, states

MODULES = (listings, albums, copies, scalars, states, records, deeds, contents)


def in_small_batches(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, whose Python workers hold few rows at once, however many a partition has."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: in_small_batches(q) for module in MODULES for name, (q, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
