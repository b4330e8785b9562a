"""Numbers, running sums and sessions within groups of any size: no group is sorted in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .graph import checkpoint_folder


def cells(rows: DataFrame, group: list[str], order: Sequence[str | Column]) -> DataFrame:
    """rows with a `cell`: the range of (group, order) they fall into, and their group.

    Ranges ascend and hold about equally many rows, so a large group is spread over many of them; rows of equal group
    and order are never parted. Rows are checkpointed, so that every reader sees the same ranges.
    """
    checkpoint_folder(rows.sparkSession)
    ranged = rows.repartitionByRange(*group, *order)
    return ranged.withColumn("cell", F.struct(F.spark_partition_id().alias("part"), *group)).checkpoint()


def _whole_groups(group: list[str]):
    """A window over the few cells of each group, in their order."""
    return W.partitionBy(*[F.col(f"cell.{g}") for g in group]).orderBy("cell.part")


def numbered(rows: DataFrame, group: list[str], order: Sequence[str | Column], sums: Sequence[str] = ()) -> DataFrame:
    """rows with their `number` in their group (from 1, by order) and, for each of sums, the running `sum_<name>`.

    Rows are numbered inside their cells; what comes before a cell is a prefix sum over the cells' totals. Null groups
    are a group, null summands count as 0; order has to decide ties.
    """
    placed = cells(rows, group, order)
    inside = W.partitionBy("cell").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    earlier = _whole_groups(group).rowsBetween(W.unboundedPreceding, -1)
    parts = {"number": F.lit(1), **{f"sum_{c}": F.coalesce(c, F.lit(0)) for c in sums}}
    totals = placed.groupBy("cell").agg(*[F.sum(v).alias(n) for n, v in parts.items()])
    before = totals.select("cell", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"before_{n}") for n in parts])
    counted = placed.withColumns({n: F.sum(v).over(inside) for n, v in parts.items()}).join(before, "cell")
    return counted.withColumns({n: F.col(n) + F.col(f"before_{n}") for n in parts}).drop("cell", *[f"before_{n}" for n in parts])


def parted(rows: DataFrame, group: list[str], order: Sequence[str | Column], value: str, gap: int) -> DataFrame:
    """rows with a `session` within their group, from 0: a step of more than gap from one value to the next begins one.

    Steps inside a cell are seen by its own rows, those between cells by their first and last values. order has to
    begin with value, ascending.
    """
    placed = cells(rows, group, order)
    inside = W.partitionBy("cell").orderBy(*order)
    wide = lambda later, earlier: F.when(later - earlier > gap, 1).otherwise(0)
    stepped = placed.withColumn("new", wide(F.col(value), F.lag(value).over(inside)))
    ends = stepped.groupBy("cell").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.sum("new").alias("inner"))
    along = _whole_groups(group)
    edged = ends.withColumn("edge", wide(F.col("first"), F.lag("last").over(along)))
    before = F.sum(F.col("edge") + F.col("inner")).over(along.rowsBetween(W.unboundedPreceding, 0)) - F.col("inner")
    counted = stepped.withColumn("session", F.sum("new").over(inside.rowsBetween(W.unboundedPreceding, 0))).join(edged.select("cell", before.alias("before")), "cell")
    return counted.withColumn("session", F.col("session") + F.col("before")).drop("cell", "new", "before")
