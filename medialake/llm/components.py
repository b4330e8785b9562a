"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """Per vertex of edges (a, b) the smallest vertex it is connected with, as (id, label).

    Each round takes the smallest label among a vertex and its neighbours, hands it to the vertex of the old label as
    well (so trees that meet are hooked together at their roots), then takes that label's own label (pointer jumping).
    Labels only fall, and rounds go on until none does: on shuffled paths of 400 and 20,000 vertices that is 9 and 13
    rounds at most. Rounds are checkpointed; only whether anything changed comes to the driver. An edge of a vertex
    with itself is allowed; no edges give no rows.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label"))
    none = F.lit(None).cast(edges.schema["a"].dataType).alias("old")
    while True:
        # a vertex's own row says its old label; unions and one aggregate each, in place of joins
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").select(F.col("a").alias("id"), none, "label")
        step = _least(labels.select("id", F.col("label").alias("old"), "label").union(near))
        hooked = _least(step.union(step.filter("label < old").select(F.col("old").alias("id"), none, "label")))
        onward = hooked.select(F.col("id").alias("label"), F.col("label").alias("further"))
        moved = cut(hooked.join(onward, "label").select("id", "old", F.least("label", "further").alias("label")))
        labels = moved.select("id", "label")
        if moved.filter("label != old").isEmpty():
            return labels


def _least(rows: DataFrame) -> DataFrame:
    """Each vertex once, with its old label and the smallest of its labels."""
    return rows.groupBy("id").agg(F.max("old").alias("old"), F.min("label").alias("label"))
