"""Connected components of edge tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def checkpoint_folder(spark: SparkSession) -> None:
    """Lets the session checkpoint in the folder the cluster names; a session on one machine may use a temporary one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="medialake-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as checkpoint_folder() sets it."""
    checkpoint_folder(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def components(edges: DataFrame) -> DataFrame:
    """Per vertex (id) the smallest vertex it reaches (root).

    A round takes the smallest root among neighbours, hands it to the old root too, so that whole trees are hung
    together, and then follows it one step up. Roots only fall; rounds are checkpointed and go on until none does; the
    driver sees only whether any did.
    """
    checkpoint_folder(edges.sparkSession)
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("root")).checkpoint()
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = labels.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        hung = step.filter("root < old").groupBy(F.col("old").alias("id")).agg(F.min("root").alias("up"))
        hooked = step.join(hung, "id", "left").select("id", "old", F.least("root", "up").alias("root"))
        onward = hooked.select(F.col("id").alias("root"), F.col("root").alias("further"))
        moved = hooked.join(onward, "root").select("id", "old", F.least("root", "further").alias("root")).checkpoint()
        labels = moved.select("id", "root")
        if moved.filter("root != old").isEmpty():
            return labels


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (id, root) after new edges (a, b) came: those of all edges so far, without reading the old ones.

    The ends of a new edge are put down to their roots, vertices that are new being their own; components of these few
    edges between roots say which trees are hung together. Each label is read once and changed if its root was. Empty
    labels are a start; batches in any order, repeated or not, give what all edges at once give.
    """
    checkpoint_folder(edges.sparkSession)
    known = labels.select(F.col("id").alias("of"), "root")
    ends = edges.select("a", "b").join(known, F.col("a") == F.col("of"), "left").select("b", "a", F.coalesce("root", "a").alias("from"))
    ends = ends.join(known, F.col("b") == F.col("of"), "left").select("a", "b", "from", F.coalesce("root", "b").alias("to")).checkpoint()
    moved = components(ends.filter(F.col("from") != F.col("to")).select(F.col("from").alias("a"), F.col("to").alias("b"))).select(F.col("id").alias("was"), F.col("root").alias("now"))
    new = ends.select(F.col("a").alias("id")).union(ends.select("b")).distinct().join(labels.select("id"), "id", "left_anti").select("id", F.col("id").alias("root"))
    return labels.select("id", "root").unionByName(new).join(moved, F.col("root") == F.col("was"), "left").select("id", F.coalesce("now", "root").alias("root"))
