"""Sharding by bytes: global prefix sums from per-bucket totals, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import bucket_of, range_buckets, running, stored, text_of


def byte_shards(docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Contiguous shards of nearly equal bytes, in ascending id.

    A row's size is its text's UTF-8 bytes plus 1 (null text: 1). Sizes are summed per range bucket of ids, the few
    bucket totals are prefix-summed, and a row's own prefix is its bucket's plus the one inside the bucket. The row
    whose middle byte lies in [k, k + 1) * total / shards belongs to shard k. Only narrow rows (id, size, checksum)
    are shuffled, never texts, and no bucket is a group of equal keys: copies and sources play no part.

    Null ids come first, repeated ids (ties) are ordered by checksum and size; repeated rows stay; a very long text is
    one row, and makes its shard as much larger; an empty table gives no rows. Columns of docs
    other than id and text are ignored. Returns id, size, text_crc32, law, shard, slot, grown_shard.
    """
    text = text_of(docs, text_column)
    narrow = docs.select(
        docs[id_column].alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("crc"),
    )
    rows = stored(narrow, "sizes")  # texts are read once
    cuts = range_buckets(rows, "id")
    rows = rows.withColumn("bucket", bucket_of(F.col("id"), cuts))
    totals = rows.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = running(totals, ["bytes", "rows"])
    whole = totals.agg(F.sum("bytes").alias("total"))
    inside = W.partitionBy("bucket").orderBy(F.asc_nulls_first("id"), "crc", "size")
    placed = (
        rows.withColumns(
            {
                "in_bytes": F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)),
                "in_rows": F.row_number().over(inside),
            }
        )
        # one row per bucket, at most 65,536: bounded
        .join(F.broadcast(before), "bucket")
        .join(F.broadcast(whole))
        .withColumn("middle", F.col("before_bytes") + F.col("in_bytes") - F.col("size") / 2)
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("middle") * shards / F.col("total"))).cast("int"))
        .withColumn("place", F.col("before_rows") + F.col("in_rows") - 1)
    )
    per_bucket_shard = placed.groupBy("bucket", "shard").agg(F.min("place").alias("first"))
    firsts = per_bucket_shard.groupBy("shard").agg(F.min("first").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(id_column),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
