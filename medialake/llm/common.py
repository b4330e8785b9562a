"""What the operators of this subpackage share: tables, the shared scratch folder, order of rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..batches import BATCH_BYTES, BATCH_ROWS, small_batches  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, for operators that get it in small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Where it is unset, a session on one machine (tests) gets a temporary folder; on a cluster, where executors couldn't
    see it, that is an error.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = context._jsc.sc().getCheckpointDir()
        if not path.isDefined() and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = path.get() if path.isDefined() else f"file://{tempfile.mkdtemp(prefix='medialake-')}"
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(docs[column], F.lit(""))


def told(ids: Column, kind: T.DataType) -> Column:
    """Ids as pandas can hold them beside nulls: whole numbers as texts, since pandas makes floats of them."""
    return ids.cast("string") if isinstance(kind, T.IntegralType) else ids


def told_type(kind: T.DataType) -> T.DataType:
    """The type of told(ids, kind); a cast to kind gives the ids back."""
    return T.StringType() if isinstance(kind, T.IntegralType) else kind


def range_buckets(ids: DataFrame, key: str, rows_per_bucket: int = 20_000) -> list:
    """Ascending cut points of a key, one per rows_per_bucket rows or so, at most 65,535 of them.

    Quantiles of an integer key, and for a key of another type those of a bounded sample of its values, by hash. The
    cut points only decide how work is spread; results never depend on them.
    """
    k = max(1, min(1 << 16, ids.count() // rows_per_bucket))
    if k == 1:
        return []
    if isinstance(ids.schema[key].dataType, T.IntegralType):
        cuts = ids.select(F.percentile_approx(key, [i / k for i in range(1, k)], max(10_000, 4 * k))).first()[0] or []
        return sorted(set(cuts))
    sample = sorted(r[0] for r in ids.filter(F.col(key).isNotNull()).select(key).orderBy(F.xxhash64(key)).limit(16 * k).collect())
    return sorted({sample[i * len(sample) // k] for i in range(1, k)}) if sample else []


def _at_or_below(points: Column, key: Column) -> Column:
    """How many of the ascending points are at or below the key."""
    return F.size(F.filter(points, lambda c: c <= key))


def bucket_of(key: Column, cuts: list) -> Column:
    """Number of cut points at or below the key, 0 for null keys: buckets ascend with the key.

    Two levels of at most 256 points each are compared, not all points.
    """
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5), -(-len(cuts) // 256))
    listed = lambda xs: F.array(*[F.lit(x).cast("long") if isinstance(x, int) else F.lit(x) for x in xs])
    parts = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    coarse = _at_or_below(listed([p[0] for p in parts]), key)
    fine = _at_or_below(F.element_at(F.array(*[listed(p) for p in parts]), F.greatest(coarse, F.lit(1))), key)
    return F.when(key.isNull() | (coarse == 0), 0).otherwise((coarse - 1) * step + fine).cast("int")


def running(per_bucket: DataFrame, sums: list[str]) -> DataFrame:
    """Exclusive prefix sums over the few rows of a table of buckets, as columns before_<name>."""
    over = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    return per_bucket.select("bucket", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"before_{c}") for c in sums])
