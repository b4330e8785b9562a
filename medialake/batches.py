"""How many rows Python workers get at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows and bytes in one batch: texts may be long, and a batch is held several times over.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lets the session hand rows to Python in small batches: a setting that queries and the pipeline make."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
