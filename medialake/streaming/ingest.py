"""Streaming ingest: staged files in micro-batches, gated, promoted or rejected, with failures counted."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.gates import path_code
from .attempts import unseen

STAGED = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("failed", T.BooleanType()),
        T.StructField("staged_at", T.TimestampType()),
    ]
)


def gated(staged: DataFrame) -> DataFrame:
    """Each staged row with its code and where it goes: library, rejected, or retry for failed ones."""
    code = path_code(F.col("path"), F.col("file_size"), F.col("width"), F.col("height"))
    lifecycle = F.when(F.coalesce("failed", F.lit(False)), "retry").when(code.isNull(), "library").otherwise("rejected")
    return staged.withColumns({"code": code, "lifecycle": lifecycle})


def staged_stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """Rows of Parquet files as they arrive, a bounded number of files each time, oldest first."""
    return spark.readStream.schema(STAGED).option("maxFilesPerTrigger", files_per_batch).option("latestFirst", "false").parquet(folder)


def drain(stream: DataFrame, library: str, checkpoint: str, after_batch=None, known: DataFrame | None = None) -> StreamingQuery:
    """Drains what is staged into library/batch=N folders: a batch run again overwrites its own folder only.

    Content that came before, in the stream or in known (sha256), is skipped: its hashes are in the stream's state, so
    no batch reads the library, and a resumed import adds nothing twice. Failed rows come out as retry and don't count
    as seen (see again()). after_batch(spark, library) may then organise.
    """

    def commit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{library}/batch={number}")
        if after_batch:
            after_batch(batch.sparkSession, library)

    new = unseen(gated(stream), known)
    return new.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def again(results: DataFrame, most: int = 3) -> DataFrame:
    """Rows to stage once more: those of a drained library that only failed so far, less than `most` times."""
    last = F.max_by(F.struct(*STAGED.names), F.col("batch")).alias("row")
    per_item = results.groupBy("id").agg(F.count_if(F.col("lifecycle") == "retry").alias("failures"), F.count_if(F.col("lifecycle") != "retry").alias("settled"), last)
    return per_item.filter((F.col("settled") == 0) & (F.col("failures") < most)).select("row.*").withColumn("failed", F.lit(False))


def failure_counts(failures: DataFrame, most: int = 3) -> DataFrame:
    """Running number of failures per item of a stream (id, at), and whether it is parked: kept in the stream's state."""
    n = failures.groupBy("id").agg(F.count(F.lit(1)).alias("attempts"))
    return n.withColumn("state", F.when(F.col("attempts") >= most, "error").otherwise("retry"))


def event_windows(events: DataFrame, ts: str = "ts", late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Counts per type in windows of event time; rows later than the watermark are left out of closed windows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def mounted(previous: set[str], current: set[str]) -> tuple[set[str], set[str]]:
    """New volumes, and the state to keep: those unmounted are forgotten, so that they count as new again."""
    return current - previous, set(current)


class Progress(StreamingQueryListener):
    """What streaming queries have done last: the newest `most` reports, for a table of live progress."""

    def __init__(self, most: int = 20):
        self.reports: deque[tuple] = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:
        self.reports.append((str(event.id), event.name, "started", None, None, 0.0))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.reports.append((str(p.id), p.name, "running", p.batchId, p.numInputRows, float(p.processedRowsPerSecond or 0.0)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.reports.append((str(event.id), None, "failed" if event.exception else "ended", None, None, 0.0))

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per report, the oldest first: query, name, status, batch, rows, rows a second."""
        return spark.createDataFrame(list(self.reports), "query string, name string, status string, batch long, rows long, per_second double")
