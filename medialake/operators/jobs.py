"""The job state machine: reaping, cancelling, choosing what to recover."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULTS, Settings
from .ordered import numbered


def reaped(jobs: DataFrame, now: Column, s: Settings = DEFAULTS) -> DataFrame:
    """jobs after a pass over orphans: old queued or running ones without a worker end as cancelled or interrupted."""
    age = lambda since: F.unix_timestamp(now) - F.unix_timestamp(since)
    old = F.when(F.col("status") == "queued", age(F.col("created_at")) >= 60 * s.queued_minutes).when(
        F.col("status") == "running", age(F.coalesce("started_at", "created_at")) >= 60 * s.running_minutes
    )
    orphan = F.coalesce(old, F.lit(False)) & ~F.col("is_live")
    cancelled = F.lower(F.coalesce("message", F.lit(""))).contains("cancel") | F.coalesce(F.col("error") == "cancelled_by_user", F.lit(False))
    status = F.when(orphan & cancelled, "cancelled").when(orphan, "interrupted").otherwise(F.col("status"))
    return jobs.withColumns({"was": F.col("status"), "reaped": orphan, "status": status})


def cancelled(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """jobs after cancel requests (id, times): queued ones end at once, running ones end when asked twice or dead."""
    joined = jobs.join(requests.select("id", "times"), "id", "left")
    asked = F.coalesce("times", F.lit(0))
    done = (F.col("status") == "queued") & (asked > 0) | (F.col("status") == "running") & ((asked > 1) | (asked > 0) & ~F.col("is_live"))
    refused = ~F.col("status").isin("queued", "running") & (asked > 0)
    outcome = F.when(refused, "refused").when(done, "cancelled").when(asked > 0, "cancelling").otherwise("untouched")
    return joined.withColumns({"outcome": outcome, "status": F.when(done, "cancelled").otherwise(F.col("status"))}).drop("times")


def recovery(jobs: DataFrame) -> DataFrame:
    """The one job to resume: the newest interrupted one of each type that has no active job."""
    busy = jobs.filter(F.col("status").isin("queued", "running")).select("job_type").distinct()
    idle = jobs.filter("status = 'interrupted'").join(busy, "job_type", "left_anti")
    return idle.groupBy("job_type").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


def throughput(progress: DataFrame) -> DataFrame:
    """Items an hour of each job, from its items done and seconds elapsed; 0 before any time has passed."""
    return progress.withColumn("per_hour", F.when(F.col("elapsed_s") > 0, F.col("done") * 3600.0 / F.nullif("elapsed_s", F.lit(0))).otherwise(0.0))


def parked(failures: DataFrame, most: int = 3) -> DataFrame:
    """Items by number of failures: retried below `most`, parked as errors from there."""
    n = failures.groupBy("id").agg(F.count(F.lit(1)).alias("attempts"))
    return n.withColumn("state", F.when(F.col("attempts") >= most, "error").otherwise("retry"))


def attempts_of(tries: DataFrame, most: int = 3) -> DataFrame:
    """Each item's (id, attempts, state) after its tries (id, ok, at, pos): failures since its last success.

    An item that ever failed `most` times in a row is parked as an error; successes after that change nothing. pos
    decides ties of time.
    """
    rows = tries.select("id", "at", "pos", F.col("ok").cast("int").alias("ok"))
    runs = numbered(rows, ["id"], ["at", "pos"], ["ok"]).groupBy("id", F.col("sum_ok").alias("run")).agg(F.count_if(F.col("ok") == 0).alias("failures"))
    per_item = runs.groupBy("id").agg(F.max("failures").alias("most"), F.max_by("failures", "run").alias("last"))
    parked = F.col("most") >= most
    count = F.when(parked, most).otherwise(F.col("last")).cast("int")
    return per_item.select("id", count.alias("attempts"), F.when(parked, "error").when(F.col("last") > 0, "retry").otherwise("done").alias("state"))


def stale(jobs: DataFrame) -> DataFrame:
    """Jobs that are marked stale, or are active without a living worker."""
    active = F.col("status").isin("queued", "running") & ~F.coalesce("is_live", F.lit(True))
    return jobs.filter(F.coalesce("stale", F.lit(False)) | active)


def next_batch(queue: DataFrame, previous: DataFrame, most: int = 100) -> DataFrame:
    """The first ids of a queue (pos, id); none if all of them were in the previous batch, as then nothing moves."""
    batch = queue.orderBy("pos", "id").limit(most).select("id")
    fresh = batch.join(previous.select("id").distinct(), "id", "left_anti").limit(1).select(F.lit(True).alias("fresh"))
    return batch.join(F.broadcast(fresh))  # one row or none


def drained(queue: Callable[[], DataFrame], work: Callable[[DataFrame], None], most: int = 100) -> int:
    """Hands batch after batch of a queue to work, until there is none or one brings nothing new; their number.

    The driver holds the ids of one batch, `most` at the most.
    """
    spark, done, ids = queue().sparkSession, 0, []
    while True:
        rows = queue()
        type_ = rows.schema["id"].dataType.simpleString()
        previous = spark.createDataFrame([(i,) for i in ids], f"id {type_}")
        ids = [r.id for r in next_batch(rows, previous, most).select("id").collect()]
        if not ids:
            return done
        work(spark.createDataFrame([(i,) for i in ids], f"id {type_}"))
        done += 1
