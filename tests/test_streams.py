"""State of streams over restarts, volumes as they come and go, copies that fail or are stopped, groups by arrival."""

import hashlib
import os
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from medialake.operators import graph, jobs as J
from medialake.sources import copying, files
from medialake.streaming import attempts as A, ingest

TRIES = "id long, ok boolean, at timestamp, pos long"


@pytest.fixture
def few(spark):
    """One partition of state is enough for small streams."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def drained(stream, checkpoint, sink, mode="update"):
    query = stream.writeStream.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(sink)).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_attempts_over_a_restart_equal_the_batch(few, tmp_path):
    r = random.Random(1)
    told = [(r.randrange(12), r.random() < 0.35, k) for k in range(150)]
    rows = few.createDataFrame([(i, ok, k, k) for i, ok, k in told], "id long, ok boolean, s long, pos long").withColumn("at", F.timestamp_seconds(F.col("s") + 1_700_000_000)).select("id", "ok", "at", "pos")
    folder = str(tmp_path / "in")
    for part in range(3):  # each time another run of the query, from its checkpoint
        rows.filter((F.col("pos") >= 50 * part) & (F.col("pos") < 50 * part + 50)).coalesce(1).write.mode("append").parquet(folder)
        drained(A.attempts(few.readStream.schema(TRIES).parquet(folder)), str(tmp_path / "cp"), str(tmp_path / "out"))
    last = few.read.parquet(str(tmp_path / "out")).groupBy("id").agg(F.max_by(F.struct("attempts", "state"), "batch").alias("x")).select("id", "x.*")
    expected = {x.id: (x.attempts, x.state) for x in J.attempts_of(rows).collect()}
    assert {x.id: (x.attempts, x.state) for x in last.collect()} == expected and {s for _, s in expected.values()} >= {"error"}


def test_failures_are_forgotten_after_a_while(few, tmp_path):
    folder, at = str(tmp_path / "in"), lambda h: F.timestamp_seconds(F.lit(1_700_000_000 + 3600 * h))
    one = lambda i, h: few.range(1).select(F.lit(i).cast("long").alias("id"), F.lit(False).alias("ok"), at(h).alias("at"), F.lit(0).cast("long").alias("pos"))
    for rows in (one(1, 0), one(9, 30), one(9, 60), one(1, 61)):
        rows.write.mode("append").parquet(folder)
        drained(A.attempts(few.readStream.schema(TRIES).parquet(folder), forget=timedelta(hours=10)), str(tmp_path / "cp"), str(tmp_path / "out"))
    got = few.read.parquet(str(tmp_path / "out")).filter("id = 1").orderBy("batch").collect()
    assert [(x.attempts, x.state) for x in got] == [(1, "retry"), (0, "forgotten"), (1, "retry")]


def staged(spark, rows):
    names = "id long, path string, sha256 string, file_size long, width int, height int, failed boolean"
    return spark.createDataFrame(rows, names).withColumn("staged_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")))


def test_draining_knows_contents_from_its_state(few, tmp_path):
    folder, library, progress = (str(tmp_path / n) for n in ("staged", "library", "cp"))
    file = lambda i, h, failed=False: (i, f"d/{i}.jpg", h, 90_000, 900, 900, failed)
    known = few.createDataFrame([("old",)], "sha256 string")
    for rows in ([file(1, "a"), file(2, "a"), file(3, "old"), file(4, None), file(5, None), file(6, "b", True)], [file(7, "a"), file(8, "b"), file(9, "c", True)], [file(10, "b"), file(11, "c", True)]):
        staged(few, rows).coalesce(1).write.mode("append").parquet(folder)
        ingest.drain(ingest.staged_stream(few, folder), library, progress, known=known).awaitTermination()
    got = few.read.parquet(library)
    assert sorted(r.id for r in got.filter("lifecycle = 'library'").collect()) == [1, 4, 5, 8]
    assert sorted(r.id for r in got.filter("lifecycle = 'retry'").collect()) == [6, 9, 11]
    again = ingest.again(got)
    assert sorted(r.id for r in again.collect()) == [6, 9, 11] and again.columns == ingest.STAGED.names
    assert ingest.again(got.filter("id = 9"), most=1).count() == 0


def test_sessions_of_a_stream_equal_those_of_the_table(few, tmp_path):
    events = few.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "user_id", "ts")
    events = events.repartitionByRange(3, "ts").sortWithinPartitions("ts")
    folder = str(tmp_path / "in")
    events.union(events.limit(20)).write.parquet(folder)  # repeated events
    far = events.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), (F.col("ts") + F.expr("interval 402 days")).alias("ts"))
    far.write.mode("append").parquet(folder)
    schema = "event_id long, user_id long, ts timestamp"
    stream = few.readStream.schema(schema).parquet(folder)
    drained(A.sessions(stream, "12 hours", late="400 days"), str(tmp_path / "cp"), str(tmp_path / "out"), "append")
    late = events.limit(1).select(F.lit(-2).cast("long").alias("event_id"), "user_id", F.lit("2000-01-01").cast("timestamp").alias("ts"))
    far.union(late).withColumn("event_id", F.col("event_id") - 10).coalesce(1).write.mode("append").parquet(folder)
    query = drained(A.sessions(few.readStream.schema(schema).parquet(folder), "12 hours", late="400 days"), str(tmp_path / "cp"), str(tmp_path / "out"), "append")
    rows = lambda df: sorted((r.user_id, r["first"], r["last"], r.n) for r in df.collect() if r.user_id >= 0)
    closed = rows(few.read.parquet(str(tmp_path / "out")))
    assert closed == rows(A.sessions(events, "12 hours")) and A.dropped(query) >= 1


def test_volumes_come_go_and_come_again(few, tmp_path):
    root, out, progress = tmp_path / "volumes", str(tmp_path / "out"), str(tmp_path / "cp")
    (root / "there").mkdir(parents=True)

    def turn():
        query = files.new_volumes(few, str(root)).writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(out)).option("checkpointLocation", progress).start()
        try:
            query.processAllAvailable()
            yield
            query.processAllAvailable()
        finally:
            query.stop()

    def told():
        return sorted(r.name for r in few.read.schema("name string, path string, kind string").parquet(out).collect()) if os.path.isdir(out) else []

    for _ in turn():
        (root / "card").mkdir()
        (root / ".hidden").mkdir()
    assert told() == ["card"]
    for _ in turn():  # a restart: card is known
        (root / "CD 1").mkdir()
    assert told() == ["CD 1", "card"]
    for _ in turn():
        (root / "card").rmdir()
    (root / "card").mkdir()
    for _ in turn():
        pass
    assert told() == ["CD 1", "card", "card"]


def test_copies_with_failures_repeats_and_a_stop(spark, tmp_path, monkeypatch):
    sources = tmp_path / "in"
    sources.mkdir()
    rows = []
    for i in range(6):
        (sources / f"{i}.bin").write_bytes(os.urandom(copying.BLOCK * (i % 3) + 17 * i))
        os.utime(sources / f"{i}.bin", (1_000_000_000 + i, 1_000_000_000 + i))
        rows.append((str(sources / f"{i}.bin"), f"file://{tmp_path}/out/d{i % 2}/{i}.bin"))
    rows += [(str(sources / "none.bin"), str(tmp_path / "out/none.bin")), (None, "x"), (rows[1][0], str(tmp_path / "out/d0/taken.bin"))]
    (tmp_path / "out/d0").mkdir(parents=True)
    (tmp_path / "out/d0/taken.bin").write_bytes(b"other")
    df = spark.createDataFrame(rows, "source string, target string")
    got = {r.source: r for r in copying.copied(df).filter("target not like '%taken%'").collect()}
    for i in range(6):
        r, path = got[rows[i][0]], rows[i][1].removeprefix("file://")
        content = open(path, "rb").read()
        assert (r.outcome, r.sha256, r.size) == ("copied", hashlib.sha256(content).hexdigest(), len(content)) and content == (sources / f"{i}.bin").read_bytes() and os.stat(path).st_mtime == 1_000_000_000 + i
    assert got[rows[6][0]].outcome == "failed" and got[None].outcome == "failed"
    again = {r.target: r.outcome for r in copying.copied(df).collect()}
    assert all(again[t] == "present" for _, t in rows[:6]) and again[rows[8][1]] == "failed" and (tmp_path / "out/d0/taken.bin").read_bytes() == b"other"
    (tmp_path / "stop").write_text("")
    stopped = copying.copied(spark.createDataFrame([(rows[2][0], str(tmp_path / "late/2.bin"))], "source string, target string"), mark=str(tmp_path / "stop")).collect()
    assert [r.outcome for r in stopped] == ["cancelled"] and not os.listdir(tmp_path / "late")

    real = copying.hashed
    monkeypatch.setattr(copying, "hashed", lambda f, p: ("damaged", 0) if p.endswith(".part") else real(f, p))
    assert copying.copy(rows[2][0], str(tmp_path / "bad/2.bin"))[0] == "failed" and not os.listdir(tmp_path / "bad")
    monkeypatch.undo()
    totals = {r.outcome: r.files for r in copying.totals(copying.copied(df)).collect()}
    assert totals == {"present": 6, "failed": 3}


def test_a_lost_attempt_leaves_nothing_that_matters(spark, tmp_path):
    """A task that dies in the middle and is run again, and two attempts at once: the target is whole."""
    source = tmp_path / "a.bin"
    source.write_bytes(os.urandom(3 * copying.BLOCK))
    target = tmp_path / "out" / "a.bin"
    target.parent.mkdir()
    (tmp_path / "out" / "a.bin.0123.part").write_bytes(b"half")  # what a killed attempt left
    rows = spark.createDataFrame([(str(source), str(target))] * 4, "source string, target string").repartition(4)
    outcomes = [r.outcome for r in copying.copied(rows).collect()]
    assert set(outcomes) <= {"copied", "present"} and target.read_bytes() == source.read_bytes()
    assert sorted(os.listdir(tmp_path / "out")) == ["a.bin", "a.bin.0123.part"]


@pytest.mark.parametrize("seed", [0, 1])
def test_groups_by_arrival(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)]
    whole = {x.id: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    r.shuffle(edges)
    labels = spark.createDataFrame([], "id long, root long")
    for k in range(0, 45, 15):
        labels = graph.joined(labels, spark.createDataFrame(edges[k : k + 15] + edges[:2], "a long, b long")).checkpoint()
    assert {x.id: x.root for x in labels.collect()} == whole
    assert {x.id: x.root for x in graph.joined(labels, spark.createDataFrame([], "a long, b long")).collect()} == whole
