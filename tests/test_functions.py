"""Boundaries, nulls and ties of functions and operators on small literal tables."""

import io
import zipfile

from pyspark.sql import functions as F

from medialake.functions import annotate as A, dates as D, gates as G, names as N, pixels as P, vectors as V
from medialake.operators import commands as K, duplicates as U, jobs as J, organise as O, rules as R, search as S
from medialake.sources import archives, files
from medialake.streaming import ingest



class _Now:
    """The clock of these tests, made when a session is there."""

    def __new__(cls):
        return F.lit("2024-06-01 00:00:00").cast("timestamp")



def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_names(spark):
    got = one(spark, N.slug(F.lit(" Ünder "), F.lit("A b")), N.slug(F.lit("")), N.scene_title(F.lit("group_photo")), N.scene_title(F.lit("N/A")), N.safe_path(F.lit("a/../b")), N.safe_path(F.lit("a\\b?.jpg")), N.archive_suffix(F.lit("x.tar.gz")))
    assert tuple(got) == ("nder-a-b", "untitled", "Group Photo", "", None, "a/b_.jpg", ".tar.gz")
    assert one(spark, N.json_list(F.lit('[" 2 ", "", "a2"]')), N.json_list(F.lit("[bad")), N.json_list(F.lit(None).cast("string")))[:3] == (["2", "a2"], [], [])


def test_path_dates(spark):
    day = lambda p: D.path_date(F.lit(p), _Now()).cast("string")
    got = one(spark, day("Forest 28-02-2005/P1.jpg"), day("Holiday/2007-07-15/I.JPG"), day("trip_20050228/p.jpg"), day("x/31-02-2005/20060102.jpg"), day("x/y.jpg"), day("2001-01-01/2002-02-02/a.jpg"))
    assert tuple(got) == ("2005-02-28", "2007-07-15", "2005-02-28", "2006-01-02", None, "2002-02-02")


def test_capture_dates(spark):
    none = F.lit(None).cast("timestamp")
    meta = lambda text: F.create_map(F.lit("DateTimeOriginal"), F.lit(text))
    got = one(spark, D.taken_at(meta("2005:02:28 14:30:00"), F.lit("x.jpg"), none, _Now(), _Now()), D.taken_at(meta("bad"), F.lit("2007-07-15/x.jpg"), none, _Now(), _Now()), D.taken_at(meta("bad"), F.lit("x.jpg"), none, _Now(), _Now()))
    assert (got.c0.source, str(got.c0.at)) == ("exif:DateTimeOriginal", "2005-02-28 14:30:00")
    assert got.c1.source == "path" and got.c2 is None


def test_birth_times_near_the_clock_are_not_believed(spark):
    born = lambda text: D.taken_at(F.create_map(F.lit("DateTime"), F.lit("bad")), F.lit("x.jpg"), F.lit(text).cast("timestamp"), _Now(), _Now())
    near, after, good = one(spark, born("2024-06-02 00:00:00"), born("2026-06-01 00:00:00"), born("2024-05-20 00:00:00"))
    assert near is None and after is None and good.source == "birthtime"


def test_gates(spark):
    code = lambda p, size, w, h: G.path_code(F.lit(p), F.lit(size), F.lit(w), F.lit(h))
    got = one(spark, code("a/logo.svg", 9, 1, 1), code("a/b.jpg", 0, 9, 9), code("a/favicon_x.jpg", 90_000, 900, 900), code("downloads/ok.jpg", 90_000, 900, 900), code("web/ok.jpg", 90_000, 900, 900), code("a/b.jpg", 90_000, 200, 150), code("a/b.jpg", 90_000, 3000, 2000), code("a/b.jpg", 90_000, 5000, 500), code("a/b.png", 9_000, 900, 900))
    assert tuple(got) == ("vector_or_blocked", "empty", "junk_path", "junk_path", "junk_dir", "too_small", None, "extreme_aspect", "web_format_too_small")
    assert one(spark, G.dimension_code(F.lit(None).cast("int"), F.lit(5), F.lit("image"))).c0 is None


def test_annotations(spark):
    got = one(spark, A.scene(F.lit("Ocean")), A.scene(F.lit(None).cast("string")), A.unit_score(F.lit("0")), A.unit_score(F.lit("7")), A.failures(F.lit("vlm-failed:x")), A.failures(F.lit("VLM-gave-up")))
    assert tuple(got) == ("water", "other", 0.5, 1.0, 1, 10_000)
    assert one(spark, A.is_heuristic(F.lit(None).cast("string"), F.lit(None).cast("string"))).c0 is None


def test_hamming_and_cosine(spark):
    got = one(spark, V.hamming_hex(F.lit("ff"), F.lit("00")), V.hamming_hex(F.lit("ff"), F.lit("000")), V.hamming_hex(F.lit("zz"), F.lit("00")), V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))))
    assert tuple(got) == (8, 999, 999, 0.0)
    hashes = spark.createDataFrame([(1, "0000000000000000"), (2, "0101010101010101"), (3, "01010101010101ff"), (4, "00000000000000ff")], "id long, phash string")
    pairs = {(r.a, r.b): r.distance for r in U.hamming_pairs(hashes).collect()}
    assert pairs == {(1, 2): 8, (1, 4): 8, (2, 3): 7, (3, 4): 7}


def test_sessions_gap_of_exactly_three_days(spark):
    rows = [(1, 1, "2024-01-01 00:00:00"), (1, 2, "2024-01-04 00:00:00"), (1, 3, "2024-01-07 00:00:00.000001"), (1, 4, None)]
    df = spark.createDataFrame(rows, "k long, id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r.id: r.session for r in O.sessions(df, ["k"], "ts").collect()} == {1: 0, 2: 0, 3: 1}
    assert {r.id: r.event for r in O.events(df, "ts").collect()} == {1: 0, 2: 0, 3: 1}


def test_components_and_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(50, 51)], "a long, b long")
    got = {r.media_id: r.group_id for r in U.groups(edges).collect()}
    assert got == {i: 1 for i in range(1, 21)} | {50: 50, 51: 50}
    assert U.groups(edges.limit(0)).count() == 0


def test_pruning_twice_is_once(spark):
    items = spark.createDataFrame([(1, "library"), (2, None), (3, "trash"), (4, "library")], "id long, lifecycle string")
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (9, 3), (9, 4)], "group_id long, media_id long")
    first = U.pruned(members, items)
    assert sorted(map(tuple, first.select("group_id", "media_id").collect())) == [(1, 1), (1, 2)]
    assert sorted(map(tuple, U.pruned(first, items).select("group_id", "media_id").collect())) == [(1, 1), (1, 2)]


def test_patch_keeps_what_commands_leave_out(spark):
    media = spark.createDataFrame([(1, 3, False, "pending"), (2, 4, True, "pending")], "id long, rating int, flag boolean, hitl_status string")
    edits = spark.createDataFrame([(1, 9, None, None), (2, None, None, "x"), (7, 1, None, None)], "id long, rating int, flag boolean, caption string")
    got = {r.id: (r.rating, r.flag, r.hitl_status) for r in K.patched(media, edits).collect()}
    assert got == {1: (5, False, "pending"), 2: (4, True, "edited")}


def test_rules():
    assert R.auto_name({"year": 0}) == "Year 0" and R.auto_name({"camera_make": "A", "camera_model": "B"}) == "A B" and R.auto_name({}) == "Smart collection"
    assert R.auto_key({"a": 1, "b": 2}) == R.auto_key({"b": 2, "a": 1})


def test_search_syntax(spark):
    docs = spark.createDataFrame([(1, "Élan vital"), (2, "elan mortel"), (3, None)], "id long, t string")
    ids = lambda q: [r.id for r in S.search(docs, q, "id", ["t"]).collect()]
    assert ids("elan -") == [1, 2] and ids("elan NOT vital") == [2] and ids("vit* OR mortel") == [1, 2] and ids("") == [] and ids("t:vital") == [1]


def test_archives(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name in ("album/P1.JPG", "notes.txt", "__MACOSX/._P1.JPG", "../escape.jpg", "safe/ok.jpg"):
            z.writestr(name, b"x" * 10)
    assert [m[0] for m in archives.members_of(buffer.getvalue())] == ["album/P1.JPG", "safe/ok.jpg"]
    assert [m[0] for m in archives.members_of(buffer.getvalue(), most_files=1)] == ["album/P1.JPG"]
    assert list(archives.members_of(b"junk")) == []
    (tmp_path / "pack.zip").write_bytes(buffer.getvalue())
    found = archives.expanded(spark.read.format("binaryFile").load(str(tmp_path)))
    assert sorted(r.rel_path for r in found.collect()) == ["archives/pack/album/P1.JPG", "archives/pack/safe/ok.jpg"]


def test_folder_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.jpg", "sub/b.MP4", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    assert {r.filename: r.media_type for r in files.scan(spark, str(tmp_path)).collect()} == {"a.jpg": "image", "b.MP4": "video"}
    assert [r.name for r in files.volumes(spark, str(tmp_path)).collect()] == ["sub"]


def test_metadata(spark):
    raw = F.lit('{"EXIF:Make":"","IFD0:Make":"Canon","GPS:GPSLatitude":"10.5","GPS:GPSLatitudeRef":"South","X:Duration":"2.5","X:ImageWidth":"640"}')
    got = one(spark, files.metadata(raw)).c0
    assert (got.camera_make, got.gps_lat, got.duration_ms, got.width, got.height) == ("Canon", -10.5, 2500, 640, None)


def test_blur(spark):
    sharp = [[float((i // 4 + j // 4) % 2 * 255) for j in range(40)] for i in range(40)]
    flat = [[1.0] * 40] * 40
    df = spark.createDataFrame([(1, sharp), (2, flat), (3, [[1.0]]), (4, None)], "id long, g array<array<double>>")
    got = {r.id: r.s for r in df.select("id", P.blur_score(F.col("g")).alias("s")).collect()}
    assert got[1] > 80 and got[2] == 0 and got[3] is None and got[4] is None
    assert tuple(one(spark, P.degrees(F.lit(6)), P.degrees(F.lit(2)))) == (90, 0)


def test_reaper(spark):
    ts = lambda m: f"2024-05-31 23:{60 - m:02d}:00"
    rows = [(1, "running", ts(20), False, None), (2, "running", ts(20), True, None), (3, "queued", ts(5), False, None), (4, "running", ts(20), False, "Cancelling")]
    df = spark.createDataFrame([(i, s, None, None, at, at, live, m) for i, s, at, live, m in rows], "id long, status string, error string, job_type string, created_at string, started_at string, is_live boolean, message string")
    df = df.withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "started_at")})
    assert {r.id: r.status for r in J.reaped(df, _Now()).collect()} == {1: "interrupted", 2: "running", 3: "queued", 4: "cancelled"}


def test_stream_drains_once(spark, tmp_path):
    rows = [(1, "d/a.jpg", "h1", 90_000, 900, 900, False), (2, "d/icon_x.jpg", "h2", 90_000, 900, 900, False), (3, "d/c.jpg", "h1", 90_000, 900, 900, False)]
    names = [f.name for f in ingest.STAGED][:-1]
    staged = spark.createDataFrame(rows, "id long, path string, sha256 string, file_size long, width int, height int, failed boolean").select(*names, F.current_timestamp().alias("staged_at"))
    folder, library = str(tmp_path / "staged"), str(tmp_path / "library")
    for _ in range(2):
        staged.coalesce(1).write.mode("append").parquet(folder)
        ingest.drain(ingest.staged_stream(spark, folder), library, str(tmp_path / "progress")).awaitTermination()
    got = spark.read.parquet(library)
    assert got.filter("lifecycle = 'library'").count() == 1 and got.filter("lifecycle = 'rejected'").select("code").distinct().collect()[0].code == "junk_path"


def test_event_windows_stream(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "e"))
    stream = ingest.event_windows(spark.readStream.schema(spark.read.parquet(str(tmp_path / "e")).schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == spark.read.parquet(str(tmp_path / "e")).count()


def test_repair():
    import json

    assert json.loads(A.repaired('```json\n{"a": [1, 2,], }\n```')) == {"a": [1, 2]}
    assert json.loads(A.repaired('So: {"a": {"b": ["x", "y \\" z')) == {"a": {"b": ["x", 'y " z']}}
    assert A.repaired('{"a": 1, "b":') is None
    assert A.repaired(None) is None and A.repaired("no") is None and A.repaired("[1]") is None


def plain_turn(gray, aggressive):
    """The rule for upright pictures in plain steps."""
    import numpy as np

    def score(a):
        if min(a.shape) < 8:
            return 0.0
        n = a.shape[0] // 5
        top, middle, bottom = a[:n].mean(), a[2 * n : 3 * n].mean(), a[4 * n :].mean()
        return 1.2 * np.abs(a[:, 1:] - a[:, :-1]).mean() + 0.95 * np.abs(a[1:] - a[:-1]).mean() + 0.08 * (abs(top - bottom) + 0.35 * abs(top - middle))

    turned = {t: np.rot90(gray, -t // 90) for t in (0, 90, 180, 270)}
    scores = {t: score(a) for t, a in turned.items()}
    (best, high), (second, low) = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:2]
    if best == 0 or low <= 0:
        return best
    lead = (high - low) / max(low, 1e-6)
    if {best, second} == {90, 270} and lead < 0.08:
        ends = {t: round(abs(turned[t][: len(turned[t]) // 4].mean() - turned[t][3 * (len(turned[t]) // 4) :].mean()), 6) for t in (90, 270)}
        return 90 if ends[90] >= ends[270] else 270
    return best if lead >= (0.03 if aggressive else 0.10) or aggressive and high > 1.08 * scores[0] else 0


def test_upright(spark):
    import numpy as np

    r = np.random.default_rng(1)
    sky = np.repeat(np.linspace(255, 0, 64)[:, None], 64, axis=1) + r.normal(0, 1, (64, 64))
    shapes = [sky, sky.T, np.ones((4, 4)), np.zeros((20, 20))]
    shapes += [np.cumsum(r.normal(0, 1, (int(h), int(w))), axis=int(k)) * r.choice([1, 5]) for h, w, k in zip(r.integers(8, 30, 60), r.integers(8, 30, 60), r.integers(0, 2, 60))]
    rows = [(i, a.ravel().tolist(), a.shape[1]) for i, a in enumerate(shapes)] + [(-1, None, None)]
    df = spark.createDataFrame(rows, "id int, pixels array<double>, width int").select("id", P.picture_signs(F.col("pixels"), F.col("width")).alias("s"), P.blur_score(F.col("pixels"), F.col("width")).alias("blur"))
    got = {x.id: x for x in df.select("id", P.upright_degrees(F.col("s")).alias("turn"), P.upright_degrees(F.col("s"), True).alias("more"), "blur").collect()}
    assert got[0].turn == 0 and got[0].more == 0 and got[2].turn == 0 and got[2].blur is None and got[3].blur == 0.0 and got[-1].turn is None
    for i, a in enumerate(shapes):
        assert (got[i].turn, got[i].more) == (plain_turn(a, False), plain_turn(a, True)), i
    assert len({x.turn for x in got.values()}) > 3


def test_fusion(spark):
    one, other = spark.createDataFrame([(1, 9.0), (2, 8.0)], "id long, score double"), spark.createDataFrame([(2, 0.5), (3, 0.4)], "id long, score double")
    assert [r.id for r in S.fused([one, other]).collect()] == [2, 1, 3]


def test_stems(spark):
    from medialake.functions.stem import stem

    known = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat",
        "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam",
        "triplicate": "triplic", "hopefulness": "hope", "revival": "reviv", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll",
    }
    assert {w: stem(w) for w in known} == known
    docs = spark.createDataFrame([(1, "Running boats"), (2, "a boat ran")], "id long, t string")
    assert [r.id for r in S.search(docs, "boats run", "id", ["t"], stemmed=True).collect()] == [1]


def test_cosine_pairs_in_blocks(spark):
    import numpy as np

    vectors = np.random.default_rng(3).normal(size=(60, 4))
    vectors[7] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(99, None)], "id long, embedding array<double>")
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-300)[:, None]
    expect = {(i, j) for i in range(60) for j in range(i + 1, 60) if unit[i] @ unit[j] >= 0.92}
    for rows in (7, 1000):
        assert {(r.a, r.b) for r in U.cosine_pairs(df, 0.92, block_rows=rows).collect()} == expect
    assert U.cosine_pairs(df.limit(0)).count() == 0


def test_numbers_and_sessions_of_large_groups(spark):
    """Against plain Python: a hot group, a null one, ties in values, null summands, over more ranges than groups."""
    from medialake.operators import ordered

    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        data = [(i, None if i % 10 == 0 else "hot" if i % 10 < 8 else f"g{i % 40}", (i * i) % 997, None if i % 7 == 0 else i % 50) for i in range(3_000)]
        df = spark.createDataFrame(data, "id long, g string, v long, size long").repartition(5)
        found = {r.id: (r.number, r.sum_size) for r in ordered.numbered(df, ["g"], [F.desc("v"), "id"], ["size"]).collect()}
        steps = {r.id: r.session for r in ordered.parted(df, ["g"], ["v", "id"], "v", 3).collect()}
        assert len(ordered.cells(df, ["g"], ["v", "id"]).filter("g = 'hot'").select("cell").distinct().collect()) > 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    for group in {r[1] for r in data}:
        total = 0
        for n, (i, _, _, size) in enumerate(sorted((r for r in data if r[1] == group), key=lambda r: (-r[2], r[0])), 1):
            total += size or 0
            assert found[i] == (n, total)
        last, session = None, 0
        for i, _, v, _ in sorted((r for r in data if r[1] == group), key=lambda r: (r[2], r[0])):
            session += last is not None and v - last > 3
            assert steps[i] == session
            last = v
    empty = df.filter("id < 0")
    assert ordered.numbered(empty, ["g"], ["id"], ["size"]).count() == ordered.parted(empty, ["g"], ["v", "id"], "v", 3).count() == 0


def test_probes_of_files_and_archives(spark, tmp_path):
    (tmp_path / "good.jpg").write_bytes(b"x")
    (tmp_path / "empty.jpg").write_bytes(b"")
    paths = [str(tmp_path / "good.jpg"), f"file://{tmp_path}/empty.jpg", str(tmp_path), str(tmp_path / "gone.jpg"), None]
    found = {r.path: (r.readable, r.reason) for r in files.probed(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert [found[p][0] for p in paths] == [True, True, False, False, False]
    assert found[None][1] == "not a regular file"
    for name, members in (("yes", ["a/P.JPG"]), ("no", ["a/notes.txt", "__MACOSX/P.JPG", ".hidden.jpg"])):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for m in members:
                z.writestr(m, b"1")
    packed = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(str(tmp_path))
    peeked = packed.select(F.element_at(F.split("path", "/"), -1).alias("p"), archives.has_media("content").alias("has"))
    assert {r.p: r.has for r in peeked.collect()} == {"yes.zip": True, "no.zip": False}


def test_queue_is_drained_until_nothing_moves(spark):
    left, seen = list(range(7)), []

    def queue():
        return spark.createDataFrame([(i, i) for i in left], "pos long, id long")

    def work(batch):
        ids = [r.id for r in batch.collect()]
        seen.append(ids)
        for i in ids:
            if i != 5:  # this one never leaves the queue
                left.remove(i)

    assert J.drained(queue, work, most=3) == 3
    assert seen == [[0, 1, 2], [3, 4, 5], [5, 6]]
    left.clear()
    assert J.drained(queue, work, most=3) == 0


def test_progress_of_streams(spark, tmp_path):
    import time

    staged = spark.createDataFrame([(1, "a/p.jpg", "x", 90_000, 900, 900, False, None)], ingest.STAGED)
    staged.write.parquet(str(tmp_path / "in"))
    progress = ingest.Progress(most=5)
    spark.streams.addListener(progress)
    try:
        ingest.drain(ingest.staged_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        for _ in range(100):
            if any(r[2] == "ended" for r in progress.reports):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    told = progress.table(spark).collect()
    assert told[0].status == "started" and told[-1].status == "ended" and len({r.query for r in told}) == 1
    assert sum(r["rows"] or 0 for r in told) == 1


def test_words_of_records(spark):
    got = one(spark, N.as_int(F.lit("-3.9")), N.as_int(F.lit("1e30")), N.as_int(F.lit("NaN")), N.as_text(F.lit(" \t")), N.volume_slug(F.lit(" Fotos ß/1 ")), N.volume_slug(F.lit("/ /")), A.failed_version(F.lit(None).cast("int")), A.failed_version(F.lit(1)))
    assert tuple(got) == (-3, None, None, None, "Fotos_ß_1", "unknown_volume", "vlm-failed:1", "vlm-gave-up")
