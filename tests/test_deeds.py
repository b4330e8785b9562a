"""Commands on small tables: unknown and repeated ids, nulls, edits that reach the kept index."""

import json

from pyspark.sql import functions as F

from medialake.functions.names import ascii_json
from medialake.operators import commands as K, organise as O, search as S

MEDIA = "id long, disc_id string, filename string, rating int, flag boolean, hitl_status string, lifecycle string, deleted_at timestamp, is_duplicate boolean"
EDITS = "id long, hitl_status string, rating int, flag boolean, caption_short string, description string, suggested_tags array<string>"


def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def media(spark):
    rows = [(i, "d", "a.jpg", 1, False, "pending", life, None, True) for i, life in enumerate(["library", None, "staging", "trash", "staging", "rejected"])]
    return spark.createDataFrame(rows, MEDIA)


def analysis(spark):
    return spark.createDataFrame([(0, "old words", "d", '["x"]'), (9, "orphan", None, None)], "media_id long, caption_short string, description string, suggested_tags string")


def test_edits_reach_annotations_and_the_index(spark, tmp_path):
    edits = spark.createDataFrame([(0, "rejected", 9, None, "harbour lights", None, None), (1, None, -4, True, None, None, ["Sée", 'q"']), (1, None, None, None, None, None, None), (2, "accepted", None, None, None, None, None), (77, None, 5, None, "nobody", None, None)], EDITS)
    out = K.edited(media(spark), analysis(spark), edits, now())
    m = {r.id: r for r in out["media"].collect()}
    assert len(m) == 6 and [(m[i].rating, m[i].hitl_status, m[i].updated_at is not None) for i in range(4)] == [(5, "edited", True), (0, "edited", True), (1, "accepted", True), (1, "pending", False)]
    a = {r.media_id: r for r in out["analysis"].collect()}
    assert set(a) == {0, 1, 9} and a[0].caption_short == "harbour lights" and a[0].suggested_tags == '["x"]' and a[0].human_edited and not a[9].human_edited
    assert a[1].suggested_tags == json.dumps(["Sée", 'q"'])
    kept = S.KeptIndex(spark, f"file://{tmp_path}/index", list(S.FIELDS))
    items = media(spark).join(analysis(spark), F.col("id") == F.col("media_id"), "left")
    kept.upsert(S.document(items), "id")
    assert [r.id for r in kept.search("old words").collect()] == [0] and kept.search("harbour").count() == 0
    K.reindexed(kept, out)
    assert kept.search("old words").count() == 0 and [r.id for r in kept.search("harbour").collect()] == [0] and [r.id for r in kept.search("see").collect()] == [1]


def test_json_in_ascii(spark):
    lists = [["a", 'b"c\\', "é", "中😀", "\n\t\r\b\f\x01\x7f"], [], ["", None]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*lists, None])], "i int, x array<string>")
    got = [r.j for r in df.select("i", ascii_json(F.col("x")).alias("j")).orderBy("i").collect()]
    assert got == [json.dumps(x).replace("\x7f", "\\u007f") for x in lists] + [None]


def test_promotion_gives_clashing_names_the_id(spark):
    out = K.promoted_items(media(spark), spark.createDataFrame([(2, None, None), (4, "old", None)], "media_id long, resolution string, resolved_at timestamp"), spark.createDataFrame([(2,), (2,), (3,), (50,)], "id long"), now())
    m = {r.id: (r.library_path, r.lifecycle, r.hitl_status) for r in out["media"].collect()}
    assert m[2] == ("d/00000002_a.jpg", "library", "accepted") and m[3] == (None, "trash", "pending") and m[4] == (None, "staging", "pending")
    assert {r.media_id: r.resolution for r in out["queue"].collect()} == {2: "accepted", 4: "old"}


def test_a_batch_has_a_limit_and_keeps_times(spark):
    m = media(spark).withColumn("deleted_at", F.when(F.col("id") == 3, F.expr("timestamp '2020-01-01'")))
    reviews = spark.createDataFrame([(i, None, None) for i in range(6)], "media_id long, resolution string, resolved_at timestamp")
    out = K.trashed_batch(m, reviews, spark.createDataFrame([(i, i) for i in (3, 0, 1, 4)], "pos int, id long"), now(), most=3)
    assert {r.id: str(r.deleted_at)[:4] for r in out["media"].filter("lifecycle = 'trash'").collect()} == {0: "2024", 1: "2024", 3: "2020"}
    assert sorted(r.media_id for r in out["queue"].filter("resolution = 'trashed'").collect()) == [0, 1]


def test_groups_with_one_active_member_stay(spark):
    ranked = spark.createDataFrame([("g", 0, True), ("g", 3, False), ("h", 1, False), ("h", 2, True), ("h", 5, False)], "group_id string, media_id long, keep boolean")
    tables = {"media": media(spark), "members": ranked.select("group_id", "media_id"), "groups": ranked.select("group_id").distinct(), "queue": spark.createDataFrame([], "media_id long, resolution string, resolved_at timestamp")}
    out = K.resolved_groups(tables, ranked, now())
    assert {r.group_id for r in out["groups"].collect()} == {"g"} and out["members"].count() == 2 and out["queue"].count() == 0
    assert {r.id: (r.lifecycle, r.hitl_status) for r in out["media"].collect() if r.id in (1, 2, 5)} == {1: ("trash", "rejected"), 2: ("staging", "accepted"), 5: ("rejected", "pending")}


def test_albums_without_members_lose_their_cover(spark):
    albums = spark.createDataFrame([("a", "album", "old", 1), ("s", "smart", "old", 2), ("k", "album", "k", 3)], "auto_key string, kind string, name string, cover_id long")
    held = spark.createDataFrame([("a", 1, 0), ("k", 3, 0)], "auto_key string, media_id long, position long")
    proposed = spark.createDataFrame([("a", "album", "new"), ("s", "smart", "new")], "auto_key string, kind string, name string")
    out = O.albums_upserted(albums, held, proposed, held.limit(0))
    assert {r.auto_key: (r.name, r.cover_id, r.outcome) for r in out["albums"].collect()} == {"a": ("new", None, "updated"), "s": ("new", 2, "updated"), "k": ("k", 3, "kept")}
    assert [r.auto_key for r in out["items"].collect()] == ["k"]
