"""Albums from media: buckets, events, covers, positions and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import DEFAULTS, Settings
from ..functions.names import event_key, event_title, json_list, scene_title, slug
from .ordered import numbered, parted


def sessions(rows: DataFrame, keys: list[str], ts: str, gap_days: int = DEFAULTS.event_gap_days) -> DataFrame:
    """rows with a session number within keys: a gap of more than gap_days begins a new one; a gap of exactly that doesn't.

    Rows without a time drop. Keys of any size are spread over ranges of time.
    """
    dated = rows.filter(F.col(ts).isNotNull()).withColumn("micros", F.unix_micros(F.col(ts).cast("timestamp")))
    return parted(dated, keys, ["micros", *[c for c in ("id",) if c in rows.columns]], "micros", gap_days * 86_400_000_000).drop("micros")


def events(rows: DataFrame, ts: str, gap_days: int = DEFAULTS.event_gap_days) -> DataFrame:
    """rows with one event number over the whole table, at any size.

    Days are never split by a gap of whole days, so each day is aggregated to its first and last time; the window runs
    over days only (a few ten thousand whatever the input), and rows get their day's number.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    dated = rows.filter(F.col(ts).isNotNull()).withColumn("day", F.to_date(F.col(ts)))
    days = dated.groupBy("day").agg(F.min(micros).alias("first"), F.max(micros).alias("last"))
    order = W.orderBy("day")
    new = F.when(F.col("first") - F.lag("last").over(order) > gap_days * 86_400_000_000, 1).otherwise(0)
    numbered = days.withColumn("new", new).select("day", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("event"))
    return dated.join(F.broadcast(numbered), "day").drop("day")  # one row per calendar day: bounded


def event_albums(items: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Events of enough members with title, key and the scene that prevails, if it does."""
    numbered = events(items, "taken_at", s.event_gap_days)
    spans = numbered.groupBy("event").agg(F.min("taken_at").alias("t0"), F.max("taken_at").alias("t1"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= s.min_members)
    top = dominant(numbered.withColumn("scene", scene_title(F.col("scene_type"))), ["event"], "scene", "taken_at")
    found = spans.join(top, "event", "left")
    bit = F.when(F.col("top_n") >= F.greatest(F.lit(2), F.floor(F.col("n") / 4)), F.concat(F.lit(" · "), "top")).otherwise("")
    return found.select(event_key(F.col("t0"), F.col("t1"), F.col("n")).alias("auto_key"), F.concat(event_title(F.col("t0"), F.col("t1")), bit).alias("name"), "n")


def dominant(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Per key the most frequent non-blank value (top, top_n); of equally frequent ones the one seen first."""
    seen = rows.filter((F.col(value) != "") & F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(order, "id")).alias("first"))
    ranks = W.partitionBy(*keys).orderBy(F.desc("c"), "first")
    return seen.withColumn("rank", F.row_number().over(ranks)).filter("rank = 1").select(*keys, F.col(value).alias("top"), F.col("c").alias("top_n"))


def buckets(items: DataFrame) -> DataFrame:
    """Every (kind, key) an item belongs to: year, month, camera, disc, scene, tags (the first eight), people."""
    ts = F.col("taken_at")
    entry = lambda kind, key, cond: F.when(cond & key.isNotNull(), F.struct(F.lit(kind).alias("kind"), key.alias("key")))
    scene = F.nullif(scene_title(F.col("scene_type")), F.lit(""))
    single = F.array(
        entry("year", F.date_format(ts, "yyyy"), ts.isNotNull()),
        entry("month", F.date_format(ts, "yyyy-MM"), ts.isNotNull()),
        entry("camera", F.nullif(F.trim(F.concat_ws(" ", "camera_make", "camera_model")), F.lit("")), F.lit(True)),
        entry("disc", F.col("disc_id"), F.lit(True)),
        entry("scene", scene, F.lit(True)),
        entry("people", F.lit("people"), F.coalesce(F.col("people_count") > 0, F.lit(False))),
    )
    tags = F.transform(F.slice(json_list(F.col("suggested_tags")), 1, 8), lambda t: F.struct(F.lit("tag").alias("kind"), F.lower(t).alias("key")))
    return items.select("*", F.explode(F.array_compact(F.concat(single, tags))).alias("bucket")).select("*", "bucket.kind", "bucket.key").drop("bucket")


def bucket_albums(items: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Albums of the buckets with enough distinct members: key, kind, members, cover."""
    cover = F.max_by("id", F.struct(F.coalesce("rating", F.lit(0)), ~F.coalesce("is_blurry", F.lit(False)), F.coalesce("blur_score", F.lit(0.0)), F.coalesce(F.col("width") * F.col("height"), F.lit(0)), -F.col("id")))
    least = F.when(F.col("kind") == "scene", s.min_scene).when(F.col("kind") == "tag", s.min_tag).otherwise(s.min_members)
    found = buckets(items).groupBy("kind", "key").agg(F.countDistinct("id").alias("n"), cover.alias("cover_id"))
    return found.filter(F.col("n") >= least).select(F.concat_ws(":", "kind", F.when(F.col("kind").isin("year", "month"), F.col("key")).otherwise(slug(F.col("key")))).alias("auto_key"), "kind", "key", "n", "cover_id")


def top_tags(items: DataFrame, n: int = DEFAULTS.top_tags) -> DataFrame:
    """The n most frequent tags; of equally frequent ones the one whose first item has the smaller id."""
    tags = items.select("id", F.posexplode(json_list(F.col("suggested_tags"))).alias("pos", "tag"))
    counted = tags.groupBy(F.lower("tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "pos")).alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(n).select("tag", "n")


def positions(members: DataFrame, album: str, cover: Column) -> DataFrame:
    """Members of each album numbered from 0: the cover first, then by date, undated last."""
    order = [F.desc("is_cover"), F.asc_nulls_last("taken_at"), "id"]
    found = numbered(members.withColumn("is_cover", cover.cast("int")), [album], order)
    return found.withColumn("position", F.col("number") - 1).drop("is_cover", "number")


def upserted(albums: DataFrame, proposed: DataFrame) -> DataFrame:
    """Albums after an organiser's run: proposed ones replace those of their key or are added; the others stay."""
    new = proposed.select("auto_key", F.struct(*[c for c in proposed.columns if c != "auto_key"]).alias("new"))
    old = albums.select("auto_key", F.struct(*[c for c in albums.columns if c != "auto_key"]).alias("old"))
    both = old.join(new, "auto_key", "full_outer")
    state = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "kept").otherwise("updated")
    return both.select("auto_key", state.alias("outcome"), *[F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c) for c in proposed.columns if c != "auto_key"])


def albums_upserted(albums: DataFrame, album_items: DataFrame, proposed: DataFrame, members: DataFrame) -> dict[str, DataFrame]:
    """Albums (auto_key, kind, name, cover_id) and their items (auto_key, media_id, position) after an organiser's run.

    Proposed albums (auto_key, kind, name) replace those of their key or are added, the others stay. The items of a
    proposed plain album are replaced by its members (auto_key, media_id, position), the first of which is the cover,
    none for an empty one; a smart album keeps no items, and its cover where it has no members.
    """
    first = members.groupBy("auto_key").agg(F.min_by("media_id", F.struct("position", "media_id")).alias("first"))
    new = proposed.select("auto_key", F.col("kind").alias("new_kind"), F.col("name").alias("new_name"), F.lit(True).alias("new"))
    both = albums.withColumn("old", F.lit(True)).join(new, "auto_key", "full_outer").join(first, "auto_key", "left")
    cover = F.when(F.col("new").isNull(), F.col("cover_id")).when(F.col("new_kind") == "smart", F.coalesce("first", "cover_id")).otherwise(F.col("first"))
    outcome = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "kept").otherwise("updated")
    after = both.select("auto_key", F.coalesce("new_kind", "kind").alias("kind"), F.coalesce("new_name", "name").alias("name"), cover.alias("cover_id"), outcome.alias("outcome"))
    plain = new.filter("new_kind = 'album'").select("auto_key")
    stay = album_items.join(plain, "auto_key", "left_anti").select("auto_key", "media_id", "position")
    return {"albums": after, "items": stay.unionByName(members.join(plain, "auto_key", "left_semi").select("auto_key", "media_id", "position"))}


def timeline(items: DataFrame) -> DataFrame:
    """Items per UTC day; undated ones under 'Unknown date'."""
    day = F.coalesce(F.date_format("taken_at", "yyyy-MM-dd"), F.lit("Unknown date"))
    return items.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def sequence_names(items: DataFrame) -> DataFrame:
    """Names numbered by path within each disc: 0001_name."""
    found = numbered(items.select("id", "disc_id", "original_path", "filename"), ["disc_id"], ["original_path", "id"])
    return found.select("id", "disc_id", F.format_string("%04d_%s", "number", "filename").alias("staged_name"))
