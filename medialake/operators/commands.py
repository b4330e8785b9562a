"""Changes as functions: a table and a table of commands give the table after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import ascii_json
from .catalog import active
from .ordered import numbered
from .search import KeptIndex, document


def patched(media: DataFrame, commands: DataFrame) -> DataFrame:
    """media after edits (id, rating, flag, caption): ratings are clamped to 0..5, a text edit marks the item edited."""
    c = commands.select("id", F.col("rating").alias("new_rating"), F.col("flag").alias("new_flag"), F.col("caption").alias("new_caption"))
    joined = media.join(c, "id", "left")
    edited = F.col("new_caption").isNotNull()
    return joined.withColumns(
        {
            "rating": F.when(F.col("new_rating").isNull(), F.col("rating")).otherwise(F.least(F.lit(5), F.greatest(F.lit(0), F.col("new_rating")))),
            "flag": F.coalesce("new_flag", "flag"),
            "hitl_status": F.when(edited, "edited").otherwise(F.col("hitl_status")),
            "human_edited": edited,
        }
    ).drop("new_rating", "new_flag", "new_caption")


def trashed(media: DataFrame, ids: DataFrame, at) -> DataFrame:
    """media after a soft delete; items in the trash keep their time, unknown ids do nothing."""
    joined = media.join(ids.select("id", F.lit(True).alias("hit")).distinct(), "id", "left")
    goes = F.coalesce("hit", F.lit(False)) & ~(F.coalesce("lifecycle", F.lit("library")) == "trash")
    return joined.withColumns({"deleted_at": F.when(goes, at).otherwise(F.col("deleted_at")), "lifecycle": F.when(goes, "trash").otherwise(F.col("lifecycle"))}).drop("hit")


def restored(media: DataFrame, ids: DataFrame) -> DataFrame:
    """media after items came back; only those in the trash do."""
    joined = media.join(ids.select("id", F.lit(True).alias("hit")).distinct(), "id", "left")
    back = F.coalesce("hit", F.lit(False)) & F.coalesce(F.col("lifecycle") == "trash", F.lit(False))
    return joined.withColumns({"deleted_at": F.when(back, F.lit(None)).otherwise(F.col("deleted_at")), "lifecycle": F.when(back, "library").otherwise(F.col("lifecycle"))}).drop("hit")


def purged(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables after items are gone for good: their children go with them, groups lose them as best, empty groups go."""
    gone = ids.select(F.col("id").alias("gone")).distinct()
    without = lambda df, key: df.join(gone, df[key] == F.col("gone"), "left_anti")
    out = {name: without(df, "id" if name == "media" else "media_id") for name, df in tables.items() if name != "groups"}
    groups = tables["groups"].join(gone, tables["groups"]["best_media_id"] == F.col("gone"), "left")
    groups = groups.withColumn("best_media_id", F.when(F.col("gone").isNull(), F.col("best_media_id"))).drop("gone")
    out["groups"] = groups.join(out["members"].select("group_id").distinct(), "group_id", "left_semi")
    return out


def reviewed(queue: DataFrame, commands: DataFrame) -> DataFrame:
    """Review rows after resolutions (id, resolution, edits): accepted with edits is edited; deferred stays open, later."""
    joined = queue.join(commands.select("id", F.col("resolution").alias("said"), "edits"), "id", "left")
    said = F.when((F.col("said") == "accepted") & F.col("edits"), "edited").otherwise(F.col("said"))
    deferred = F.coalesce(F.col("said") == "deferred", F.lit(False))
    return joined.select(
        *[c for c in queue.columns if c not in ("priority", "resolution", "open")],
        F.when(deferred, F.greatest("priority", F.lit(200))).otherwise(F.col("priority")).alias("priority"),
        F.when(deferred, F.col("resolution")).otherwise(F.coalesce(said, "resolution")).alias("resolution"),
        (F.col("open") & (said.isNull() | deferred)).alias("open"),
    )


def accepted_all(media: DataFrame) -> DataFrame:
    """media after the start-up sweep: pending items are accepted."""
    return media.withColumn("hitl_status", F.when(F.col("hitl_status") == "pending", "accepted").otherwise(F.col("hitl_status")))


def promoted(media: DataFrame) -> DataFrame:
    """Names in the library of promoted items: a name that another item of the folder has taken gets the id before it."""
    turns = numbered(media.select("id", "disc_id", "filename"), ["disc_id", "filename"], ["id"])
    return turns.select("id", F.when(F.col("number") > 1, F.concat_ws("_", F.left(F.lpad(F.col("id").cast("string"), 8, "0"), F.lit(8)), "filename")).otherwise(F.col("filename")).alias("library_name"))


def rejected(media: DataFrame, queue: DataFrame, verdicts: DataFrame) -> dict[str, DataFrame]:
    """Tables after a quality gate's verdicts (id, code, reason): its items are rejected with quality 0 and get an
    annotation row that says why, and their open review rows (media_id, resolution) are closed."""
    codes = verdicts.select(F.col("id").alias("hit"), "code", "reason")
    joined = media.join(codes, media["id"] == F.col("hit"), "left")
    bad = F.col("hit").isNotNull()
    after = joined.withColumns({"lifecycle": F.when(bad, "rejected").otherwise(F.col("lifecycle")), "quality_score": F.when(bad, 0.0).otherwise(F.col("quality_score"))})
    closed = queue.join(codes, queue["media_id"] == F.col("hit"), "left").withColumn("resolution", F.coalesce("resolution", F.concat(F.lit("quality:"), "code")))
    said = codes.select(F.col("hit").alias("media_id"), F.concat_ws(": ", "code", "reason").alias("description"), F.lit("quality-gate").alias("model_name"), F.lit(1.0).alias("confidence"))
    return {"media": after.select(media.columns), "queue": closed.select(queue.columns), "analysis": said}


def albums_deleted(albums: DataFrame, album_items: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Albums and their items after albums (id) are deleted; unknown ids do nothing."""
    gone = ids.select(F.col("id").alias("gone")).distinct()
    return albums.join(gone, albums["id"] == F.col("gone"), "left_anti"), album_items.join(gone, album_items["album_id"] == F.col("gone"), "left_anti")


def closed(queue: DataFrame, ids: DataFrame, resolution: Column, at: Column) -> DataFrame:
    """Review rows (media_id, resolution, resolved_at) after those still open of items (id, and what resolution reads) are closed."""
    hit = ids.withColumnRenamed("id", "hit").dropDuplicates(["hit"]).withColumn("says", resolution).select("hit", "says")
    joined = queue.join(hit, queue["media_id"] == F.col("hit"), "left")
    closes = F.col("hit").isNotNull() & F.col("resolved_at").isNull()
    return joined.withColumns({"resolution": F.when(closes, F.col("says")).otherwise(F.col("resolution")), "resolved_at": F.when(closes, at).otherwise(F.col("resolved_at"))}).select(queue.columns)


def edited(media: DataFrame, analysis: DataFrame, commands: DataFrame, at: Column) -> dict[str, DataFrame]:
    """Tables after edits (id, hitl_status, rating, flag, caption_short, description, suggested_tags; nulls change nothing).

    Ratings are clamped to 0..5. Texts and tags go to the item's annotation, which is made where there is none, and mark
    both edited, whatever status was asked for. Unknown ids do nothing; of several commands for an item each column's
    greatest value counts. `texts` names the items whose document has to be indexed again.
    """
    texts = ("caption_short", "description")
    per_item = commands.join(media.select("id"), "id", "left_semi").groupBy("id").agg(*[F.max(c).alias(f"new_{c}") for c in ("hitl_status", "rating", "flag", *texts, "suggested_tags")])
    says = F.greatest(*[F.col(f"new_{c}").isNotNull() for c in (*texts, "suggested_tags")])
    per_item = per_item.withColumn("says", says)
    m = media.join(per_item.drop(*[f"new_{c}" for c in (*texts, "suggested_tags")]).withColumn("hit", F.lit(True)), "id", "left")
    m = m.withColumns(
        {
            "rating": F.when(F.col("new_rating").isNull(), F.col("rating")).otherwise(F.least(F.lit(5), F.greatest(F.lit(0), F.col("new_rating")))),
            "flag": F.coalesce("new_flag", "flag"),
            "hitl_status": F.when(F.col("says"), "edited").otherwise(F.coalesce("new_hitl_status", "hitl_status")),
            "updated_at": F.when(F.col("hit"), at).otherwise(F.col("updated_at") if "updated_at" in media.columns else F.lit(None).cast("timestamp")),
        }
    ).drop("new_hitl_status", "new_rating", "new_flag", "says", "hit")
    told = per_item.filter("says").select(F.col("id").alias("media_id"), *[f"new_{c}" for c in texts], ascii_json(F.col("new_suggested_tags")).alias("new_suggested_tags"), F.lit(True).alias("now"))
    a = analysis.withColumn("human_edited", F.col("human_edited") if "human_edited" in analysis.columns else F.lit(False)).join(told, "media_id", "full_outer")
    a = a.withColumns({c: F.coalesce(f"new_{c}", c) for c in (*texts, "suggested_tags")} | {"human_edited": F.coalesce("now", "human_edited")})
    return {"media": m, "analysis": a.select(*analysis.columns, *[c for c in ("human_edited",) if c not in analysis.columns]), "texts": told.select(F.col("media_id").alias("id"))}


def reindexed(kept: KeptIndex, tables: dict[str, DataFrame]) -> None:
    """Hands the documents of items whose texts were edited to the kept index."""
    a = tables["analysis"].withColumnRenamed("media_id", "of")
    changed = tables["media"].join(tables["texts"], "id", "left_semi")
    kept.upsert(document(changed.join(a, F.col("id") == F.col("of"), "left")), "id")


def trashed_batch(media: DataFrame, queue: DataFrame, ids: DataFrame, at: Column, most: int = 500) -> dict[str, DataFrame]:
    """Tables after a soft delete of the first `most` ids (pos, id) at once: their open review rows are closed as trashed.

    An item that is in the trash with a time stays as it is, reviews too; without a time it gets one.
    """
    taken = ids.orderBy("pos", "id").limit(most).select("id").distinct()
    there = (F.col("lifecycle") == "trash") & F.col("deleted_at").isNotNull()
    goes = media.join(taken, "id", "left_semi").filter(~F.coalesce(there, F.lit(False))).select("id")
    m = media.join(goes.withColumn("hit", F.lit(True)), "id", "left")
    m = m.withColumns({"deleted_at": F.when(F.col("hit"), at).otherwise(F.col("deleted_at")), "lifecycle": F.when(F.col("hit"), "trash").otherwise(F.col("lifecycle"))})
    return {"media": m.drop("hit"), "queue": closed(queue, goes, F.lit("trashed"), at)}


def swept(media: DataFrame, queue: DataFrame, at: Column) -> dict[str, DataFrame]:
    """Tables after the start-up sweep: pending items are accepted, and so are all open review rows, of whatever item."""
    is_open = F.col("resolved_at").isNull()
    rows = queue.withColumns({"resolution": F.when(is_open, "accepted").otherwise(F.col("resolution")), "resolved_at": F.when(is_open, at).otherwise(F.col("resolved_at"))})
    return {"media": accepted_all(media), "queue": rows}


def promoted_items(media: DataFrame, queue: DataFrame, ids: DataFrame, at: Column) -> dict[str, DataFrame]:
    """Tables after staged items (id) came into the library: their path there, lifecycle and status, reviews closed.

    A name that the disc's folder has already, or that an earlier promoted item takes, gets the first eight places of
    the item's id before it. Items that aren't staged stay.
    """
    staged = media.filter("lifecycle = 'staging'").join(ids.select("id").distinct(), "id", "left_semi")
    held = media.filter(F.coalesce("lifecycle", F.lit("library")) == "library").select("disc_id", "filename").distinct().withColumn("held", F.lit(True))
    turns = numbered(staged.select("id", "disc_id", "filename"), ["disc_id", "filename"], ["id"]).join(held, ["disc_id", "filename"], "left")
    clash = (F.col("number") > 1) | F.coalesce("held", F.lit(False))
    name = F.when(clash, F.concat_ws("_", F.left(F.lpad(F.col("id").cast("string"), 8, "0"), F.lit(8)), "filename")).otherwise(F.col("filename"))
    moved = turns.select("id", F.concat_ws("/", "disc_id", name).alias("to"))
    m = media.join(moved, "id", "left")
    gone = F.col("to").isNotNull()
    m = m.withColumns(
        {
            "library_path": F.coalesce("to", F.col("library_path") if "library_path" in media.columns else F.lit(None).cast("string")),
            "lifecycle": F.when(gone, "library").otherwise(F.col("lifecycle")),
            "hitl_status": F.when(gone, "accepted").otherwise(F.col("hitl_status")),
        }
    ).drop("to")
    return {"media": m, "queue": closed(queue, moved, F.lit("accepted"), at)}


def resolved_groups(tables: dict[str, DataFrame], ranked: DataFrame, at: Column, trash: bool = True) -> dict[str, DataFrame]:
    """Tables (media, members, groups, queue) after the best of each group is kept.

    ranked has each member's (group_id, media_id, keep), as kept_best() gives. Of groups with two or more active members
    the best is accepted, no duplicate any more, and the other active ones are rejected, and trashed if asked. Then no
    two active members are left: the group and all its memberships go. Open reviews of the winners are closed as
    keep_best, those of the losers as trashed, or as rejected_keep_best where they aren't. Other groups stay as they are.
    """
    media = tables["media"]
    live = ranked.join(media.filter(active(F.col("lifecycle"))).select(F.col("id").alias("media_id")), "media_id", "left_semi")
    big = live.groupBy("group_id").agg(F.count(F.lit(1)).alias("live"), F.max_by("media_id", "keep").alias("best")).filter("live > 1")
    of = live.join(big, "group_id").select(F.col("media_id").alias("id"), (F.col("media_id") == F.col("best")).alias("wins"))
    m = media.join(of, "id", "left")
    won, lost = F.coalesce("wins", F.lit(False)), F.coalesce(~F.col("wins"), F.lit(False))
    goes = lost & F.lit(trash)
    m = m.withColumns(
        {
            "hitl_status": F.when(won, "accepted").when(lost, "rejected").otherwise(F.col("hitl_status")),
            "is_duplicate": F.when(won, False).otherwise(F.col("is_duplicate")),
            "lifecycle": F.when(goes, "trash").otherwise(F.col("lifecycle")),
            "deleted_at": F.when(goes, at).otherwise(F.col("deleted_at")),
        }
    ).drop("wins")
    gone = big.select("group_id")
    says = F.when(F.col("wins"), "keep_best").otherwise("trashed" if trash else "rejected_keep_best")
    return {
        "media": m,
        "members": tables["members"].join(gone, "group_id", "left_anti"),
        "groups": tables["groups"].join(gone, "group_id", "left_anti"),
        "queue": closed(tables["queue"], of, says, at),
    }
