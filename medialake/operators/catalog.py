"""Catalogue views: filters, sorts, pages and statistics over media and annotation tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.annotate import is_heuristic

#: Sort orders; each ends in the id, so that pages are the same each time.
SORTS = {
    "taken_at_desc": [F.desc_nulls_last, "taken_at", F.desc, "created_at"],
    "taken_at_asc": [F.asc_nulls_last, "taken_at", F.asc, "created_at"],
    "created_at_desc": [F.desc, "created_at"],
    "rating_desc": [F.desc, "rating", F.desc_nulls_last, "taken_at"],
    "deleted_at_desc": [F.desc_nulls_last, "deleted_at", F.desc, "created_at"],
}


def in_library(lifecycle: Column) -> Column:
    """Null counts as library."""
    return (lifecycle == "library") | lifecycle.isNull()


def active(lifecycle: Column) -> Column:
    """Neither in the trash nor rejected; null counts as library."""
    return ~F.coalesce(lifecycle, F.lit("library")).isin("trash", "rejected")


def active_raw(lifecycle: Column) -> Column:
    """As the navigation counts it: in SQL's three values, so null rows drop."""
    return ~lifecycle.isin("trash", "rejected")


@dataclass(frozen=True)
class CatalogQuery:
    """What a listing asks for; None (and empty text) means no condition."""

    trash: bool = False
    lifecycle: str | None = None
    media_type: str | None = None
    hitl_status: str | None = None
    disc_id: str | None = None
    is_duplicate: bool | None = None
    is_blurry: bool | None = None
    flag: bool | None = None
    rating_min: int | None = None
    has_gps: bool | None = None
    sort: str = "taken_at_desc"
    offset: int = 0
    limit: int = 50

    def condition(self) -> Column:
        c = F.col
        out = c("lifecycle") == "trash" if self.trash else c("lifecycle") == self.lifecycle if self.lifecycle and self.lifecycle != "library" else in_library(c("lifecycle"))
        for name in ("media_type", "hitl_status", "disc_id"):
            if getattr(self, name):
                out &= c(name) == getattr(self, name)
        for name in ("is_duplicate", "is_blurry", "flag"):
            if getattr(self, name) is not None:
                out &= c(name) == getattr(self, name)
        if self.rating_min is not None:
            out &= c("rating") >= self.rating_min
        if self.has_gps is not None:
            out &= c("gps_lat").isNotNull() if self.has_gps else c("gps_lat").isNull()
        return out

    def order(self) -> list[Column]:
        spec = SORTS.get(self.sort, SORTS["taken_at_desc"])
        return [*[f(c) for f, c in zip(spec[::2], spec[1::2])], F.asc("id")]

    def rows(self, media: DataFrame) -> DataFrame:
        """All matching rows, unordered."""
        return media.filter(self.condition())

    def page(self, media: DataFrame) -> DataFrame:
        """One page; Spark keeps only offset + limit rows of each task."""
        return self.rows(media).orderBy(*self.order()).offset(self.offset).limit(min(200, max(1, self.limit)))


def found_page(asked: CatalogQuery, media: DataFrame, hits: DataFrame) -> DataFrame:
    """A page of what a search found (hits: id, at most its limit of rows), in the page's own order: rank decides only which items there are."""
    return asked.page(media.join(F.broadcast(hits.select("id")), "id", "left_semi"))


def with_analysis(media: DataFrame, analysis: DataFrame) -> DataFrame:
    """media with its annotation, if any; the annotation's key goes."""
    return media.join(analysis, media["id"] == analysis["media_id"], "left").drop("media_id")


def never_analysed(media: DataFrame, analysis: DataFrame) -> DataFrame:
    return media.join(analysis.select("media_id"), media["id"] == F.col("media_id"), "left_anti")


def counts_per_parent(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Each parent with its number of children, 0 for none."""
    n = children.groupBy(key).agg(F.count(F.lit(1)).alias("media_count"))
    return parents.join(n, key, "left").withColumn("media_count", F.coalesce("media_count", F.lit(0)))


def looked_up(ids: DataFrame, media: DataFrame) -> DataFrame:
    """Rows of media in the order of ids (pos, id); missing ids drop and positions stay."""
    return ids.join(media, "id").orderBy("pos")


def library_stats(media: DataFrame, analysis: DataFrame) -> DataFrame:
    """All library counts in one pass over media and annotations."""
    lib = in_library(F.col("lifecycle"))
    one = with_analysis(media, analysis.select("media_id", F.coalesce("people_count", F.lit(0)).alias("people"), F.lit(True).alias("analysed")))
    n = lambda cond, name: F.count_if(lib & cond).alias(name)
    return one.agg(
        n(F.lit(True), "total"),
        n(F.col("media_type") == "image", "images"),
        n(F.col("media_type") == "video", "videos"),
        n(F.col("hitl_status") == "pending", "pending"),
        n(F.col("is_duplicate"), "duplicates"),
        n(F.col("is_blurry"), "blurry"),
        n(F.col("flag"), "flagged"),
        n(F.col("gps_lat").isNotNull(), "with_gps"),
        n(F.coalesce(F.col("analysed"), F.lit(False)), "analysed"),
        n(F.col("people") > 0, "with_people"),
        F.count_if(F.col("lifecycle") == "trash").alias("trash"),
        F.count_if(F.col("lifecycle") == "rejected").alias("rejected"),
        F.count_if(F.col("lifecycle") == "staging").alias("staging"),
        F.coalesce(F.sum(F.when(lib, F.col("file_size"))), F.lit(0)).alias("bytes"),
        F.countDistinct("disc_id").alias("discs"),
    )


def coverage(media: DataFrame, analysis: DataFrame) -> DataFrame:
    """Shares of library items that are annotated, and by a real model, in percent with one decimal; 0 for an empty library."""
    lib = with_analysis(media.filter(in_library(F.col("lifecycle"))), analysis.select("media_id", "model_name", F.lit(True).alias("analysed")))
    name = F.col("model_name")
    real = name.isNotNull() & ~(name.ilike("%heuristic%") | name.ilike("%quality-gate%") | name.ilike("%vlm-failed%"))
    counts = lib.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("analysed", F.lit(False))).alias("done"), F.count_if(real).alias("vlm_done"))
    pct = lambda c: F.when(F.col("total") > 0, F.round(100.0 * F.col(c) / F.nullif("total", F.lit(0)), 1)).otherwise(0.0)
    return counts.select("total", "done", "vlm_done", pct("done").alias("coverage_pct"), pct("vlm_done").alias("vlm_pct"))


def inference_queue(media: DataFrame, analysis: DataFrame, limit: int) -> DataFrame:
    """What to annotate next: items never annotated, oldest first, then heuristic ones, oldest first."""
    lib = media.filter(in_library(F.col("lifecycle"))).select("id", "created_at")
    pending = never_analysed(lib, analysis).withColumn("tier", F.lit(0))
    weak = analysis.filter(is_heuristic(F.col("model_name"), F.col("model_version"))).select("media_id")
    again = lib.join(weak, lib["id"] == F.col("media_id"), "left_semi").withColumn("tier", F.lit(1))
    return pending.unionByName(again).orderBy("tier", "created_at", "id").limit(min(5000, max(1, limit))).select("id", "tier")


def queue_page(rows: DataFrame, condition: Column, newest: int, offset: int, limit: int) -> DataFrame:
    """Filters within the newest rows only, then pages: the limit comes before the filter."""
    return rows.orderBy(F.desc("created_at"), "id").limit(newest).filter(condition).orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def nav_counts(media: DataFrame, analysis: DataFrame, members: DataFrame, albums: DataFrame, jobs: DataFrame, discs: DataFrame, secrets: DataFrame) -> DataFrame:
    """One row with what the navigation shows: one pass over media with annotations, and one-row counts of the rest.

    Review is always 0; grid is library and stats is discs. inference is what has no annotation, and what only a
    heuristic annotated. Duplicates are groups of two or more members that are neither in the trash nor rejected.
    settings are the secrets (name, configured) that are configured.
    """
    said = analysis.select(F.col("media_id").alias("said_of"), "people_count", "model_name")
    lib, c = in_library(F.col("lifecycle")), F.col
    pending = lib & c("said_of").isNull()
    rows = media.join(said, c("id") == c("said_of"), "left").agg(
        F.count_if(lib).alias("library"), F.count_if(lib & c("taken_at").isNotNull()).alias("timeline"), F.count_if(lib).alias("grid"), F.count_if(lib & c("gps_lat").isNotNull()).alias("map"),
        F.count_if(lib & (c("people_count") > 0)).alias("people"), F.lit(0).alias("review"), F.count_if(lib & (c("media_type") == "image")).alias("images"), F.count_if(lib & (c("media_type") == "video")).alias("videos"),
        F.count_if(c("lifecycle") == "trash").alias("trash"), (F.count_if(pending) + F.count_if(lib & c("model_name").ilike("%heuristic%"))).alias("inference"),
    )
    alive = members.join(media.filter(active_raw(F.col("lifecycle"))).select(F.col("id").alias("media_id")), "media_id", "left_semi").groupBy("group_id").count().filter("count > 1")
    number = lambda df, name: F.broadcast(df.agg(F.count(F.lit(1)).alias(name)))  # noqa: E731 - one row each
    for df, name in ((alive, "duplicates"), (albums, "albums"), (jobs.filter(F.col("status").isin("queued", "running")), "jobs"), (discs, "discs"), (secrets.filter("configured"), "settings")):
        rows = rows.join(number(df, name))
    return rows.withColumn("stats", F.col("discs"))


def album_list(albums: DataFrame, kind: str | None = None, source: str | None = None) -> DataFrame:
    """Albums of a kind and a source (none and empty ones don't matter), the last changed first."""
    for name, value in (("kind", kind), ("source", source)):
        albums = albums.filter(F.col(name) == value) if value else albums
    return albums.orderBy(F.desc_nulls_last("updated_at"), F.desc("created_at"), "id")


def open_reviews(queue: DataFrame, queue_type: str | None = None) -> DataFrame:
    """Review rows that nobody resolved, of one type if asked, the most urgent and oldest first."""
    rows = queue.filter(F.col("resolved_at").isNull())
    return (rows.filter(F.col("queue_type") == queue_type) if queue_type else rows).orderBy("priority", "created_at", "media_id")


def album_members(album_items: DataFrame, album_id) -> DataFrame:
    """Members of a fixed album by their positions, those without one last."""
    return album_items.filter(F.col("album_id") == album_id).orderBy(F.asc_nulls_last("position"), "media_id").select("media_id", "position")


def between_and_tagged(joined: DataFrame, date_from=None, date_to=None, tags: list[str] | None = None) -> DataFrame:
    """Items taken between two times (both included) that have any of the tags; what isn't given is no condition."""
    from ..functions.names import json_list

    if date_from is not None:
        joined = joined.filter(F.col("taken_at") >= date_from)
    if date_to is not None:
        joined = joined.filter(F.col("taken_at") <= date_to)
    wanted = F.array(*[F.lit(t.lower()) for t in tags]) if tags else None
    return joined if wanted is None else joined.filter(F.arrays_overlap(F.transform(json_list(F.col("suggested_tags")), F.lower), wanted))


def album_tab(albums: DataFrame, tab: str) -> DataFrame:
    """Albums under a tab, those without a kind being plain albums; 'all' shows all."""
    kind = F.coalesce(F.nullif("kind", F.lit("")), F.lit("album"))
    return albums if tab == "all" else albums.filter(kind == tab)


def album_totals(albums: DataFrame) -> DataFrame:
    """One row: smart albums, all others as fixed ones, those that were made or proposed automatically, and all."""
    auto = F.coalesce("is_ai_proposed", F.lit(False)) | F.coalesce(F.col("source").startswith("auto"), F.lit(False))
    smart = F.coalesce(F.col("kind") == "smart", F.lit(False))
    return albums.agg(F.count_if(smart).alias("smart"), F.count_if(~smart).alias("fixed"), F.count_if(auto).alias("auto"), F.count(F.lit(1)).alias("total"))


def spanned(listing: DataFrame, selected: DataFrame, anchor, clicked) -> DataFrame:
    """Ids selected once a listing (pos, id) is clicked with shift: all between the anchor and the click join those
    selected; where one of the two isn't listed, the clicked id alone does."""
    ends = listing.filter(F.col("id").isin(anchor, clicked)).agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.countDistinct("id").alias("n"))
    whole = ends.filter(F.col("n") == F.lit(len({anchor, clicked})))  # one row or none
    between = listing.join(F.broadcast(whole), F.col("pos").between(F.col("low"), F.col("high"))).select("id")
    click = listing.sparkSession.range(1).select(F.lit(clicked).cast(listing.schema["id"].dataType).alias("id"))
    return selected.select("id").union(between).union(click).distinct()
