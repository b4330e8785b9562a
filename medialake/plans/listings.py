"""Filters, joins, statistics and pages of the catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.annotate import is_heuristic
from ..operators import catalog as C, search as S
from ..operators.catalog import CatalogQuery
from ..operators.graph import shared_folder
from . import copies, states
from .surrogate import CTE, analysis, items, media

ACTIVE = "coalesce(lifecycle, 'library') not in ('trash', 'rejected')"
LIB = "(lifecycle = 'library' or lifecycle is null)"
HEURISTIC = """((model_name is null or model_name = '' or model_name ilike '%heuristic%' or model_name ilike '%quality-gate%' or model_name ilike '%vlm-failed%'
 or model_version ilike '%vlm-failed%') and not (model_version ilike '%vlm-gave-up%'))"""


def _ids(df: DataFrame) -> DataFrame:
    return df.select("id")


def _listing(**options):
    return lambda s, d: _ids(CatalogQuery(**options).rows(media(s, d)))


def _page(**options):
    return lambda s, d: CatalogQuery(**options).page(media(s, d)).select("id", "rating", "taken_s")


def _ids_sql(where: str) -> str:
    return f"{CTE} select id from media where {where}"


def _discs(s, d):
    return media(s, d).select("disc_id").distinct()


def _ordered_lookup(s, d):
    talk = s.read.parquet(f"{d}/conversations.parquet")
    wanted = talk.select((F.col("conv_id") * 3).alias("id"), (F.col("conv_id") * 100 + F.col("turn")).alias("pos"))
    return C.looked_up(wanted, media(s, d).select("id", "sha256")).select("pos", "id", "sha256")


def _orphans(s, d):
    """Groups (discs) none of whose media is flagged, top rated and blurry: an anti join, whatever nulls there are."""
    good = media(s, d).filter("flag and rating = 5 and is_blurry").select("disc_id")
    return media(s, d).select("disc_id", "hitl_status").distinct().join(good, "disc_id", "left_anti")


def _review(s, d):
    m = media(s, d)
    queue = analysis(s, d).select(F.col("media_id"), (F.col("people_count") * 10 + F.lit(100)).alias("priority"))
    return queue.join(m, queue["media_id"] == m["id"], "left").select("media_id", "priority", "filename")


def _hybrid(s, d):
    v = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    words = S.search(s.read.parquet(f"{d}/documents.parquet"), "this", "doc_id", ["text"], 50)
    return S.fused([words, S.nearest(v, [1.0] + [0.0] * 63, 50)], 30).select("id", F.round("score", 6).alias("score"))


def _first_of_each(s, d):
    order = W.partitionBy("sha256").orderBy("id")
    return media(s, d).withColumn("turn", F.row_number().over(order)).filter("turn = 1").select("id", "sha256")


def _albums(s, d):
    """Albums made of media: kinds, sources and times of change, some unknown."""
    return media(s, d).select("id", F.col("media_type").alias("kind"), F.col("disc_id").alias("source"), F.col("taken_at").alias("updated_at"), "created_at")


def _nav(s, d):
    m = media(s, d)
    return C.nav_counts(m, analysis(s, d), copies.members(s, d), m.select(F.year("taken_at").alias("y")).distinct(), states.jobs(s, d), _discs(s, d), s.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("name"), (F.col("r_regionkey") % 2 == 0).alias("configured")))


def _reviews(s, d):
    m = media(s, d)
    return m.select(F.col("id").alias("media_id"), F.col("media_type").alias("queue_type"), (F.col("id") % 50).alias("priority"), "created_at", F.when(~F.col("flag"), F.col("created_at")).alias("resolved_at"))


def _fixed(s, d):
    m = media(s, d)
    return m.select(F.col("disc_id").alias("album_id"), F.col("id").alias("media_id"), F.when(F.col("id") % 4 > 0, F.col("id") % 90).alias("position"))


def _gated(s, d):
    from ..operators import commands as K

    m = media(s, d)
    queue = m.filter("flag").select(F.col("id").alias("media_id"), F.when(F.col("id") % 2 == 0, F.lit("accepted")).alias("resolution"))
    after = K.rejected(m, queue, m.filter("id % 5 = 0").select("id", F.lit("too_small").alias("code"), F.lit("small").alias("reason")))
    parts = [
        after["media"].filter("lifecycle = 'rejected' and quality_score = 0").select(F.lit("media").alias("name"), "id", F.lit("").alias("what")),
        after["queue"].select(F.lit("queue").alias("name"), F.col("media_id").alias("id"), F.coalesce("resolution", F.lit("")).alias("what")),
        after["analysis"].select(F.lit("analysis").alias("name"), F.col("media_id").alias("id"), F.col("description").alias("what")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _deleted(s, d):
    from ..operators import commands as K

    m = media(s, d)
    albums, held = K.albums_deleted(m.select("id"), _fixed(s, d).withColumn("album_id", F.col("media_id") % 10), m.filter("id % 3 = 0").select("id"))
    return albums.select(F.lit("albums").alias("name"), "id").unionByName(held.select(F.lit("items").alias("name"), F.col("media_id").alias("id")))


def _kept(s, d):
    """An index fed in three batches: all documents, a third of them at first with other words, and a seventh deleted."""
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    kept = S.KeptIndex(s, f"{shared_folder(s)}/index-{uuid.uuid4().hex}", ["text"])
    kept.upsert(docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.lit("this and this and nothing else")).otherwise(F.col("text"))), "doc_id")
    kept.delete(docs.filter("doc_id % 7 = 0").select(F.col("doc_id").alias("id")))
    kept.merge()
    kept.upsert(docs.filter("doc_id % 3 = 0 and doc_id % 7 <> 0"), "doc_id")
    return kept.search("this and").withColumn("score", F.round("score", 6))


def _found_page(s, d):
    hits = S.search(s.read.parquet(f"{d}/documents.parquet"), "this and", "doc_id", ["text"])
    return C.found_page(CatalogQuery(), media(s, d), hits).select("id", "taken_s")


def _documented(s, d):
    return S.document(items(s, d)).select("id", "filename", F.sha2("description", 256).alias("description"), "people_desc", "suggested_tags", "camera_make")


FOLDED = "list_filter(string_split_regex(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


def bm25(counts: list[str], where: str = "true") -> str:
    """Tables up to `found` (id, score): BM25 of documents in which each of the counts over the token list t is above 0."""
    return f"""f as (select doc_id as id, {FOLDED} as t from documents where {where}), st as (select count(*) as docs, avg(len(t)) as mean from f),
 hits as ({" union all ".join(f"select id, len(t) as dl, {i} as q, {c} as tf from f" for i, c in enumerate(counts))}),
 h as (select * from hits where tf > 0), df as (select q, count(*) as df from h group by q),
 sc as (select h.id, sum(ln(1 + (docs - df.df + 0.5) / (df.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))) as score, count(*) as n
  from h join df using (q), st group by h.id),
 found as (select id, score from sc where n = {len(counts)} order by score desc, id limit 500)"""


def times(word: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{word}'))"


THIS_AND = bm25([times("this"), times("and")])
BM25 = f"with {THIS_AND} select id, round(score, 6) as score from found"

QUERIES = {
    "sc1_scan": (lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "n_chars"), "select doc_id, lang, n_chars from documents"),
    "sc2_point_lookup": (lambda s, d: media(s, d).filter("id = 77").limit(1).select("id", "sha256"), f"{CTE} select id, sha256 from media where id = 77 limit 1"),
    "fi1_library_view": (_listing(), _ids_sql(LIB)),
    "fi2_trash_view": (_listing(trash=True, lifecycle="staging"), _ids_sql("lifecycle = 'trash'")),
    "fi3_equality": (_listing(media_type="image", hitl_status="pending", disc_id=""), _ids_sql(f"{LIB} and media_type = 'image' and hitl_status = 'pending'")),
    "fi4_tristate": (_listing(is_duplicate=False, flag=True), _ids_sql(f"{LIB} and not is_duplicate and flag")),
    "fi5_rating_min": (_listing(rating_min=4), _ids_sql(f"{LIB} and rating >= 4")),
    "fi6_has_value": (_listing(has_gps=False), _ids_sql(f"{LIB} and gps_lat is null")),
    "fi15_active": (lambda s, d: _ids(media(s, d).filter(C.active(F.col("lifecycle")))), _ids_sql(ACTIVE)),
    "fi16_null_not_in": (lambda s, d: _ids(media(s, d).filter(C.active_raw(F.col("lifecycle")))), _ids_sql("not (lifecycle in ('trash', 'rejected'))")),
    "fi17_null_trap": (
        lambda s, d: analysis(s, d).filter(is_heuristic(F.col("model_name"), F.col("model_version"))).select("media_id"),
        f"{CTE} select media_id from analysis where {HEURISTIC}",
    ),
    "jn1_left_analysis": (lambda s, d: items(s, d).select("id", "scene_type", "people_count"), f"{CTE} select id, scene_type, people_count from items"),
    "jn3_never_analysed": (lambda s, d: _ids(C.never_analysed(media(s, d), analysis(s, d))), f"{CTE} select id from media where id not in (select media_id from analysis)"),
    "jn4_inner_analysis": (
        lambda s, d: media(s, d).join(analysis(s, d), F.col("id") == F.col("media_id")).filter("people_count > 0").select("id", "people_count"),
        f"{CTE} select id, people_count from media join analysis on id = media_id where people_count > 0",
    ),
    "jn10_orphan_groups": (
        _orphans,
        f"{CTE} select distinct disc_id, hitl_status from media m where not exists (select 1 from media g where g.disc_id = m.disc_id and g.flag and g.rating = 5 and g.is_blurry)",
    ),
    "jn11_parent_counts": (
        lambda s, d: C.counts_per_parent(_discs(s, d), media(s, d).filter("flag and rating = 5"), "disc_id"),
        f"{CTE} select d.disc_id, count(m.id) as media_count from (select distinct disc_id from media) d left join media m on m.disc_id = d.disc_id and m.flag and m.rating = 5 group by 1",
    ),
    "jn13_review_media": (
        _review, f"{CTE} select media_id, people_count * 10 + 100 as priority, filename from analysis left join media on id = media_id",
    ),
    "jn14_ordered_lookup": (
        _ordered_lookup, f"{CTE} select c.conv_id * 100 + c.turn as pos, m.id, m.sha256 from conversations c join media m on m.id = c.conv_id * 3",
    ),
    "ag1_library_stats": (
        lambda s, d: C.library_stats(media(s, d), analysis(s, d)),
        f"""{CTE} select count(*) filter ({LIB}) as total, count(*) filter ({LIB} and media_type = 'image') as images, count(*) filter ({LIB} and media_type = 'video') as videos,
 count(*) filter ({LIB} and hitl_status = 'pending') as pending, count(*) filter ({LIB} and is_duplicate) as duplicates, count(*) filter ({LIB} and is_blurry) as blurry,
 count(*) filter ({LIB} and flag) as flagged, count(*) filter ({LIB} and gps_lat is not null) as with_gps, count(*) filter ({LIB} and a.media_id is not null) as analysed,
 count(*) filter ({LIB} and coalesce(a.people_count, 0) > 0) as with_people, count(*) filter (lifecycle = 'trash') as trash, count(*) filter (lifecycle = 'rejected') as rejected,
 count(*) filter (lifecycle = 'staging') as staging, cast(coalesce(sum(file_size) filter ({LIB}), 0) as bigint) as bytes, count(distinct disc_id) as discs
 from media m left join analysis a on a.media_id = m.id""",
    ),
    "ag8_media_per_disc": (lambda s, d: media(s, d).groupBy("disc_id").agg(F.count(F.lit(1)).alias("n")), f"{CTE} select disc_id, count(*) as n from media group by 1"),
    "ag9_queue_counts": (
        lambda s, d: media(s, d).filter(C.in_library(F.col("lifecycle"))).join(analysis(s, d), F.col("id") == F.col("media_id"), "left").agg(
            F.count_if(F.col("media_id").isNull()).alias("pending"), F.count_if(F.col("media_id").isNotNull() & is_heuristic(F.col("model_name"), F.col("model_version"))).alias("heuristic")
        ),
        f"{CTE} select count(*) filter (media_id is null) as pending, count(*) filter (media_id is not null and {HEURISTIC}) as heuristic from media left join analysis on id = media_id where {LIB}",
    ),
    "ag10_coverage_pct": (
        lambda s, d: C.coverage(media(s, d), analysis(s, d)),
        f"""{CTE}, c as (select count(*) as total, count(media_id) as done, count(*) filter (model_name is not null and not (model_name ilike '%heuristic%' or model_name ilike '%quality-gate%'
 or model_name ilike '%vlm-failed%')) as vlm_done from media left join analysis on id = media_id where {LIB})
 select total, done, vlm_done, case when total > 0 then round(100.0 * done / total, 1) else 0.0 end::double as coverage_pct, case when total > 0 then round(100.0 * vlm_done / total, 1) else 0.0 end::double as vlm_pct from c""",
    ),
    "ag13_review_counts": (
        lambda s, d: media(s, d).groupBy("hitl_status", "lifecycle").agg(F.count(F.lit(1)).alias("n")), f"{CTE} select hitl_status, lifecycle, count(*) as n from media group by all",
    ),
    "or1_page_desc": (_page(), f"{CTE} select id, rating, taken_s from media where {LIB} order by taken_at desc nulls last, created_at desc, id limit 50"),
    "or1_page_asc": (_page(sort="taken_at_asc"), f"{CTE} select id, rating, taken_s from media where {LIB} order by taken_at asc nulls last, created_at asc, id limit 50"),
    "or1_page_rating": (_page(sort="rating_desc", limit=75), f"{CTE} select id, rating, taken_s from media where {LIB} order by rating desc, taken_at desc nulls last, id limit 75"),
    "or2_page_offset": (_page(offset=120, limit=60), f"{CTE} select id, rating, taken_s from media where {LIB} order by taken_at desc nulls last, created_at desc, id limit 60 offset 120"),
    "or8_two_tier_queue": (
        lambda s, d: C.inference_queue(media(s, d), analysis(s, d), 400),
        f"""{CTE}, q as (select id, 0 as tier, created_at from media where {LIB} and id not in (select media_id from analysis)
 union all select id, 1, created_at from media join analysis on id = media_id where {LIB} and {HEURISTIC}) select id, tier from q order by tier, created_at, id limit 400""",
    ),
    "or9_prelimit_filter": (
        lambda s, d: C.queue_page(media(s, d), F.col("rating") >= 3, 300, 10, 100).select("id"),
        f"{CTE}, n as (select * from media order by created_at desc, id limit 300) select id from n where rating >= 3 order by created_at desc, id limit 100 offset 10",
    ),
    "st1_ordered_dedup": (_first_of_each, f"{CTE} select min(id) as id, sha256 from media group by sha256"),
    "st6_set_operations": (
        lambda s, d: _ids(media(s, d).filter("flag")).intersect(_ids(media(s, d).filter("rating > 2"))).unionByName(_ids(media(s, d).filter("is_blurry")).exceptAll(_ids(media(s, d).filter("gps_lat is null")))),
        f"{CTE} select id from media where flag and rating > 2 union all select id from media where is_blurry and gps_lat is not null",
    ),
    "ft3_bm25": (
        lambda s, d: S.search(s.read.parquet(f"{d}/documents.parquet"), "this and", "doc_id", ["text"]).withColumn("score", F.round("score", 6)), BM25,
    ),
    "ft4_phrase": (
        lambda s, d: S.search(s.read.parquet(f"{d}/documents.parquet"), '"that the" NOT zzz', "doc_id", ["text"]).withColumn("score", F.round("score", 6)),
        f"""with {bm25(["len(list_filter(range(1, len(t)), lambda i: t[i] = 'that' and t[i + 1] = 'the'))"])} select id, round(score, 6) as score from found""",
    ),
    "ft1_document": (
        _documented,
        f"""{CTE} select id, filename, sha256(coalesce(description, '')) as description, '' as people_desc, coalesce(camera_make, '') as camera_make,
 case when suggested_tags is null then '' when json_valid(suggested_tags) then array_to_string(from_json(suggested_tags, '["VARCHAR"]'), ' ') else suggested_tags end as suggested_tags from items""",
    ),
    "sk12_kept_index": (_kept, f"with {bm25([times('this'), times('and')], 'doc_id % 7 <> 0')} select id, round(score, 6) as score from found"),
    "or4_found_page": (_found_page, f"{CTE}, {THIS_AND} select id, taken_s from media where {LIB} and id in (select id from found) order by taken_at desc nulls last, created_at desc, id limit 50"),
    "ft2_stemmed_search": (
        lambda s, d: S.search(s.read.parquet(f"{d}/documents.parquet"), "thing", "doc_id", ["text"], stemmed=True).select("id", F.round("score", 6).alias("score")), None,
    ),
    "ft6_hybrid": (_hybrid, None),
    "ft5_name_fallback": (
        lambda s, d: S.search_or_name(media(s, d), "IMG 7 e", "id", ["camera_model"], "filename"), f"{CTE} select id from media where filename ilike '%IMG 7 e%'",
    ),
    "ag3_nav_counts": (
        _nav,
        f"""{CTE}, mem as (select id as media_id, min(id) over (partition by sha256) as group_id from media qualify count(*) over (partition by sha256) > 1),
 al as (select group_id from mem join media on id = media_id where not (lifecycle in ('trash', 'rejected')) group by 1 having count(*) > 1)
 select count(*) filter ({LIB}) as library, count(*) filter ({LIB} and taken_at is not null) as timeline, count(*) filter ({LIB}) as grid, count(*) filter ({LIB} and gps_lat is not null) as map,
 count(*) filter ({LIB} and people_count > 0) as people, 0 as review, count(*) filter ({LIB} and media_type = 'image') as images, count(*) filter ({LIB} and media_type = 'video') as videos,
 count(*) filter (lifecycle = 'trash') as trash, count(*) filter ({LIB} and media_id is null) + count(*) filter ({LIB} and model_name ilike '%heuristic%') as inference,
 (select count(*) from al) as duplicates, (select count(*) from (select distinct year(taken_at) from media)) as albums, (select count(*) from ({states.JOBS} select * from jobs where status in ('queued', 'running'))) as jobs,
 count(distinct disc_id) as discs, count(distinct disc_id) as stats, (select count(*) from region where r_regionkey % 2 = 0) as settings from media left join analysis on media_id = id""",
    ),
    "fi25_album_list": (lambda s, d: C.album_list(_albums(s, d), "image", "").select("id", "source"), f"{CTE} select id, disc_id as source from media where media_type = 'image'"),
    "or5_newest_albums": (
        lambda s, d: C.album_list(_albums(s, d)).limit(60).select("id"), f"{CTE} select id from media order by taken_at desc nulls last, created_at desc, id limit 60",
    ),
    "fi27_open_reviews": (lambda s, d: C.open_reviews(_reviews(s, d), "video").select("media_id", "priority"), f"{CTE} select id as media_id, id % 50 as priority from media where flag and media_type = 'video'"),
    "or6_next_reviews": (
        lambda s, d: C.open_reviews(_reviews(s, d)).limit(40).select("media_id"), f"{CTE} select id as media_id from media where flag order by id % 50, created_at, id limit 40",
    ),
    "or11_album_members": (
        lambda s, d: C.album_members(_fixed(s, d), "src7").limit(45), f"{CTE} select id as media_id, case when id % 4 > 0 then id % 90 end as position from media where disc_id = 'src7' order by position nulls last, id limit 45",
    ),
    "fi19_dates_and_tags": (
        lambda s, d: _ids(C.between_and_tagged(items(s, d), F.lit("2006-01-01").cast("timestamp"), F.lit("2030-12-31").cast("timestamp"), ["SEA", "none"])),
        f"""{CTE} select id from items where taken_at between timestamp '2006-01-01' and timestamp '2030-12-31' and json_valid(suggested_tags) and suggested_tags ilike '%" Sea "%'""",
    ),
    "jn12_lookup": (
        lambda s, d: media(s, d).join(F.broadcast(s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name")), F.col("id") % 30 == F.col("n_nationkey"), "left").select("id", F.coalesce("n_name", F.lit("unknown")).alias("name")),
        f"{CTE} select id, coalesce(n_name, 'unknown') as name from media left join nation on id % 30 = n_nationkey",
    ),
    "sk8_rejected": (
        _gated,
        f"""{CTE} select 'media' as name, id, '' as what from media where id % 5 = 0 or (lifecycle = 'rejected' and quality_score = 0)
 union all select 'queue', id, coalesce(case when id % 2 = 0 then 'accepted' end, case when id % 5 = 0 then 'quality:too_small' end, '') from media where flag
 union all select 'analysis', id, 'too_small: small' from media where id % 5 = 0""",
    ),
    "sk11_albums_deleted": (
        _deleted, f"{CTE} select 'albums' as name, id from media where id % 3 <> 0 union all select 'items', id from media where not (id % 10 % 3 = 0 and id % 10 in (select id from media))",
    ),
}
