"""Collections, buckets, events and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import organise as O, rules as R
from ..operators.catalog import in_library
from ..operators.ordered import numbered
from .surrogate import CTE, items, media

LIB = "(lifecycle = 'library' or lifecycle is null)"
RULES = {"year": 2006, "camera_make": "a", "is_blurry": False, "people_min": 0, "tag": "sea", "unknown": 1}
TITLE = """case when lower(trim(replace(replace(coalesce(scene_type, ''), '_', ' '), '-', ' '))) in ('', 'unknown', 'none', 'n/a') then ''
 else array_to_string(list_transform(string_split(lower(trim(replace(replace(scene_type, '_', ' '), '-', ' '))), ' '), lambda w: upper(w[1]) || w[2:]), ' ') end"""
TAGS = "list_filter(list_transform(case when json_valid(suggested_tags) then from_json(suggested_tags, '[\"VARCHAR\"]') else [] end, lambda x: trim(x)), lambda x: x <> '')"
SLUG = "trim(regexp_replace(lower(key), '[^a-z0-9]+', '-', 'g'), '-')"
BUCKETS = f"""b as (select distinct on (id, kind, key) * from (
 select *, 'year' as kind, strftime(taken_at, '%Y') as key from lib where taken_at is not null
 union all select *, 'month', strftime(taken_at, '%Y-%m') from lib where taken_at is not null
 union all select *, 'camera', camera_make || ' ' || camera_model from lib where camera_make is not null
 union all select *, 'disc', disc_id from lib
 union all select *, 'scene', {TITLE} from lib where {TITLE} <> ''
 union all select *, 'people', 'people' from lib where people_count > 0
 union all select *, 'tag', lower(unnest({TAGS}[1:8])) from lib))"""


def library(s, d):
    return items(s, d).filter(in_library(F.col("lifecycle")))


def _orders(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("ts"))


def _sessions(s, d):
    found = O.sessions(_orders(s, d), ["owner"], "ts")
    return found.groupBy("owner", "session").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).select("owner", "n", "first_id")


def _positions(s, d):
    found = O.positions(library(s, d), "disc_id", F.col("rating") == 5)
    return found.select("disc_id", "id", "position")


def _dominant(s, d):
    return O.dominant(library(s, d).withColumn("scene", O.scene_title(F.col("scene_type"))), ["disc_id"], "scene", "id")


def _running_cap(s, d):
    """Members of each archive (disc) up to the first that breaks a cap on bytes: it and all after it are left out."""
    found = numbered(media(s, d).select("disc_id", "id", "file_size"), ["disc_id"], ["id"], ["file_size"])
    return found.select("disc_id", "id", F.col("sum_file_size").alias("sum")).filter("sum <= 4000000")


def _upsert(s, d):
    old = O.buckets(library(s, d)).filter("kind = 'year'").groupBy(F.concat_ws(":", "kind", "key").alias("auto_key")).agg(F.lit(-1).cast("long").alias("n"))
    old = old.unionByName(s.createDataFrame([("year:1900", 3)], "auto_key string, n long"))
    new = O.bucket_albums(library(s, d)).filter("kind in ('year', 'camera')").select("auto_key", "n")
    return O.upserted(old, new)


def _event_albums(s, d):
    return O.event_albums(library(s, d))


EVENTS = f"""{CTE}, lib as (select * from items where {LIB} and taken_at is not null),
 g as (select *, case when taken_at - lag(taken_at) over (order by taken_at, id) > interval 3 day then 1 else 0 end as new from lib),
 e as (select *, sum(new) over (order by taken_at, id rows unbounded preceding) as event, {TITLE} as scene from g),
 sp as (select event, min(taken_at) as t0, max(taken_at) as t1, count(*) as n from e group by event having count(*) >= 2),
 sc as (select event, scene, count(*) as c, min((taken_at, id)) as f from e where scene <> '' group by all),
 top as (select event, scene, c from sc qualify row_number() over (partition by event order by c desc, f) = 1)
select 'event:' || strftime(t0, '%Y%m%d') || '-' || strftime(t1, '%Y%m%d') || '-' || n as auto_key,
 case when t0::date = t1::date then day(t0) || ' ' || strftime(t0, '%b %Y') when year(t0) = year(t1) and month(t0) = month(t1) then day(t0) || '–' || day(t1) || ' ' || strftime(t0, '%b %Y')
 when year(t0) = year(t1) then strftime(t0, '%b') || '–' || strftime(t1, '%b %Y') else year(t0) || '–' || year(t1) end || case when c >= greatest(2, n // 4) then ' · ' || scene else '' end as name, n
from sp left join top using (event)"""
MATCH = f"{LIB} and strftime(taken_at, '%Y') = '2006' and camera_make ilike '%a%' and people_count >= 0 and suggested_tags ilike '%sea%'"

QUERIES = {
    "og1_smart_rules": (
        lambda s, d: R.resolve(items(s, d), RULES), f"{CTE} select id from items where {MATCH} order by taken_at desc nulls last, created_at desc, id limit 2000",
    ),
    "fi13_text_rule": (
        lambda s, d: items(s, d).filter(R.condition({"q": "es t"})).select("id"),
        f"{CTE} select id from items where {LIB} and (filename ilike '%es t%' or caption_short ilike '%es t%' or description ilike '%es t%')",
    ),
    "fi9_ilike_contains": (
        lambda s, d: items(s, d).filter(R.condition({"scene_type": "c_ty"})).select("id"), f"{CTE} select id from items where {LIB} and scene_type ilike '%c_ty%'",
    ),
    "og4_builtin_counts": (
        lambda s, d: R.counts(items(s, d)),
        f"""{CTE}, r as (select 'smart:recent-pending' as auto_key, 'Needs review' as name, count(*) filter ({LIB} and hitl_status = 'pending') as item_count from items
 union all select 'smart:blurry', 'Blurry shots', count(*) filter ({LIB} and is_blurry) from items
 union all select 'smart:has-gps', 'On the map', count(*) filter ({LIB} and gps_lat is not null) from items
 union all select 'smart:videos', 'Videos', count(*) filter ({LIB} and media_type = 'video') from items
 union all select 'smart:photos', 'All photos', count(*) filter ({LIB} and media_type = 'image') from items
 union all select 'smart:duplicates', 'Duplicates', count(*) filter ({LIB} and is_duplicate) from items
 union all select 'smart:people', 'With people (smart)', count(*) filter ({LIB} and people_count >= 1) from items) select * from r""",
    ),
    "ag14_bucket_albums": (
        lambda s, d: O.bucket_albums(library(s, d)),
        f"""{CTE}, lib as (select * from items where {LIB}), {BUCKETS}
 select kind || ':' || case when kind in ('year', 'month') then key else {SLUG} end as auto_key, kind, key, count(*) as n,
 arg_max(id, (coalesce(rating, 0), not coalesce(is_blurry, false), coalesce(blur_score, 0.0), coalesce(width * height, 0), -id)) as cover_id
 from b group by kind, key having count(*) >= case when kind in ('scene', 'tag') then 3 else 2 end""",
    ),
    "og2_album_members": (
        lambda s, d: O.buckets(library(s, d)).select("kind", "key", "id").distinct(), f"{CTE}, lib as (select * from items where {LIB}), {BUCKETS} select kind, key, id from b",
    ),
    "ag15_dominant_scene": (
        _dominant,
        f"""{CTE}, c as (select disc_id, {TITLE} as top, count(*) as top_n, min(id) as f from items where {LIB} and {TITLE} <> '' group by 1, 2)
 select disc_id, top, top_n from c qualify row_number() over (partition by disc_id order by top_n desc, f) = 1""",
    ),
    "or10_top_tags": (
        lambda s, d: O.top_tags(library(s, d), 15),
        f"""{CTE}, t as (select id, unnest({TAGS}) as tag, generate_subscripts({TAGS}, 1) as pos from items where {LIB})
 select lower(tag) as tag, count(*) as n from t group by 1 order by n desc, min((id, pos)) limit 15""",
    ),
    "wi1_event_sessions": (
        _sessions,
        """with g as (select o_custkey as owner, o_orderkey as id, o_orderdate as ts, case when o_orderdate - lag(o_orderdate) over w > interval 3 day then 1 else 0 end as new from orders
 window w as (partition by o_custkey order by o_orderdate, o_orderkey)), e as (select *, sum(new) over (partition by owner order by ts, id rows unbounded preceding) as session from g)
 select owner, count(*) as n, min(id) as first_id from e group by owner, session""",
    ),
    "og3_event_albums": (_event_albums, EVENTS),
    "wi3_sequence_names": (
        lambda s, d: O.sequence_names(media(s, d)),
        f"{CTE} select id, disc_id, printf('%04d_%s', row_number() over (partition by disc_id order by original_path, id), filename) as staged_name from media",
    ),
    "wi4_positions": (
        _positions,
        f"{CTE} select disc_id, id, row_number() over (partition by disc_id order by (rating = 5)::int desc, taken_at asc nulls last, id) - 1 as position from media where {LIB}",
    ),
    "wi5_running_cap": (
        _running_cap,
        f"{CTE}, r as (select disc_id, id, cast(sum(file_size) over (partition by disc_id order by id rows unbounded preceding) as bigint) as sum from media) select * from r where sum <= 4000000",
    ),
    "wi6_timeline_days": (
        lambda s, d: O.timeline(library(s, d)), f"{CTE} select coalesce(strftime(taken_at, '%Y-%m-%d'), 'Unknown date') as day, count(*) as n, min(id) as first_id from media where {LIB} group by 1",
    ),
    "sk10_album_upsert": (
        _upsert,
        f"""{CTE}, lib as (select * from items where {LIB}), {BUCKETS},
 new as (select kind || ':' || case when kind = 'year' then key else {SLUG} end as auto_key, count(*) as n from b where kind in ('year', 'camera') group by kind, key having count(*) >= 2),
 old as (select 'year:' || key as auto_key, -1 as n from b where kind = 'year' group by key union all select 'year:1900', 3)
 select auto_key, case when old.n is null then 'created' when new.n is null then 'kept' else 'updated' end as outcome, coalesce(new.n, old.n)::bigint as n from old full join new using (auto_key)""",
    ),
    "ag12_item_counts": (
        lambda s, d: library(s, d).groupBy("disc_id").agg(F.least(F.count(F.lit(1)), F.lit(30)).alias("shown")), f"{CTE} select disc_id, least(count(*), 30) as shown from media where {LIB} group by 1",
    ),
}
