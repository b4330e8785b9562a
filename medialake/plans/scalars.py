"""Scalar functions: names, dates, gates, annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import annotate as A, dates as T, gates as G, names as N, pixels as P
from .surrogate import CTE, NOW, analysis, items, media

JUNK = G.JUNK_PATH.replace("'", "''")
FOLDERS = ", ".join(f"'{f}'" for f in G.JUNK_FOLDERS)
BLOCKED = ", ".join(f"'{e}'" for e in G.BLOCKED)
VIDEOS = ", ".join(f"'{e}'" for e in N.VIDEOS)
WEB = ", ".join(f"'{e}'" for e in G.WEB)
EXT = "lower(regexp_extract(original_path, '[^/.][^/]*?(\\.[^./]+)$', 1))"
DIMS = """case when width is null or height is null or width <= 0 or height <= 0 then null when {video} and least(width, height) < 360 then 'video_too_small' when {video} then null
 when least(width, height) < 480 or greatest(width, height) < 640 or width::double * height / 1e6 < 0.35 then 'too_small' when greatest(width, height)::double / least(width, height) > 3.5 then 'extreme_aspect' end"""
GATE = f"""case when {EXT} in ({BLOCKED}) then 'vector_or_blocked' when file_size <= 0 then 'empty' when file_size < 2048 then 'file_too_small'
 when regexp_matches(original_path, '{JUNK}') then 'junk_path' when list_has_any(string_split_regex(lower(original_path), '[/\\\\]'), [{FOLDERS}]) then 'junk_dir'
 when {EXT} in ({VIDEOS}) and file_size < 200000 then 'file_too_small' when {EXT} in ({VIDEOS}) then null when {DIMS.format(video="false")} is not null then {DIMS.format(video="false")}
 when not coalesce(least(width, height) >= 600 and width is not null and height is not null, false) and file_size < case when {EXT} in ({WEB}) then 40000 else 25000 end then 'file_too_small'
 when {EXT} in ({WEB}) and file_size < 10000 then 'web_format_too_small' end"""
SEGMENTS = "list_filter(string_split(replace(original_path, '\\', '/'), '/'), lambda x: x <> '')"


def _try(pattern: str, y: int, m: int, d: int) -> str:
    g = lambda i: f"regexp_extract(s, '{pattern}', {i})"
    return f"try_cast(nullif({g(y)}, '') || '-' || lpad({g(m)}, 2, '0') || '-' || lpad({g(d)}, 2, '0') as date)"


#: DuckDB's expressions have no look-behind; a leading group that takes a non-digit stands for it.
_B = "(?:^|[^0-9])"
_E = "(?:$|[^0-9])"
SEGMENT_DATE = "coalesce({}, {}, {})".format(
    _try(f"{_B}([0-9]{{1,2}})[-_./ ]([0-9]{{1,2}})[-_./ ](19[0-9]{{2}}|20[0-9]{{2}}){_E}", 3, 2, 1),
    _try(f"{_B}(19[0-9]{{2}}|20[0-9]{{2}})[-_./]([0-9]{{1,2}})[-_./]([0-9]{{1,2}}){_E}", 1, 2, 3),
    _try(f"{_B}(19[0-9]{{2}}|20[0-9]{{2}})([0-9]{{2}})([0-9]{{2}}){_E}", 1, 2, 3),
)
PATH_DATE = f"list_filter(list_transform(list_concat(list_reverse({SEGMENTS}[1:-2]), {SEGMENTS}[-1:]), lambda s: {SEGMENT_DATE}), lambda x: x is not null)[1]"


def now():
    return F.lit(NOW).cast("timestamp")


def _gate(s, d):
    c = F.col
    return media(s, d).select("id", G.path_code(c("original_path"), c("file_size"), c("width"), c("height")).alias("code"))


def _repair(s, d):
    """Capture dates after repair: suspicious ones (here every seventh lies on the import's day) get the path's date."""
    m = media(s, d).withColumn("taken", F.when(F.col("id") % 7 == 0, F.col("created_at")).otherwise(F.col("taken_at")))
    doubt = T.suspicious(F.col("taken"), F.col("created_at"), now())
    fresh = T.path_date(F.col("original_path"), now()).cast("timestamp")
    outcome = F.when(~doubt, "skipped").when(fresh.isNull() & F.col("taken").isNull(), "missing").when(fresh.isNull(), "cleared").otherwise("updated")
    return m.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def _normalised(s, d):
    c = F.col
    label = A.scene(c("scene_type"))
    return items(s, d).select(
        "id", label.alias("scene"), A.unit_score(c("raw_quality")).alias("quality"), A.era(c("estimated_era"), c("taken_at")).alias("era"),
        F.array_join(A.normalised_tags(N.json_list(c("suggested_tags")), label, c("is_blurry")), ",").alias("tags"), A.caption(F.when(c("id") % 2 == 0, c("caption_short")), label).alias("caption"),
    )


SCENES = ", ".join(f"'{x}'" for x in A.SCENES)
SCENE = f"""case when s0 in ({SCENES}) then s0 {' '.join(f"when s0 = '{a}' then '{b}'" for a, b in A.SYNONYMS.items())} else 'other' end"""
NORMALISED = f"""{CTE}, x as (select *, replace(lower(trim(coalesce(nullif(scene_type, ''), 'other'))), ' ', '_') as s0, try_cast(raw_quality as double) as q,
  list_filter(list_transform(case when json_valid(suggested_tags) then from_json(suggested_tags, '["VARCHAR"]') else [] end, lambda x: lower(trim(x))), lambda x: x <> '') as t0 from items),
 y as (select *, {SCENE} as scene, case when is_blurry and not list_contains(t0, 'blurry') then list_append(t0, 'blurry') else t0 end as t1 from x)
 select id, scene, greatest(0.0, least(1.0, case when q is null or q = 0 then 0.5 else q end))::double as quality,
 case when coalesce(estimated_era, 'unknown') in ('unknown', '', 'none') then coalesce((year(taken_at) // 10 * 10) || 's', coalesce(estimated_era, 'unknown')) else estimated_era end as era,
 array_to_string((case when scene <> 'other' and not list_contains(t1, scene) then list_prepend(scene, t1) else t1 end)[1:15], ',') as tags,
 left(case when trim(coalesce(case when id % 2 = 0 then caption_short end, '')) = '' then array_to_string(list_transform(string_split(replace(scene, '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' photo'
  else trim(caption_short) end, 160) as caption from y"""


def _heuristic(s, d):
    c = F.col
    return media(s, d).select(
        "id", A.heuristic_quality(c("width"), c("height"), c("is_blurry")).alias("quality"),
        F.array_join(A.heuristic_tags(c("media_type"), c("camera_make"), c("camera_model"), c("gps_lat"), c("taken_at")), ",").alias("tags"),
    )


def _embedded(s, d):
    m = media(s, d)
    return m.select("id", P.hash_embedding(F.col("sha256"), F.col("width"), F.col("height"), F.col("media_type")).alias("v")).select("id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"))


def _repaired(s, d):
    """Answers made of documents: fenced, with a trailing comma, or cut off inside a string."""
    m = media(s, d).withColumn("name", F.concat(F.lit("IMG "), F.col("id")))
    answer = F.when(F.col("id") % 3 == 0, F.concat(F.lit('```json\n{"n": "'), "name", F.lit('", "t": ["a", "b",]}\n```'))).when(F.col("id") % 3 == 1, F.concat(F.lit('Sure: {"t": ["a"], "n": "'), "name"))
    return m.select("id", F.get_json_object(A.repaired_json(answer), "$.n").alias("name"))


def _turned(s, d):
    """Pictures made of ids, 12 wide: slopes of light in both directions, and a pattern."""
    i = F.sequence(F.lit(0), F.lit(179))
    pixels = F.transform(i, lambda k: ((k % 12) * (F.col("id") % 7) + F.floor(k / 12) * (F.col("id") % 5) * 3 + (k * k * F.col("id")) % 11).cast("double"))
    drawn = media(s, d).select("id", pixels.alias("pixels"), F.lit(12).alias("width"))
    found = drawn.select("id", P.picture_signs(F.col("pixels"), F.col("width")).alias("found"), P.blur_score(F.col("pixels"), F.col("width")).alias("blur"))
    return found.select("id", P.upright_degrees(F.col("found")).alias("turn"), P.upright_degrees(F.col("found"), aggressive=True).alias("aggressive_turn"), "blur")


QUERIES = {
    "sf31_json_repair": (_repaired, f"{CTE} select id, case when id % 3 <> 2 then 'IMG ' || id end as name from media"),
    "sf26_upright": (_turned, None),
    "sf25_orientation": (
        lambda s, d: media(s, d).select("id", P.degrees((F.col("id") % 10).cast("int")).alias("degrees")),
        f"{CTE} select id, cast(case id % 10 when 3 then 180 when 4 then 180 when 5 then 270 when 6 then 90 when 7 then 90 when 8 then 270 else 0 end as int) as degrees from media",
    ),
    "sc5_media_type": (
        lambda s, d: media(s, d).select("id", N.media_type(N.suffix(F.col("original_path"))).alias("kind")),
        f"{CTE} select id, case when {EXT} in ({', '.join(repr(e) for e in N.IMAGES)}) then 'image' when {EXT} in ({VIDEOS}) then 'video' end as kind from media",
    ),
    "sf1_slug": (
        lambda s, d: media(s, d).select("id", N.slug(F.col("disc_id"), F.lit("  "), F.col("filename")).alias("slug")),
        f"{CTE} select id, trim(regexp_replace(lower(disc_id || '-' || filename), '[^a-z0-9]+', '-', 'g'), '-') as slug from media",
    ),
    "sf2_title": (
        lambda s, d: analysis(s, d).select("media_id", N.scene_title(F.col("scene_type")).alias("title")),
        f"""{CTE} select media_id, case when scene_type is null or scene_type = 'unknown' then '' when scene_type = 'beach' then 'Beach' when scene_type = 'group_photo' then 'Group Photo' else 'City Scape' end as title from analysis""",
    ),
    "sf4_json_list": (
        lambda s, d: analysis(s, d).select("media_id", F.array_join(N.json_list(F.col("suggested_tags")), "|").alias("tags")),
        f"""{CTE} select media_id, array_to_string(list_filter(list_transform(case when json_valid(suggested_tags) then from_json(suggested_tags, '["VARCHAR"]') else [] end, lambda x: trim(x)), lambda x: x <> ''), '|') as tags from analysis""",
    ),
    "sf9_asset_version": (
        lambda s, d: media(s, d).select("id", N.asset_version(F.col("created_s"), F.col("rating"), F.col("sha256")).alias("version")),
        f"{CTE} select id, (created_s * 1000) || '-' || rating || '-' || left(sha256, 8) as version from media",
    ),
    "sf15_path_date": (
        lambda s, d: media(s, d).select("id", F.date_format(T.path_date(F.col("original_path"), now()), "yyyy-MM-dd").alias("day")),
        f"{CTE} select id, strftime({PATH_DATE}, '%Y-%m-%d') as day from media",
    ),
    "fi20_suspicious": (
        lambda s, d: media(s, d).filter(T.suspicious(F.col("taken_at"), F.col("created_at"), now())).select("id"),
        f"{CTE} select id from media where taken_s is null or abs(taken_s - epoch(timestamp '{NOW}')) < 172800 or abs(taken_s - created_s) < 172800",
    ),
    "dr1_date_repair": (
        _repair,
        f"""{CTE}, m as (select *, case when id % 7 = 0 then created_s else taken_s end as t, {PATH_DATE} as fresh from media), o as (select case
 when not (t is null or abs(t - epoch(timestamp '{NOW}')) < 172800 or abs(t - created_s) < 172800) then 'skipped' when fresh is null and t is null then 'missing' when fresh is null then 'cleared' else 'updated' end as outcome from m)
 select outcome, count(*) as n from o group by 1""",
    ),
    "sf18_quality_gate": (_gate, f"{CTE} select id, {GATE} as code from media"),
    "ag11_code_histogram": (
        lambda s, d: _gate(s, d).filter("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("n")), f"{CTE}, g as (select {GATE} as code from media) select code, count(*) as n from g where code is not null group by 1",
    ),
    "sf19_dimension_gate": (
        lambda s, d: media(s, d).select("id", G.dimension_code(F.col("width"), F.col("height"), F.col("media_type")).alias("code")),
        f"{CTE} select id, {DIMS.format(video=chr(39).join(['media_type = ', 'video', '']))} as code from media",
    ),
    "sf20_media_gate": (
        lambda s, d: media(s, d).select("id", G.media_code(F.col("original_path"), F.col("media_type"), F.col("file_size"), F.col("width"), F.col("height")).alias("code")),
        f"""{CTE} select id, case when {EXT} in ({BLOCKED}) then 'vector_or_blocked' when regexp_matches(original_path, '{JUNK}') then 'junk_path'
 when list_has_any(string_split(lower(original_path), '/'), [{FOLDERS}]) then 'junk_dir' when {DIMS.format(video="media_type = 'video'")} is not null then {DIMS.format(video="media_type = 'video'")}
 when media_type = 'video' and file_size < 200000 then 'file_too_small' when media_type <> 'video' and not coalesce(least(width, height) >= 600, false) and file_size < 25000 then 'file_too_small' end as code from media""",
    ),
    "sf30_heuristic": (
        _heuristic,
        f"""{CTE} select id, round(case when is_blurry then least(q, 0.35) else q end, 3)::double as quality, concat_ws(',', media_type, lower(camera_make), replace(lower(camera_model), ' ', '-'),
 case when gps_lat is not null then 'geo-tagged' end, year(taken_at)::varchar) as tags from (select *, (case when width::double * height > 0 then least(1.0::double, 0.35::double + width::double * height / 1e6 / 12.0::double) else 0.5::double end) as q from media)""",
    ),
    "sf32_normalise": (_normalised, NORMALISED),
    "sf33_failures": (
        lambda s, d: analysis(s, d).select("media_id", A.failures(F.col("model_version")).alias("failures")),
        f"{CTE} select media_id, cast(case model_version when 'vlm-failed:2' then 2 when 'vlm-gave-up' then 10000 when 'vlm-failed' then 1 when 'vlm-failed:x' then 1 else 0 end as int) as failures from analysis",
    ),
    "sf36_format_bytes": (
        lambda s, d: media(s, d).select("id", N.human_bytes(F.col("file_size")).alias("size")),
        f"{CTE} select id, case when file_size < 1024 then file_size || ' B' when file_size < 1048576 then printf('%.1f KB', round(file_size / 1024.0::double, 1)) when file_size < 1073741824 then printf('%.1f MB', round(file_size / 1048576.0::double, 1)) else printf('%.1f GB', file_size / 1073741824.0::double) end as size from media",
    ),
    "sf28_hash_embedding": (_embedded, None),
}
