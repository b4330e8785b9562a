"""Commands with all their outputs: rows of every table that they touch."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from ..operators import commands as K, duplicates as D, organise as O, rules as R
from .albums import BUCKETS, LIB, RULES, SLUG, library
from .copies import ACTIVE, MEMBERS, SCORE, members
from .listings import _fixed
from .states import now
from .surrogate import CTE, NOW, analysis, items, media

AT = f"timestamp '{NOW}'"
#: Media, some of the trash with the time they went there, and a review row for every item, open for flagged ones.
TIMED = "case when id % 20 = 0 then timestamp '2020-01-01' end"
QUEUE = f"{CTE}, q as (select id as media_id, case when not flag then 'old' end as resolution, case when not flag then timestamp '2021-01-01' end as resolved_at from media)"


def timed(s, d) -> DataFrame:
    return media(s, d).withColumn("deleted_at", F.expr(TIMED))


def queue(s, d) -> DataFrame:
    m, flagged = media(s, d), F.col("flag")
    return m.select(F.col("id").alias("media_id"), F.when(~flagged, "old").alias("resolution"), F.when(~flagged, F.expr("timestamp '2021-01-01'")).alias("resolved_at"))


def told(name: str, rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """A table's rows as (name, id, what)."""
    return rows.select(F.lit(name).alias("name"), F.col(key).alias("id"), F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]).alias("what"))


def said(name: str, source: str, key: str, *values: str) -> str:
    """The same in SQL."""
    return f"select '{name}' as name, {key} as id, concat_ws('|', {', '.join(f'coalesce(({v})::varchar, {chr(39)}-{chr(39)})' for v in values)}) as what from {source}"


def _edited(s, d):
    m = media(s, d)
    each = F.col("id")
    edits = m.filter("id % 3 = 0").select(
        "id", F.when(each % 5 == 0, "rejected").alias("hitl_status"), (each % 11 - 3).cast("int").alias("rating"), F.when(each % 2 == 0, True).alias("flag"),
        F.when(each % 9 == 0, F.concat(F.lit("new "), each)).alias("caption_short"), F.when(each % 12 == 0, "long").alias("description"),
        F.when(each % 15 == 0, F.array(F.lit("Sée"), F.lit('a "b"\\'), F.concat(F.lit("😀"), each % 4))).alias("suggested_tags"),
    )
    out = K.edited(m, analysis(s, d), edits.unionByName(edits.withColumn("id", -each - 1)), now())
    a = out["analysis"].withColumn("described", F.sha2("description", 256))
    return told("media", out["media"], "id", "rating", "flag", "hitl_status", "updated_at").unionByName(told("analysis", a, "media_id", "caption_short", "described", "suggested_tags", "human_edited")).unionByName(
        told("texts", out["texts"], "id")
    )


_TAGS = "case when id % 15 = 0 then '[\"S\\u00e9e\", \"a \\\"b\\\"\\\\\", \"\\ud83d\\ude00' || id % 4 || '\"]' end"
_SAYS = "id % 3 = 0 and (id % 9 = 0 or id % 12 = 0 or id % 15 = 0)"
EDITED = f"""{CTE}, e as (select *, {_SAYS} as says from media), a as (select coalesce(e.id, an.media_id) as id, an.*, e.says, case when says and id % 9 = 0 then 'new ' || id end as c, case when says and id % 12 = 0 then 'long' end as ds, case when says then {_TAGS} end as tg
  from (select * from e where says) e full join analysis an on an.media_id = e.id)
 {said("media", "e", "id", "case when id % 3 = 0 then least(5, greatest(0, id % 11 - 3)) else rating end", "case when id % 3 = 0 and id % 2 = 0 then true else flag end",
       "case when says then 'edited' when id % 3 = 0 and id % 5 = 0 then 'rejected' else hitl_status end", f"case when id % 3 = 0 then {AT} end")}
 union all {said("analysis", "a", "id", "coalesce(c, caption_short)", "sha256(coalesce(ds, description))", "coalesce(tg, suggested_tags)", "coalesce(says, false)")}
 union all select 'texts', id, '' from e where says"""


def _trashed(s, d):
    m = timed(s, d)
    out = K.trashed_batch(m, queue(s, d), m.filter("id % 4 < 2").select((-F.col("id")).alias("pos"), "id"), now(), 500)
    return told("media", out["media"], "id", "lifecycle", "deleted_at").unionByName(told("queue", out["queue"], "media_id", "resolution", "resolved_at"))


TRASHED = f"""{QUEUE}, t as (select *, {TIMED} as was from media), b as (select id as hit from t where id % 4 < 2 order by -id limit 500),
 g as (select t.*, hit is not null and not (coalesce(lifecycle, '') = 'trash' and was is not null) as goes from t left join b on hit = id)
 {said("media", "g", "id", "case when goes then 'trash' else lifecycle end", f"case when goes then {AT} else was end")}
 union all {said("queue", "q join g on id = media_id", "media_id", "case when goes and resolved_at is null then 'trashed' else resolution end", f"case when goes and resolved_at is null then {AT} else resolved_at end")}"""


def _swept(s, d):
    out = K.swept(media(s, d), queue(s, d), now())
    return told("media", out["media"], "id", "hitl_status").unionByName(told("queue", out["queue"], "media_id", "resolution", "resolved_at"))


SWEPT = f"{QUEUE} {said('media', 'media', 'id', chr(39) + 'accepted' + chr(39))} union all {said('queue', 'q', 'media_id', 'coalesce(resolution, ' + chr(39) + 'accepted' + chr(39) + ')', f'coalesce(resolved_at, {AT})')}"


def _promoted(s, d):
    m = media(s, d)
    out = K.promoted_items(m, queue(s, d), m.filter("id % 5 <> 4").select("id"), now())
    return told("media", out["media"], "id", "library_path", "lifecycle", "hitl_status").unionByName(told("queue", out["queue"], "media_id", "resolution", "resolved_at"))


PROMOTED = f"""{QUEUE}, st as (select *, row_number() over (partition by disc_id, filename order by id) as k from media where lifecycle = 'staging' and id % 5 <> 4),
 held as (select distinct disc_id, filename from media where coalesce(lifecycle, 'library') = 'library'),
 p as (select id as pid, disc_id || '/' || case when k > 1 or h.filename is not null then left(lpad(id::varchar, 8, '0'), 8) || '_' || st.filename else st.filename end as dest from st left join held h using (disc_id, filename)),
 m as (select * from media left join p on pid = id)
 {said("media", "m", "id", "dest", "case when dest is not null then 'library' else lifecycle end", "case when dest is not null then 'accepted' else hitl_status end")}
 union all {said("queue", "q join m on id = media_id", "media_id", "case when dest is not null and resolved_at is null then 'accepted' else resolution end", f"case when dest is not null and resolved_at is null then {AT} else resolved_at end")}"""


def _resolved(trash: bool):
    def run(s, d):
        m, mem = timed(s, d), members(s, d)
        tables = {"media": m, "members": mem, "groups": mem.select("group_id").distinct(), "queue": queue(s, d)}
        out = K.resolved_groups(tables, D.kept_best(mem, m), now(), trash)
        return (
            told("media", out["media"], "id", "hitl_status", "is_duplicate", "lifecycle", "deleted_at").unionByName(told("members", out["members"], "media_id", "group_id"))
            .unionByName(told("groups", out["groups"], "group_id")).unionByName(told("queue", out["queue"], "media_id", "resolution", "resolved_at"))
        )

    return run


def resolved_sql(trash: bool) -> str:
    goes = "true" if trash else "false"
    how = "trashed" if trash else "rejected_keep_best"
    return f"""{MEMBERS}, q as (select id as media_id, case when not flag then 'old' end as resolution, case when not flag then timestamp '2021-01-01' end as resolved_at from media),
 x as (select group_id, media_id, {SCORE} as score from members join media on id = media_id where {ACTIVE}),
 r as (select *, row_number() over (partition by group_id order by score desc, media_id) = 1 as wins, count(*) over (partition by group_id) as live from x),
 w as (select * from r where live > 1), m as (select media.*, {TIMED} as was, wins from media left join w on media_id = id)
 {said("media", "m", "id", "case when wins then 'accepted' when not wins then 'rejected' else hitl_status end", "case when wins then false else is_duplicate end",
       f"case when not wins and {goes} then 'trash' else lifecycle end", f"case when not wins and {goes} then {AT} else was end")}
 union all {said("members", "members where group_id not in (select group_id from w)", "media_id", "group_id")}
 union all select distinct 'groups', group_id, '' from members where group_id not in (select group_id from w)
 union all {said("queue", "q join m on id = q.media_id", "q.media_id", f"case when resolved_at is null and wins then 'keep_best' when resolved_at is null and not wins then '{how}' else resolution end",
                 f"case when resolved_at is null and wins is not null then {AT} else resolved_at end")}"""


def _organised(s, d):
    """An organiser's run over year and camera albums: half of the years exist already, with a member that goes, and one album that isn't proposed."""
    found = O.buckets(library(s, d)).filter("kind in ('year', 'camera')").select("kind", "key", "id").distinct()
    proposed = O.bucket_albums(library(s, d)).filter("kind in ('year', 'camera')").select("auto_key", F.when(F.col("kind") == "year", "album").otherwise("smart").alias("kind"), F.col("key").alias("name"), F.col("kind").alias("of"), "key")
    rows = found.withColumnRenamed("kind", "of").join(proposed.select("auto_key", "of", "key"), ["of", "key"]).select("auto_key", F.col("id").alias("media_id"), F.col("id").alias("position"))
    old = proposed.filter("of = 'year' and cast(key as int) % 2 = 0").select("auto_key", "kind", F.lit("old name").alias("name"), F.lit(-1).cast("long").alias("cover_id"))
    old = old.unionByName(s.createDataFrame([("year:1900", "album", "1900", -5)], "auto_key string, kind string, name string, cover_id long"))
    held = old.select("auto_key", F.lit(-1).cast("long").alias("media_id"), F.lit(0).cast("long").alias("position"))
    out = O.albums_upserted(old, held, proposed.select("auto_key", "kind", "name"), rows)
    albums = out["albums"].select(F.lit("albums").alias("name"), F.col("auto_key").alias("key"), F.concat_ws("|", "kind", "name", "cover_id", "outcome").alias("what"))
    return albums.unionByName(out["items"].select(F.lit("items").alias("name"), F.col("auto_key").alias("key"), F.concat_ws("|", "media_id", "position").alias("what")))


ORGANISED = f"""{CTE}, lib as (select * from items where {LIB}), {BUCKETS},
 n as (select kind, key, kind || ':' || case when kind = 'year' then key else {SLUG} end as auto_key, min(id) as cover from b where kind in ('year', 'camera') group by kind, key having count(*) >= 2),
 o as (select auto_key from n where kind = 'year' and key::int % 2 = 0)
 select 'albums' as name, auto_key as key, concat_ws('|', case when kind = 'year' then 'album' else 'smart' end, key, cover, case when auto_key in (select auto_key from o) then 'updated' else 'created' end) as what from n
 union all select 'albums', 'year:1900', 'album|1900|-5|kept'
 union all select 'items', auto_key, concat_ws('|', id, id) from b join n using (kind, key) where kind = 'year' union all select 'items', 'year:1900', '-1|0'"""


def _album_ids(s, d):
    """Members of a fixed album, of a smart one, and of a smart one whose rules are broken."""
    fixed = R.album_ids({"id": "src7", "kind": "album"}, _fixed(s, d), items(s, d), 30)
    smart = R.album_ids({"id": "x", "kind": "smart", "rules_json": json.dumps(RULES)}, _fixed(s, d), items(s, d))
    broken = R.album_ids({"id": "y", "kind": "smart", "rules_json": "{broken"}, _fixed(s, d), items(s, d), 25)
    parts = [df.select(F.lit(n).alias("name"), "id") for n, df in (("fixed", fixed), ("smart", smart), ("broken", broken))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_MATCH = f"{LIB} and strftime(taken_at, '%Y') = '2006' and camera_make ilike '%a%' and people_count >= 0 and suggested_tags ilike '%sea%'"
ALBUM_IDS = f"""{CTE}, fixed as (select id from media where disc_id = 'src7' order by case when id % 4 > 0 then id % 90 end nulls last, id limit 30),
 smart as (select id from items where {_MATCH} order by taken_at desc nulls last, created_at desc, id limit 2000), broken as (select id from items where {LIB} order by taken_at desc nulls last, created_at desc, id limit 25)
 select 'fixed' as name, id from fixed union all select 'smart', id from smart union all select 'broken', id from broken"""

QUERIES = {
    "sk2_edits": (_edited, EDITED),
    "sk6_trash_batch": (_trashed, TRASHED),
    "sk7_promotion": (_promoted, PROMOTED),
    "sk10_albums_and_items": (_organised, ORGANISED),
    "sk17_sweep": (_swept, SWEPT),
    "du4_resolved_groups": (_resolved(True), resolved_sql(True)),
    "du4_rejected_groups": (_resolved(False), resolved_sql(False)),
    "og5_album_ids": (_album_ids, ALBUM_IDS),
}
