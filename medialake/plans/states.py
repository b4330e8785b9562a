"""Commands on tables, jobs and ingest states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import commands as K, jobs as J
from ..sources.archives import accepted_members
from ..streaming import attempts as A
from .copies import MEMBERS, members
from .surrogate import CTE, NOW, analysis, media


def now():
    return F.lit(NOW).cast("timestamp")


def jobs(s, d):
    """Jobs made of orders: status by order status, age by key, a worker alive for some."""
    o = s.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey")
    status = F.expr("case o_orderstatus when 'O' then 'queued' when 'F' then 'running' else 'interrupted' end")
    at = lambda minutes: F.timestamp_seconds(F.unix_timestamp(now()) - minutes * 60)
    return o.select(
        k.alias("id"), F.col("o_orderpriority").alias("job_type"), status.alias("status"), F.when(k % 5 == 0, "Cancelling now").alias("message"), F.lit(None).cast("string").alias("error"),
        at(k % 30).alias("created_at"), F.when(k % 2 == 0, at(k % 25)).alias("started_at"), (k % 4 == 0).alias("is_live"), (k % 30).alias("age"),
    )


JOBS = """with jobs as (select o_orderkey as id, o_orderpriority as job_type, case o_orderstatus when 'O' then 'queued' when 'F' then 'running' else 'interrupted' end as status,
 o_orderkey % 5 = 0 as cancelling, o_orderkey % 30 as age, case when o_orderkey % 2 = 0 then o_orderkey % 25 else o_orderkey % 30 end as run_age, o_orderkey % 4 = 0 as is_live from orders)"""


def _patched(s, d):
    m = media(s, d)
    edits = m.filter("id % 3 = 0").select("id", (F.col("id") % 11 - 3).cast("int").alias("rating"), F.when(F.col("id") % 2 == 0, True).alias("flag"), F.when(F.col("id") % 9 == 0, "new").alias("caption"))
    return K.patched(m, edits).select("id", "rating", "flag", "hitl_status", "human_edited")


def _trashed(s, d):
    m = media(s, d)
    return K.trashed(m, m.filter("id % 4 = 1").select("id"), now()).groupBy("lifecycle").agg(F.count(F.lit(1)).alias("n"), F.count("deleted_at").alias("stamped"))


def _restored(s, d):
    m = media(s, d)
    return K.restored(m, m.filter("id % 4 <> 1").select("id")).groupBy("lifecycle").agg(F.count(F.lit(1)).alias("n"))


def _purged(s, d):
    m, mem = media(s, d), members(s, d)
    groups = mem.groupBy("group_id").agg(F.min("media_id").alias("best_media_id"))
    out = K.purged({"media": m, "analysis": analysis(s, d), "members": mem, "groups": groups}, m.filter("id % 3 = 0").select("id"))
    count = lambda name: out[name].agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
    return count("media").unionByName(count("analysis")).unionByName(count("members")).unionByName(count("groups")).unionByName(
        out["groups"].agg(F.lit("best").alias("name"), F.count("best_media_id").alias("n"))
    )


def _reviewed(s, d):
    m = media(s, d)
    queue = m.filter("hitl_status = 'pending'").select("id", (F.col("id") % 300).alias("priority"), F.lit(None).cast("string").alias("resolution"), F.lit(True).alias("open"))
    said = F.expr("case id % 4 when 0 then 'accepted' when 1 then 'rejected' when 2 then 'deferred' end")
    return K.reviewed(queue, m.filter("id % 4 <> 3").select("id", said.alias("resolution"), (F.col("id") % 8 == 0).alias("edits")))


def _failures(s, d):
    """Failed attempts are an event type; items are users."""
    e = s.read.parquet(f"{d}/events.parquet").filter("value < 20").select(F.col("user_id").alias("id"))
    return J.parked(e, 20)


def _reaped(s, d):
    return J.reaped(jobs(s, d), now()).select("id", "was", "status", "reaped")


def _cancelled(s, d):
    j = jobs(s, d)
    return J.cancelled(j, j.filter("id % 3 = 0").select("id", (F.col("id") % 2 + 1).alias("times"))).select("id", "status", "outcome")


def _archive_members(s, d):
    """Members of archives (sources) named by documents: what an expansion would take, under caps."""
    m = media(s, d).select(F.col("disc_id").alias("archive"), F.col("original_path").alias("member"), F.col("file_size").alias("size"), F.col("id").alias("pos"))
    return accepted_members(m, most_files=40, most_bytes=30_000_000).select("archive", "pos", "size")


def _resume(s, d):
    """Files of a second scan whose content isn't in the library yet."""
    m = media(s, d)
    known = m.filter("lifecycle = 'library'").select("sha256")
    return m.filter("lifecycle = 'staging'").join(known, "sha256", "left_anti").select("id")


QUERIES = {
    "sk2_patch": (
        _patched,
        f"""{CTE} select id, case when id % 3 = 0 then cast(least(5, greatest(0, id % 11 - 3)) as int) else rating end as rating, case when id % 3 = 0 and id % 2 = 0 then true else flag end as flag,
 case when id % 9 = 0 then 'edited' else hitl_status end as hitl_status, id % 9 = 0 as human_edited from media""",
    ),
    "sk3_soft_delete": (
        _trashed,
        f"""{CTE}, t as (select case when id % 4 = 1 then 'trash' else lifecycle end as lifecycle, id % 4 = 1 and coalesce(lifecycle, 'library') <> 'trash' as hit from media)
 select lifecycle, count(*) as n, count(*) filter (hit) as stamped from t group by 1""",
    ),
    "sk4_restore": (
        _restored, f"{CTE} select case when id % 4 <> 1 and lifecycle = 'trash' then 'library' else lifecycle end as lifecycle, count(*) as n from media group by 1",
    ),
    "sk5_cascade": (
        _purged,
        f"""{MEMBERS}, kept as (select * from members where media_id % 3 <> 0), g as (select group_id, min(media_id) as best from members group by 1 having group_id in (select group_id from kept))
 select 'media' as name, count(*) as n from media where id % 3 <> 0 union all select 'analysis', count(*) from analysis where media_id % 3 <> 0 union all select 'members', count(*) from kept
 union all select 'groups', count(*) from g union all select 'best', count(*) from g where best % 3 <> 0""",
    ),
    "sk7_promoted_names": (
        lambda s, d: K.promoted(media(s, d)),
        f"""{CTE} select id, case when row_number() over (partition by disc_id, filename order by id) > 1 then left(lpad(id::varchar, 8, '0'), 8) || '_' || filename else filename end as library_name from media""",
    ),
    "sk16_review": (
        _reviewed,
        f"""{CTE}, q as (select id, id % 300 as p, case id % 4 when 0 then case when id % 8 = 0 then 'edited' else 'accepted' end when 1 then 'rejected' end as r, id % 4 = 2 as deferred from media where hitl_status = 'pending')
 select id, case when deferred then greatest(p, 200) else p end as priority, r as resolution, r is null as open from q""",
    ),
    "sk17_accept_all": (
        lambda s, d: K.accepted_all(media(s, d)).groupBy("hitl_status").agg(F.count(F.lit(1)).alias("n")), f"{CTE} select 'accepted' as hitl_status, count(*) as n from media",
    ),
    "sr5_failures": (
        _failures, "select user_id as id, count(*) as attempts, case when count(*) >= 20 then 'error' else 'retry' end as state from events where value < 20 group by 1",
    ),
    "sr5_attempts": (
        lambda s, d: J.attempts_of(s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("id"), (F.col("value") >= 60).alias("ok"), F.col("ts").alias("at"), F.col("event_id").alias("pos")), 5),
        """with e as (select *, sum((value >= 60)::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from events),
 r as (select user_id, run, count(*) filter (value < 60) as f from e group by all)
 select user_id as id, cast(case when max(f) >= 5 then 5 else arg_max(f, run) end as int) as attempts, case when max(f) >= 5 then 'error' when arg_max(f, run) > 0 then 'retry' else 'done' end as state from r group by 1""",
    ),
    "wi1_event_sessions_by_time": (
        lambda s, d: A.sessions(s.read.parquet(f"{d}/events.parquet"), "12 hours").select("user_id", "n", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last")),
        """with e as (select *, case when ts - lag(ts) over (partition by user_id order by ts) >= interval 12 hour then 1 else 0 end as new from events),
 g as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from e)
 select user_id, count(*) as n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last from g group by user_id, s""",
    ),
    "sr8_resume": (
        _resume, f"{CTE} select id from media where lifecycle = 'staging' and sha256 not in (select sha256 from media where lifecycle = 'library')",
    ),
    "sr11_reaper": (
        _reaped,
        f"""{JOBS}, o as (select *, not is_live and ((status = 'queued' and age >= 10) or (status = 'running' and run_age >= 15)) as reaped from jobs)
 select id, status as was, case when reaped and cancelling then 'cancelled' when reaped then 'interrupted' else status end as status, reaped from o""",
    ),
    "sr12_cancel": (
        _cancelled,
        f"""{JOBS}, a as (select *, case when id % 3 = 0 then id % 2 + 1 else 0 end as asked from jobs),
 b as (select *, (status = 'queued' and asked > 0) or (status = 'running' and (asked > 1 or (asked > 0 and not is_live))) as done from a)
 select id, case when done then 'cancelled' else status end as status, case when status not in ('queued', 'running') and asked > 0 then 'refused' when done then 'cancelled' when asked > 0 then 'cancelling' else 'untouched' end as outcome from b""",
    ),
    "sr13_recovery_choice": (
        lambda s, d: J.recovery(jobs(s, d).filter("not (job_type like '1%' and status <> 'interrupted')")),
        f"""{JOBS}, j as (select * from jobs where not (job_type like '1%' and status <> 'interrupted'))
 select job_type, arg_max(id, (-age, id)) as id from j where status = 'interrupted' and job_type not in (select job_type from j where status in ('queued', 'running')) group by 1""",
    ),
    "fi26_active_jobs": (
        lambda s, d: jobs(s, d).filter(F.col("status").isin("queued", "running")).groupBy("job_type").agg(F.count(F.lit(1)).alias("n")),
        f"{JOBS} select job_type, count(*) as n from jobs where status in ('queued', 'running') group by 1",
    ),
    "or7_newest_jobs": (
        lambda s, d: jobs(s, d).orderBy("age", "id").limit(200).select("id", "status"), f"{JOBS} select id, status from jobs order by age, id limit 200",
    ),
    "ag19_throughput": (
        lambda s, d: J.throughput(media(s, d).groupBy("disc_id").agg(F.count(F.lit(1)).alias("done"), (F.max("created_s") - F.min("created_s")).alias("elapsed_s"))).select("disc_id", "done", F.round("per_hour", 4).alias("per_hour")),
        f"""{CTE}, p as (select disc_id, count(*) as done, max(created_s) - min(created_s) as e from media group by 1) select disc_id, done, round(case when e > 0 then done * 3600.0::double / e else 0.0 end, 4)::double as per_hour from p""",
    ),
    "sc8_archive_members": (
        _archive_members,
        f"""{CTE}, m as (select disc_id as archive, id as pos, file_size as size, row_number() over w as k, sum(file_size) over w as total from media
  where lower(regexp_extract(original_path, '(\\.[^./]+)$', 1)) in ('.jpg', '.jpeg', '.tif', '.tiff', '.png', '.heic', '.heif', '.raw', '.cr2', '.nef', '.arw', '.dng', '.gif', '.webp', '.bmp', '.mp4', '.mov', '.avi', '.mkv', '.m4v', '.wmv', '.mpg', '.mpeg', '.3gp')
  window w as (partition by disc_id order by id rows unbounded preceding)) select archive, pos, size from m where k <= 40 and total <= 30000000""",
    ),
}
