"""Duplicates: pairs, groups, the best of each, pruning and summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

from ..functions import hashes as H
from ..functions.vectors import hamming_hex
from ..operators import duplicates as D
from ..operators.catalog import active
from ..operators.graph import checkpoint_folder, joined
from .surrogate import CTE, media

ACTIVE = "coalesce(lifecycle, 'library') not in ('trash', 'rejected')"
#: Members of exact groups: group_id is the smallest id of a hash that several items share.
MEMBERS = f"""{CTE}, members as (select id as media_id, min(id) over (partition by sha256) as group_id from media qualify count(*) over (partition by sha256) > 1)"""
SCORE = f"""case when {ACTIVE} then (coalesce(width, 0) * coalesce(height, 0))::double * coalesce(quality_score, 0.5)
 * (case when coalesce(is_blurry, false) then (case when blur_score is null then 1.0::double else 0.4::double + least(1.6::double, greatest(0.0::double, blur_score) / 250.0::double) end) * 0.35::double
    else (case when blur_score is null then 1.0::double else 0.4::double + least(1.6::double, greatest(0.0::double, blur_score) / 250.0::double) end) end)
 * (case when coalesce(flag, false) then 0.85::double else 1.0::double end * (1.0::double + case when taken_at is not null then 0.12::double else 0.0::double end + case when coalesce(camera_make, '') <> '' then 0.06::double else 0.0::double end
    + case when gps_lat is not null then 0.05::double else 0.0::double end + 0.04::double * coalesce(rating, 0)))
 * case when coalesce(lifecycle, 'library') = 'library' then 1.0::double else 0.9::double end else -1.0::double end"""


def members(s, d):
    m = media(s, d)
    return D.groups(D.exact_edges(m))


def hashed(s, d):
    """Items with a hash whose first digits follow from their text's hash and whose last from their id: crowded ones."""
    tail = F.expr("substr('0123456789abcdef', cast(1 + id % 16 as int), 1)")
    return media(s, d).select("id", "sha256", F.concat(F.substring("sha256", 1, 2), F.lit("0f0f0f0f0f0f0"), tail).alias("phash"))


def revised(s, d):
    """Items with the SimHash of their whole text: near copies differ in few bits."""
    docs = s.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"), H.simhash(F.col("text")).alias("phash"))


HASHED = f"{CTE}, h as (select id, sha256, concat(substr(sha256, 1, 2), '0f0f0f0f0f0f0', substr('0123456789abcdef', cast(1 + id % 16 as int), 1)) as phash from media)"
CLASSES = f"{HASHED}, c as (select min(id) as id, phash from h group by phash)"
#: The SimHash of documents: hashes of runs of three words, each bit by majority.
REVISED = """with words as (select doc_id as id, sha256(text) as sha256, list_filter(regexp_split_to_array(text, '[\\x09-\\x0D\\x1C-\\x20\\x85\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda x: x <> '') as w from documents),
 runs as (select id, ('0x' || substr(md5(array_to_string(w[i:i + 2], ' ')), 1, 16))::ubigint as h from (select id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from words where len(w) > 0)),
 votes as (select id, k, 2 * sum((h >> (63 - k)) & 1) > count(*) as up from runs, (select unnest(range(64))::int as k) group by id, k),
 sims as (select id, lpad(lower(hex(sum(case when up then 1::ubigint << (63 - k) else 0 end)::ubigint)), 16, '0') as phash from votes group by id),
 h as (select id, sha256, phash from words left join sims using (id))"""
DISTANCE = "bit_count(xor(('0x' || a.phash)::ubigint, ('0x' || b.phash)::ubigint))"


def _keep(s, d):
    found = D.kept_best(members(s, d), media(s, d))
    return found.select("group_id", "media_id", F.round("score", 3).alias("score"), "rank", "keep")


def _selection(s, d):
    return D.covered(media(s, d).filter("id % 3 <> 0").select("id"), members(s, d), media(s, d))


def _cosine(s, d):
    v = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    return D.cosine_pairs(v, 0.35).withColumn("similarity", F.round("similarity", 5))


def _projected(s, d):
    """Pairs among all vectors and as many that lie near them: half-way shifts towards their mirror images."""
    v = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    moved = F.zip_with("v", F.reverse("v"), lambda x, y: x + y * (F.col("vec_id") % 5) / 10)
    both = v.select((F.col("vec_id") * 2).alias("id"), F.col("v").alias("embedding")).union(v.select((F.col("vec_id") * 2 + 1).alias("id"), moved.alias("embedding")))
    return D.projected_pairs(both, miss=1e-6, copies=True).select("a", "b", F.round("similarity", 5).alias("similarity"))


def _nested(s, d):
    told = F.transform("members", lambda x: F.concat_ws(":", x["media_id"], F.coalesce(x["lifecycle"], F.lit("-"))))
    return D.listed(members(s, d), media(s, d)).select("group_id", "page", F.array_join(told, ",").alias("members"))


def _hamming_components(s, d):
    return D.groups(D.near_edges(hashed(s, d), most=2))


def _by_arrival(s, d):
    """Groups of near and equal hashes, their edges arriving in three batches, the last ones first."""
    edges = D.near_edges(hashed(s, d), most=2)
    checkpoint_folder(s)
    labels = s.createDataFrame([], "id long, root long")
    for k in (2, 0, 1):
        labels = joined(labels, edges.filter(F.pmod(F.xxhash64("a", "b"), F.lit(3)) == k)).checkpoint()
    return labels.select(F.col("root").alias("group_id"), F.col("id").alias("media_id"))


def _staged(s, d):
    v = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    return D.staged(revised(s, d), v, least=0.35, vector_best=D.nearest_cosines).select("id", "stage", F.round("similarity", 5).alias("similarity"))


LETTERS = 32


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _pairs(texts: pd.Series) -> pd.Series:
    out = []
    for text in texts:
        codes = np.frombuffer((text or "").encode("utf-32-le"), "<u4").astype(np.int64) % LETTERS
        out.append(np.minimum(255, np.bincount(codes[:-1] * LETTERS + codes[1:], minlength=LETTERS**2)).astype(float))
    return pd.Series(out)


def _pictured(s, d):
    """Hashes of pictures of whole texts: how often each letter follows each other one."""
    drawn = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), _pairs("text").alias("pixels"))
    return drawn.select("id", H.picture_hashes(F.col("pixels"), F.lit(LETTERS)).alias("h")).select("id", "h.phash", "h.dhash")


#: Pictures of texts, their cosine transform, and their resampling to 9 x 8 by Lanczos's window.
PICTURES = """with codes as (select doc_id as id, list_transform(string_split(text, ''), lambda x: ord(x) % 32) as l from documents),
 px as (select id, a as y, b as x, least(255, count(*))::double as p from (select id, l[i] as a, l[i + 1] as b from (select id, l, unnest(range(1, len(l))) as i from codes)) group by all),
 u as (select unnest(range(8))::int as u), n as (select unnest(range(32))::int as n),
 c as (select u, n, cos(pi() * u * (2 * n + 1) / 64) as w from u, n),
 rowed as (select id, a.u, x, sum(p * w) as s from px join c a on a.n = y group by all),
 low as (select id, rowed.u, b.u as v, sum(s * w) as s from rowed join c b on b.n = x group by all),
 every as (select g.id, g.u, g.v, coalesce(s, 0) as s from (select d.id, a.u, b.u as v from codes d, u a, u b) g left join low on low.id = g.id and low.u = g.u and low.v = g.v),
 ph as (select id, lpad(lower(hex(sum(case when s > m then 1::ubigint << (63 - u * 8 - v) else 0 end)::ubigint)), 16, '0') as phash from (select *, median(s) over (partition by id) as m from every) group by id),
 lanczos as (select wanted, i, n, case when x = 0 then 1 when abs(x) < 3 then sin(pi() * x) / (pi() * x) * sin(pi() * x / 3) / (pi() * x / 3) else 0 end as w
  from (select wanted, i, n, (n + 0.5::double - (i + 0.5::double) * 32 / wanted) / (32::double / wanted) as x from n, (select 8 as wanted union all select 9), (select unnest(range(9))::int as i) where i < wanted)),
 r as (select wanted, i, n, w / sum(w) over (partition by wanted, i) as w from lanczos),
 across as (select id, y, i as x, greatest(0, least(255, floor(sum(p * w) + 0.5))) as p from px join r on wanted = 9 and n = x group by id, y, i),
 small as (select id, i as y, x, greatest(0, least(255, floor(sum(p * w) + 0.5))) as p from across join r on wanted = 8 and n = y group by id, i, x),
 dh as (select id, sum(case when b.p > a.p then 1::ubigint << (63 - a.y * 8 - a.x) else 0 end)::ubigint as d from small a join small b using (id, y) where b.x = a.x + 1 group by id)
select ph.id, phash, lpad(lower(hex(coalesce(d, 0))), 16, '0') as dhash from ph left join dh on dh.id = ph.id"""

COMPONENTS = f"""with recursive {HASHED[5:]}, k as (select distinct phash from h), p as (select a.phash as a, b.phash as b from k a join k b on a.phash <> b.phash where {DISTANCE} <= 2),
 r as (select phash, phash as top from k union select p.b, r.top from r join p on p.a = r.phash where r.top < p.b),
 t as (select phash, min(top) as top from r group by 1)
 select id as media_id, min(id) over (partition by top) as group_id from h join t using (phash) qualify count(*) over (partition by top) > 1"""

QUERIES = {
    "sf23_picture_hashes": (_pictured, PICTURES),
    "sf23_simhash": (lambda s, d: revised(s, d).select("id", "phash"), f"{REVISED} select id, phash from h"),
    "jn6_exact_dupes": (
        lambda s, d: D.exact_groups(media(s, d)), f"{CTE} select sha256, count(*) as n, min(id) as first_id from media group by 1 having count(*) > 1",
    ),
    "ag5_group_having": (
        lambda s, d: members(s, d).groupBy("group_id").count().filter("count >= 2").agg(F.count(F.lit(1)).alias("groups")), f"{MEMBERS} select count(distinct group_id) as groups from members",
    ),
    "du1_exact_members": (lambda s, d: members(s, d), f"{MEMBERS} select group_id, media_id from members"),
    "jn7_hamming_pairs": (
        lambda s, d: D.hamming_pairs(D.hash_classes(hashed(s, d)), most=3),
        f"{CLASSES} select a.id as a, b.id as b, cast({DISTANCE} as int) as distance from c a join c b on a.id < b.id where {DISTANCE} <= 3",
    ),
    "jn7_hamming_of_eight": (
        lambda s, d: D.hamming_pairs(D.hash_classes(revised(s, d))),
        f"{REVISED}, c as (select min(id) as id, phash from h group by phash) select a.id as a, b.id as b, cast({DISTANCE} as int) as distance from c a join c b on a.id < b.id where {DISTANCE} <= 8",
    ),
    "jn7_hash_members": (
        lambda s, d: hashed(s, d).join(D.hash_classes(hashed(s, d)).select("phash", F.col("id").alias("class_id")), "phash").select("id", "class_id"),
        f"{HASHED} select id, min(id) over (partition by phash) as class_id from h",
    ),
    "du1_staged": (
        _staged,
        f"""{REVISED}, n as (select vec_id as id, list_transform(embedding, lambda x: x::double) as v from embeddings), u as (select id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as norm from n),
 m as (select a.id, 1 as stage, 1.0::double as sim from h a join h b on a.sha256 = b.sha256 and a.id <> b.id
  union all select a.id, 2, 1 - {DISTANCE} / 64.0::double from h a join h b on a.id <> b.id where {DISTANCE} <= 8
  union all select a.id, 3, list_dot_product(a.v, b.v) / (a.norm * b.norm) from u a join u b on a.id <> b.id where list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.35),
 g as (select id, stage, max(sim) as sim from m group by id, stage), f as (select * from g qualify stage = min(stage) over (partition by id))
 select id, case stage when 1 then 'exact' when 2 then 'phash' else 'embedding' end as stage, round(sim, 5) as similarity from f""",
    ),
    "du5_keep_of_selection": (
        lambda s, d: D.kept_of_selection(media(s, d).filter("id % 3 <> 0").select("id"), members(s, d), media(s, d)),
        f"""{MEMBERS}, x as (select id as media_id, coalesce(group_id::varchar, 'adhoc') as set, {SCORE} as score from media left join members on media_id = id where id % 3 <> 0 and {ACTIVE}),
 r as (select *, count(*) over (partition by set) as n, row_number() over (partition by set order by score desc, media_id) as k from x)
 select media_id, set, case when k = 1 then 'accepted' else 'trashed' end as outcome from r where n > 1""",
    ),
    "du5_keep_of_all": (
        lambda s, d: D.kept_of_selection(members(s, d).select(F.col("media_id").alias("id")), members(s, d), media(s, d)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n")),
        f"""{MEMBERS}, x as (select group_id from members join media on media_id = id where {ACTIVE}), g as (select count(*) as n from x group by group_id having count(*) > 1),
 o as (select 'accepted' as outcome, count(*) as n from g union all select 'trashed', sum(n - 1)::bigint from g) select * from o where n > 0""",
    ),
    "du2_components": (_hamming_components, COMPONENTS),
    "du2_by_arrival": (_by_arrival, COMPONENTS),
    "jn8_cosine_pairs": (
        _cosine,
        """with n as (select vec_id as id, list_transform(embedding, lambda x: x::double) as v from embeddings), u as (select id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as norm from n)
 select a.id as a, b.id as b, round(list_dot_product(a.v, b.v) / (a.norm * b.norm), 5) as similarity from u a join u b on a.id < b.id
 where list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.35""",
    ),
    "jn8_projected_pairs": (
        _projected,
        """with n as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
 both_ as (select vec_id * 2 as id, v from n union all select vec_id * 2 + 1, list_transform(list_zip(v, list_reverse(v)), lambda z: z[1] + z[2] * (vec_id % 5) / 10) from n),
 u as (select id, v, sqrt(list_dot_product(v, v)) as norm from both_)
 select a.id as a, b.id as b, round(list_dot_product(a.v, b.v) / (a.norm * b.norm), 5) as similarity from u a join u b on a.id < b.id where list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.92""",
    ),
    "sf24_hamming": (
        lambda s, d: media(s, d).select("id", hamming_hex(F.substring("sha256", 1, 16), F.substring("sha256", 17, 16)).alias("distance"), hamming_hex(F.substring("sha256", 1, 8), F.substring("sha256", 1, 9)).alias("unequal")),
        f"{CTE} select id, cast(bit_count(xor(('0x' || substr(sha256, 1, 16))::ubigint, ('0x' || substr(sha256, 17, 16))::ubigint)) as int) as distance, 999 as unequal from media",
    ),
    "sf29_best_score": (
        lambda s, d: media(s, d).select("id", F.round(D.best_score(), 3).alias("score")), f"{CTE} select id, round({SCORE}, 3) as score from media",
    ),
    "ag16_best_member": (
        lambda s, d: D.best_members(members(s, d), media(s, d)),
        f"{MEMBERS}, x as (select *, {SCORE} as score from members join media on id = media_id) select group_id, arg_max(media_id, (score, -media_id)) as best_media_id, count(*) as n from x group by 1",
    ),
    "wi2_keep_best_rank": (
        _keep,
        f"""{MEMBERS}, x as (select group_id, media_id, {SCORE} as score from members join media on id = media_id),
 r as (select *, row_number() over (partition by group_id order by score desc, media_id) as rank from x) select group_id, media_id, round(score, 3) as score, rank, rank = 1 as keep from r""",
    ),
    "du4_keep_best": (
        lambda s, d: D.kept_best(members(s, d), media(s, d)).select("media_id", F.when(F.col("keep"), "accepted").otherwise("trashed").alias("outcome")),
        f"""{MEMBERS}, x as (select group_id, media_id, {SCORE} as score from members join media on id = media_id)
 select media_id, case when row_number() over (partition by group_id order by score desc, media_id) = 1 then 'accepted' else 'trashed' end as outcome from x""",
    ),
    "st2_superset": (
        _selection,
        f"""{MEMBERS}, live as (select group_id, media_id from members join media on id = media_id where {ACTIVE})
 select group_id, count(*) as live, count(*) filter (media_id % 3 <> 0) as selected, count(*) = count(*) filter (media_id % 3 <> 0) as covered from live group by 1""",
    ),
    "du6_prune": (
        lambda s, d: D.pruned(members(s, d), media(s, d)),
        f"{MEMBERS}, live as (select group_id, media_id from members join media on id = media_id where {ACTIVE}) select group_id, media_id from live qualify count(*) over (partition by group_id) > 1",
    ),
    "du7_nested_groups": (
        _nested,
        f"""{MEMBERS}, n as (select *, (row_number() over (partition by group_id order by media_id) - 1) // 1000 as page from members join media on media_id = id)
 select group_id, page, string_agg(media_id || ':' || coalesce(lifecycle, '-'), ',' order by media_id) as members from n group by 1, 2""",
    ),
    "ag7_dup_summary": (
        lambda s, d: D.summary(members(s, d), media(s, d)),
        f"""{MEMBERS}, r as (select group_id, media_id, file_size, {ACTIVE} as live from members join media on id = media_id),
 g as (select group_id, count(*) filter (live) as live, count(*) as n from r group by 1),
 h as (select count(*) as groups, count(*) filter (live > 1) as active_groups, sum(n)::bigint as members, sum(case when live > 1 then live - 1 else 0 end)::bigint as trashable from g)
 select h.*, (select count(*) from (select distinct media_id from r)) as unique_media, (select sum(file_size)::bigint from (select distinct media_id, file_size from r)) as bytes from h""",
    ),
    "fi22_alive_groups": (
        lambda s, d: members(s, d).join(media(s, d).filter(active(F.col("lifecycle"))).select(F.col("id").alias("media_id")), "media_id", "left_semi").groupBy("group_id").agg(F.count(F.lit(1)).alias("alive")).filter("alive >= 2"),
        f"{MEMBERS} select group_id, count(*) as alive from members join media on id = media_id where {ACTIVE} group by 1 having count(*) >= 2",
    ),
}
