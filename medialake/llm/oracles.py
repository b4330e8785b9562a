"""SQL for the queries that SQL can express, as DuckDB runs it on whole tables."""

#: A-Z to lower case and nothing else.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""with recursive w as (select doc_id, list_filter(regexp_split_to_array({LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
 s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w),
 n as (select doc_id, count(*) as n from s group by 1),
 p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
 e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
 edges as (select a, b from e union all select b, a from e),
 r as (select doc_id, doc_id as root from w union select edges.b, r.root from r join edges on edges.a = r.doc_id where r.root < edges.b)
select w.doc_id, coalesce(n.n, 0) as n_shingles, m.root as component_id from w left join n using (doc_id) join (select doc_id, min(root) as root from r group by 1) m using (doc_id)"""

CONTAMINATION = rf"""with d as (select doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
 i as (select item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
 v as (select distinct item_id, least(13, len(w)) as size, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') as g from (select *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as k from i where len(w) > 0)),
 g as (select doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') as g from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as k from d, (select distinct size from v) where len(w) >= size)),
 h as (select distinct doc_id, v.size, k, item_id from g join v on g.g = v.g and g.size = v.size),
 hit as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(k, k + size)) as pos from h) group by 1),
 who as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from h group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
 coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from d left join hit using (doc_id) left join who using (doc_id)"""

WARC = """with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as hex from pages),
 f as (select *, min(page_id) over (partition by hex) as first from p)
select page_id, cast(strlen(h) as bigint) as payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::int >> (15 - 5 * (i % 4))) & 31 as int), 1)), '') as payload_digest,
 case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from f"""

DIVERGENCE = r"""with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from (select row_number() over () as doc_id, * exclude (doc_id) from documents)),
 w as (select lang, source, doc_id, unnest(w) as term from d),
 kept as (select lang, term, count(*)::hugeint as n from w group by all having count(distinct doc_id) >= 10),
 v as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from kept group by lang),
 groups as (select distinct lang, source from d),
 c as (select w.lang, w.source, term, count(*)::hugeint as n from w join kept using (lang, term) group by all),
 s as (select lang, source, sum(n)::hugeint as total from c group by all),
 p as (select lang, source, term, coalesce(c.n, 0) as n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * v.v) as p, 1 + (1000000000 * (kept.n + 2)) // (v.total + 2 * v.v) as q
  from groups join kept using (lang) join v using (lang) left join c using (lang, source, term) left join s using (lang, source)),
 f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b using (lang, term) where a.source <> b.source group by all),
 pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
 terms as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from p where n > 0 and p > q),
 r as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank::int as rank from r where part = 'pair' or rank <= 10"""


def vector_codes(parts: int = 8, width: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Plain Lloyd rounds as a chain of tables: every part against every entry."""
    floor_mean = "(s - ((s % n) + n) % n) // n"
    said = [
        f"""with e as (select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 x as (select vec_id, label, j, v[j * {width} + 1 : j * {width} + {width}] as x from e, (select unnest(range({parts})) as j)),
 b0 as (select j, row_number() over (partition by j order by vec_id) - 1 as k, x as c from x qualify k < {entries})"""
    ]
    for r in range(rounds + 1):
        said.append(
            f"""a{r} as (select vec_id, label, j, x, arg_min(k, struct_pack(d, k)) as k, min(d) as d from (
  select vec_id, label, j, x, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from x join b{r} using (j)) group by all)"""
        )
        if r < rounds:
            said.append(
                f"""b{r + 1} as (select b.j, b.k, coalesce(m.c, b.c) as c from b{r} b left join (select j, k, list({floor_mean} order by i) as c from (
  select j, k, i, sum(x[i + 1])::hugeint as s, count(*)::hugeint as n from a{r}, (select unnest(range({width})) as i) group by all) group by all) m using (j, k))"""
            )
    return ",\n ".join(said) + f""",
 h as (select sha256(string_agg(array_to_string(list_transform(c, lambda z: z::bigint::varchar), ','), ',' order by j, k)) as h from b{rounds}),
 codes as (select vec_id, label, string_agg(printf('%02x', k), '' order by j) as code, sum(d)::bigint as error from a{rounds} group by all)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, h as codebooks_sha256 from codes, h"""


SQL = {
    "op3_ngram_jaccard_join": JACCARD,
    "op7_benchmark_decontamination": CONTAMINATION,
    "op10_warc": WARC,
    "op12_source_divergence": DIVERGENCE,
    "op13_vector_codes": vector_codes(),
}
