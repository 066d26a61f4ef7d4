"""SQL of another engine for the queries that SQL can express on whole tables, written from their contracts."""

WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"

OP5 = """
with t as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
win as (select doc_id, s, md5(substr(x, 2 * s + 1, 200)) as h from t, unnest(range(0, greatest(len(x) // 2 - 99, 0))) u(s)),
head as (select h, min(doc_id::hugeint * 1000000000 + s) as f from win group by 1),
bad as (select win.doc_id, win.s from win join head using (h) where win.doc_id::hugeint * 1000000000 + win.s > f),
edge as (select doc_id, s as i, 1 as d from bad union all select doc_id, s + 100, -1 from bad),
byte as (select doc_id, unnest(l) as b, generate_subscripts(l, 1) - 1 as i from (select doc_id, regexp_extract_all(x, '..') as l from t)),
cell as (select doc_id, i, b, coalesce(e.d, 0) as d from byte left join (select doc_id, i, sum(d) as d from edge group by 1, 2) e using (doc_id, i)),
mark as (select doc_id, i, b, sum(d) over (partition by doc_id order by i) > 0 as gone from cell),
span as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as opens from mark),
done as (select doc_id, count(*) as n, count(*) filter (gone) as r, count(*) filter (opens) as o, coalesce(string_agg(b, '' order by i) filter (not gone), '') as k from span group by 1)
select t.doc_id, coalesce(n, 0) as n_bytes, coalesce(r, 0) as n_removed, coalesce(o, 0) as n_spans, sha256(unhex(coalesce(k, ''))) as kept_sha256 from t left join done using (doc_id)
"""

OP7 = """
with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
good as (select vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from e
         where label is not null and vec_id is not null and v is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
link as (select a.vec_id as x, b.vec_id as y from good a join good b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
         and list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] / a.n * (b.v[i] / b.n))) >= 0.98),
reach as (with recursive r(a, b) as (select vec_id, vec_id from e union select r.a, l.y from r join link l on l.x = r.b) select a, min(b) as c from r group by 1)
select vec_id, (select count(*) from link where x = vec_id) as n_links, c as component_id, vec_id = c as kept from e join reach on a = vec_id
"""

OP8 = f"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
sh as (select distinct doc_id, array_to_string(ws[i : i + 2], ' ') as g from d, unnest(range(1, len(ws) - 1)) u(i) where len(ws) >= 3
       union select doc_id, array_to_string(ws, ' ') from d where len(ws) between 1 and 2),
n as (select doc_id, count(*) as n from sh group by 1),
met as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
half as (select x, y from met join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
link as (select x, y from half union all select y, x from half),
reach as (with recursive r(a, b) as (select doc_id, doc_id from d union select r.a, l.y from r join link l on l.x = r.b) select a, min(b) as c from r group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c as component_id, d.doc_id = c as kept from d left join n using (doc_id) join reach on a = d.doc_id
"""

OP9 = f"""
with t as (select doc_id, {WORDS} as ws from documents),
win as (select doc_id, s, md5(array_to_string(ws[s : s + 49], ' ')) as h from t, unnest(range(1, greatest(len(ws) - 48, 1))) u(s)),
head as (select h, min(doc_id) as f from win group by 1),
bad as (select win.doc_id, win.s from win join head using (h) where f < win.doc_id),
edge as (select doc_id, i, sum(d) as d from (select doc_id, s as i, 1 as d from bad union all select doc_id, s + 50, -1 from bad) group by 1, 2),
cell as (select c.doc_id, c.i, w, coalesce(e.d, 0) as d from (select doc_id, i, ws[i] as w from t, unnest(range(1, len(ws) + 1)) u(i)) c left join edge e on e.doc_id = c.doc_id and e.i = c.i),
mark as (select doc_id, i, w, sum(d) over (partition by doc_id order by i) > 0 as gone from cell),
done as (select doc_id, count(*) as n, count(*) filter (gone) as r, string_agg(w, ' ' order by i) filter (not gone) as k from mark group by 1)
select t.doc_id, coalesce(n, 0) as n_words, coalesce(r, 0) as n_removed, sha256(coalesce(k, '')) as kept_sha256 from t left join done using (doc_id)
"""
