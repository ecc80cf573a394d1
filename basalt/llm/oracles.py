"""SQL for DuckDB of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

OP1 = f"""
with w as (select doc_id, coalesce({_WORDS.format(text='text')}, []) as ws from documents),
p as (select doc_id, i, array_to_string(ws[i:i + 49], ' ') as win from w, lateral (select unnest(range(1, len(ws) - 48)) as i)),
f as (select win, min(doc_id) as least from p group by win),
hit as (select distinct doc_id, i from p join f using (win) where least < doc_id),
gone as (select distinct doc_id, i + k as pos from hit, (select unnest(range(0, 50)) as k)),
each as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as pos from w),
kept as (select doc_id, string_agg(word, ' ' order by pos) as t from each anti join gone using (doc_id, pos) group by doc_id),
cut as (select doc_id, count(*) as n from gone group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(cut.n, 0) as bigint) as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256
from w left join kept using (doc_id) left join cut using (doc_id)"""

OP5 = """
with b as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
p as (select doc_id, i, md5(substring(h, 2 * i - 1, 400)) as win from b, lateral (select unnest(range(1, length(h) // 2 - 198)) as i)),
r as (select win from p group by win having count(*) > 1),
hit as (select doc_id, i from p semi join r using (win)),
runs as (select doc_id, i, coalesce(i - lag(i) over (partition by doc_id order by i) > 200, true) as fresh from hit),
numbered as (select doc_id, i, sum(fresh::int) over (partition by doc_id order by i) as k from runs),
spans as (select doc_id, k, min(i) as a, max(i) + 199 as z from numbered group by doc_id, k),
kept as (select b.doc_id, string_agg(substring(h, 2 * g.a - 1, 2 * (g.z - g.a + 1)), '' order by g.a) as t
    from b join (select doc_id, lag(z, 1, 0) over (partition by doc_id order by a) + 1 as a, a - 1 as z from spans
                 union all select doc_id, max(z) + 1, 1 << 30 from spans group by doc_id) g using (doc_id) where g.z >= g.a group by b.doc_id),
cut as (select doc_id, sum(z - a + 1) as n, count(*) as spans from spans group by doc_id)
select b.doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(cut.n, 0) as bigint) as n_removed, cast(coalesce(cut.spans, 0) as bigint) as n_spans,
    sha256(unhex(case when cut.n is null then h else coalesce(kept.t, '') end)) as kept_sha256
from b left join kept using (doc_id) left join cut using (doc_id)"""

OP8 = f"""
with recursive w as (select doc_id, coalesce({_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, []) as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 90 * (x.n + y.n - shared)),
e as (select a, b from l union select b, a from l),
r(doc_id, c) as (select doc_id, doc_id from w union select e.b, r.c from r join e on e.a = r.doc_id)
select w.doc_id, coalesce(n.n, 0) as n_shingles, min(r.c) as component_id from w left join n using (doc_id) join r using (doc_id) group by w.doc_id, n.n"""
