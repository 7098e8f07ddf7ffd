"""SQL of queries that a database can answer at small sizes by comparing everything with everything."""

TOP_K = r"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(cast(x as double) * 1024)) as v from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, d.vec_id, cast(list_dot_product(q.v, d.v) as bigint) as score from v q join v d on q.vec_id != d.vec_id and len(q.v) = len(d.v) where q.vec_id % 100 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s)
select * from r where rank <= 10
"""

JACCARD = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) end) as shingle from w),
n as (select doc_id, count(*) as n from s group by 1),
o as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from o join n p on p.doc_id = x join n q on q.doc_id = y where 100 * k >= 80 * (p.n + q.n - k)),
b as (select x, y from e union all select y, x from e),
c as (select doc_id, doc_id as c from documents union select b.x, c.c from c join b on b.y = c.doc_id)
select d.doc_id, coalesce(any_value(n), 0) as n_shingles, min(c) as component_id from documents d left join n using (doc_id) left join c using (doc_id) group by 1
"""
