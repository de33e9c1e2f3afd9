"""DuckDB SQL of the text queries that SQL can express."""

from __future__ import annotations

LINE_DEDUP = """with docs as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
lines as (select r, doc_id, unnest(ls) as line, unnest(range(len(ls))) as i from docs),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
frequent as (select key from (select distinct r, key from keyed) where key <> '' group by key having count(*) >= 10),
marked as (select k.*, f.key is not null as gone from keyed k left join frequent f using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from marked group by r, doc_id"""

# What windows of 50 units cover, from rows (r, i) of the windows that an earlier document has.
_ISLANDS = """ends as (select r, i, max(i) over (partition by r order by i rows between unbounded preceding and 1 preceding) + 50 as before from hit),
numbered as (select r, i, sum(case when before is null or i > before then 1 else 0 end) over (partition by r order by i) as k from ends),
islands as (select r, k, min(i) as a, max(i) + 50 as b from numbered group by r, k),
gaps as (select r, k, coalesce(lag(b) over (partition by r order by k), 0) as a, a as b from islands),
tails as (select r, max(k) + 1 as k, max(b) as a from islands group by r)"""

SUFFIX_DEDUP = f"""with docs as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
windows as (select r, doc_id, i, substr(h, 2 * i + 1, 100) as w from (select r, doc_id, h, unnest(range(greatest(length(h) // 2 - 49, 0))) as i from docs)),
first as (select w, min(doc_id) as m from windows group by w),
hit as (select r, i from windows join first using (w) where m < doc_id),
{_ISLANDS},
kept as (select r, string_agg(part, '' order by k) as h from (
  select r, k, substr(h, 2 * a + 1, 2 * (b - a)) as part from gaps join docs using (r) union all select r, k, substr(h, 2 * a + 1) from tails join docs using (r)) group by r),
sums as (select r, sum(b - a) as removed, count(*) as n from islands group by r)
select doc_id, length(docs.h) // 2 as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, coalesce(n, 0) as n_spans, sha256(unhex(coalesce(kept.h, docs.h))) as kept_sha256
from docs left join sums using (r) left join kept using (r)"""

SUBSTRING_DEDUP = rf"""with docs as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
windows as (select r, doc_id, i, array_to_string(list_slice(ws, i + 1, i + 50), ' ') as w from (select r, doc_id, ws, unnest(range(greatest(len(ws) - 49, 0))) as i from docs)),
first as (select w, min(doc_id) as m from windows group by w),
hit as (select r, i from windows join first using (w) where m < doc_id),
{_ISLANDS},
parts as (select r, k, list_slice(ws, a + 1, b) as part from gaps join docs using (r) union all select r, k, list_slice(ws, a + 1, len(ws)) from tails join docs using (r)),
kept as (select r, flatten(list(part order by k)) as ws from parts group by r),
sums as (select r, sum(b - a) as removed from islands group by r)
select doc_id, len(docs.ws) as n_words, cast(coalesce(removed, 0) as bigint) as n_removed, sha256(coalesce(array_to_string(coalesce(kept.ws, docs.ws), ' '), '')) as kept_sha256
from docs left join sums using (r) left join kept using (r)"""

NEAREST = """with v as (select vec_id, embedding::double[] as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
n as (select row_number() over () as rid, vec_id, e, len(e) as d, sqrt(list_inner_product(e, e)) as norm from v),
s as (select q.rid, q.vec_id as query_id, c.vec_id, list_inner_product(c.e, q.e) / (q.norm * c.norm) as score from n q join n c on q.d = c.d and q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by rid order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": LINE_DEDUP, "op8_suffix_dedup": SUFFIX_DEDUP, "op9_nearest_neighbours": NEAREST, "op10_substring_dedup": SUBSTRING_DEDUP}
