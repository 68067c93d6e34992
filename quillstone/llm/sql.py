"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op8_exact_dedup"] = """
select doc_id, max(doc_id) over w as keep_id, cast(count(*) over w as bigint) as group_size, doc_id = max(doc_id) over w as kept,
  sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))"""

ORACLES["op4_warc"] = """
with p as (select page_id, cast(strlen(coalesce(html, '')) as bigint) as n, sha256(coalesce(html, '')) as d from pages),
r as (select *, min(page_id) over (partition by d) as f from p)
select page_id, n as payload_bytes, d as payload_digest, case when n >= 100 and page_id <> f then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id <> f then f end as refers_to from r"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES["op1_jaccard_join"] = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
g as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from g a join g b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)),
r as (select doc_id as x, doc_id as y from d union select r.x, l.y from r join l on l.x = r.y)
select doc_id, coalesce(n, 0) as n_shingles, component_id from d left join n using (doc_id) join (select x as doc_id, min(y) as component_id from r group by x) using (doc_id)"""

ORACLES["op6_quality"] = rf"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t, {_WORDS} as w from documents),
win as (select r, i, array_to_string(w[i:i + 4], ' ') as g from (select r, w, unnest(range(1, len(w) - 3)) as i from d where len(w) > 4)),
rep as (select r, i from win qualify count(*) over (partition by r, g) > 1),
cov as (select r, count(distinct i + k) as n from rep, range(0, 5) s(k) group by r),
every as (select r, source, t, unnest(string_split(t, chr(10))) as l, unnest(range(1, len(string_split(t, chr(10))) + 1)) as p from d),
lin as (select r, source, t, l, p, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) as n,
  regexp_replace(trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g') as norm
  from every where regexp_matches(l, '[^\x20\x09-\x0D]')),
dup as (select r, count(*) - count(distinct l) as n from lin group by r),
held as (select source, norm, count(distinct t) as c from lin group by 1, 2 having c > 6),
host as (select source, count(distinct t) as c from d group by 1),
common as (select held.source, norm from held join host on held.source is not distinct from host.source where held.c > 0.02 * host.c),
gone as (select r, p, n from lin join common h on lin.source is not distinct from h.source and lin.norm = h.norm),
lost as (select r, sum(n) as n from gone group by r),
rest as (select r, string_agg(l, chr(10) order by p) as k from every anti join gone using (r, p) group by r),
m as (select d.r, doc_id, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(dup.n, 0) as n_dup_lines, coalesce(cov.n, 0) as n_repeat_words, cast(coalesce(lost.n, 0) as bigint) as n_boilerplate_words, sha256(coalesce(rest.k, '')) as cleaned_sha256
  from d left join dup using (r) left join cov using (r) left join lost using (r) left join rest using (r)),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, n_words - n_boilerplate_words as remaining from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_boilerplate_words, cleaned_sha256,
  not base_failed and not (n_boilerplate_words > 0 and (remaining < 10 or remaining < 0.2 * n_words)) as kept from f"""

ORACLES["op9_substring_dedup"] = rf"""
with d as (select doc_id, {_WORDS} as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) > 49)),
gone as (select distinct doc_id, i + k as p from (select doc_id, i from win qualify min(doc_id) over (partition by g) < doc_id), range(0, 50) s(k)),
word as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d),
kept as (select doc_id, string_agg(x, ' ' order by p) as t, count(*) as n from word anti join gone using (doc_id, p) group by doc_id)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)"""

ORACLES["op10_mixing"] = rf"""
with recursive d as (select row_number() over () as r, doc_id, source, len({_WORDS}) as size, coalesce(cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 4) as integer), 0) as slot from documents),
s as (select source, sum(size) as total, row_number() over (order by encode(source) nulls last) - 1 as place from d group by source),
w as (select *, case place % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double as weight, 2.0::double * total as cap, 1.5::double * sum(total) over () as asked from s),
o as (select *, (asked - coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by cap / weight, place rows between current row and unbounded following) as level,
  row_number() over (order by cap / weight, place) as k from w),
v as (select coalesce(arg_min(level, k) filter (where level <= cap / weight), 1e300) as level from o),
t as (select source, place, cast(total as bigint) as total, least(cap, weight * v.level) as target from w, v),
h as (select place, size::double as z, count(*)::double as m from d join t on d.source is not distinct from t.source where size > 0 group by 1, 2),
q as (select place, sum(z * z * m) as q, min(z) as z from h group by 1),
b as (select t.place, total::double as total, target, q / total as scale, q / total / z as reach from t join q using (place) where target > 0 and target < 2.0 * total),
newton as (select place, total, target, scale, 0 as k, 0.0::double as x, case when target < total then -ln(total / target) * reach - 1 else 0.0 end as lo, case when target > total then ln(2.0) * reach else 0.0 end as hi from b
  union all
  select place, total, target, scale, k + 1, case when abs(gap) <= target * 1e-13 then x when x - gap / bent > lo and x - gap / bent < hi then x - gap / bent else (lo + hi) / 2 end, lo, hi from (
    select place, total, target, scale, k, x, gap, bent, case when gap < 0 then x else lo end as lo, case when gap > 0 then x else hi end as hi from (
      select n.place, total, target, scale, k, x, lo, hi, sum(z * m * least(2.0, exp(x * z / scale))) - target as gap, nullif(sum(case when exp(x * z / scale) < 2.0 then z * m * exp(x * z / scale) * z / scale else 0 end), 0) as bent
      from newton n join h on n.place = h.place where k < 60 group by n.place, total, target, scale, k, x, lo, hi))),
u as (select t.source, t.place, t.total, t.target, scale, x from t left join (select place, scale, x from newton where k = 60) using (place)),
y as (select u.source, size, count(*) as m, any_value(total) as total, any_value(target) as target, any_value(case when x is not null then least(2.0, exp(x * size / scale)) when total > 0 and target > 0 then 2.0 else 0.0 end) as rate
  from d join u on d.source is not distinct from u.source group by u.source, size),
a as (select *, coalesce(sum(rate * m) over (partition by source order by size rows between unbounded preceding and 1 preceding), 0) as base from y),
k as (select d.*, total, target, rate, base, row_number() over (partition by d.source, d.size order by slot, doc_id) as i from d join a on d.source is not distinct from a.source and d.size = a.size),
c as (select *, cast(least(floor(base + rate * i + 0.5) - floor(base + rate * (i - 1) + 0.5), ceil(rate)) as bigint) as copies from k),
m as (select *, target - sum(copies * size) over (partition by source) as miss from c),
e as (select *, size > 0 and ((miss > 0 and copies < ceil(rate)) or (miss < 0 and copies > floor(rate))) as may from m),
z as (select *, sum(case when may then size else 0 end) over (partition by source order by size, slot, doc_id rows unbounded preceding) as used from e),
f as (select *, copies + case when may and used <= abs(miss) then cast(sign(miss) as bigint) else 0 end as n from z)
select doc_id, size, total as source_size, target, n * size as taken, source, n as copies from f"""
