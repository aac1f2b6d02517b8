"""DuckDB SQL for the operators that SQL can express; production parameters are taken from the operators."""

from __future__ import annotations

from quillgraph.llm import decontamination, lines, sharding

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE_WORDS = r"'[^\x20\x09-\x0D]+'"

LINES = f"""
with d as (select row_number() over () as rid, doc_id, source, text, string_split(text, chr(10)) as ls from documents),
h as (select source, count(*) as pages from d group by 1),
e as (select rid, doc_id, source, unnest(ls) as x, generate_subscripts(ls, 1) as i from d),
c as (select source, trim(x) as line, count(distinct rid) as n from e where trim(x) <> '' group by 1, 2),
b as (select c.source, line from c join h on h.source is not distinct from c.source where n > {lines.RATIO} * pages and n >= {lines.LEAST}),
k as (select rid, count(*) as n_lines, count(b.line) as n_dropped, coalesce(string_agg(x, chr(10) order by i) filter (b.line is null), '') as t from e left join b on b.source is not distinct from e.source and b.line = trim(x) group by 1)
select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_dropped, 0) as n_dropped, md5(coalesce(t, '')) as kept_md5 from d left join k using (rid)"""

DECONTAMINATION = rf"""
with dw as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
it as (select distinct item_id, least({decontamination.WINDOW}, len(w)) as n, array_to_string(w[i : i + least({decontamination.WINDOW}, len(w)) - 1], ' ') as s from (select item_id, w, unnest(range(1, greatest(1, len(w) - {decontamination.WINDOW} + 1) + 1)) as i from iw where len(w) > 0)),
ns as (select distinct n from it),
g as (select rid, i, n, array_to_string(w[i : i + n - 1], ' ') as s from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from dw cross join ns where len(w) >= n)),
m as (select rid, i, g.n, item_id from g join it on it.n = g.n and it.s = g.s),
hit as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from m) group by 1),
its as (select rid, count(k) as n_items, string_agg(k, ',' order by k) as ks from (select distinct rid, cast(item_id as varchar) as k from m) group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ks, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from dw left join hit using (rid) left join its using (rid)"""

WARC = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as x from pages),
r as (select x, max(page_id) as top from p group by 1),
b as (select page_id, payload_bytes, top, array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([32768, 1024, 32, 1], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(x, cast(g * 5 + 1 as bigint), 5) as bigint) // s) % 32 + 1 as bigint), 1)), '')), '') as d from p join r using (x))
select page_id, payload_bytes, d as payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to from b"""

QUALITY = rf"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), {SPACE_WORDS}) as w from documents),
g as (select rid, i, array_to_string(w[i : i + 4], ' ') as s from (select rid, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)),
rep as (select rid, unnest(range(i, i + 5)) as p from (select rid, i, count(*) over (partition by rid, s) as n from g) where n > 1),
rw as (select rid, count(distinct p) as n from rep group by 1),
ln as (select rid, count(*) - count(distinct x) as n from (select rid, unnest(string_split(t, chr(10))) as x from d) where regexp_matches(x, '[^\x20\x09-\x0D]') group by 1),
f as (select d.rid, doc_id, source, len(w) as n_words, coalesce(length(array_to_string(w, '')), 0) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(ln.n, 0) as n_dup_lines, coalesce(rw.n, 0) as n_repeat_words from d left join rw using (rid) left join ln using (rid)),
j as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from f),
h as (select source, count(*) as n, count(*) filter (base_failed) as k from j group by 1),
pr as (select avg(k / n) as m, coalesce(var_pop(k / n), 0) as v from h),
st as (select m, case when v * 10001 <= m * (1 - m) then 10000 else greatest(10, m * (1 - m) / v - 1) end as s from pr),
ok as (select source, (k + m * s) / (n + s) <= 0.5 as host_kept from h cross join st)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and host_kept as kept from j join ok on ok.source is not distinct from j.source"""

_P = sharding.PRIME
SHARDING = f"""
with recursive tab as (select list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: case when c % 2 = 1 then xor(3988292384, c // 2) else c // 2 end, i)) as crc),
c as (select doc_id, strlen(coalesce(text, '')) + 8 as size, case when coalesce(text, '') = '' then 0 else xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: cast('0x' || b as bigint)), lambda a, b: xor(a // 256, crc[cast(xor(a % 256, b) + 1 as bigint)]), 4294967295)) end as text_crc32 from documents cross join tab),
b as (select *, (((coalesce(doc_id, 0) % {_P}) * 48271 + size % {_P}) % {_P} * 48271 + text_crc32 % {_P}) % {_P} % (select greatest({sharding.BUCKETS}, cast(ceil(count(*) / {sharding.BUCKET_ROWS}.0) as bigint)) from documents) as bucket from c),
n as (select *, row_number() over (order by bucket, doc_id nulls first, size, text_crc32) - 1 as number, count(*) over () as total, cast(ceil(sqrt(count(*) over ())) as bigint) as side from b),
w as (select number, total, side, number // side as l, number % side as r, 0 as k from n
 union all
 select number, total, side, case when k = 6 then l else r end, case when k = 6 then r else (l + ((({sharding.round_keys(20240229, 6)}[k + 1] + r) % {_P}) * (({sharding.round_keys(20240229, 6)}[k + 1] + r) % {_P}) % {_P}) * (({sharding.round_keys(20240229, 6)}[k + 1] + r) % {_P}) % {_P}) % side end, case when k = 6 then 0 else k + 1 end from w where k < 6 or l * side + r >= total)
select doc_id, size, cast(text_crc32 as bigint) as text_crc32, 'rows' as law, cast((l * w.side + r) % 24 as integer) as shard, (l * w.side + r) // 24 as slot, cast(null as integer) as grown_shard from w join n using (number) where k = 6 and l * w.side + r < w.total"""

ORACLE_SQL = {"op2_lines": LINES, "op3_decontamination": DECONTAMINATION, "op4_warc": WARC, "op8_quality": QUALITY, "op9_sharding": SHARDING}
