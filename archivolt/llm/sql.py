"""DuckDB SQL for the operators that SQL can express over whole tables."""

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

NEAR_DEDUP = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, g from (
  select doc_id, case when len(w) < 5 then array_to_string(w, ' ') else unnest([array_to_string(w[i:i + 4], ' ') for i in generate_series(1, greatest(1, len(w) - 4))]) end g from w where len(w) >= 5
  union all select doc_id, array_to_string(w, ' ') from w where len(w) between 1 and 4) x),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
e as (select a, b from l union select b, a from l),
r as (select a, b from e union select r.a, e.b from r join e on e.a = r.b),
c as (select a, least(a, min(b)) c from r group by a)
select w.doc_id, coalesce(n.n, 0)::bigint n_shingles, coalesce(c.c, w.doc_id) component_id, coalesce(c.c, w.doc_id) = w.doc_id kept from w left join n on n.doc_id = w.doc_id left join c on c.a = w.doc_id"""

LINE_DEDUP = f"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i from documents),
k as (select *, {_LOW.format(f"trim(line, {_BLANKS})")} key from l),
gone as (select key from k where len(key) >= 1 group by key having count(distinct doc_id) >= 10),
m as (select k.*, gone.key is not null out from k left join gone on gone.key = k.key)
select doc_id, count(*)::bigint n_lines, count(*) filter (out)::bigint n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not out), '')) kept_sha256 from m group by doc_id"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DECONTAMINATE = f"""
with d as (select doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_WORD}') w from documents),
b as (select item_id, regexp_extract_all({_LOW.format("text")}, '{_WORD}') w from benchmark),
bw as (select item_id, least(10, len(w)) s, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') g from (select *, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) i from b where len(w) > 0) x),
dw as (select doc_id, i, s, array_to_string(w[i:i + s - 1], ' ') g from (select doc_id, w, s, unnest(generate_series(1, len(w) - s + 1)) i from d, (select distinct s from bw) t where len(w) >= s) x),
h as (select doc_id, i, dw.s, item_id from dw join bw on bw.s = dw.s and bw.g = dw.g),
hit as (select doc_id, count(distinct p)::bigint n from (select doc_id, unnest(generate_series(i, i + s - 1)) p from h) x group by all),
it as (select doc_id, count(*)::bigint n, string_agg(item_id::varchar, ',' order by item_id::varchar) x from (select distinct doc_id, item_id from h) y group by all)
select d.doc_id, len(w)::bigint n_words, coalesce(hit.n, 0) n_hit, coalesce(it.n, 0) n_items, sha256(coalesce(it.x, '')) items_sha256, coalesce(hit.n, 0) > 0 contaminated
from d left join hit on hit.doc_id = d.doc_id left join it on it.doc_id = d.doc_id"""

QUALITY_RULES = rf"""
with w as (select doc_id, lang, source, coalesce(text, '') text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
g as (select doc_id, i, count(*) over (partition by doc_id, g) n from (select doc_id, i, array_to_string(w[i:i + 2], ' ') g from (select doc_id, w, unnest(generate_series(1, len(w) - 2)) i from w where len(w) > 2) x) y),
rep as (select doc_id, count(distinct p)::bigint n from (select doc_id, unnest([i, i + 1, i + 2]) p from g where n >= 2) x group by all),
lines as (select doc_id, count(*)::bigint n, (count(*) - count(distinct line))::bigint dup from (select doc_id, unnest(string_split(text, chr(10))) line from w) x where regexp_matches(line, '[^\x20\x09-\x0D]') group by all),
m as (select w.doc_id, lang, source, len(w)::bigint n_words, coalesce(list_sum([len(x) for x in w]), 0)::bigint word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint n_symbols,
  coalesce(dup, 0) n_dup_lines, coalesce(lines.n, 0) n_lines, coalesce(rep.n, 0) n_repeat_words from w left join rep on rep.doc_id = w.doc_id left join lines on lines.doc_id = w.doc_id),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from m),
r as (select f.*, unnest(['symbol_rate', 'repeat_rate', 'dup_line_rate', 'word_length']) rate,
  unnest([(n_symbols + 1) / (word_chars + 2)::double, (n_repeat_words + 1) / (n_words + 2)::double, (n_dup_lines + 1) / (n_lines + 2)::double, word_chars / greatest(n_words, 1)::double]) x from f where not base_failed),
k as (select *, ceil(ln(x) / ln(1.02))::int bucket from r),
lev as (select 0 lev, lang, source, rate, bucket, count(*) n from k group by all union all select 1, lang, null, rate, bucket, count(*) from k group by all union all select 2, null, null, rate, bucket, count(*) from k group by all),
cum as (select *, sum(n) over (partition by lev, lang, source, rate order by bucket) upto, sum(n) over (partition by lev, lang, source, rate) total from lev),
q as (select lev, lang, source, rate, total::double n, min(bucket) filter (upto >= total * 0.25)::double q1, min(bucket) filter (upto >= total * 0.75)::double q3 from cum group by lev, lang, source, rate, total),
ql as (select l.lang, l.rate, (l.n * l.q1 + 25 * e.q1) / (l.n + 25) q1, (l.n * l.q3 + 25 * e.q3) / (l.n + 25) q3 from q l join q e on l.lev = 1 and e.lev = 2 and l.rate = e.rate),
qs as (select o.lang, o.source, o.rate, (o.n * o.q1 + 25 * l.q1) / (o.n + 25) q1, (o.n * o.q3 + 25 * l.q3) / (o.n + 25) q3 from q o join ql l on o.lev = 0 and o.lang is not distinct from l.lang and o.rate = l.rate),
over as (select doc_id, bool_or(bucket > q3 + 3 * (q3 - q1 + 1)) over_ from k join qs on qs.lang is not distinct from k.lang and qs.source is not distinct from k.source and qs.rate = k.rate group by all)
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce(over_, false) kept from f left join over on over.doc_id = f.doc_id"""

ORACLE: dict[str, str] = {"op4_near_dedup": NEAR_DEDUP, "op5_line_dedup": LINE_DEDUP, "op8_decontaminate": DECONTAMINATE, "op9_quality_rules": QUALITY_RULES}
