"""SQL twins of the last three queries, for DuckDB; checksums are worked out byte by byte from a table."""

from __future__ import annotations

_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = f"translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}')"

#: The table of the CRC-32 checksum, and the checksum of a list of bytes.
_TABLE = "crc as (select list(list_reduce([k] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by k) t from range(256) r(k))"


def _crc32(data: str) -> str:
    return f"xor(list_reduce([4294967295] || {data}, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


_ASCII = "list_transform(string_split({}, ''), lambda x: unicode(x)::bigint)"
#: Letters above ASCII here are U+00C0 to U+00FF, whose two bytes are 195 and the code less 64.
_LATIN = "flatten(list_transform(string_split({}, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [195, unicode(x)::bigint - 64] end))"

OP11 = f"""
with {_TABLE},
d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w, {_crc32(_ASCII.format("doc_id::varchar"))} h from documents, crc),
a as (select *, len(w) n, case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) end a from d),
p as (select *, 1 + (n - a) // (3 + (h // 10) % 8) p from a),
t as (select doc_id, n, case when a is null then w else list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % p end]) end w from p),
g as (select doc_id, n, i, array_to_string(w[i + 1:i + 6], ' ') g from (select *, unnest(range(n - 5)) i from t where n >= 12)),
s as (select x.doc_id, x.i, y.i - x.i q from g x join g y on x.doc_id = y.doc_id and x.g = y.g and x.i < y.i where 2 * (y.i - x.i) <= x.n),
k as (select *, i - row_number() over (partition by doc_id, q order by i) island from s),
m as (select doc_id, q, min(i) a, count(*) + 5 + q size from k group by doc_id, q, island having count(*) + 5 >= q and count(*) + 5 + q >= 12),
r as (select doc_id, a, size, min(q) q from m group by all),
b as (select doc_id, count(*) n_runs, min((-size, a, q)) best, string_agg(a || ',' || size || ',' || q || chr(10), '' order by a, q) listed from r group by doc_id),
u as (select doc_id, i, w[i + 1] word from (select *, unnest(range(n)) i from t where doc_id in (select doc_id from r))),
v as (select doc_id, string_agg(word, ' ' order by i) kept from u where not exists (select 1 from r where r.doc_id = u.doc_id and i >= a + q and i < a + size) group by doc_id)
select t.doc_id, coalesce(n_runs, 0) n_runs, best[2] "start", -best[1] length, best[3] period, 1000 * -best[1] // best[3] exponent_milli, sha256(coalesce(listed, '')) runs_sha256,
  sha256(case when n_runs is null then array_to_string(w, ' ') else coalesce(kept, '') end) collapsed_sha256
from t left join b using (doc_id) left join v using (doc_id)
"""

OP12 = f"""
with recursive {_TABLE},
o as (select doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) w from documents),
c as (select doc_id, w, count(*) n from o group by all),
h as (select w, n, {_crc32(_LATIN.format("(doc_id || ':' || w)"))} h from c, crc),
e as (select case when h % 97 = 0 then w[1:(h % length(w))] || w[(h % length(w)) + 2:] else w end w, n from h),
v as (select w, sum(n)::bigint n from e group by w having length(w) >= 5 and sum(n) >= 3),
x as (select w, n, i, w[1:i] || w[i + 2:] cut from (select *, unnest(range(length(w))) i from v)),
p as (select a.w, b.w other, b.n from x a join x b on a.cut = b.cut and a.i = b.i and a.w <> b.w
      union select x.w, v.w, v.n from x join v on x.cut = v.w union select v.w, x.w, x.n from x join v on x.cut = v.w),
b as (select w, count(*) n_near, min((-n, other)) best from p group by w),
f as (select v.w word, v.n, coalesce(n_near, 0) n_near, case when -best[1] >= 2 * v.n then best[2] end form, case when -best[1] >= 2 * v.n then -best[1] end form_n from v left join b using (w)),
y as (select word, word "at", 0 step from f union all select y.word, f.form, step + 1 from y join f on f.word = y."at" where f.form is not null),
z as (select word, max_by("at", step) root from y group by word)
select f.word, form, root, n, n_near, form_n::bigint form_n from f join z using (word)
"""

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP13 = f"""
with d as (select doc_id, row_number() over () k, regexp_extract_all({_LOWER}, '{_WORDS}') w from documents),
b as (select item_id, regexp_extract_all({_LOWER}, '{_WORDS}') w from benchmark where item_id is not null),
g as (select distinct item_id, least(10, len(w)) size, array_to_string(w[i + 1:i + 10], ' ') g from (select *, unnest(range(greatest(1, len(w) - 9))) i from b where len(w) > 0)),
s as (select k, i, size, array_to_string(w[i + 1:i + size], ' ') g from (select k, w, size, unnest(range(len(w) - size + 1)) i from d, (select distinct size from g))),
m as (select k, i, item_id, size from s join g using (size, g)),
h as (select k, count(distinct j) n_hit from (select k, unnest(range(i, i + size)) j from m) group by k),
n as (select k, count(*) n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) items from (select distinct k, item_id from m) group by k)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join h using (k) left join n using (k)
"""
