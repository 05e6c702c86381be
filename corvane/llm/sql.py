"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality import LEAST_WORDS, LINE_LIMIT

#: The words of a text: runs without white space.
WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"


def words(t: str) -> str:
    return WORDS.format(t=t)


OP1 = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
w as (select doc_id, p, substr(h, 2 * p + 1, 200) as g from (select doc_id, h, unnest(range(0, n - 99)) as p from d)),
f as (select doc_id, p, row_number() over (partition by g order by doc_id, p) as k from w),
c as (select doc_id, p as s, coalesce(p > max(p) over (partition by doc_id order by p rows between unbounded preceding and 1 preceding) + 100, true) as new from f where k > 1),
i as (select doc_id, s, sum(new::int) over (partition by doc_id order by s) as i from c),
r as (select doc_id, min(s) as s, max(s) + 100 as e from i group by doc_id, i),
t as (select doc_id, count(*) as spans, sum(e - s) as gone from r group by doc_id),
cut as (select doc_id, coalesce(lag(e) over (partition by doc_id order by s), 0) as a, s as b from r union all select doc_id, max(e), max(n) from r join d using (doc_id) group by doc_id),
k as (select doc_id, string_agg(substr(h, (2 * a + 1)::bigint, (2 * (b - a))::bigint), '' order by a) as kept from cut join d using (doc_id) group by doc_id)
select doc_id, n::bigint as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from d left join t using (doc_id) left join k using (doc_id)"""

OP6 = rf"""with recursive t as (select doc_id, {words("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as g from t),
x as (select doc_id, unnest(g) as g from s),
l as (select a.doc_id as u, b.doc_id as v, count(*) as n from x a join x b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select u, v from l join s a on a.doc_id = u join s b on b.doc_id = v where 100 * n >= 75 * (len(a.g) + len(b.g) - n)),
r as (select u as doc_id, u as other from e union select r.doc_id, e.v from r join e on e.u = r.other)
select s.doc_id, len(g)::bigint as n_shingles, least(s.doc_id, coalesce(min(other), s.doc_id)) as component_id, s.doc_id <= coalesce(min(other), s.doc_id) as kept from s left join r using (doc_id) group by s.doc_id, g"""

OP7 = """with p as (select page_id, encode(coalesce(html, '')) as b from pages), m as (select b, max(page_id) as top from p where octet_length(b) >= 1000 group by b)
select page_id, octet_length(p.b)::bigint as payload_bytes, sha1(p.b) as payload_digest, case when top <> page_id then 'revisit' else 'response' end as record_type, case when top <> page_id then top end as refers_to from p left join m using (b)"""

OP9 = rf"""with t as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as t, {words("coalesce(text, '')")} as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from t)),
dup as (select doc_id, unnest(range(i, i + 8)) as p from (select doc_id, i, count(*) over (partition by doc_id, g) as n from win) where n > 1),
rep as (select doc_id, count(distinct p) as n_repeat_words from dup group by doc_id),
ln as (select doc_id, count(*) - count(distinct line) as n_dup_lines from (select doc_id, unnest(string_split(t, chr(10))) as line from t) where len({words('line')}) > 0 group by doc_id),
base as (select t.doc_id, host, t, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words from t left join rep using (doc_id) left join ln using (doc_id)),
doc as (select distinct host, t from base),
nl as (select host, t, i, array_to_string({words('line')}, ' ') as line, len({words('line')}) as n from (select host, t, lower(unnest(string_split(t, chr(10)))) as line, generate_subscripts(string_split(t, chr(10)), 1) as i from doc) where len({words('line')}) > 0),
common as (select host, line from nl group by host, line having count(distinct t) > {LINE_LIMIT}),
gone as (select host, t from nl left join (select host, line, 1 as common from common) c using (host, line) group by host, t having count(common) > 0 and coalesce(sum(n) filter (where common is null), 0) < {LEAST_WORDS})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and gone.t is null as kept from base left join gone using (host, t)"""

#: The remainders of the 256 bytes, by the polynomial of CRC-32.
CRC_TABLE = "list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(1, 9)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"

OP12 = f"""with recursive t as (select {CRC_TABLE} as t),
runs as (select doc_id, run, count(*) as c from (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) as run from documents) group by doc_id, run),
x as (select run, c, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as x from runs where length(run) >= 5),
b as (select run, c, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint) as b from x),
h as (select run, c, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda a, k: xor(a >> 8, t.t[(xor(a, k) & 255) + 1])), 4294967295) as h from b, t),
w as (select case when h % 97 = 0 then left(run, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, c from h),
v as (select word, sum(c)::bigint as n from w where length(word) >= 5 group by word having sum(c) >= 3),
d as (select word, n, i, left(word, i) || substr(word, i + 2) as k from (select word, n, unnest(range(0, length(word))) as i from v)),
p as (select a.word, b.word as other, b.n as m from d a join d b on a.k = b.k and a.i = b.i and a.word <> b.word union select d.word, v.word, v.n from d join v on d.k = v.word union select v.word, d.word, d.n from d join v on d.k = v.word),
f as (select word, count(*) as n_near, first(other order by m desc, other) as other, max(m) as m from p group by word),
o as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when m >= 2 * v.n then other end as form, case when m >= 2 * v.n then m end as form_n from v left join f using (word)),
r as (select word, word as root, 0 as steps from o union all select r.word, o.form, steps + 1 from r join o on o.word = r.root where o.form is not null)
select o.word, form, arg_max(r.root, r.steps) as root, n, n_near, form_n from o join r using (word) group by all"""

ORACLES: dict[str, str] = {"op1_suffix_dedup": OP1, "op6_minhash": OP6, "op7_warc": OP7, "op9_quality_rules": OP9, "op12_spelling": OP12}
