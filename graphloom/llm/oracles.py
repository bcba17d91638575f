"""DuckDB SQL for the queries that SQL can express.

The others need a tokenizer, a language model, XXH64 or iterated scoring; the
tests hold them against brute force.
"""

from __future__ import annotations

import string

from .conversation_repair import GONE, INSERT, SYSTEM, USER, edits
from .url_filter import LISTED_WORDS, RULES
from .vector_codes import ROUNDS

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase

#: Base32 of a SHA-1: its 40 hexadecimal digits as four numbers of 40 bits, each of eight signs.
OP4 = """with p as (select page_id, coalesce(html, '') as html from pages),
h as (select page_id, html, strlen(html)::bigint as n, sha1(html) as x from p),
b as (select *, list_transform([1, 11, 21, 31], lambda i: ('0x' || x[i:i + 9])::bigint) as parts from h),
d as (select *, array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([35, 30, 25, 20, 15, 10, 5, 0],
  lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> s) & 31) + 1]), '')), '') as digest from b),
m as (select *, max(page_id) over (partition by html) as latest from d)
select page_id, n as payload_bytes, digest as payload_digest,
  case when page_id = latest then 'response' else 'revisit' end as record_type,
  case when page_id = latest then null else latest end as refers_to from m"""

OP5 = rf"""with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
iw as materialized (select distinct item_id, least(len(w), 10) as n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') as k
  from i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(p) where len(w) > 0),
sizes as materialized (select distinct n from iw),
dw as (select doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') as k from d, sizes, unnest(range(1, len(w) - n + 2)) t(p) where len(w) >= n),
m as materialized (select dw.doc_id, dw.p, dw.n, iw.item_id from dw join iw on iw.n = dw.n and iw.k = dw.k),
hit as (select doc_id, count(distinct x) as n_hit from m, unnest(range(p, p + n)) t(x) group by doc_id),
who as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from m group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join hit on hit.doc_id = d.doc_id left join who on who.doc_id = d.doc_id"""


def op6() -> str:
    fits = lambda host, path: f"((host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}'))"  # noqa: E731
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda of: "case " + " ".join(f"when {fits(h, p)} then '{of(v, h, p)}'" for v, h, p in rules) + " end"  # noqa: E731
    words = ", ".join(f"'{w}'" for w in LISTED_WORDS)
    return f"""with r as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
u as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from r),
j as (select *, {case(lambda v, h, p: h + p)} as rule, {case(lambda v, h, p: v)} as said,
  len(list_filter(string_split(host, '.')[:-2], lambda x: list_has_any(string_split(x, '-'), [{words}]))) > 0 as listed from u)
select page_id, host, path, rule, coalesce(said, case when listed then 'block' else 'allow' end) as verdict, listed from j"""


OP10 = r"""with l as (select doc_id, i as place, string_split(text, chr(10))[i] as line from documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(i)),
w as (select *, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: case when regexp_matches(x, '[0-9]') then '<*>' else x end) as w from l),
d as materialized (select line, any_value(w) as w, min(doc_id) as first, max(doc_id) as last from w where len(w) > 0 group by line),
p as (select line, len(w) as n, w[1] as a, w[2] as b, i, w[i] as word from d, unnest(range(3, len(w) + 1)) t(i) where w[i] <> '<*>'),
f as materialized (select line, i, word, count(*) over (partition by n, a, b, i, word) as c from p),
q as (select line, list_sort(list(c)) as cs from f group by line),
k as (select f.line, count(*) - count(*) filter (where c > 1 and 2 * c >= cs[(len(cs) + 1) // 2]) as words,
  string_agg(i || ' ' || word, ' ' order by i) filter (where c > 1 and 2 * c >= cs[(len(cs) + 1) // 2]) as const from f join q on q.line = f.line group by f.line),
s as (select d.line, first, last, w, len(w) as n, coalesce(words, 0) as words, len(list_filter(w, lambda x: x = '<*>')) as fields, coalesce(const, '') as const from d left join k on k.line = d.line),
t as materialized (select line, first, last, case when 4 * words <= n and 2 * (words + fields) <= n then 't ' || n || ' ' || w[1] || ' ' || coalesce(w[2], '') || chr(10) || const else 'l ' || line end as key from s),
known as materialized (select key, min(first) as first from t group by key having min(first) < max(last)),
gone as materialized (select l.doc_id, l.place from l join t on t.line = l.line join known on known.key = t.key where l.doc_id > known.first),
kept as (select l.doc_id, count(g.place) as n_dropped, count(*) as n_lines, coalesce(string_agg(l.line, chr(10) order by l.place) filter (where g.place is null), '') as text
  from l left join gone g on g.doc_id = l.doc_id and g.place = l.place group by l.doc_id)
select d.doc_id, coalesce(k.n_lines, 0)::bigint as n_lines, coalesce(k.n_dropped, 0)::bigint as n_dropped, case when d.text is not null then k.text end as text
from documents d left join kept k on k.doc_id = d.doc_id"""


def op12(rounds: int = ROUNDS) -> str:
    """The rounds one after another: every part against every entry, then the mean of each entry, floored."""
    ctes = [
        """e as (select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x)::bigint) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        "k as materialized (select row_number() over (order by vec_id nulls last, x) as n, * from e)",
        "p as materialized (select n, (i - 1) // (len(x) // 8) as part, (i - 1) % (len(x) // 8) as pos, x[i] as v from k, unnest(range(1, len(x) + 1)) t(i))",
        "b0 as materialized (select part, n - 1 as entry, pos, v from p where n <= 16)",
    ]
    for r in range(rounds + 1):
        ctes.append(f"d{r} as (select n, part, entry, sum((p.v - b.v) * (p.v - b.v))::bigint as d from p join b{r} b using (part, pos) group by n, part, entry)")
        ctes.append(f"a{r} as materialized (select n, part, min({{'d': d, 'e': entry}}) as a from d{r} group by n, part)")
        if r < rounds:
            ctes.append(f"s{r} as (select part, a.e as entry, pos, sum(v) as s, count(*) as c from p join a{r} using (n, part) group by part, a.e, pos)")
            ctes.append(f"b{r + 1} as materialized (select part, entry, pos, case when c is null then v else ((s - ((s % c) + c) % c) // c)::bigint end as v from b{r} left join s{r} using (part, entry, pos))")
    return f"""with {", ".join(ctes)},
f as (select n, string_agg(printf('%02x', a.e), '' order by part) as code, sum(a.d)::bigint as error from a{rounds} group by n)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
  (select sha256(string_agg(v::varchar, ',' order by part, entry, pos)) from b{rounds}) as codebooks_sha256 from k join f using (n)"""


def op13() -> str:
    """The same recursion over all conversations at once; CRC-32 bit by bit."""
    ways = ", ".join(f"({kind}, {p}, {q}, {cost}, '{letters}')" for kind, p, q, cost, letters in edits())
    bits = "list_reduce([xor(c, b) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda t, u: xor(t >> 1, 3988292384 * (t & 1)))"
    return rf"""with recursive c as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  xor(4294967295, list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint), lambda c, b: xor(c >> 8, {bits}))) % 20 as n from conversations),
d as (select conv_id, turn, case when n = 4 then 'user' else role end as role, case when n = 1 then '' when n = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from c, unnest(case when n = 3 then [1, 2] else [1] end) where n <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, role[1] as x from d),
f as (select *, not regexp_matches(text, '[^ 	-]') as blank, row_number() over (partition by conv_id, role, text order by i) > 1 as again,
  not regexp_matches(text, '[.!?][ 	-]*$') as open, lag(x) over (partition by conv_id order by i) || x not in ('su', 'ua', 'au') as wrong from o),
t as materialized (select *, dense_rank() over (order by conv_id) as k, case when blank or again then {GONE} else case x when 's' then 0 when 'u' then 1 when 'a' then 2 else 3 end + case when open then 4 else 0 end end as kind from f),
sizes as materialized (select k, any_value(conv_id) as conv_id, count(*) as n from t group by k),
ways(kind, p, q, cost, letters) as (values {ways}),
w as (select k, 0::bigint as i, 0 as q, 0::bigint as cost, '' as audit from sizes union all
  select k, i + 1, q, b.cost, b.audit from (select w.k, w.i, e.q, min({{'cost': w.cost + e.cost, 'audit': w.audit || e.letters}}) as b
    from w join t on t.k = w.k and t.i = w.i + 1 join ways e on e.kind = t.kind and e.p = w.q group by w.k, w.i, e.q)),
z as (select k, min({{'cost': cost + {INSERT} * (case q when {USER} then 1 when {SYSTEM} then 2 else 0 end), 'audit': audit || case q when {USER} then 'I' when {SYSTEM} then 'II' else '' end}}) as b
  from w join sizes using (k) where w.i = sizes.n group by k),
a as materialized (select k, b.cost as cost, b.audit as audit from z),
s as (select k, i, role, text, regexp_extract_all(audit, 'I*[DKR]')[i] as what from t join a using (k) union all select k, n + 1, '', '', regexp_extract(audit, 'I*$') from a join sizes using (k)),
l as (select k, i, j, role, text, what[j] as letter from s, unnest(range(1, len(what) + 1)) u(j) where what[j] <> 'D'),
m as (select *, row_number() over (partition by k order by i, j) as nth, count(*) over (partition by k) % 2 as odd from l),
h as (select k, sha256(string_agg(case when letter = 'K' then role when (nth - 1 + odd) % 2 = 0 then 'user' else 'assistant' end || ':' || case when letter = 'I' then '' else text end, chr(10) order by nth)) as sha from m group by k),
g as (select k, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, sum(blank::int) as blank, sum((not blank and again)::int) as duplicate,
  sum((not blank and not again and open)::int) as truncated, sum(coalesce(wrong, false)::int) as illegal from t group by k)
select v.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, coalesce(sha, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) v left join sizes on sizes.conv_id is not distinct from v.conv_id left join g using (k) left join a using (k) left join h using (k)"""


SQL: dict[str, str] = {"op4_warc": OP4, "op5_decontamination": OP5, "op6_url_filter": op6(), "op10_line_dedup": OP10, "op12_vector_codes": op12(), "op13_conversation_repair": op13()}
