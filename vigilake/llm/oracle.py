"""DuckDB SQL for the operators whose results SQL can express (4, 5, 6, 8, 11 and 13)."""

from __future__ import annotations

OP4 = """
with recursive v as (
    select vec_id, embedding::double[] as e from embeddings
    where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where list_cosine_similarity(a.e, b.e) >= 0.9),
r(n, m) as (select a, a from p union select r.n, p.b from r join p on r.m = p.a),
c as (select n, min(m) as component from r group by n),
l as (select a, count(*) as links from p group by a)
select vec_id, coalesce(links, 0) as n_links, coalesce(component, vec_id) as component_id, vec_id = coalesce(component, vec_id) as kept
from embeddings left join l on a = vec_id left join c on n = vec_id
"""

OP5 = """
with p as (select page_id, coalesce(html, '') as h from pages),
k as (select h, max(page_id) as keeper, count(*) as n from p where strlen(h) >= 1000 group by h)
select page_id, strlen(p.h) as payload_bytes, sha1(p.h) as payload_digest,
    case when n > 1 and page_id <> keeper then 'revisit' else 'response' end as record_type,
    case when n > 1 and page_id <> keeper then keeper end as refers_to
from p left join k on p.h = k.h
"""

_RAW = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)|<style\b.*?(?:</style|\z)|<title\b.*?(?:</title|\z)|<textarea\b.*?(?:</textarea|\z)"
_TAG = r"""(?is)<(?:link|meta)\b(?:[^"''>]|"[^"]*"|''[^'']*'')*>"""
_CANONICAL = r"""(?is)^<link\b.*[\s"''/]rel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|''(?:[^'']*\s)?canonical(?:\s[^'']*)?''|canonical[\s/>])"""
_REFRESH = r"""(?is)^<meta\b.*[\s"''/]http-equiv\s*=\s*["'']?refresh\b"""
_HREF = r"""(?is)[\s"''/]href\s*=\s*["'']?\s*([^"''\s>]+)"""
_CONTENT = r"""(?is)[\s"''/]content\s*=\s*["''][^"'']*?url\s*=\s*([^"''\s>]+)"""


def op6(rules: list[tuple[str, str, str]]) -> str:
    """rules: verdict, host, path; those given here never have equal lengths where more than one fits."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for _, h, p in ranked]
    rule = " ".join(f"when {f} then '{h}{p}'" for f, (_, h, p) in zip(fits, ranked, strict=True))
    verdict = " ".join(f"when {f} then '{v}'" for f, (v, _, _) in zip(fits, ranked, strict=True))
    return rf"""
with recursive t as (select split_part(url, '#', 1) as url, unnest(regexp_extract_all(regexp_replace(html, '{_RAW}', ' ', 'g'), '{_TAG}')) as t from pages where contains(url, '://')),
x as (select url as a, case when regexp_matches(t, '{_CANONICAL}') then regexp_extract(t, '{_HREF}', 1) else regexp_extract(t, '{_CONTENT}', 1) end as b
    from t where regexp_matches(t, '{_CANONICAL}') or regexp_matches(t, '{_REFRESH}')),
e as (select a, split_part(replace(b, '&amp;', '&'), '#', 1) as b from x),
s as (select a, b from e where contains(b, '://') and a <> b union select b, a from e where contains(b, '://') and a <> b),
r(n, m) as (select a, a from s union select r.n, s.b from r join s on r.m = s.a),
c as (select n, min(m) as component from r group by n),
u as (select url from pages union select n from c),
k as (select url, coalesce(regexp_extract(case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end, '(?s)^([^?#]*)', 1), '') as rest from u),
h as (select url, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, substr(rest, length(split_part(rest, '/', 1)) + 1) as path from k),
d as (select url, host, path, case {rule} end as rule, case {verdict} end as decision from h),
g as (select component, min(decision) as decision from c join d on d.url = c.n group by component)
select page_id, d.host, d.path, d.rule, coalesce(d.decision, g.decision, 'allow') as verdict, c.component as alias_of
from pages p join d on p.url is not distinct from d.url left join c on c.n = split_part(p.url, '#', 1) left join g on g.component = c.component
"""


OP8 = r"""
with t as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
    sum(24 + length(replace(replace(role, '\', '\\'), '<', '\<')) + length(replace(replace(text, '\', '\\'), '<', '\<')))::bigint as formatted_chars
from t group by conv_id
"""

OP11 = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
c as (select count(*)::bigint as n_docs, sum(len(t))::bigint as n_terms from d where len(t) > 0),
i as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
q as (select item_id, term, count(*)::bigint as times from i group by item_id, term),
e as (select r, doc_id, len(t)::bigint as n, unnest(t) as term from d),
p as (select r, doc_id, n, term, count(*)::bigint as tf from e where term in (select term from q) group by r, doc_id, n, term),
w as (select term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::bigint as w from p, c group by term, n_docs),
s as (select item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::bigint as score
    from p join w using (term) join q using (term), c group by item_id, r, doc_id)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id, r))::int as rank, doc_id, score from s where score > 0
qualify rank <= 10
"""

OP13 = """
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
g as (select r, doc_id, x, len(x) // 2 as n from d),
p as (select r, i, md5(substr(x, 2 * i::bigint + 1, 800)) as s from (select r, x, unnest(range(n - 399)) as i from g where n >= 400)),
f as (select r, i from p where s in (select s from p group by s having count(*) > 1)),
b as (select r, i, i - lag(i) over (partition by r order by i) as gap from f),
m as (select r, i, sum(case when gap is null or gap > 400 then 1 else 0 end) over (partition by r order by i) as k from b),
t as (select r, k, min(i) as a, max(i) + 400 as e from m group by r, k),
h as (select r, a, e, coalesce(lag(e) over (partition by r order by a), 0) as z from t),
j as (select h.r, count(*) as n_spans, sum(e - a) as n_removed, string_agg(substr(x, 2 * z::bigint + 1, 2 * (a - z)::bigint), '' order by a) || substr(any_value(x), 2 * max(e)::bigint + 1) as kept
    from h join g on g.r = h.r group by h.r)
select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, x))) as kept_sha256
from g left join j on j.r = g.r
"""
