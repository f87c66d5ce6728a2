"""DuckDB SQL of the training-data queries that SQL can express; plain text, written apart from the operators."""

from __future__ import annotations


def _resolved(name: str, source: str) -> str:
    """CTEs up to ``{name}_out`` (a, b): what the links of ``source`` (a, base, link) name, relative to their base."""
    return rf"""
{name}_q as (select *, substr(base, strpos(base, '://') + 3) as rest, regexp_extract(base, '^[^:]*:') as scheme, replace(link, '&amp;', '&') as href from ({source}) where contains(base, '://')),
{name}_d as (select *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
  regexp_extract(href, '^[^?#]*') as own, regexp_extract(href, '^[^?#]*(.*)$', 1) as tail from {name}_q),
{name}_p as (select *, string_split(substr(case when href like '/%' then own else regexp_extract(case path when '' then '/' else path end, '^.*/') || own end, 2), '/') as parts from {name}_d),
{name}_w as (select *, list_reduce(list_prepend('', parts), lambda done, x: case x when '..' then regexp_replace(done, '/[^/]*$', '') when '.' then done else done || '/' || x end)
    || case when parts[-1] in ('.', '..') then '/' else '' end as walked from {name}_p),
{name}_out as (select a, case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') then href
    when regexp_matches(href, '^([A-Za-z][A-Za-z0-9+.-]*:|#|$)') then null when href like '//%' then scheme || href
    when href like '?%' then scheme || '//' || host || path || href else scheme || '//' || host || walked || tail end as b from {name}_w),"""


URL_FILTER = r"""
with recursive u as (
  select distinct url, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages where url is not null),
s as (select url, contains(url, '://') as ok, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) as query from u),
c as (select url, 'https://' || host || regexp_replace(path, '/+$', '') || case when kept <> '' then '?' || kept else '' end as target
  from (select *, array_to_string(list_filter(string_split(query, '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)=')), '&') as kept from s where ok)),
t as (select url, regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>') as link_tag,
  regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>') as meta_tag,
  regexp_extract(html, '(?is)<base\b[^>]*\bhref\s*=[^>]*>') as base_tag from pages where url is not null),
h as (select url, regexp_extract(link_tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) as canonical,
  regexp_extract(meta_tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) as refresh, regexp_extract(base_tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) as base from t),
""" + _resolved("b", "select url as a, url as base, base as link from h where canonical <> '' or refresh <> ''") + r"""
l as (select h.url as a, coalesce(b_out.b, h.url) as base, unnest([canonical, refresh]) as link from h left join (select distinct a, b from b_out where b is not null) b_out on b_out.a = h.url),
""" + _resolved("k", "select * from l where link <> ''") + r"""
e as (select url as a, target as b from c union select a, b from k_out),
both_ways as (select a, b from e where b is not null and a <> b union select b, a from e where b is not null and a <> b),
reach as (select a as node, a as other from both_ways union select r.node, w.b from reach r join both_ways w on w.a = r.other),
groups as (select node, min(other) as root from reach group by 1),
nodes as (select url from u union select b from both_ways),
parts as (select url, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from nodes),
hp as (select url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts),
rules(action, h, p) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
best as (select hp.url, arg_max(r.action, (length(h || p), action = 'allow', h || p)) as action, arg_max(r.h || r.p, (length(h || p), action = 'allow', h || p)) as rule
  from hp join rules r on (hp.host = r.h or hp.host like '%.' || r.h) and starts_with(hp.path, r.p) group by 1),
spread as (select g.root, bool_or(b.action = 'allow') as allows from groups g join best b on b.url = g.node group by 1)
select p.page_id, coalesce(hp.host, '') as host, coalesce(hp.path, '') as path, b.rule,
  coalesce(b.action, case when s.allows then 'allow' when not s.allows then 'block' end, 'allow') as verdict
from pages p left join hp on hp.url = p.url left join best b on b.url = p.url left join groups g on g.node = p.url left join spread s on s.root = g.root"""

NGRAM_JOIN = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') as words from documents),
g as (select doc_id, case when len(words) >= 4 then list_distinct([array_to_string(words[i : i + 3], ' ') for i in range(1, len(words) - 2)]) when len(words) > 0 then ['short ' || array_to_string(words, ' ')] else [] end as shingles from w),
each as (select doc_id, len(shingles) as n, unnest(shingles) as shingle from g),
pairs as (select a.doc_id as a, b.doc_id as b from each a join each b on a.shingle = b.shingle and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges as (select a, b from pairs union select b, a from pairs),
reach as (select a as node, a as other from edges union select r.node, e.b from reach r join edges e on e.a = r.other),
groups as (select node, min(other) as component_id from reach group by 1)
select g.doc_id, len(g.shingles) as n_shingles, coalesce(c.component_id, g.doc_id) as component_id from g left join groups c on c.node = g.doc_id"""

FILTER_AUDIT = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
firsts as (select text, min(doc_id) as first from d group by 1),
l as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by 1),
w as (select d.*, coalesce(d.doc_id > f.first, false) as repeats, coalesce(l.good, false) as good, coalesce(l.toxic, false) as toxic,
    list_filter(string_split_regex(d.text, '[ \t\n\v\f\r]+'), lambda x: x <> '') as words
  from d join firsts f on f.text = d.text left join l on l.doc_id = d.doc_id),
m as (select part, good, toxic, case when len(words) < 200 then 'A' else '' end || case when 100 * len(list_distinct(words)) < 50 * len(words) then 'B' else '' end
    || case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) then 'C' else '' end
    || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end || case when repeats then 'E' else '' end as fails from w),
g as (select part, good, toxic, fails, count(*) as n from m group by all),
f(x) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
orders as (select a.x || b.x || c.x || d.x || e.x as filter_order from f a, f b, f c, f d, f e
  where a.x not in (b.x, c.x, d.x, e.x) and b.x not in (c.x, d.x, e.x) and c.x not in (d.x, e.x) and d.x <> e.x),
steps as (select filter_order, step, filter_order[step] as own, filter_order[1 : step - 1] as before from orders, range(1, 6) r(step)),
s as (select g.*, filter_order, cast(step as int) as step, own, contains(fails, own) as hit, length(translate(fails, before, '')) < length(fails) as earlier from g, steps),
r as (select part, filter_order, step, own, coalesce(sum(n) filter (not hit and not earlier), 0) as kept, coalesce(sum(n) filter (hit and not earlier), 0) as removed,
  coalesce(sum(n) filter (hit and earlier), 0) as redundant, coalesce(sum(n) filter (fails = own), 0) as unique_fails,
  coalesce(sum(n) filter (hit and not earlier and good), 0) as good_lost, coalesce(sum(n) filter (hit and not earlier and toxic), 0) as toxic_lost from s group by all)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from r"""
