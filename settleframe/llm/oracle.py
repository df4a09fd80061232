"""DuckDB SQL of the operators that SQL can express: near-duplicates, WARC, URL rules, decontamination, mixing."""

from __future__ import annotations

from .mixing import BLOCKS, SEED, SHARDS  # choices of the operator that its result shows
from .oracle_trees import TREES_SQL

#: the contract's weights and limit, and URL rules; the globs are the operator's own judgement
WEIGHTS, MOST = (1, 2, 3), 3
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
BLOCKED = ("*.ads-*", "*.ads.*", "*.adserver*", "*.adult-*", "*.cheap-*", "*-pills.*", "*.casino*", "*.spam*")

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"

_NEAR_DUPS = rf"""
with recursive w as (select doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, {_SPACED}), []) as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) end as g from w),
e as (select doc_id, unnest(g) as x from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as n from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join s x on x.doc_id = a join s y on y.doc_id = b where 100*n >= 80*(len(x.g) + len(y.g) - n)),
both_ as (select a, b from l union all select b, a from l),
r(id, c) as (select doc_id, doc_id from s union select k.b, r.c from r join both_ k on k.a = r.id)
select s.doc_id, cast(len(g) as bigint) as n_shingles, m.c as component_id, s.doc_id = m.c as kept
from s join (select id, min(c) as c from r group by id) m on m.id = s.doc_id
"""

_CHAR = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {}) & 31) + 1, 1)"
_WARC = f"""
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as d from pages),
c as (select d, string_agg({" || ".join(_CHAR.format(k) for k in (15, 10, 5, 0))}, '' order by k) as b32
    from (select d, k, cast('0x' || substr(d, k*5 + 1, 5) as bigint) as v from (select distinct d from p), range(8) t(k)) group by d),
f as (select d, min(page_id) as head from p group by d)
select page_id, cast(strlen(h) as bigint) as payload_bytes, b32 as payload_digest, case when head is null or page_id = head then 'response'
    else 'revisit' end as record_type,
    case when page_id is null or page_id > head then head end as refers_to, true as intact
from p join c using (d) join f using (d)
"""


def _url_filter() -> str:
    rest = "case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end"
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    globs = " or ".join(f"full_ like '{g.replace('*', '%')}'" for g in BLOCKED)
    return f"""
with u as (select page_id, coalesce({rest}, '') as rest from pages),
hp as (select page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r as (select * from (values {rules}) v(verdict, rule_host, rule_path)),
m as (select page_id, host, path, '.' || host || '#' || path as full_, arg_max(rule_host || rule_path, len(rule_host || rule_path)) as rule,
    arg_max(verdict, len(rule_host || rule_path)) as said
    from hp left join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by 1, 2, 3)
select page_id, host, path, rule, coalesce(said, case when {globs} then 'block' else 'allow' end) as verdict from m
"""


_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_DECONTAMINATION = f"""
with i as (select cast(item_id as varchar) as item, regexp_extract_all({_LOWER.format("text")}, {_WORDS}) as ws from benchmark where text is not null),
n as (select item, ws, least(10, len(ws)) as n from i where len(ws) > 0),
p as (select distinct item, n, array_to_string(ws[k:k+n-1], ' ') as x from (select item, ws, n, unnest(range(1, len(ws) - n + 2)) as k from n)),
d as (select doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, {_WORDS}), []) as ws from documents),
g as (select doc_id, n, k, array_to_string(ws[k:k+n-1], ' ') as x from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as k from d,
    (select distinct n from n) where len(ws) >= n)),
h as (select g.doc_id, g.k, g.n, p.item from g join p on g.n = p.n and g.x = p.x),
hits as (select doc_id, count(distinct k + o) as c from h, range(10) t(o) where o < n group by 1),
items as (select doc_id, count(distinct item) as c, string_agg(distinct item, ',' order by item) as names from h group by 1)
select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(hits.c, 0) as n_hit, coalesce(items.c, 0) as n_items,
    sha256(coalesce(items.names, '')) as items_sha256, coalesce(hits.c, 0) > 0 as contaminated
from d left join hits using (doc_id) left join items using (doc_id)
"""


def _key(*parts: str) -> str:  # as mixing._key
    text = " || '|' || ".join(f"coalesce(cast({p} as varchar), '~')" for p in parts)
    return f"cast('0x' || substr(md5({text}), 1, 15) as bigint)"


def _tree() -> str:
    """The splitting tree: a table of units by level, each row with the shards from low up to high that are left to it."""
    levels = [f"u0 as (select source, block, pass, 0 as low, {SHARDS} as high from m, unnest(range(0, passes + case when more > 0 then 1 else 0 end)) t(pass) where words > 0)"]
    for k in range((SHARDS - 1).bit_length()):
        order = f"order by {_key(*("'split'", str(SEED), str(k), 'pass', 'block', 'source'))}, pass, block, source nulls last"
        ranked = f"select *, row_number() over (partition by low {order}) as rank, count(*) over (partition by low) as n, (low + high) // 2 as middle from u{k}"
        half = "rank <= n*(middle - low) // (high - low)"
        levels.append(f"u{k + 1} as (select source, block, pass, case when {half} then low else middle end as low, case when {half} then middle else high end as high from ({ranked}))")
    return ",\n".join(levels)


_LAST = f"u{(SHARDS - 1).bit_length()}"
_MIXING = f"""
with k as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, {_SPACED})), 0) as bigint) as size,
    {_key("'block'", "doc_id", "source")} as number from documents),
d as (select doc_id, source, size, number % {BLOCKS} as block, number // {BLOCKS} % {BLOCKS} as part from k),
b as (select source, block, cast(sum(size) as bigint) as words from d group by 1, 2),
s as (select source, cast(sum(words) as bigint) as source_size,
    [{", ".join(map(str, WEIGHTS))}][(row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1] as weight from b
    group by source),
o as (select *, sum(source_size) over () - {MOST}*coalesce(sum(source_size) over u, 0) as left_,
    sum(weight) over () - coalesce(sum(weight) over u, 0) as shared, row_number() over (order by source_size/weight, source nulls last) as k
    from s window u as (order by source_size/weight, source nulls last rows between unbounded preceding and 1 preceding)),
f as (select min(k) as k from o where weight*left_ <= {MOST}*source_size*shared),
t as (select o.source, o.source_size, case when f.k is null or o.k < f.k then cast({MOST}*o.source_size as double)
    else cast(o.weight*c.left_ as double)/cast(c.shared as double) end as target from o cross join f left join o c on c.k = f.k),
r as (select b.source, block, words, source_size, target, case when source_size > 0 then cast(round(target) as bigint) // source_size else 0 end as passes,
    coalesce(sum(words) over (partition by b.source order by {_key("'order'", "block", "b.source")}, block rows between unbounded preceding and 1 preceding), 0) as before
    from b join t on b.source is not distinct from t.source),
m as (select *, greatest(0, least(words, cast(round(target) as bigint) - passes*source_size - before)) as more from r),
{_tree()},
q as (select source, low as shard, count(*) as quota from {_LAST} group by 1, 2),
runs as (select source, shard, sum(quota) over (partition by source order by shard) as last, last - quota + 1 as first from q),
pu as (select source, block, pass, row_number() over (partition by source order by {_key("'unit'", str(SEED), "pass", "block", "source")}, pass, block) as unit from u0),
pl as (select pu.source, pu.block, list({{'pass': pu.pass, 'shard': runs.shard}} order by pu.pass) as units from pu
    join runs on pu.source is not distinct from runs.source and unit between first and last group by 1, 2),
w as (select d.source, d.block, d.part, cast(sum(size) as bigint) as part_words, any_value(more) as more from d
    join m on d.source is not distinct from m.source and d.block = m.block where more > 0 and more < words group by 1, 2, 3),
x as (select *, greatest(0, least(part_words, more - coalesce(sum(part_words) over (partition by source
    order by {_key("'part'", "part", "source")}, part rows between unbounded preceding and 1 preceding), 0))) as part_more from w),
j as (select d.doc_id, d.size, m.source_size, m.target, m.passes, coalesce(pl.units, []) as units,
    case when x.part is null then case when m.more > 0 then d.size else 0 end when part_more = 0 then 0 when part_more = part_words
        then d.size else greatest(0, least(d.size, part_more -
    coalesce(sum(d.size) over (partition by d.source, d.block, d.part order by {_key("'document'", "d.doc_id", "d.source")}, d.doc_id,
        d.size rows between unbounded preceding and 1 preceding), 0))) end as again
    from d join m on d.source is not distinct from m.source and d.block = m.block left join pl on d.source is not distinct from pl.source and d.block = pl.block
    left join x on d.source is not distinct from x.source and d.block = x.block and d.part = x.part),
g as (select *, list_filter(list_transform(units,
    lambda u: {{'pass': u.pass, 'shard': u.shard, 'words': case when u.pass < passes then size else again end}}),
    lambda u: u.words > 0) as given from j)
select doc_id, size, source_size, target, cast(coalesce(list_sum(list_transform(given, lambda u: u.words)), 0) as bigint) as taken,
    array_to_string(list_transform(given, lambda u: u.pass || ':' || u.shard || ':' || u.words), ',') as placed from g
"""

ORACLE_SQL = {"op1_near_dups": _NEAR_DUPS, "op3_warc": _WARC, "op5_url_filter": _url_filter(), "op8_decontamination": _DECONTAMINATION, "op9_mixing": _MIXING}
ORACLE_SQL |= TREES_SQL
