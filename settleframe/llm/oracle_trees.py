"""DuckDB SQL of the conversation trie and the Merkle manifest. The contract's numbers are spelled here, not taken from the operators."""

from __future__ import annotations

_TABLE = """list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"""
_CRC = """xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(1, length(s) + 1), lambda i: cast(ascii(substr(s, i, 1)) as bigint))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""


def _crc_of(column: str, table: str) -> str:
    """(column, crc): the unsigned crc32 of the distinct integers as decimal text."""
    return f"""select {column}, {_CRC} as crc from (select distinct {column}, cast({column} as varchar) as s, {_TABLE} as t from {table} where {column} is not null)"""


PREFIX_TRIE = f"""
with raw as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
own as (select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role, sha256(strlen(role) || ':' || role || text)) as k from raw),
crc as ({_crc_of("conv_id", "own")}),
convs as (select conv_id, crc % 9 as h, conv_id - conv_id % 5 as base from crc),
given as (select c.conv_id, c.h, count(b.k) as m from convs c left join own b on b.conv_id = c.base and b.k <= c.h group by 1, 2),
rows_ as (select c.conv_id, b.k as d, b.role, b.text from convs c join own b on b.conv_id = c.base and b.k <= c.h
    union all select g.conv_id, g.m + o.k - g.h, o.role, o.text from given g join own o on o.conv_id = g.conv_id and o.k > g.h),
hashed as (select conv_id, d, strlen(text) as bytes, sha256(strlen(role) || ':' || role || text) as turn_hash from rows_),
prefixes as (select conv_id, d, bytes, sha256(string_agg(turn_hash, ',' order by d) over (partition by conv_id order by d rows between unbounded preceding and current row)) as key from hashed
    union all select conv_id, 0, 0, '' from convs),
named as (select conv_id, d, bytes, key, min(conv_id) over (partition by d, key) as node, count(*) over (partition by d, key) as n, d = max(d) over (partition by conv_id) as whole from prefixes),
ups as (select conv_id, d, lag(node) over (partition by conv_id order by d) as parent from named),
nodes as (select n.node, n.d, any_value(n.n) as n, any_value((n.n - 1)*n.bytes) as saved, any_value(u.parent) as parent,
    sha256(coalesce(string_agg(cast(n.conv_id as varchar), ',' order by n.conv_id) filter (n.whole), '')) as ends from named n join ups u using (conv_id, d) group by 1, 2),
kids as (select parent, d - 1 as d, count(*) as k from nodes where d > 0 group by 1, 2),
valued as (select n.*, coalesce(k.k, 0) as k from nodes n left join kids k on k.parent = n.node and k.d = n.d),
below as (select a.node, a.d, cast(count(*) filter (v.k = 0) as bigint) as leaves, cast(sum(v.saved) as bigint) as saved
    from valued v join named a on a.conv_id = v.node and a.d <= v.d group by 1, 2)
select v.node as conv_id, cast(v.d as bigint) as depth, v.parent as parent_conv_id, v.n as n_convs, v.k as n_children, b.leaves as n_leaves, b.saved as saved_tokens, v.ends as ends_sha256
from valued v join below b using (node, d)
"""

_UP = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LEVELS = 8  # 16**8 leaves in a tree


def _field(x: str) -> str:
    return f"coalesce(strlen(cast({x} as varchar)) || ':' || cast({x} as varchar), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _climb(name: str) -> str:
    """Levels of the tree in the table ``name``0 (tree, p, n, d), then of each place of level 0 the steps to the top."""
    out = []
    run = "partition by tree, p // 16 order by p rows between"
    for k in range(LEVELS):
        out.append(f"""{name}s{k} as (select *, coalesce(string_agg(d, '') over ({run} unbounded preceding and 1 preceding), '') as l,
            coalesce(string_agg(d, '') over ({run} 1 following and unbounded following), '') as r from {name}{k})""")
        out.append(f"""{name}{k + 1} as (select tree, p // 16 as p, (any_value(n) + 15) // 16 as n, case when any_value(n) = 1 then any_value(d) else sha256(string_agg(d, '' order by p)) end as d
            from {name}{k} group by 1, 2)""")
    joins = " ".join(f"join {name}s{k} x{k} on x{k}.tree = x0.tree and x{k}.p = x0.p // {16**k}" for k in range(1, LEVELS))
    lists = ", ".join(f"case when x{k}.n > 1 then [{{'l': x{k}.l, 'r': x{k}.r}}] else [] end" for k in range(LEVELS))
    out.append(f"{name}up as (select x0.tree, x0.p, flatten([{lists}]) as steps from {name}s0 x0 {joins})")
    return ",\n".join(out)


MERKLE = f"""
with crc as ({_crc_of("doc_id", "documents")}),
rows_ as (select d.doc_id, d.source, {_leaf("text")} as leaf, case when crc.crc % 5 = 0 then {_leaf(_UP.format("text"))} else {_leaf("text")} end as changed
    from documents d left join crc using (doc_id)),
trees as (select source, row_number() over (order by source nulls first) - 1 as tree from (select distinct source from rows_)),
placed as (select t.tree, r.*, row_number() over (partition by t.tree order by doc_id nulls first, leaf) - 1 as p, count(*) over (partition by t.tree) as n
    from rows_ r join trees t on r.source is not distinct from t.source),
a0 as (select tree, p, n, leaf as d from placed),
{_climb("a")},
b0 as (select 0 as tree, tree as p, count(*) over () as n, d from a{LEVELS}),
{_climb("b")},
proved as (select q.doc_id, q.leaf, q.changed, s.d as subroot, w.d as root, list_concat(u.steps, v.steps) as steps
    from placed q join aup u using (tree, p) join bup v on v.p = q.tree join b0 s on s.p = q.tree cross join b{LEVELS} w),
folded as (select *, list_reduce(list_prepend({{'l': '', 'r': changed}}, steps), lambda x, y: {{'l': '', 'r': sha256(y.l || x.r || y.r)}}).r as folded_root from proved)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s.l || s.r), '')) as proof_sha256, folded_root, folded_root = root as verified from folded
"""

TREES_SQL = {"op11_prefix_trie": PREFIX_TRIE, "op13_merkle": MERKLE}
