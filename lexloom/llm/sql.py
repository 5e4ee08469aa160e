"""DuckDB SQL of the queries on conversations and the manifest."""


def crc32(value: str) -> str:
    """CRC-32 of a short ASCII text, which DuckDB has no function for: bit by bit over its characters."""
    step = "lambda x, y: xor(x >> 1, 3988292384 * (x & 1))"
    byte = f"lambda a, b: list_reduce(list_prepend(xor(a, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), {step})"
    codes = f"list_transform(string_split(cast({value} as varchar), ''), lambda c: cast(ascii(c) as bigint))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), {byte}), 4294967295::bigint)"


MANIFEST = f"""
with recursive hashed as (
  select *, {crc32('doc_id')} % 7 = 0 as tampered,
         concat_ws('', coalesce(octet_length(encode(cast(doc_id as varchar))) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
                   coalesce(octet_length(encode(lang)) || ':' || lang, '-')) as head,
         coalesce(octet_length(encode(text)) || ':' || text, '-') as tail
  from documents
), leaves as (
  select doc_id, lang, sha256(head || coalesce(length(cast(n_chars as varchar)) || ':' || n_chars, '-') || tail) as h,
         sha256(head || coalesce(length(cast(n_chars + tampered::int as varchar)) || ':' || (n_chars + tampered::int), '-') || tail) as now
  from hashed
), placed as (
  select *, row_number() over (partition by lang order by doc_id nulls first, h) - 1 as rank, count(*) over (partition by lang) as n from leaves
), nodes as (
  select lang, 0 as level, rank, h, n from placed
  union all
  select lang, level + 1, rank // 2, sha256(string_agg(h, '' order by rank)), (n + 1) // 2 from nodes where n > 1 group by lang, level, rank // 2, n
), subroots as (
  select lang, h, row_number() over (order by lang nulls first) - 1 as rank, count(*) over () as n from nodes where n = 1
), tops as (
  select 0 as level, rank, h, n from subroots
  union all
  select level + 1, rank // 2, sha256(string_agg(h, '' order by rank)), (n + 1) // 2 from tops where n > 1 group by level, rank // 2, n
), steps as (
  select p.doc_id, p.h as leaf, p.now, r.h as subroot, s.level, s.rank, o.rank as other_rank, o.h as other, p.rank as leaf_rank
  from placed p join subroots r on p.lang is not distinct from r.lang
  join nodes s on s.lang is not distinct from p.lang and s.rank = p.rank >> s.level and s.n > 1
  left join nodes o on o.lang is not distinct from p.lang and o.level = s.level and o.rank = xor(s.rank, 1)
  union all
  select p.doc_id, p.h, p.now, r.h, 1000 + s.level, s.rank, o.rank, o.h, p.rank
  from placed p join subroots r on p.lang is not distinct from r.lang
  join tops s on s.rank = r.rank >> s.level and s.n > 1
  left join tops o on o.level = s.level and o.rank = xor(s.rank, 1)
), paths as (
  select p.doc_id, p.lang, p.rank, p.h as leaf, p.now, r.h as subroot,
         coalesce((select list({{'other': other, 'left': other_rank < s.rank}} order by level) from steps s where s.doc_id is not distinct from p.doc_id and s.leaf_rank = p.rank and s.leaf = p.h), []) as path
  from placed p join subroots r on p.lang is not distinct from r.lang
), folds as (
  select doc_id, rank, lang, leaf, subroot, path, now as acc, 1 as k from paths
  union all
  select doc_id, rank, lang, leaf, subroot, path, sha256(case when path[k]['other'] is null then acc when path[k]['left'] then path[k]['other'] || acc else acc || path[k]['other'] end), k + 1
  from folds where k <= len(path)
)
select doc_id, leaf, subroot, (select h from tops where n = 1) as root,
       sha256(coalesce(list_aggregate(list_filter(list_transform(path, lambda s: s['other']), lambda x: x is not null), 'string_agg', ''), '')) as proof_sha256,
       acc as folded_root, acc = (select h from tops where n = 1) as verified
from folds where k = len(path) + 1
"""
TRIE = f"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first) as k, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null
), convs as (
  select conv_id as c, conv_id - (conv_id % 100 + 100) % 100 as base, {crc32('conv_id')} % 6 as h from (select distinct conv_id from conversations where conv_id is not null)
), rebuilt as (
  select c, k as d, role, text from convs join turns on conv_id = base and k <= h
  union all
  select c, k - h + (select count(*) from turns t where t.conv_id = base and t.k <= h), role, text from convs join turns on conv_id = c and k > h
), prefixes as (
  select c, d, text, md5(string_agg(md5(octet_length(encode(role)) || ':' || role || text), '') over (partition by c order by d)) as p from rebuilt
  union all
  select c, 0, '', '' from convs
), members as (
  select *, lag(p) over (partition by c order by d) as parent, max(d) over (partition by c) = d as ended from prefixes
), nodes as (
  select p, d, min(parent) as parent, min(c) as c, count(*) as n, max(length(text)) as chars,
         sha256(coalesce(string_agg(c, ',' order by c) filter (ended), '')) as ends_sha256
  from members group by p, d
), kids as (
  select p, d, n, chars, c, (select count(*) from nodes k where k.parent = x.p and k.d = x.d + 1) as n_children from nodes x
), below as (
  select m.p, m.d, sum((k.n_children = 0)::int) as n_leaves, sum((k.n - 1) * k.chars) as saved_tokens
  from kids k join members m on m.c = k.c and m.d <= k.d group by m.p, m.d
)
select x.c as conv_id, x.d as depth, o.c as parent_conv_id, x.n as n_convs, k.n_children, cast(b.n_leaves as bigint) as n_leaves,
       cast(b.saved_tokens as bigint) as saved_tokens, x.ends_sha256
from nodes x join kids k on x.p = k.p and x.d = k.d join below b on x.p = b.p and x.d = b.d
left join nodes o on o.p = x.parent and o.d = x.d - 1
"""
