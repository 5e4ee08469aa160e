"""Queries on places in texts: benchmark passages as snippets, lines of documents as blocks, some of them in another form, out
of order or nowhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import locate
from ..sources.tables import markdown_lines
from .registry import Tables, query

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PLAIN = "translate(coalesce({0}, ''), '‘’“”' || chr(160), '''''\"\" ')"
NORMAL = f"trim(regexp_replace(lower({PLAIN}), '\\s+', ' ', 'g'))"
#: Places (from 1) of what the normal form keeps of a text.
KEPT = f"""(select list_filter(range(1, len(c) + 1), lambda i: not regexp_matches(c[i], '^\\s$') or (i > 1 and not regexp_matches(c[i - 1], '^\\s$'))) from (select string_split({PLAIN}, '') as c))"""


@query("snippet_spans_normalized", f"""
with n as (select item_id, case when item_id % 2 = 1 then replace(translate(text, '{LOWER}', '{UPPER}'), ' ', '  ') else text end as needle from benchmark),
d as (select doc_id, text, {NORMAL.format('text')} as h from documents),
x as materialized (select item_id, needle, {NORMAL.format('needle')} as nn from n),
hits as materialized (select item_id, doc_id, text, needle, nn, strpos(h, nn) as pos from x join d on contains(h, nn)),
k as (select *, {KEPT.format('text')} as kept from hits)
select item_id, doc_id, cast(case when contains(text, needle) then strpos(text, needle) - 1 else kept[pos] - 1 end as bigint) as start,
  cast(case when contains(text, needle) then strpos(text, needle) - 1 + length(needle) else kept[pos + length(nn) - 1] end as bigint) as end_at,
  case when contains(text, needle) then 'exact' else 'normalized' end as confidence
from k
""")
def snippet_spans_normalized(t: Tables) -> DataFrame:
    """TXT-23, VER-08. Where passages stand, every other one asked for in capitals and with wider blanks."""
    capitals = F.replace(F.translate("text", LOWER, UPPER), F.lit(" "), F.lit("  "))
    snippets = t.benchmark.select("item_id", F.when(F.col("item_id") % 2 == 1, capitals).otherwise(F.col("text")).alias("snippet"))
    rows = locate.snippet_spans(t.documents.select("doc_id", "text"), snippets, "doc_id", "text", "item_id", "snippet")
    return rows.select("item_id", "doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end_at"), "confidence")


@query("block_spans", f"""
with recursive l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents
), b as (
  select doc_id, case when i % 2 = 0 then i + 1 else i - 1 end as k, trim(case when i % 9 = 4 then 'no such block in any text' when i % 5 = 1 then translate(line, '{LOWER}', '{UPPER}') else line end, ' ' || chr(9) || chr(13)) as block from l
), numbered as materialized (
  select doc_id, k, block, {NORMAL.format('block')} as nb, row_number() over (partition by doc_id order by k) as n from b where block <> ''
), d as materialized (select doc_id, text, {NORMAL.format('text')} as h, {KEPT.format('text')} as kept from documents),
walk as (
  select doc_id, 0::bigint as n, null::bigint as k, 0::bigint as cur, null::bigint as s, null::bigint as e from d
  union all
  select doc_id, n, k, coalesce(e, cur), s, e from (
    select w.doc_id, b.n, b.k, w.cur, f.s, case when f.exact then f.s + length(b.block) else f.last end as e
    from walk w join numbered b on b.doc_id = w.doc_id and b.n = w.n + 1 join d on d.doc_id = w.doc_id,
    lateral (select strpos(substr(text, w.cur + 1), b.block) as e1, strpos(text, b.block) as e0, len(list_filter(kept, lambda x: x - 1 < w.cur)) as lo) p,
    lateral (select case when length(b.nb) >= 12 then strpos(substr(h, p.lo + 1), b.nb) else 0 end as n1, case when length(b.nb) >= 12 then strpos(h, b.nb) else 0 end as n0) q,
    lateral (select case when p.e1 > 0 then w.cur + p.e1 - 1 when q.n1 > 0 then kept[p.lo + q.n1] - 1 when p.e0 > 0 then p.e0 - 1 when q.n0 > 0 then kept[q.n0] - 1 end as s,
      p.e1 > 0 or (q.n1 = 0 and p.e0 > 0) as exact, case when q.n1 > 0 then kept[p.lo + q.n1 + length(b.nb) - 1] when q.n0 > 0 then kept[q.n0 + length(b.nb) - 1] end as last) f
  )
)
select doc_id, k, s as start, e as end_at from walk where n > 0
""")
def block_spans(t: Tables) -> DataFrame:
    """WIN-29. Spans of lines as blocks: neighbours change places, some are in capitals, some are nowhere, many are repeated."""
    lines = markdown_lines(t.documents, "doc_id").withColumn("i", F.col("line_no") - 1)
    block = F.when(F.col("i") % 9 == 4, "no such block in any text").when(F.col("i") % 5 == 1, F.translate("line", LOWER, UPPER)).otherwise(F.col("line"))
    k = F.when(F.col("i") % 2 == 0, F.col("i") + 1).otherwise(F.col("i") - 1).cast("long")
    blocks = lines.select("doc_id", k.alias("k"), F.btrim(block, F.lit(" \t\r")).alias("block")).where("block <> ''")
    rows = locate.block_spans(t.documents.select("doc_id", "text"), blocks, "doc_id", "text", "k", "block")
    return rows.select("doc_id", "k", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end_at"))
