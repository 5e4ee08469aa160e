"""Entity-graph queries over the lines of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import NAME_STOP
from ..operators import graph as G
from ..sources.tables import markdown_lines
from .registry import Tables, query

STOP = ", ".join(f"'{w}'" for w in NAME_STOP)
FOUND = f"""lines as materialized (
  select doc_id * 100000 + pos as chunk, line from (
    select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)
),
found as materialized (
  select chunk, name from (select chunk, unnest(regexp_extract_all(line, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+){{0,3}})\\b', 1)) as name from lines) where length(name) > 2 and name not in ({STOP})
  union all
  select chunk, name from (select chunk, unnest(regexp_extract_all(line, '\\b([A-Z]{{2,6}})\\b', 1)) as name from lines) where name not in ({STOP})
),
top as materialized (select name, count(*) as mentions from found group by 1 order by 2 desc, 1 limit 40),
kept as (select distinct chunk, name from found where name in (select name from top)),
edges as materialized (select a.name as a, b.name as b, count(*) as weight from kept a join kept b on a.chunk = b.chunk and a.name < b.name group by 1, 2)"""


def _found(t: Tables) -> DataFrame:
    lines = markdown_lines(t.documents, "doc_id").select(F.struct("doc_id", "line_no").alias("chunk"), "line")
    return G.mentions(lines, "chunk", "line")


def _edges(t: Tables) -> DataFrame:
    found = _found(t)
    return G.cooccurrence(found, G.top_entities(found), "chunk")


@query("entity_mentions", f"""
with {FOUND} select name, mentions, case when regexp_matches(name, '^[A-Z]{{2,6}}$') then 'ORG' when contains(name, ' ') then 'ENTITY' else 'CONCEPT' end as type from top
""")
def entity_mentions(t: Tables) -> DataFrame:
    """AGG-16, TXT-39, TXT-40. The 40 names with most mentions."""
    return G.top_entities(_found(t))


@query("entity_cooccurrence", f"with {FOUND} select a, b, weight from edges")
def entity_cooccurrence(t: Tables) -> DataFrame:
    """AGG-16. Lines that name both of two entities."""
    return _edges(t)


@query("entity_two_hop", f"""
with {FOUND}, both_ as (select a as node, b as next from edges union select b, a from edges),
seeds as (select name as node from top order by mentions, name limit 2),
one as (select distinct next as node from both_ where node in (select node from seeds)),
two as (select distinct next as node from both_ where node in (select node from one))
select node, min(hops) as hops from (select node, 0 as hops from seeds union all select node, 1 from one union all select node, 2 from two) group by 1
""")
def entity_two_hop(t: Tables) -> DataFrame:
    """JOIN-14, JOIN-15. Entities at most two edges from the two rarest of those kept."""
    found = _found(t)
    top = G.top_entities(found)
    seeds = top.orderBy("mentions", "name").limit(2).select(F.col("name").alias("node"))
    return G.expand(G.cooccurrence(found, top, "chunk"), seeds, 2)


@query("graph_live_edges", f"""
with {FOUND} select a, b, weight from edges where a in (select name from top where length(name) <= 4) and b in (select name from top where length(name) <= 4)
""")
def graph_live_edges(t: Tables) -> DataFrame:
    """FLT-21. Edges left when only short names are shown."""
    found = _found(t)
    top = G.top_entities(found)
    nodes = top.where(F.length("name") <= 4).select(F.col("name").alias("node"))
    return G.live_edges(G.cooccurrence(found, top, "chunk"), nodes)


@query("top_terms_topics", """
with w as (select lang, doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) as term from documents),
c as (select lang, term, count(*) as n_docs from w where length(term) >= 4 group by 1, 2)
select lang, term, n_docs, cast(row_number() over (partition by lang order by n_docs desc, term) as integer) as rank from c qualify rank <= 10
""")
def top_terms_topics(t: Tables) -> DataFrame:
    """AGG-17. The terms that most documents of a language hold."""
    return G.top_terms(t.documents, "doc_id", "lang", "text", 10)


@query("entity_chunks", f"""
with {FOUND}, few as (select name from top order by mentions, name limit 5)
select doc_id, name from documents join few on contains(lower(text), lower(name))
""")
def entity_chunks(t: Tables) -> DataFrame:
    """JOIN-12, JOIN-13. Documents that contain one of five names."""
    names = G.top_entities(_found(t)).orderBy("mentions", "name").limit(5)
    return G.mentioning(t.documents, names, F.col("text")).select("doc_id", "name")
