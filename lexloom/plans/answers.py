"""Queries on answers from metadata, filters of result lists, checks of answers and small formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answers as A
from ..sources.tables import markdown_lines
from .ingestion import LINES
from .registry import Tables, query
from .routing import NORMAL


@query("metadata_answers", """
with s as (select source, count(*) as n, min(doc_id) as oldest, max(doc_id) as latest, sum(len(string_split(text, chr(10)))) as chunks, count(distinct lang) as langs from documents group by 1)
select source, unnest(['count', 'oldest', 'latest', 'chunks', 'languages']) as kind, unnest([n, oldest, latest, chunks, langs])::bigint as value from s
""")
def metadata_answers(t: Tables) -> DataFrame:
    """RTE-07. What each source's metadata questions are answered with, in one aggregation."""
    found = t.documents.groupBy("source").agg(
        F.count("*").alias("count"), F.min("doc_id").alias("oldest"), F.max("doc_id").alias("latest"),
        F.sum(F.size(F.split("text", "\n", -1))).alias("chunks"), F.countDistinct("lang").alias("languages"),
    )
    kinds = ("count", "oldest", "latest", "chunks", "languages")
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("long").alias("value")) for k in kinds])
    return found.select("source", F.explode(rows).alias("r")).select("source", "r.*")


@query("metadata_summaries", """
select source, lang, case when lang = 'vi' then 'Có ' || count(*) || ' tài liệu trong ' || source || '.' else 'There are ' || count(*) || ' documents in ' || source || '.' end as answer from documents where lang is not null and source is not null group by 1, 2
""")
def metadata_summaries(t: Tables) -> DataFrame:
    """RTE-18, TXT-42. Counts of documents in the words of their language's template."""
    rows = t.documents.where("lang is not null and source is not null").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return rows.select("source", "lang", A.template_answer(F.col("lang"), F.lit("count"), F.col("n"), F.col("source")).alias("answer"))


@query("file_type_lists", """
with v as (select p_partkey, case p_partkey % 4 when 0 then 'PDF, ' || lower(p_type) when 1 then p_brand || ',docx,pdf ,DOCX' when 2 then 'txt' end as value from part)
select p_partkey, list_aggregate(list_sort(list_distinct(list_filter(list_transform(string_split(lower(coalesce(value, '')), ','), lambda x: trim(x)), lambda x: x in ('pdf', 'docx', 'xlsx', 'pptx', 'txt')))), 'string_agg', ',') as types from v where p_partkey % 4 <> 3
""")
def file_type_lists(t: Tables) -> DataFrame:
    """FLT-18. Known file types of lists with other words in them."""
    k = F.col("p_partkey") % 4
    value = F.when(k == 0, F.concat(F.lit("PDF, "), F.lower("p_type"))).when(k == 1, F.concat("p_brand", F.lit(",docx,pdf ,DOCX"))).when(k == 2, "txt")
    return t.part.where("p_partkey % 4 <> 3").select("p_partkey", F.array_join(A.known_file_types(value), ",").alias("types"))


@query("snippets", """
select doc_id, case when length(trim(text)) > 500 then rtrim(substr(trim(text), 1, 500)) || '…' else trim(text) end as snippet from documents where text is not null
""")
def snippets(t: Tables) -> DataFrame:
    """FLT-24. Texts as shown in a list of results."""
    return t.documents.where("text is not null").select("doc_id", A.snippet(F.col("text")).alias("snippet"))


@query("heading_children", """
select n_regionkey, s_nationkey as parent, count(*) as n_children, string_agg(s_name, ' > ' order by s_suppkey) as titles from supplier join nation on s_nationkey = n_nationkey where s_acctbal > 0 group by 1, 2
""")
def heading_children(t: Tables) -> DataFrame:
    """FLT-07, FLT-08, RTE-09, RTE-12, in part. Units under each parent, in order; suppliers stand under nations here, and
    those with a balance are headings."""
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    units = rows.select("n_regionkey", F.col("s_nationkey").alias("parent"), (F.col("s_acctbal") > 0).alias("is_heading"), "s_suppkey", F.col("s_name").alias("title"))
    return A.children(units, "n_regionkey", "s_suppkey")


@query("clause_list", """
with r as (select o_orderkey, case when o_totalprice >= 300000 then 'HIGH' when o_totalprice >= 100000 then 'MEDIUM' else 'LOW' end as level, o_orderstatus as status, substr(o_orderpriority, 1, 1) as category, o_orderpriority as text from orders)
select o_orderkey, level, status, category from r where level in ('HIGH', 'MEDIUM') and status in ('O', 'F') and category in ('1', '2', '4') and contains(lower(text), 'high')
""")
def clause_list(t: Tables) -> DataFrame:
    """FLT-20. Clauses by risk, status, category and a word."""
    price = F.col("o_totalprice")
    level = F.when(price >= 300000, "HIGH").when(price >= 100000, "MEDIUM").otherwise("LOW")
    rows = t.orders.select("o_orderkey", level.alias("level"), F.col("o_orderstatus").alias("status"), F.substring("o_orderpriority", 1, 1).alias("category"), F.col("o_orderpriority").alias("text"))
    return A.clause_filter(rows, ("HIGH", "MEDIUM"), ("O", "F"), ("1", "2", "4"), "High").drop("text")


@query("hydrated_hits", """
select d.doc_id, coalesce('quality ' || quality, d.source) as payload, coalesce(toxic, -1) as toxic from documents d left join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by 1) l on l.doc_id = d.doc_id
""")
def hydrated_hits(t: Tables) -> DataFrame:
    """JOIN-16. Hits with stored columns where there are any, else with their own payload."""
    stored = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    stored = stored.select("doc_id", F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("payload"), "toxic")
    hits = t.documents.select("doc_id", F.col("source").alias("payload"), F.lit(-1).alias("toxic"))
    return A.hydrate(hits, stored, "doc_id", ["payload", "toxic"])


@query("graph_hits_with_fallback", """
with h as (select o_custkey, o_orderkey as entity, max(case when l_quantity > 45 then l_linenumber end) as line, max(case when l_quantity > 45 then l_quantity end) as q from orders join lineitem on o_orderkey = l_orderkey group by 1, 2),
f as (select o_custkey, entity, entity * 10 + line as chunk_id, q / 50.0 as score from h where line is not null
  union all select o_custkey, entity, entity * 10 + 9 as chunk_id, 0.6 from h where line is null and entity % 2 = 0),
g as (select o_custkey, chunk_id, max(score) as score from f group by 1, 2)
select o_custkey, chunk_id, score::double as score from g qualify row_number() over (partition by o_custkey order by score desc, chunk_id) <= 5
""")
def graph_hits_with_fallback(t: Tables) -> DataFrame:
    """JOIN-17. Entities with their chunk, and a fallback chunk for those without, at most five a customer."""
    big = F.col("l_quantity") > 45
    hits = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", F.col("o_orderkey").alias("entity")).agg(
        F.max(F.when(big, F.col("l_linenumber"))).alias("line"), F.max(F.when(big, F.col("l_quantity"))).alias("q")
    ).select("o_custkey", "entity", (F.col("entity") * 10 + F.col("line")).alias("chunk_id"), (F.col("q") / 50.0).alias("score"))
    fallback = t.orders.where("o_orderkey % 2 = 0").select("o_custkey", F.col("o_orderkey").alias("entity"), (F.col("o_orderkey") * 10 + 9).alias("chunk_id"))
    return A.with_fallback(hits, "o_custkey", fallback, 5).select("o_custkey", "chunk_id", "score")


def _hint(terms: tuple[str, ...]) -> str:
    listed = "[" + ", ".join(f"'{x}'" for x in terms) + "]"
    return f"trim(n || ' ' || coalesce(list_aggregate(list_filter({listed}, lambda x: not list_contains(regexp_extract_all(n, '[\\p{{L}}\\p{{N}}_]+'), x)), 'string_agg', ' '), ''))"


@query("expanded_queries", f"""
with q as (select conv_id, turn, {NORMAL} as n from conversations)
select conv_id, turn, case when turn % 3 = 0 then {_hint(A.HINTS['contract'])} when turn % 3 = 1 then {_hint(A.HINTS['overview'])} else n end as expanded from q
""")
def expanded_queries(t: Tables) -> DataFrame:
    """TXT-19. Questions with the hint terms of an intent; turns stand for intents here."""
    rows = t.conversations.select("conv_id", "turn", X.normalize_query(F.col("text")).alias("n"))
    intent = F.when(F.col("turn") % 3 == 0, "contract").when(F.col("turn") % 3 == 1, "overview").otherwise("focused")
    return rows.select("conv_id", "turn", A.expand_query(F.col("n"), intent).alias("expanded"))


@query("unsupported_numbers", """
with x as (select d.doc_id, regexp_extract_all(d.text, '[0-9]+(?:[.,][0-9]+)*') as a, regexp_extract_all(e.text, '[0-9]+(?:[.,][0-9]+)*') as b from documents d join documents e on e.doc_id = d.doc_id + 1)
select doc_id, len(list_distinct(list_filter(a, lambda v: not list_contains(b, v)))) as n_unsupported, coalesce(list_aggregate(list_sort(list_distinct(list_filter(a, lambda v: not list_contains(b, v)))), 'string_agg', ' '), '') as numbers from x
""")
def unsupported_numbers(t: Tables) -> DataFrame:
    """VER-06, in part. Numbers of a document that the next one, taken as its evidence, doesn't hold."""
    evidence = t.documents.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("evidence"))
    rows = t.documents.select("doc_id", "text").join(evidence, "doc_id")
    found = A.unsupported_numbers(F.col("text"), F.col("evidence"))
    return rows.select("doc_id", F.size(found).cast("long").alias("n_unsupported"), F.array_join(found, " ").alias("numbers"))


@query("heading_like_lines", f"""
with {LINES}, x as (select doc_id, trim(line) as s from lines)
select doc_id, count(*) filter (length(s) between 3 and 80 and regexp_matches(s, '^(?:\\d+(?:\\.\\d+)*\\.?\\s+)?\\p{{Lu}}') and not regexp_matches(s, '[.!?;,]$')) as n_headings,
  count(*) filter (regexp_matches(s, '(?i)^(?:\\d+(?:\\.\\d+)+\\.?\\s+\\S|(?:signed|signature|date)\\b|.*\\d{{1,2}}[/.-]\\d{{1,2}}[/.-]\\d{{4}}|.*\\d+(?:[.,]\\d+)*\\s*(?:usd|vnd|eur|%))')) as n_protected from x group by 1
""")
def heading_like_lines(t: Tables) -> DataFrame:
    """TXT-09, TXT-11. Lines that look like headings, and lines that cleaning must keep."""
    lines = markdown_lines(t.documents, "doc_id")
    return lines.groupBy("doc_id").agg(F.count_if(A.looks_like_heading(F.col("line"))).alias("n_headings"), F.count_if(A.is_protected(F.col("line"))).alias("n_protected"))


@query("markdown_tables", """
select n_regionkey, '| key | nation |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || replace(n_name, '|', '\\|') || ' |', chr(10) order by n_nationkey) as markdown,
  string_agg('key: ' || n_nationkey || '; nation: ' || n_name, chr(10) order by n_nationkey) as semantic from nation group by 1
""")
def markdown_tables(t: Tables) -> DataFrame:
    """SRC-18, TXT-26. Rows as a Markdown table and as text that can be searched."""
    cells = F.array(F.col("n_nationkey").cast("string"), F.col("n_name"))
    listed = F.array_sort(F.collect_list(F.struct("n_nationkey", cells.alias("cells"), A.semantic_row(["key", "nation"], cells).alias("said"))))
    rows = t.nation.groupBy("n_regionkey").agg(listed.alias("rows"))
    return rows.select("n_regionkey", A.markdown_table(["key", "nation"], F.transform("rows", lambda r: r["cells"])).alias("markdown"), F.array_join(F.transform("rows", lambda r: r["said"]), "\n").alias("semantic"))


@query("header_rows", """
with c as (select l_orderkey, l_linenumber, (case when regexp_matches(l_returnflag, '^[-+]?\\d+$') then 1 else 0 end + case when l_quantity > 25 then 1 else 0 end + 0) as numbers from lineitem)
select l_orderkey, min(l_linenumber) as header_row from c where numbers <= 0.4 * 2 group by 1
""")
def header_rows(t: Tables) -> DataFrame:
    """SRC-08. The first line of each order of which at most two fifths of the cells are numbers; small quantities are
    written as words here."""
    quantity = F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("int").cast("string")).otherwise("few")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.array("l_returnflag", quantity).alias("cells"))
    return A.header_row(rows, "l_orderkey", "l_linenumber", "cells")


@query("local_fallbacks", """
select event_type, count(*) filter (event_id % 3 <> 0 and (user_id % 5 = 0 or 400 + 25 * (event_id % 8) >= 500 or 400 + 25 * (event_id % 8) in (408, 429))) as n_fallback, count(*) as n from events group by 1
""")
def local_fallbacks(t: Tables) -> DataFrame:
    """SRC-14. Failed parses that may be done locally."""
    status = 400 + 25 * (F.col("event_id") % 8)
    good = A.can_fall_back(F.col("event_id") % 3 != 0, status, F.col("user_id") % 5 == 0)
    return t.events.groupBy("event_type").agg(F.count_if(good).alias("n_fallback"), F.count("*").alias("n"))


@query("context_hashes", """
select o_orderkey, substr(sha256('{"custkey":' || o_custkey || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}|v1'), 1, 32) as context_hash from orders
""")
def context_hashes(t: Tables) -> DataFrame:
    """FN-21. Hash of the facts that a model is given."""
    facts = F.struct(F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    return t.orders.select("o_orderkey", A.context_hash(facts, "v1").alias("context_hash"))


@query("sanitized_metadata", """
select event_id, substr(event_type, 1, 3) as kind, 2 as n_keys from events
""")
def sanitized_metadata(t: Tables) -> DataFrame:
    """FN-27. Metadata without blocked keys, its values cut."""
    raw = F.create_map(F.lit("Token"), F.lit("x"), F.lit("kind"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    rows = t.events.select("event_id", A.sanitize_metadata(raw, 3).alias("m"))
    return rows.select("event_id", F.try_element_at("m", F.lit("kind")).alias("kind"), F.size("m").alias("n_keys"))


@query("merged_fragments", """
with f as (select o_custkey, o_orderkey, o_orderstatus, row_number() over (partition by o_custkey order by o_orderkey) - row_number() over (partition by o_custkey, o_orderstatus order by o_orderkey) as island from orders)
select o_custkey, min(o_orderkey) as first, o_orderstatus, count(*) as n_fragments from f group by o_custkey, o_orderstatus, island
""")
def merged_fragments(t: Tables) -> DataFrame:
    """WIN-21. Neighbouring fragments of one shape as one table."""
    return A.merge_fragments(t.orders, "o_custkey", "o_orderkey", "o_orderstatus")


@query("live_cache_rows", """
with c as (select o_orderkey, sha256(lower(o_orderpriority)) as query_hash, o_orderdate + interval 400 day as expires_at from orders)
select query_hash, count(*) as n_live, max(o_orderkey) as latest from c where expires_at > timestamp '2000-06-01' group by 1
""")
def live_cache_rows(t: Tables) -> DataFrame:
    """FLT-15, SNK-10, RTE-01. Cache rows are appended and never overwritten; those of a question that are still live."""
    expires = F.col("o_orderdate") + F.expr("interval 400 days")
    rows = t.orders.select("o_orderkey", X.query_hash(F.lower("o_orderpriority")).alias("query_hash"), expires.alias("expires_at"))
    live = rows.where(F.col("expires_at") > F.lit("2000-06-01").cast("timestamp_ntz"))
    return live.groupBy("query_hash").agg(F.count("*").alias("n_live"), F.max("o_orderkey").alias("latest"))
