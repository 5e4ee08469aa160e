"""Queries on collections, ties and places: set differences, overlaps, rankings with fixed tie-breaks, spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.containing import places
from ..operators.lines import html_headings
from ..operators.routing import heading_score
from ..sources.tables import markdown_lines
from .ingestion import HEADINGS, LINES
from .registry import Tables, query

W = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')"


@query("topic_ranked_chunks", """
select l_suppkey as chunk_id, count(*) as n_links, max(case when p_size > 45 then 1 else 0 end) as in_focus from lineitem join part on l_partkey = p_partkey
group by 1 order by in_focus desc, n_links desc, chunk_id limit 50
""")
def topic_ranked_chunks(t: Tables) -> DataFrame:
    """AGG-11. Chunks by focus, number of topics and id."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("chunk_id"))
    rows = rows.agg(F.count("*").alias("n_links"), F.max(F.when(F.col("p_size") > 45, 1).otherwise(0)).alias("in_focus"))
    return rows.orderBy(F.desc("in_focus"), F.desc("n_links"), "chunk_id").limit(50)


@query("active_members", """
select n_name as workspace, count(*) filter (c_acctbal > 0) as n_active, count(*) filter (c_acctbal > 0 and c_mktsegment = 'BUILDING') as n_admins
from nation left join customer on c_nationkey = n_nationkey group by 1
""")
def active_members(t: Tables) -> DataFrame:
    """AGG-12, FLT-12. Active members and admins of every workspace."""
    rows = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    active = F.coalesce(F.col("c_acctbal") > 0, F.lit(False))
    return rows.groupBy(F.col("n_name").alias("workspace")).agg(F.count_if(active).alias("n_active"), F.count_if(active & (F.col("c_mktsegment") == "BUILDING")).alias("n_admins"))


@query("summary_with_recount", """
select c_custkey as report_id, coalesce(nullif(cast(any_value(c_nationkey) % 3 as bigint), 0), count(o_orderkey)) as n_clauses,
       count(*) filter (o_orderstatus = 'F') as n_verified from customer left join orders on o_custkey = c_custkey group by 1
""")
def summary_with_recount(t: Tables) -> DataFrame:
    """AGG-34, AGG-47. A stored number, counted anew where it is 0."""
    rows = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.col("c_custkey").alias("report_id"))
    stored = F.nullif((F.max("c_nationkey") % 3).cast("long"), F.lit(0))
    return rows.agg(F.coalesce(stored, F.count("o_orderkey")).alias("n_clauses"), F.count_if(F.col("o_orderstatus") == "F").alias("n_verified"))


@query("keys_without_expansion", "select o_orderkey as id from orders except all select l_orderkey from lineitem")
def keys_without_expansion(t: Tables) -> DataFrame:
    """SET-03, SET-04. Keys that the other side lacks, as often as they are left over."""
    return t.orders.select(F.col("o_orderkey").alias("id")).exceptAll(t.lineitem.select("l_orderkey"))


@query("merged_entities", """
select distinct name, type from (select upper(trim(n_name)) as name, 'NATION' as type from nation union all select upper(trim(r_name)), 'REGION' from region
  union all select upper(trim(n_name)), 'NATION' from nation join customer on c_nationkey = n_nationkey)
""")
def merged_entities(t: Tables) -> DataFrame:
    """SET-07. Entities of several partial results, each name and type once."""
    name = lambda c: F.upper(F.btrim(c)).alias("name")
    nations = t.nation.select(name("n_name"), F.lit("NATION").alias("type"))
    more = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey")).select(name("n_name"), F.lit("NATION").alias("type"))
    return nations.union(t.region.select(name("r_name"), F.lit("REGION").alias("type"))).union(more).dropDuplicates(["name", "type"])


@query("turn_overlap", f"""
with w as (select conv_id, turn, {W} as w, lead({W}) over (partition by conv_id order by turn) as n from conversations)
select conv_id, turn, list_has_any(w, n) as overlaps, cast(len(list_distinct(w)) as integer) as n_words from w where n is not null
""")
def turn_overlap(t: Tables) -> DataFrame:
    """SET-09, SET-10. Whether two turns in a row share a word; distinct words of the first."""
    words = X.words(F.col("text"))
    rows = t.conversations.select("conv_id", "turn", words.alias("w"), F.lead(words).over(Window.partitionBy("conv_id").orderBy("turn")).alias("n"))
    return rows.where("n is not null").select("conv_id", "turn", F.arrays_overlap("w", "n").alias("overlaps"), F.size(F.array_distinct("w")).alias("n_words"))


@query("heading_match", f"""
with {HEADINGS}, q as (select page_id, left(arg_max(lower(title), position), 8) as wanted from headings group by 1),
s as (select page_id, position, level, case when wanted <> '' and lower(title) = wanted then 0.95 when wanted <> '' and starts_with(lower(title), wanted) then 0.88
  when wanted <> '' and contains(lower(title), wanted) then 0.70 else 0.0 end as score from headings join q using (page_id))
select page_id, position, score::double as score from s where score > 0 qualify row_number() over (partition by page_id order by score desc, level, position) = 1
""")
def heading_match(t: Tables) -> DataFrame:
    """TOP-10, RTE-10. The heading of each page that fits a wanted title best, shallow ones first."""
    heads = html_headings(t.pages, "page_id", "html").withColumn("title", F.lower("title"))
    wanted = heads.groupBy("page_id").agg(F.substring(F.max_by("title", "position"), 1, 8).alias("wanted"))
    rows = heads.join(wanted, "page_id").withColumn("score", heading_score(F.col("title"), F.lit(""), F.col("wanted"), F.lit("")))
    own = Window.partitionBy("page_id").orderBy(F.desc("score"), "level", "position")
    return rows.where("score > 0").withColumn("r", F.row_number().over(own)).where("r = 1").select("page_id", "position", "score")


@query("top_category", """
with c as (select user_id, event_type, count(*) as n from events group by 1, 2)
select user_id, event_type as category, n from c
qualify row_number() over (partition by user_id order by n desc, list_position(['error', 'purchase', 'signup', 'click', 'view'], event_type)) = 1
""")
def top_category(t: Tables) -> DataFrame:
    """TOP-12. The category with the greatest score; ties by a fixed list."""
    order = F.array_position(F.array(*[F.lit(c) for c in ("error", "purchase", "signup", "click", "view")]), F.col("event_type"))
    rows = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    own = Window.partitionBy("user_id").orderBy(F.desc("n"), order)
    return rows.withColumn("r", F.row_number().over(own)).where("r = 1").select("user_id", F.col("event_type").alias("category"), "n")


@query("node_search", "select c_custkey as id, c_name as name from customer where lower(c_name) like '%0001%' order by c_name limit 10")
def node_search(t: Tables) -> DataFrame:
    """TOP-14. The first ten names with a text in them."""
    return t.customer.where(F.col("c_name").ilike("%0001%")).orderBy("c_name").limit(10).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("tightest_block", f"""
with {LINES}, n as (select item_id, left(text, 30) as needle from benchmark)
select item_id, doc_id, arg_min(line_no, (length(line), line_no)) as line_no from n join lines on contains(line, needle) group by 1, 2
""")
def tightest_block(t: Tables) -> DataFrame:
    """JOIN-24 in part. The shortest line of a document that holds a passage's first 30 code points."""
    needles = t.benchmark.select("item_id", F.substring("text", 1, 30).alias("needle"))
    rows = markdown_lines(t.documents, "doc_id").join(needles, F.col("line").contains(F.col("needle")))
    return rows.groupBy("item_id", "doc_id").agg(F.min_by("line_no", F.struct(F.length("line"), F.col("line_no"))).alias("line_no"))


@query("snippet_spans", """
with n as (select item_id, text as needle from benchmark)
select item_id, doc_id, cast(strpos(text, needle) - 1 as integer) as start, cast(strpos(text, needle) - 1 + length(needle) as integer) as end_at
from n join documents on contains(text, needle)
""")
def snippet_spans(t: Tables) -> DataFrame:
    """TXT-23, VER-08. Where a passage stands in a document, word for word."""
    needles = t.benchmark.select("item_id", F.col("text").alias("needle"))
    found = places(t.documents, needles, "doc_id", "text", "item_id", "needle").groupBy("item_id", "doc_id").agg(F.min("start").cast("int").alias("start"))
    rows = found.join(needles, "item_id")
    return rows.select("item_id", "doc_id", "start", (F.col("start") + F.length("needle")).alias("end_at"))


@query("run_durations", """
select o_orderkey as run_id, cast(date_diff('day', min(o_orderdate), max(l_shipdate)) as integer) as days, max(l_shipdate) is null as running
from orders left join lineitem on l_orderkey = o_orderkey group by 1
""")
def run_durations(t: Tables) -> DataFrame:
    """FN-29. Days from a run's beginning to its last stage; null while it has none."""
    rows = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy(F.col("o_orderkey").alias("run_id"))
    return rows.agg(F.datediff(F.max("l_shipdate"), F.min("o_orderdate")).alias("days"), F.max("l_shipdate").isNull().alias("running"))
