"""Queries over the relational tables. orders, customer, supplier, nation and lineitem stand for messages,
sessions, users, workspaces and generations; events for the query log; documents for documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from .registry import Tables, query

money = lambda c: F.col(c).cast("decimal(18,2)")


@query("cost_totals", """
select coalesce(sum(cast(l_extendedprice as decimal(18,2))), 0)::double as total_cost, count(*) as n_calls,
       cast(coalesce(sum(l_quantity), 0) as bigint) as total_units
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
where l_shipdate >= timestamp '1995-01-01' and l_shipdate < timestamp '1997-01-01'
""")
def cost_totals(t: Tables) -> DataFrame:
    """AGG-01, JOIN-09. Totals of a star join inside a day window; 0 rather than null for no rows."""
    rows = t.lineitem.where(R.day_window(F.col("l_shipdate"), "1995-01-01", "1996-12-31"))
    rows = rows.join(t.orders, rows.l_orderkey == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.agg(
        F.coalesce(F.sum(money("l_extendedprice")), F.lit(0)).cast("double").alias("total_cost"), F.count("*").alias("n_calls"),
        F.coalesce(F.sum("l_quantity"), F.lit(0)).cast("long").alias("total_units"),
    )


@query("cost_by_model", """
select coalesce(l_returnflag, 'unknown') as model, c_mktsegment as segment, count(*) as n_calls,
       sum(cast(l_extendedprice as decimal(18,2)))::double as cost, cast(sum(l_quantity) as bigint) as units
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
group by 1, 2
""")
def cost_by_model(t: Tables) -> DataFrame:
    """AGG-02. Calls, cost and units by model and segment; a null model is `unknown`."""
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.coalesce("l_returnflag", F.lit("unknown")).alias("model"), F.col("c_mktsegment").alias("segment")).agg(
        F.count("*").alias("n_calls"), F.sum(money("l_extendedprice")).cast("double").alias("cost"), F.sum("l_quantity").cast("long").alias("units")
    )


@query("agent_cost", """
select event_type as agent_type, count(*) as n, round(sum(coalesce(value, 0)), 4) as total,
       round(sum(coalesce(value, 0)) / count(*), 4) as average
from events group by 1
""")
def agent_cost(t: Tables) -> DataFrame:
    """AGG-04, AGG-44. Count, sum and sum / count by agent; a missing value counts as 0."""
    total = F.sum(F.coalesce("value", F.lit(0.0)))
    return t.events.groupBy(F.col("event_type").alias("agent_type")).agg(
        F.count("*").alias("n"), F.round(total, 4).alias("total"), F.round(total / F.count("*"), 4).alias("average")
    )


@query("status_breakdown", """
select o_orderpriority as priority, count(*) as n_total, count(*) filter (o_orderstatus = 'O') as n_o,
       count(*) filter (o_orderstatus = 'F') as n_f, count(*) filter (o_orderstatus = 'P') as n_p
from orders group by 1
""")
def status_breakdown(t: Tables) -> DataFrame:
    """AGG-05, AGG-33. Conditional counts by status."""
    return R.status_counts(t.orders.withColumnRenamed("o_orderpriority", "priority"), ["priority"], "o_orderstatus", ["O", "F", "P"])


@query("count_by_type", "select lang as file_type, source as workspace, count(*) as n from documents group by 1, 2")
def count_by_type(t: Tables) -> DataFrame:
    """AGG-07, AGG-08. Documents by workspace and type."""
    return t.documents.groupBy(F.col("lang").alias("file_type"), F.col("source").alias("workspace")).agg(F.count("*").alias("n"))


@query("count_distinct_pages", """
select source as workspace, count(distinct n_chars // 500) as n_pages, count(*) as n_chunks from documents group by 1
""")
def count_distinct_pages(t: Tables) -> DataFrame:
    """AGG-09, AGG-10. Distinct page numbers of a whole workspace, not summed over its documents."""
    return t.documents.groupBy(F.col("source").alias("workspace")).agg(
        F.countDistinct(F.floor(F.col("n_chars") / 500)).alias("n_pages"), F.count("*").alias("n_chunks")
    )


@query("latest_documents", """
(select o_orderkey as id, o_orderdate as created_at, 'latest' as side from orders order by o_orderdate desc, o_orderkey desc limit 20)
union all
(select o_orderkey as id, o_orderdate as created_at, 'oldest' as side from orders order by o_orderdate asc, o_orderkey asc limit 20)
""")
def latest_documents(t: Tables) -> DataFrame:
    """TOP-06. The latest and the oldest 20."""
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    latest = R.sorted_page(rows, "created_at", True, "id", 20).withColumn("side", F.lit("latest"))
    return latest.union(R.sorted_page(rows, "created_at", False, "id", 20).withColumn("side", F.lit("oldest")))


@query("paged_sorted_list", """
select o_orderkey as id, o_totalprice as price from orders where o_orderstatus = 'O' and lower(o_orderpriority) like '%urgent%'
order by o_totalprice desc nulls last, o_orderkey desc limit 50 offset 50
""")
def paged_sorted_list(t: Tables) -> DataFrame:
    """TOP-07, SRC-22, FLT-11. Second page of an ordered, filtered list."""
    rows = R.optional_filters(t.orders, F.col("o_orderstatus") == "O", R.contains_any("Urgent", ["o_orderpriority"]), None)
    order = [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").desc()]
    return rows.orderBy(*order).offset(50).limit(50).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))


@query("list_with_total", """
select o_custkey as workspace, o_orderkey as id, count(*) over (partition by o_custkey) as n_total
from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) <= 3
""")
def list_with_total(t: Tables) -> DataFrame:
    """AGG-06. The first rows of a list next to the number of all rows that match."""
    own = Window.partitionBy("o_custkey")
    rank = F.row_number().over(own.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    rows = t.orders.select("o_custkey", "o_orderkey", F.count("*").over(own).alias("n_total"), rank.alias("rank"))
    return rows.where("rank <= 3").select(F.col("o_custkey").alias("workspace"), F.col("o_orderkey").alias("id"), "n_total")


@query("no_membership_anti", """
select c_custkey as user_id, c_name as name from customer where c_acctbal > 0
and not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'O')
""")
def no_membership_anti(t: Tables) -> DataFrame:
    """JOIN-07, FLT-12. Users without an active membership."""
    active = t.orders.where("o_orderstatus = 'O'").select("o_custkey")
    users = t.customer.where("c_acctbal > 0").join(active, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return users.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))


@query("coalesced_key_left_joins", """
select o_orderkey as id, c_name as customer, s_name as supplier, n_name as nation
from orders left join customer on o_custkey = c_custkey and c_acctbal > 0
left join supplier on o_custkey % 100 = s_suppkey
left join nation on n_nationkey = coalesce(c_nationkey, s_nationkey)
""")
def coalesced_key_left_joins(t: Tables) -> DataFrame:
    """JOIN-02, JOIN-03, JOIN-04. Left joins of which the last has a key from either of two sides."""
    rows = t.orders.join(t.customer.where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = rows.join(t.supplier, F.col("o_custkey") % 100 == F.col("s_suppkey"), "left")
    rows = rows.join(t.nation, F.col("n_nationkey") == F.coalesce("c_nationkey", "s_nationkey"), "left")
    return rows.select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("customer"), F.col("s_name").alias("supplier"), F.col("n_name").alias("nation"))


@query("hydrate_rows", """
select l_orderkey as chunk, l_linenumber as chunk_index, o_orderdate as version_date, c_name as title, p_name as section
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join part on l_partkey = p_partkey
where c_mktsegment = 'BUILDING' and p_size in (1, 2, 3, 4, 5)
""")
def hydrate_rows(t: Tables) -> DataFrame:
    """FLT-01, FLT-23, JOIN-01, JOIN-10. Rows with what their version, document and dimension tables say."""
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t.customer.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t.part.where(F.col("p_size").isin(1, 2, 3, 4, 5)), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("l_orderkey").alias("chunk"), F.col("l_linenumber").alias("chunk_index"), F.col("o_orderdate").alias("version_date"),
        F.col("c_name").alias("title"), F.col("p_name").alias("section"),
    )


@query("latest_pass_rows", """
with latest as (select user_id, max(ts) as pass from events group by 1)
select e.user_id, e.event_id, e.event_type, u.c_name is not null as intact
from events e join latest l on e.user_id = l.user_id and e.ts = l.pass left join customer u on u.c_custkey = e.user_id
""")
def latest_pass_rows(t: Tables) -> DataFrame:
    """AGG-13, JOIN-05. Rows of each user's latest pass, flagged by whether their joins are whole."""
    latest = t.events.groupBy("user_id").agg(F.max("ts").alias("ts"))
    rows = t.events.join(latest, ["user_id", "ts"]).join(t.customer, F.col("user_id") == F.col("c_custkey"), "left")
    return R.integrity(rows, ["c_name"]).select("user_id", "event_id", "event_type", "intact")


@query("next_version_number", """
select c_custkey as document_id, coalesce(max(o_orderkey), 0) + 1 as next_version
from customer left join orders on c_custkey = o_custkey group by 1
""")
def next_version_number(t: Tables) -> DataFrame:
    """AGG-14. Greatest version and 1; 1 where there is none."""
    rows = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy(F.col("c_custkey").alias("document_id")).agg((F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("next_version"))


@query("current_version_flags", """
select o_custkey as document_id, o_orderkey as version_id,
       row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1 as is_current
from orders
""")
def current_version_flags(t: Tables) -> DataFrame:
    """SNK-13, JOIN-25. Exactly one version of each document is current, the latest."""
    own = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return t.orders.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_id"), (F.row_number().over(own) == 1).alias("is_current"))


@query("session_last_message", """
select conv_id as session_id, count(*) as message_count, max(turn) as last_turn,
       left(arg_max(text, turn), 512) as last_message_preview
from conversations group by 1
""")
def session_last_message(t: Tables) -> DataFrame:
    """AGG-15, SNK-14. What a session shows: number of messages and the beginning of the last one."""
    return t.conversations.groupBy(F.col("conv_id").alias("session_id")).agg(
        F.count("*").alias("message_count"), F.max("turn").alias("last_turn"), F.substring(F.max_by("text", "turn"), 1, 512).alias("last_message_preview")
    )


@query("ttl_cleanup", """
select event_id, ts, ts + interval 7 day as expires_at from events where ts + interval 7 day >= timestamp '2024-01-20'
""")
def ttl_cleanup(t: Tables) -> DataFrame:
    """SNK-12, STR-04, FLT-15. Rows that have not expired at a given time."""
    rows = t.events.select("event_id", "ts", (F.col("ts") + F.expr("interval 7 days")).alias("expires_at"))
    return rows.where(F.col("expires_at") >= F.lit("2024-01-20").cast("timestamp_ntz"))


@query("cache_hit_counts", """
select user_id as cache_id, count(*) filter (event_type = 'view') as hit_count, max(ts) as last_used_at from events group by 1
""")
def cache_hit_counts(t: Tables) -> DataFrame:
    """SNK-11. Counters from the log of hits rather than by updates in place."""
    return t.events.groupBy(F.col("user_id").alias("cache_id")).agg(F.count_if(F.col("event_type") == "view").alias("hit_count"), F.max("ts").alias("last_used_at"))


@query("runs_with_stages", """
select o_orderkey as run_id, count(*) as n_stages,
       string_agg(l_linenumber || ':' || l_linestatus, ',' order by l_linenumber, l_linestatus) as stages
from orders join lineitem on o_orderkey = l_orderkey where o_orderstatus = 'P' group by 1
""")
def runs_with_stages(t: Tables) -> DataFrame:
    """JOIN-11, TOP-08. Runs with their stage logs as an ordered list."""
    rows = t.orders.where("o_orderstatus = 'P'").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    stages = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_linestatus")))
    written = F.array_join(F.transform(stages, lambda s: F.concat_ws(":", s["l_linenumber"], s["l_linestatus"])), ",")
    return rows.groupBy(F.col("o_orderkey").alias("run_id")).agg(F.count("*").alias("n_stages"), written.alias("stages"))


@query("vector_upsert", """
select user_id as point_id, event_id as payload from events
qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1
""")
def vector_upsert(t: Tables) -> DataFrame:
    """SNK-03. The last write for each point wins."""
    return R.latest_per(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select(F.col("user_id").alias("point_id"), F.col("event_id").alias("payload"))


@query("rank_candidates", """
select o_custkey as message_id, o_orderkey as chunk_id, o_totalprice as score,
       cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as bigint) as rank
from orders
""")
def rank_candidates(t: Tables) -> DataFrame:
    """SNK-08, WIN-01. Candidates with their rank by score."""
    own = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.select(
        F.col("o_custkey").alias("message_id"), F.col("o_orderkey").alias("chunk_id"), F.col("o_totalprice").alias("score"),
        F.row_number().over(own).cast("long").alias("rank"),
    )


@query("user_search", """
select c_custkey as user_id, c_name as name from customer
where (contains(lower(c_name), '00001') or contains(lower(c_mktsegment), 'build')) and c_custkey not in (1, 2, 3)
""")
def user_search(t: Tables) -> DataFrame:
    """FLT-13, FLT-14. Containment in any of several columns, with some ids left out."""
    rows = t.customer.where(R.contains_any("00001", ["c_name"]) | R.contains_any("BUILD", ["c_mktsegment"]))
    return rows.where(~F.col("c_custkey").isin(1, 2, 3)).select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))


@query("representative_sample", """
with d as (
  select l_orderkey as version_id, l_linenumber as chunk_index, max(l_quantity) > 25 as is_heading from lineitem group by 1, 2
), b as (
  select *, min(chunk_index) over w as f, max(chunk_index) over w as e from d window w as (partition by version_id)
), h as (
  select *, is_heading and chunk_index > f and chunk_index < e as hd from b
), c as (
  select *, count(*) filter (hd) over (partition by version_id) as n_h,
         count(*) filter (hd) over (partition by version_id order by chunk_index) as r from h
), p as (
  select *, row_number() over (partition by version_id order by chunk_index) as k from c
  where chunk_index = f or chunk_index = e or (hd and (r - 1) % greatest(1, ceil(n_h / 2.0)::bigint) = 0)
)
select version_id, chunk_index from p where k <= 4
""")
def representative_sample(t: Tables) -> DataFrame:
    """WIN-07. First, every step-th heading and last."""
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("chunk_index")).agg((F.max("l_quantity") > 25).alias("is_heading"))
    return R.representatives(rows, "version_id", "chunk_index", F.col("is_heading"), 4).select("version_id", "chunk_index")


@query("topic_chunks_distinct", """
select distinct p_type as topic, s_nationkey as version_id from lineitem
join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
""")
def topic_chunks_distinct(t: Tables) -> DataFrame:
    """JOIN-06. Many-to-many join, each pair once."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(F.col("p_type").alias("topic"), F.col("s_nationkey").alias("version_id")).distinct()
