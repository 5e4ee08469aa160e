"""Routing queries over user turns and the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import routing as R
from .registry import Tables, query

NORMAL = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(coalesce(text, ''))), '[''‘’′]s\\b', ' ', 'g'), '[''‘’′]', ' ', 'g'), '[^\\p{L}\\p{N}_\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_case = lambda rules, column, default: "case when " + column + " = '' then '" + default + "' " + " ".join(f"when regexp_matches({column}, '{p}') then '{n}'" for n, p in rules) + f" else '{default}' end"


@query("query_hash", f"with q as (select conv_id, turn, {NORMAL} as normalized from conversations) select conv_id, turn, normalized, sha256(normalized) as query_hash from q")
def query_hash(t: Tables) -> DataFrame:
    """TXT-01, FN-19. Normalised text of every turn and its hash."""
    rows = t.conversations.select("conv_id", "turn", X.normalize_query(F.col("text")).alias("normalized"))
    return rows.withColumn("query_hash", X.query_hash(F.col("normalized")))


@query("exact_cache_hits", f"""
with q as (select conv_id, turn, {NORMAL} as n from conversations where role = 'user')
select n as normalized, count(*) as n_asked, min(conv_id) as first_conv from q group by 1 having count(*) > 1
""")
def exact_cache_hits(t: Tables) -> DataFrame:
    """RTE-01, FLT-15. Questions that an exact cache would answer."""
    rows = t.conversations.where("role = 'user'").select("conv_id", X.normalize_query(F.col("text")).alias("normalized"))
    return rows.groupBy("normalized").agg(F.count("*").alias("n_asked"), F.min("conv_id").alias("first_conv")).where("n_asked > 1")


@query("route_by_rules", f"""
with q as (select conv_id, turn, role, {NORMAL} as n from conversations)
select conv_id, turn, {_case(R.RULES, 'n', 'complex')} as route,
       case when {' or '.join(f"regexp_matches(n, '{p}')" for p in R.CONTRACT)} then 'contract' when {' or '.join(f"regexp_matches(n, '{p}')" for p in R.OVERVIEW)} then 'overview' else 'focused' end as intent
from q
""")
def route_by_rules(t: Tables) -> DataFrame:
    """RTE-03, RTE-05, RTE-14. Route and intent of every turn."""
    rows = t.conversations.select("conv_id", "turn", X.normalize_query(F.col("text")).alias("n"))
    return rows.select("conv_id", "turn", R.route(F.col("n")).alias("route"), R.intent(F.col("n")).alias("intent"))


@query("agent_decision", f"""
with q as (select conv_id, turn, {NORMAL} as n from conversations),
r as (select conv_id, count(*) filter (role = 'user') as n_docs from conversations group by 1)
select conv_id, turn, case when regexp_matches(n, '\\b(count|total|average|sum|how many|list)\\b') then 'sql'
  when regexp_matches(n, '{R.MULTI_HOP}') or n_docs >= 3 then 'graph' else 'rewrite' end as agent
from q join r using (conv_id)
""")
def agent_decision(t: Tables) -> DataFrame:
    """RTE-15, RTE-16. Which agent would help a question."""
    rows = t.conversations.select("conv_id", "turn", X.normalize_query(F.col("text")).alias("n"))
    asked = t.conversations.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n_docs"))
    return rows.join(asked, "conv_id").select("conv_id", "turn", R.decide_agent(F.col("n"), F.col("n_docs")).alias("agent"))


@query("prompt_history", """
with h as (select conv_id, turn, role, text, lag(role) over (partition by conv_id order by turn) as before from conversations where role in ('user', 'assistant') and trim(text) <> '')
select conv_id, turn, case when role is distinct from before then role || ': ' else '' end || text as block from h
""")
def prompt_history(t: Tables) -> DataFrame:
    """WIN-28. Turns of a prompt; the speaker is named where it changes."""
    from pyspark.sql import Window

    rows = t.conversations.where(F.col("role").isin("user", "assistant") & (F.btrim("text") != ""))
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    block = F.concat(F.when(~F.col("role").eqNullSafe(before), F.concat("role", F.lit(": "))).otherwise(""), "text")
    return rows.select("conv_id", "turn", block.alias("block"))


@query("cost_estimate", """
select conv_id, round((sum(length(text) // 4) filter (role <> 'assistant') * 0.25 + sum(length(text) // 4) filter (role = 'assistant') * 1.25) / 1e6, 8) as cost_usd from conversations group by 1
""")
def cost_estimate(t: Tables) -> DataFrame:
    """FN-22, FN-23. Cost of a conversation by the light model's rates."""
    tokens = F.floor(F.length("text") / 4)
    rows = t.conversations.groupBy("conv_id").agg(
        F.sum(F.when(F.col("role") != "assistant", tokens)).alias("i"), F.sum(F.when(F.col("role") == "assistant", tokens)).alias("o")
    )
    return rows.select("conv_id", R.cost_usd(F.col("i"), F.col("o"), 0.25, 1.25).alias("cost_usd"))
