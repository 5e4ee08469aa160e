"""Evaluation and observability queries: classification scores, mixes, overviews, facets, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import Tables, query

FLAGS = """judged as (
  select l.doc_id, case when l.quality = 1 then 'good' else 'bad' end as expected,
         case when length(text) - length(translate(text, '#*$%&|<>!', '')) > 0.02 * length(text) then 'bad' else 'good' end as predicted
  from labels l join documents d using (doc_id)
),
classes as (select * from (values ('good'), ('bad')) v(label)),
counts as (
  select label, count(*) filter (expected = label and predicted = label) as tp, count(*) filter (expected <> label and predicted = label) as fp,
         count(*) filter (expected = label and predicted <> label) as fn, count(*) filter (expected <> label and predicted <> label) as tn
  from judged, classes group by 1
),
scores as (
  select *, case when tp + fp = 0 then 1.0 else tp / (tp + fp) end as precision, case when tp + fn = 0 then 1.0 else tp / (tp + fn) end as recall from counts
)"""


def _scores(t: Tables) -> DataFrame:
    """AGG-29. One-vs-rest counts and scores of each label; without cases a score is 1."""
    marks = F.length("text") - F.length(F.translate("text", "#*$%&|<>!", ""))
    rows = t.labels.join(t.documents, "doc_id").select(
        F.when(F.col("quality") == 1, "good").otherwise("bad").alias("expected"), F.when(marks > 0.02 * F.length("text"), "bad").otherwise("good").alias("predicted")
    )
    pairs = rows.groupBy("expected", "predicted").agg(F.count("*").alias("n"))
    labelled = pairs.select("*", F.explode(F.array(F.lit("good"), F.lit("bad"))).alias("label"))
    hit, said = F.col("expected") == F.col("label"), F.col("predicted") == F.col("label")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    counts = labelled.groupBy("label").agg(total(hit & said).alias("tp"), total(~hit & said).alias("fp"), total(hit & ~said).alias("fn"), total(~hit & ~said).alias("tn"))
    share = lambda a, b: F.when(b == 0, 1.0).otherwise(a / F.greatest(b, F.lit(1)))
    return counts.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))


@query("eval_metrics", f"""
with {FLAGS} select label, tp, fp, fn, tn, round(precision, 6) as precision, round(recall, 6) as recall,
  round(case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end, 6) as f1 from scores
""")
def eval_metrics(t: Tables) -> DataFrame:
    """AGG-29. A symbol heuristic against the quality labels."""
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p + r == 0, 0.0).otherwise(2 * p * r / F.greatest(p + r, F.lit(1e-12)))
    return _scores(t).select("label", "tp", "fp", "fn", "tn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


@query("eval_macro", f"""
with {FLAGS} select round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(sum(tp) / any_value(tp + fp + fn + tn), 6) as accuracy,
  round(max(case when label = 'bad' then fp / greatest(1, fp + tn) end), 6) as false_positive_rate from scores
""")
def eval_macro(t: Tables) -> DataFrame:
    """AGG-30. Macro averages, accuracy and the rate of false alarms."""
    alarm = F.when(F.col("label") == "bad", F.col("fp") / F.greatest(F.lit(1), F.col("fp") + F.col("tn")))
    return _scores(t).agg(
        F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall"),
        F.round(F.sum("tp") / F.max(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 6).alias("accuracy"), F.round(F.max(alarm), 6).alias("false_positive_rate"),
    )


@query("route_mix", """
with r as (select unnest(['view', 'click', 'signup', 'purchase', 'error', 'refund']) as route), c as (select event_type, count(*) as n from events group by 1)
select route, coalesce(n, 0) as n, round(coalesce(n, 0) / greatest(1, sum(n) over ()), 6) as share from r left join c on route = event_type
""")
def route_mix(t: Tables) -> DataFrame:
    """AGG-03, AGG-37. Counts of all routes, those without an event included, and their share."""
    from pyspark.sql import Window

    routes = t.spark.createDataFrame([(r,) for r in ("view", "click", "signup", "purchase", "error", "refund")], "route string")
    counts = t.events.groupBy(F.col("event_type").alias("route")).agg(F.count("*").alias("c"))
    rows = routes.join(counts, "route", "left").select("route", F.coalesce("c", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # a row for each route
    return rows.select("route", "n", F.round(F.col("n") / F.greatest(F.lit(1), total), 6).alias("share"))


@query("model_mix", """
with m as (select l_returnflag as model, count(*) as calls, sum(cast(l_extendedprice as decimal(18,2)))::double as cost from lineitem group by 1)
select model, calls, cost, round(cost / sum(cost) over (), 6) as share, round(cost / calls, 4) as cost_per_call from m
""")
def model_mix(t: Tables) -> DataFrame:
    """AGG-38. Each model's share of the cost and cost of a call."""
    from pyspark.sql import Window

    rows = t.lineitem.groupBy(F.col("l_returnflag").alias("model")).agg(F.count("*").alias("calls"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("cost"))
    total = F.sum("cost").over(Window.partitionBy())  # a row for each model
    return rows.select("model", "calls", "cost", F.round(F.col("cost") / total, 6).alias("share"), F.round(F.col("cost") / F.col("calls"), 4).alias("cost_per_call"))


@query("query_log_overview", """
select count(*) as n, round(count(*) filter (event_type = 'view') / count(*), 6) as hit_rate, round(avg(value), 4) as avg_latency,
       cast(sum(greatest(0, cast(json_extract_string(props, '$.k') as integer) - 50)) as bigint) as calls from events
""")
def query_log_overview(t: Tables) -> DataFrame:
    """AGG-39. Hit rate, mean latency without nulls, calls."""
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.agg(
        F.count("*").alias("n"), F.round(F.count_if(F.col("event_type") == "view") / F.count("*"), 6).alias("hit_rate"),
        F.round(F.avg("value"), 4).alias("avg_latency"), F.sum(F.greatest(F.lit(0), k - 50)).cast("long").alias("calls"),
    )


@query("pipeline_overview", """
select o_orderstatus as status, count(*) as n_runs, round(avg(case when o_orderstatus = 'F' then n_items end), 4) as avg_duration
from orders join (select l_orderkey, count(*) as n_items from lineitem group by 1) on l_orderkey = o_orderkey group by 1
""")
def pipeline_overview(t: Tables) -> DataFrame:
    """AGG-40. Runs by status, mean duration of those that are complete."""
    items = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n_items"))
    rows = t.orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n_runs"), F.round(F.avg(F.when(F.col("o_orderstatus") == "F", F.col("n_items"))), 4).alias("avg_duration"))


@query("facet_counts", """
select 'lang' as facet, lang as value, count(*) as n from documents where n_chars > 1000 group by 1, 2
union all select 'source', source, count(*) from documents where n_chars > 1000 and lang = 'en' group by 1, 2
""")
def facet_counts(t: Tables) -> DataFrame:
    """AGG-41. Each facet is counted under the other facets' filters, not under its own."""
    rows = t.documents.where("n_chars > 1000")
    facets = F.array(F.struct(F.lit("lang").alias("facet"), F.col("lang").alias("value"), F.lit(True).alias("ok")), F.struct(F.lit("source").alias("facet"), F.col("source").alias("value"), (F.col("lang") == "en").alias("ok")))
    return rows.select(F.explode(facets).alias("f")).where("f.ok").groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


@query("status_rollup", """
select o_custkey as service, case when bool_or(o_orderstatus = 'P') then 'unhealthy' when bool_or(o_orderstatus = 'O') and bool_or(o_orderstatus = 'F') then 'degraded'
  when bool_and(o_orderstatus = 'F') then 'healthy' else 'unknown' end as status from orders group by 1
""")
def status_rollup(t: Tables) -> DataFrame:
    """AGG-45. One status from many."""
    s = F.col("o_orderstatus")
    status = F.when(F.bool_or(s == "P"), "unhealthy").when(F.bool_or(s == "O") & F.bool_or(s == "F"), "degraded").when(F.bool_and(s == "F"), "healthy").otherwise("unknown")
    return t.orders.groupBy(F.col("o_custkey").alias("service")).agg(status.alias("status"))


@query("usage_per_modified", """
select conv_id, round(count(*) filter (role = 'assistant') / greatest(1, count(*) filter (role = 'user')), 6) as calls_per_question from conversations group by 1
""")
def usage_per_modified(t: Tables) -> DataFrame:
    """AGG-31, AGG-32. A rate whose denominator is at least 1."""
    answers, questions = F.count_if(F.col("role") == "assistant"), F.count_if(F.col("role") == "user")
    return t.conversations.groupBy("conv_id").agg(F.round(answers / F.greatest(F.lit(1), questions), 6).alias("calls_per_question"))
