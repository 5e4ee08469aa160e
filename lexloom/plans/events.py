"""Event-time queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import windows as S
from .registry import Tables, query


@query("fixed_window_rate", """
select user_id as tenant, cast(floor(epoch_us(ts) / 3600000000) as bigint) as window_no, count(*) as n, greatest(0, count(*) - 2) as n_rejected from events group by 1, 2
""")
def fixed_window_rate(t: Tables) -> DataFrame:
    """STR-01, STR-02, FN-28. Requests by tenant and hour, and those over two."""
    return S.rate_limit(t.events, "user_id", "ts", 2, 3600)


@query("tumbling_counts", """
select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by 1, 2
""")
def tumbling_counts(t: Tables) -> DataFrame:
    """Extension: events by hour and type."""
    rows = S.windowed_counts(t.events, "ts", ["event_type"], "1 hour")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("session_windows", """
with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts) as s from g)
select user_id, min(ts) as start, count(*) as n from s group by user_id, s
""")
def session_windows(t: Tables) -> DataFrame:
    """Extension: sessions that end after six hours."""
    rows = S.session_counts(t.events, "ts", ["user_id"], "6 hours")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("debounced_opens", """
select event_id from events qualify coalesce(ts - lag(ts) over (partition by user_id, event_type order by ts, event_id) >= interval 60 minute, true)
""")
def debounced_opens(t: Tables) -> DataFrame:
    """CMP-27. Events that follow their like by an hour or more."""
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    rows = t.events.withColumn("before", before)
    return rows.where(F.coalesce(F.col("ts") - F.col("before") >= F.expr("interval 60 minutes"), F.lit(True))).select("event_id")


@query("answer_stream", """
with a as (select conv_id * 1000 + turn as id, text, greatest(1, ceil(length(text) / 24.0)::bigint) as n from conversations where role = 'assistant')
select id, n + 2 as n_events, substr(text, 1, 24) as first_piece from a
""")
def answer_stream(t: Tables) -> DataFrame:
    """STR-03. Events of every streamed answer."""
    rows = t.conversations.where("role = 'assistant'").select(F.struct("conv_id", "turn").alias("answer"), "text")
    events = S.answer_events(rows, "answer", "text").groupBy("answer").agg(F.count("*").alias("n_events"), F.max(F.when(F.col("seq") == 1, F.col("data"))).alias("first_piece"))
    return events.select((F.col("answer.conv_id") * 1000 + F.col("answer.turn")).alias("id"), "n_events", "first_piece")
