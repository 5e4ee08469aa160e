"""Queries on partial dates, progress, structure and typed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import partial_date, preset, timeline_order
from ..operators.legal import markers, parents
from ..operators.lines import html_headings
from ..sources.tables import markdown_lines
from .ingestion import HEADINGS, LINES
from .registry import Tables, query

WRITTEN = """w as (select o_orderkey as id, o_custkey as owner, case o_orderkey % 5 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%d/%m/%Y')
  when 2 then strftime(o_orderdate, '%Y-%m') when 3 then 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) else strftime(o_orderdate, '%Y') end as period, o_orderdate from orders),
p as (select *, case id % 5 when 0 then 'day' when 1 then 'day' when 2 then 'month' when 3 then 'quarter' else 'year' end as precision,
  cast(case id % 5 when 0 then o_orderdate when 1 then o_orderdate when 2 then date_trunc('month', o_orderdate) when 3 then date_trunc('quarter', o_orderdate) else date_trunc('year', o_orderdate) end as date) as first_day from w)"""


def _periods(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    quarter = F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit(" "), F.year(d).cast("string"))
    kind = F.col("o_orderkey") % 5
    period = F.when(kind == 0, F.date_format(d, "yyyy-MM-dd")).when(kind == 1, F.date_format(d, "dd/MM/yyyy")).when(kind == 2, F.date_format(d, "yyyy-MM")).when(kind == 3, quarter).otherwise(F.date_format(d, "yyyy"))
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), period.alias("period"))


@query("partial_dates", f"with {WRITTEN} select id, period, precision, strftime(first_day, '%Y-%m-%d') as first_day from p")
def partial_dates(t: Tables) -> DataFrame:
    """FN-01, FN-02. Precision and first day of dates and periods in several notations."""
    precision, date = partial_date(F.col("period"))
    return _periods(t).select("id", "period", precision.alias("precision"), date.cast("string").alias("first_day"))


@query("timeline_sort", f"""
with {WRITTEN} select owner, id, cast(row_number() over (partition by owner order by first_day, case precision when 'year' then 0 when 'quarter' then 1 when 'month' then 2 else 3 end, period, id) as integer) as place from p
""")
def timeline_sort(t: Tables) -> DataFrame:
    """TOP-09. Events of each owner in order, coarser periods before finer ones."""
    own = Window.partitionBy("owner").orderBy(*timeline_order(F.col("period")), "id")
    return _periods(t).select("owner", "id", F.row_number().over(own).alias("place"))


@query("date_presets", """
select event_type, count(*) filter (ts > timestamp '2024-01-25' - interval 7 day and ts <= timestamp '2024-01-25') as last_week,
       count(*) filter (ts >= timestamp '2024-01-01' and ts <= timestamp '2024-01-25') as this_month,
       count(*) filter (ts >= timestamp '2023-12-01' and ts < timestamp '2024-01-01') as last_month from events group by 1
""")
def date_presets(t: Tables) -> DataFrame:
    """FN-30, FLT-10, FLT-19. Counts in preset windows before a given time."""
    now = F.lit("2024-01-25").cast("timestamp_ntz")
    return t.events.groupBy("event_type").agg(*[
        F.count_if(preset(F.col("ts"), now, p)).alias(name) for p, name in (("7d", "last_week"), ("month", "this_month"), ("previous", "last_month"))
    ])


@query("stage_progress", """
with s as (select unnest(['view', 'click', 'signup', 'purchase']) as stage, unnest([1, 2, 3, 4]) as step),
u as (select distinct user_id from events), l as (select user_id, event_type, max(ts) as ts, count(*) as n from events group by 1, 2)
select u.user_id, stage, step, coalesce(n, 0) as n, ts, n is null as pending from u cross join s left join l on l.user_id = u.user_id and event_type = stage
""")
def stage_progress(t: Tables) -> DataFrame:
    """WIN-31. The last log of each stage of a run; stages without one are pending."""
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(k + 1).alias("step")) for k, s in enumerate(("view", "click", "signup", "purchase"))])
    runs = t.events.select("user_id").distinct().select("user_id", F.explode(stages).alias("s")).select("user_id", "s.*")
    logs = t.events.groupBy("user_id", F.col("event_type").alias("stage")).agg(F.max("ts").alias("ts"), F.count("*").alias("n"))
    rows = runs.join(logs, ["user_id", "stage"], "left")
    return rows.select("user_id", "stage", "step", F.coalesce("n", F.lit(0)).alias("n"), "ts", F.col("n").isNull().alias("pending"))


@query("heading_parents", f"""
with {HEADINGS} select h.page_id, h.position, (select max(a.position) from headings a where a.page_id = h.page_id and a.position < h.position and a.level < h.level) as parent from headings h
""")
def heading_parents(t: Tables) -> DataFrame:
    """WIN-06, RTE-11. The heading that each heading stands under."""
    return parents(html_headings(t.pages, "page_id", "html"), "page_id", "position").select("page_id", "position", "parent")


@query("values_by_type", """
with m as (select doc_id, text, unnest(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*%?')) as raw, generate_subscripts(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*%?'), 1) as k from documents),
y as (select doc_id, k, raw, case when contains(raw, '%') then 'PERCENTAGE' when regexp_matches(raw, '[.,]') then 'DECIMAL' when length(raw) >= 10 then 'IDENTIFIER' else 'NUMBER' end as type from m)
select doc_id, raw, type, cast(row_number() over (partition by doc_id, type order by k) as integer) as index_in_type from y
""")
def values_by_type(t: Tables) -> DataFrame:
    """WIN-23, FN-05. Values of each document numbered within their type."""
    rows = t.documents.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[0-9]+(?:[.,][0-9]+)*%?"), F.lit(0))).alias("k", "raw"))
    kind = F.when(F.col("raw").contains("%"), "PERCENTAGE").when(F.col("raw").rlike("[.,]"), "DECIMAL").when(F.length("raw") >= 10, "IDENTIFIER").otherwise("NUMBER")
    rows = rows.withColumn("type", kind)
    own = Window.partitionBy("doc_id", "type").orderBy("k")
    return rows.select("doc_id", "raw", "type", F.row_number().over(own).alias("index_in_type"))


@query("median_sizes", f"with {LINES} select doc_id, median(length(line)) as median_chars, max(length(line)) as longest from lines group by 1")
def median_sizes(t: Tables) -> DataFrame:
    """FN-32. Median length of each document's lines."""
    return markdown_lines(t.documents, "doc_id").groupBy("doc_id").agg(F.median(F.length("line")).alias("median_chars"), F.max(F.length("line")).cast("long").alias("longest"))


@query("json_payloads", """
select cast(json_extract_string(props, '$.k') as integer) % 10 as bucket, count(*) as n, round(sum(value), 4) as total from events group by 1
""")
def json_payloads(t: Tables) -> DataFrame:
    """FN-24, FN-26. Objects of a known shape parsed from text."""
    k = F.from_json("props", "k int")["k"]
    return t.events.groupBy((k % 10).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("legal_markers", f"""
with {LINES} select doc_id, line_no, case when regexp_matches(line, '(?i)^\\s*(?:chương|chapter)\\s+([ivxlc]+|\\d+)\\b') then 'CHAPTER'
  when regexp_matches(line, '(?i)^\\s*(?:phụ lục|appendix|annex)\\s+([a-z]|\\d+)\\b') then 'APPENDIX' when regexp_matches(line, '(?i)^\\s*(?:mục|section)\\s+([ivxlc]+|\\d+(?:\\.\\d+)*)\\b') then 'SECTION'
  when regexp_matches(line, '(?i)^\\s*(?:điều|article)\\s+(\\d+)\\b') then 'ARTICLE' when regexp_matches(line, '^\\s*(\\d+\\.\\d+(?:\\.\\d+)*)\\.?\\s+\\S') then 'CLAUSE'
  when regexp_matches(line, '^\\s*([a-zđ])\\)\\s+\\S') then 'POINT' end as type
from lines where type is not null and not regexp_matches(line, '^\\s*\\|')
""")
def legal_markers(t: Tables) -> DataFrame:
    """CMP-02, TXT-33. Lines that begin a unit of a legal text."""
    return markers(markdown_lines(t.documents, "doc_id"), "doc_id").select("doc_id", "line_no", "type")
