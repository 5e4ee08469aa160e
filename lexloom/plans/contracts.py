"""Contract-comparison queries. A customer's consecutive orders stand for versions of a value, consecutive
documents for versions of a contract whose lines are clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import contracts as C
from ..operators.extraction import table_cells
from ..operators.matching import best_first, in_order
from ..sources.tables import markdown_lines
from .registry import Tables, query

DELTAS = """v as (select o_custkey, o_orderkey, o_orderpriority, cast(o_totalprice as decimal(18,2)) as new,
  cast(lag(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey) as decimal(18,2)) as old from orders),
c as (select *, case when old <> 0 then round(((new - old) * 100)::double / old::double, 4) end as relative,
  case when new > old then 'INCREASED' when new < old then 'DECREASED' when new = old then 'UNCHANGED' else 'UNKNOWN' end as direction,
  case when o_orderpriority like '1%' then 'LIABILITY' when o_orderpriority like '2%' then 'PENALTY' when o_orderpriority like '3%' then 'PAYMENT' else 'OTHER' end as category,
  case when old is null then 'ADDED' else 'MODIFIED' end as change from v)"""
SCORED = f"""{DELTAS}, s as (select *, round(least(greatest(
  case category when 'LIABILITY' then 40.0 when 'PENALTY' then 30.0 when 'PAYMENT' then 26.0 else 12.0 end
  + case when direction = 'UNCHANGED' then 0 when category = 'LIABILITY' and direction = 'DECREASED' then 12 when category = 'LIABILITY' and direction = 'INCREASED' then -8
         when category = 'PENALTY' and direction = 'INCREASED' then 12 when category = 'PENALTY' and direction = 'DECREASED' then -8 else 4 end
  + case when relative is null then 4 when abs(relative) < 5 then 2 when abs(relative) < 15 then 6 when abs(relative) < 35 then 12 when abs(relative) < 60 then 18 else 24 end
  + case change when 'ADDED' then 8 else 0 end, 0), 100), 1)::double as score from c)"""


def _deltas(t: Tables) -> DataFrame:
    own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)").alias("new"), F.lag("o_totalprice").over(own).cast("decimal(18,2)").alias("old"))
    first = F.substring("o_orderpriority", 1, 1)
    category = F.when(first == "1", "LIABILITY").when(first == "2", "PENALTY").when(first == "3", "PAYMENT").otherwise("OTHER")
    relative = F.when(F.col("old") != 0, F.round(((F.col("new") - F.col("old")) * 100).cast("double") / F.col("old").cast("double"), 4))
    return rows.select(
        "o_custkey", "o_orderkey", "old", "new", relative.alias("relative"), F.coalesce(C.direction(F.col("old"), F.col("new")), F.lit("UNKNOWN")).alias("direction"),
        category.alias("category"), F.when(F.col("old").isNull(), "ADDED").otherwise("MODIFIED").alias("change"),
    )


def _scored(t: Tables) -> DataFrame:
    score = C.risk_score(F.col("category"), F.col("change"), F.col("direction"), F.col("relative"), F.lit(0), F.lit(1))
    return _deltas(t).withColumn("score", score)


@query("value_delta", f"with {DELTAS} select o_orderkey, (new - old)::double as delta, relative, direction from c")
def value_delta(t: Tables) -> DataFrame:
    """FN-08, FN-09. Change of a value from version to version."""
    return _deltas(t).select("o_orderkey", (F.col("new") - F.col("old")).cast("double").alias("delta"), "relative", "direction")


@query("risk_score", f"with {SCORED} select o_orderkey, category, score, case when score < 25 then 'LOW' when score < 50 then 'MEDIUM' when score < 75 then 'HIGH' else 'CRITICAL' end as level from s")
def risk_score(t: Tables) -> DataFrame:
    """CMP-16..19. Risk score and level of each change."""
    return _scored(t).select("o_orderkey", "category", "score", C.risk_level(F.col("score")).alias("level"))


@query("risk_counts", f"""
with {SCORED}, l as (select category, case when score < 25 then 'LOW' when score < 50 then 'MEDIUM' when score < 75 then 'HIGH' else 'CRITICAL' end as level from s)
select category, count(*) as n_total, count(*) filter (level = 'LOW') as n_low, count(*) filter (level = 'MEDIUM') as n_medium,
       count(*) filter (level = 'HIGH') as n_high, count(*) filter (level = 'CRITICAL') as n_critical from l group by 1
""")
def risk_counts(t: Tables) -> DataFrame:
    """AGG-33, AGG-35. Changes by level, levels without any included."""
    from ..operators.relational import status_counts

    rows = _scored(t).withColumn("level", C.risk_level(F.col("score")))
    return status_counts(rows, ["category"], "level", ["LOW", "MEDIUM", "HIGH", "CRITICAL"])


@query("strongest_change", f"""
with {DELTAS} select o_custkey, o_orderkey, relative from c
qualify row_number() over (partition by o_custkey order by coalesce(abs(relative), abs((new - old)::double), 0) desc, relative, o_orderkey) = 1
""")
def strongest_change(t: Tables) -> DataFrame:
    """TOP-13. The strongest change of each customer."""
    rows = _deltas(t).select("o_custkey", "o_orderkey", "relative", (F.col("new") - F.col("old")).cast("double").alias("delta"))
    own = Window.partitionBy("o_custkey").orderBy(F.desc(F.coalesce(F.abs("relative"), F.abs("delta"), F.lit(0.0))), "relative", "o_orderkey")
    return rows.withColumn("r", F.row_number().over(own)).where("r = 1").select("o_custkey", "o_orderkey", "relative")


CLAUSES = """k as (select distinct doc_id, sha256(lower(trim(line))) as key from (select doc_id, unnest(string_split(text, chr(10))) as line from documents)),
a as (select doc_id as pair, key from k where doc_id % 2 = 0), b as (select doc_id - 1 as pair, key from k where doc_id % 2 = 1)"""


@query("clause_diff", f"""
with {CLAUSES}, d as (select coalesce(a.pair, b.pair) as pair, case when a.key is null then 'ADDED' when b.key is null then 'REMOVED' else 'UNCHANGED' end as status
  from a full outer join b on a.pair = b.pair and a.key = b.key)
select pair, status, count(*) as n from d group by 1, 2
""")
def clause_diff(t: Tables) -> DataFrame:
    """CMP-11, SET-04, SET-05. Lines that one of two consecutive documents has and the other has not."""
    key = F.sha2(F.lower(F.btrim("line")).cast("binary"), 256)
    rows = markdown_lines(t.documents, "doc_id").select("doc_id", key.alias("key")).distinct()
    a = rows.where("doc_id % 2 = 0").select(F.col("doc_id").alias("pair"), "key", F.col("key").alias("print"))
    b = rows.where("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("pair"), "key", F.col("key").alias("print"))
    return C.clause_diff(a, b, ["pair", "key"], "print").groupBy("pair", "status").agg(F.count("*").alias("n"))


@query("numbers_in_text", """
with m as (select doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')) as raw from documents),
p as (select doc_id, raw, case when regexp_matches(raw, '^\\d{1,3}(\\.\\d{3})+$') then replace(raw, '.', '')
  when regexp_matches(raw, '^\\d{1,3}(,\\d{3})+(\\.\\d+)?$') then replace(raw, ',', '')
  when regexp_matches(raw, '^\\d{1,3}(\\.\\d{3})+,\\d+$') then replace(replace(raw, '.', ''), ',', '.')
  when regexp_matches(raw, '^\\d+,\\d{1,2}$') then replace(raw, ',', '.') else raw end as t from m)
select doc_id, raw, count(*) as n, max(try_cast(t as decimal(38,6)))::double as number from p group by 1, 2
""")
def numbers_in_text(t: Tables) -> DataFrame:
    """FN-04, FN-05. Numbers of a text in either notation."""
    rows = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]+(?:[.,][0-9]+)*"), F.lit(0))).alias("raw"))
    return rows.groupBy("doc_id", "raw").agg(F.count("*").alias("n"), F.max(C.parse_number(F.col("raw"))).cast("double").alias("number"))


def _versions(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Lines of even documents as source clauses, of the odd ones after them as target clauses."""
    rows = markdown_lines(t.documents, "doc_id").select("doc_id", F.col("line_no").alias("place"), F.lower(F.btrim("line")).alias("body"))
    a = rows.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "pair")
    return a, rows.where("doc_id % 2 = 1").withColumn("pair", F.col("doc_id") - 1).drop("doc_id")


PAIRED = """l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as place, lower(trim(unnest(string_split(text, chr(10))))) as body from documents),
a as (select doc_id as pair, place, body, row_number() over (partition by doc_id, body order by place) as n from l where doc_id % 2 = 0),
b as (select doc_id - 1 as pair, place, body, row_number() over (partition by doc_id, body order by place) as n from l where doc_id % 2 = 1)"""


@query("moved_lines", f"with {PAIRED} select pair, a.place as old_place, b.place as new_place from a join b using (pair, body, n) where a.place <> b.place")
def moved_lines(t: Tables) -> DataFrame:
    """WIN-30. Lines that stand elsewhere in the next document."""
    from ..operators.mapping import moved

    return moved(*_versions(t), "pair")


W = "list_distinct(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+'))"


@query("mapping_candidates", f"""
with {PAIRED}, s as (select pair, a.place as source, b.place as target, {W.format('a.body')} as x, {W.format('b.body')} as y from a join b using (pair) where abs(a.place - b.place) <= 4),
j as (select pair, source, target, round(case when len(list_distinct(list_concat(x, y))) = 0 then 0 else len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) end, 6) as score from s)
select pair, source, target, score from j qualify row_number() over (partition by pair, source order by score desc, abs(source - target), target) <= 8
""")
def mapping_candidates(t: Tables) -> DataFrame:
    """JOIN-18, CMP-06, both in part. Candidates of each clause among those near it, by word overlap alone."""
    from ..operators.mapping import candidates

    return candidates(*_versions(t), "pair").select("pair", "source", "target", "score")


@query("clause_mapping")
def clause_mapping(t: Tables) -> DataFrame:
    """JOIN-19. One-to-one mapping of lines in document order by word overlap."""
    from ..operators.mapping import candidates

    return in_order(candidates(*_versions(t), "pair").select("pair", "source", "target", "score"), ["pair"], 0.1)


STATUSES = ("MODIFIED", "ADDED", "AMBIGUOUS_MAPPING", "UNKNOWN")


@query("subtree_status", """
with recursive o as (select o_custkey as tree, row_number() over (partition by o_custkey order by o_orderkey) as node, o_orderkey from orders),
n as (select tree, node, case when node > 1 then greatest(1, node - 1 - node % 3) end as parent,
  case o_orderkey % 60 when 0 then 'MODIFIED' when 1 then 'ADDED' when 2 then 'AMBIGUOUS_MAPPING' when 3 then 'UNKNOWN' else 'UNCHANGED' end as status from o),
below as (
  select tree, node as top, node, status from n
  union all
  select b.tree, b.top, n.node, n.status from below b join n on n.tree = b.tree and n.parent = b.node
)
select n.tree, n.node, any_value(n.status) as status, case when bool_or(b.status in ('MODIFIED', 'ADDED')) then 'MODIFIED'
  when bool_or(b.status in ('AMBIGUOUS_MAPPING', 'UNKNOWN')) then 'AMBIGUOUS_MAPPING' else any_value(n.status) end as subtree_status
from n join below b on b.tree = n.tree and b.top = n.node group by 1, 2
""")
def subtree_status(t: Tables) -> DataFrame:
    """AGG-46. Orders of a customer as a tree of a dozen levels and more; what happened below decides a node's class."""
    node = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    rows = t.orders.select(F.col("o_custkey").alias("tree"), node.alias("node"), (F.col("o_orderkey") % 60).alias("r"))
    status = F.coalesce(F.get(F.array(*map(F.lit, STATUSES)), F.col("r").cast("int")), F.lit("UNCHANGED"))
    parent = F.when(F.col("node") > 1, F.greatest(F.lit(1), F.col("node") - 1 - F.col("node") % 3))
    return C.tree_status(rows.select("tree", "node", parent.alias("parent"), status.alias("status")), "tree", "node", "parent", "status").drop("parent")


@query("payload_tables", """
with i as (select l_orderkey as id, l_linenumber as line, cast(l_quantity as integer) as qty, l_returnflag as mode, l_linestatus as status from lineitem),
s as (select *, case id % 5 when 0 then '[' || line || ', ' || qty || ']' when 1 then '{"metric": "' || mode || '", "value": ' || qty || ', "context": "' || status || '"}'
  when 2 then '{"id": ' || line || ', "name": "' || mode || '"' else mode end as item from i),
l as (select *, row_number() over (partition by id order by line, item) - 1 as row_no from s),
c as (
  select id, row_no, unnest([0, 1]) as column_no, unnest(['line', null]) as header, unnest([line::varchar, qty::varchar]) as value from l where id % 5 = 0
  union all select id, row_no, unnest([0, 1, 2, 3]), unnest(['metric', 'value', 'unit', 'context']), unnest([mode, qty::varchar, null, status]) from l where id % 5 = 1
  union all select id, row_no, unnest([0, 1, 2, 3]), unnest(['id', 'name', 'type', 'description']), unnest([line::varchar, mode, 'ORG', null]) from l where id % 5 = 2
  union all select id, row_no, unnest([0, 1, 2]), unnest(['date_or_period', 'event', 'source_chunk_id']), unnest(['Q' || line, mode, id::varchar]) from l where id % 5 = 3
)
select id, cast(row_no as integer) as row_no, column_no, header, value from c
""")
def payload_tables(t: Tables) -> DataFrame:
    """FN-25. Cells of payloads of four shapes, one of them with a header too few; every fifth payload is broken off."""
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p[0].cast("string") for p in parts])
    line, qty, mode, status, order = ([F.col(c)] for c in ("l_linenumber", "qty", "l_returnflag", "l_linestatus", "l_orderkey"))
    kinds = (
        ("table", '{"headers": ["line"], "rows": [', said("[", line, ", ", qty, "]")), ("figures", '{"figures": [', said('{"metric": "', mode, '", "value": ', qty, ', "context": "', status, '"}')),
        ("entities", '{"entities": [', said('{"id": ', line, ', "name": "', mode, '", "type": "ORG", "description": null}')),
        ("timeline", '{"events": [', said('{"date_or_period": "Q', line, '", "event": "', mode, '", "source_chunk_id": ', order, "}")), ("figures", '{"figures": [{"metric": ', said(qty)),
    )
    which = F.col("l_orderkey") % 5
    pick = lambda k: F.element_at(F.array(*[F.lit(x[k]) if isinstance(x[k], str) else x[k] for x in kinds]), (which + 1).cast("int"))
    items = t.lineitem.withColumn("qty", F.col("l_quantity").cast("int")).select(F.col("l_orderkey").alias("id"), "l_linenumber", pick(0).alias("kind"), pick(1).alias("head"), pick(2).alias("item"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "item"))), lambda s: s["item"]), ", ")
    rows = items.groupBy("id", "kind", "head").agg(body.alias("body")).select("id", "kind", F.concat("head", "body", F.lit("]}")).alias("payload"))
    return table_cells(rows, "id", "kind", "payload")


#: Orders and parts of each supplier in 40 groups each, so that many want the same.
WANTED = """e as (select l_suppkey as supplier, l_orderkey % 40 as source, l_partkey % 40 as target, max(l_quantity)::double / 50 as score from lineitem group by 1, 2, 3)"""


def _wanted(t: Tables) -> DataFrame:
    score = (F.max("l_quantity").cast("double") / 50).alias("score")
    return t.lineitem.groupBy(F.col("l_suppkey").alias("supplier"), (F.col("l_orderkey") % 40).alias("source"), (F.col("l_partkey") % 40).alias("target")).agg(score)


@query("greedy_matching", f"""
with recursive {WANTED}, pick as (
  select supplier, []::bigint[] as sources, []::bigint[] as targets, null::struct(s bigint, t bigint, score double) as edge from e group by 1
  union all
  select p.supplier, list_append(p.sources, arg_max(e.source, (e.score, -e.source, -e.target))), list_append(p.targets, arg_max(e.target, (e.score, -e.source, -e.target))),
    {{'s': arg_max(e.source, (e.score, -e.source, -e.target)), 't': arg_max(e.target, (e.score, -e.source, -e.target)), 'score': max(e.score)}}
  from pick p join e on e.supplier = p.supplier and e.score >= 0.28 and not list_contains(p.sources, e.source) and not list_contains(p.targets, e.target)
  group by p.supplier, p.sources, p.targets
)
select supplier, edge.s as source, edge.t as target, edge.score as score from pick where edge is not null
""")
def greedy_matching(t: Tables) -> DataFrame:
    """JOIN-21. Contested pairs taken by best score, each side once, not below 0.28."""
    return best_first(_wanted(t), ["supplier"], 0.28)


@query("ordered_matching", f"""
with recursive {WANTED}, turn as (
  select supplier, -1::bigint as source, []::bigint[] as targets, null::bigint as target, null::double as score from e group by 1
  union all
  select p.supplier, p.source + 1, case when count(e.target) = 0 then p.targets else list_append(p.targets, arg_max(e.target, (e.score, -e.target))) end,
    arg_max(e.target, (e.score, -e.target)), max(e.score)
  from turn p left join e on e.supplier = p.supplier and e.source = p.source + 1 and e.score >= 0.28 and not list_contains(p.targets, e.target)
  where p.source < 39 group by p.supplier, p.source, p.targets
)
select supplier, source, target, score from turn where target is not null
""")
def ordered_matching(t: Tables) -> DataFrame:
    """JOIN-19. Sources in order take their best target that is still free."""
    return in_order(_wanted(t), ["supplier"], 0.28)


@query("citation_check", """
with o as (select o_custkey as message_id, o_orderkey as chunk_id, row_number() over (partition by o_custkey order by o_orderkey) as place from orders),
l as (select l_orderkey as chunk_id, min(l_linenumber) as retrieval_id from lineitem where l_quantity > 30 group by 1)
select message_id, o.chunk_id, retrieval_id, cast(row_number() over (partition by message_id order by place) - 1 as integer) as order_index
from o join l on o.chunk_id = l.chunk_id
""")
def citation_check(t: Tables) -> DataFrame:
    """SNK-09. References that the latest pass holds, numbered without gaps."""
    from ..sources.sinks import citation_rows

    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    refs = t.orders.select(F.col("o_custkey").alias("message_id"), F.col("o_orderkey").alias("chunk_id"), place.alias("place"), F.lit("x").alias("snippet"))
    held = t.lineitem.where("l_quantity > 30").groupBy(F.col("l_orderkey").alias("chunk_id")).agg(F.min("l_linenumber").alias("retrieval_id"))
    latest = held.join(refs.select("message_id", "chunk_id"), "chunk_id")
    return citation_rows(refs, latest).select("message_id", "chunk_id", "retrieval_id", "order_index")


@query("citation_reasons", """
with refs as (select item_id, text as snippet, item_id * 7 % 200 as doc_id from benchmark union all select b.item_id, b.text, d.doc_id from benchmark b join documents d on contains(d.text, b.text)),
n as (select *, row_number() over (partition by doc_id, snippet order by item_id) > 1 as repeated from refs),
norm as (select n.*, d.text,
  lower(trim(regexp_replace(regexp_replace(regexp_replace(snippet, '\\s+', ' ', 'g'), '\\s+([,.;:!?])', '\\1', 'g'), '([(\\[])\\s+', '\\1', 'g'))) as a,
  lower(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), '\\s+([,.;:!?])', '\\1', 'g'), '([(\\[])\\s+', '\\1', 'g'))) as b
  from n left join documents d using (doc_id))
select item_id, doc_id, case when text is null then 'missing_source' when trim(snippet) = '' then 'empty_snippet' when trim(text) = '' then 'empty_source'
  when not contains(b, a) then 'text_mismatch' when repeated then 'duplicate' else 'valid' end as reason from norm
""")
def citation_reasons(t: Tables) -> DataFrame:
    """VER-01, AGG-43. Why a citation doesn't hold."""
    from ..operators.mapping import citation_reason

    items = t.benchmark.select("item_id", F.col("text").alias("snippet"))
    guessed = items.withColumn("doc_id", F.col("item_id") * 7 % 200)
    found = t.documents.join(items, F.col("text").contains(F.col("snippet"))).select("item_id", "snippet", "doc_id")
    refs = guessed.select("item_id", "snippet", "doc_id").union(found)
    refs = refs.withColumn("repeated", F.row_number().over(Window.partitionBy("doc_id", "snippet").orderBy("item_id")) > 1)
    rows = refs.join(t.documents.select("doc_id", "text"), "doc_id", "left")
    reason = citation_reason(F.col("text").isNotNull(), F.lit(True), F.col("snippet"), F.col("text"), F.col("repeated"))
    return rows.select("item_id", "doc_id", reason.alias("reason"))
