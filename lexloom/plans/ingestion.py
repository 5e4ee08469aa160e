"""Queries over the text of documents and pages: lines, cleaning, headings, blocks, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking as C
from ..operators import headers as H
from ..operators import lines as L
from ..sources.tables import detect_file_type, markdown_lines
from .registry import Tables, query

LINES = """lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents
)"""
HEADINGS = """tags as (
  select page_id, unnest(t) as tag, generate_subscripts(t, 1) as position
  from (select page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') as t from pages)
), headings as (
  select page_id, position, cast(substr(tag, 3, 1) as integer) as level,
         trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(tag, '<[^>]*>', '', 'g'),
           '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) as title
  from tags
)"""
KEY = "case when trim(line) <> '' and not regexp_matches(line, '^#{1,6}\\s+\\S') and not regexp_matches(line, '^\\s*\\|.*\\|\\s*$') and length(trim(line)) <= 120 then lower(regexp_replace(trim(line), '\\s+', ' ', 'g')) end"


@query("line_explode", f"with {LINES} select doc_id, line_no, line from lines")
def line_explode(t: Tables) -> DataFrame:
    """SRC-15, CMP-01. Numbered lines of every document."""
    return markdown_lines(t.documents, "doc_id")


@query("repeated_lines_removed", f"""
with {LINES}, k as (select *, {KEY} as key from lines), c as (select *, count(*) over (partition by doc_id, key) as n from k)
select doc_id, line_no, line from c where key is null or n < 3
""")
def repeated_lines_removed(t: Tables) -> DataFrame:
    """AGG-18, TXT-07. Short lines that a document repeats three times or more are dropped."""
    return L.drop_running_lines(markdown_lines(t.documents, "doc_id"), "doc_id")


@query("cleaning_stats", f"""
with {LINES}, k as (select *, {KEY} as key from lines), c as (select *, count(*) over (partition by doc_id, key) as n from k)
select d.doc_id, length(any_value(d.text)) as chars_before, count(*) as lines_before,
       count(*) filter (key is null or n < 3) as lines_after,
       count(*) filter (key is not null and n >= 3) as lines_removed
from c join documents d using (doc_id) group by 1
""")
def cleaning_stats(t: Tables) -> DataFrame:
    """AGG-22. Lines and characters of each document before and after cleaning."""
    docs = t.documents.select("doc_id", F.length("text").alias("chars_before"), F.size(F.split("text", "\n", -1)).cast("long").alias("lines_before"))
    after = L.drop_running_lines(markdown_lines(t.documents, "doc_id"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("lines_after"))
    rows = docs.join(after, "doc_id", "left").withColumn("lines_after", F.coalesce("lines_after", F.lit(0)).cast("long"))
    return rows.select("doc_id", F.col("chars_before").cast("long").alias("chars_before"), "lines_before", "lines_after", (F.col("lines_before") - F.col("lines_after")).alias("lines_removed"))


@query("structure_metrics", f"""
with {LINES}
select doc_id, count(*) as n_lines, count(*) filter (regexp_matches(line, '^#{{1,6}}\\s+\\S')) as n_headings,
       count(*) filter (regexp_matches(line, '^\\s*\\|.*\\|\\s*$')) as n_table_rows,
       count(*) filter (regexp_matches(line, '^\\s*[-*+]\\s+')) as n_list_items,
       cast(sum(len(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}_]+'))) as bigint) as n_words, cast(sum(length(line)) as bigint) as n_chars
from lines group by 1
""")
def structure_metrics(t: Tables) -> DataFrame:
    """AGG-20, WIN-11. What each document is made of."""
    return L.markdown_metrics(markdown_lines(t.documents, "doc_id"), "doc_id")


@query("blank_runs_collapsed", f"""
with {LINES}, b as (select *, trim(line) = '' as blank from lines),
c as (select *, lag(blank) over (partition by doc_id order by line_no) as was from b)
select doc_id, count(*) as n_lines from c where not blank or not coalesce(was, false) group by 1
""")
def blank_runs_collapsed(t: Tables) -> DataFrame:
    """WIN-13. Lines left when runs of blank lines become one."""
    return L.collapse_blank_lines(markdown_lines(t.documents, "doc_id"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query("table_delimiters", f"""
with {LINES}, r as (select *, regexp_matches(line, '^\\s*\\|.*\\|\\s*$') as is_row, regexp_matches(line, '^\\s*\\|(\\s*:?-+:?\\s*\\|)+\\s*$') as is_delimiter from lines),
w as (select *, coalesce(lag(is_row) over (partition by doc_id order by line_no), false) as was_row,
             coalesce(lead(is_delimiter) over (partition by doc_id order by line_no), false) as delimiter_follows from r)
select doc_id, count(*) + count(*) filter (is_row and not was_row and not delimiter_follows) as n_lines from w group by 1
""")
def table_delimiters(t: Tables) -> DataFrame:
    """WIN-14. Lines of each document once its pipe tables have delimiter rows."""
    return L.insert_table_delimiters(markdown_lines(t.documents, "doc_id"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query("soft_line_paragraphs", f"""
with {LINES}, b as (select *, lag(line) over (partition by doc_id order by line_no) as before from lines),
s as (select *, case when before is not null and not regexp_matches(before, '[.!?:;…]\\s*$') and regexp_matches(line, '^\\s*\\p{{Ll}}') then 0 else 1 end as new from b),
p as (select *, sum(new) over (partition by doc_id order by line_no) as paragraph from s)
select doc_id, cast(paragraph as bigint) as paragraph, string_agg(trim(line), ' ' order by line_no) as content, count(*) as n_lines from p group by 1, 2
""")
def soft_line_paragraphs(t: Tables) -> DataFrame:
    """WIN-22. Soft line breaks joined."""
    return L.join_soft_lines(markdown_lines(t.documents, "doc_id"), "doc_id")


@query("text_blocks", f"""
with {LINES}, k as (select *, case when trim(line) = '' then 'blank' when regexp_matches(line, '^#{{1,6}}\\s+\\S') then 'heading'
  when regexp_matches(line, '^\\s*\\|.*\\|\\s*$') then 'table' when regexp_matches(line, '^\\s*([-*+]|\\d+[.)])\\s+') then 'list' else 'paragraph' end as kind from lines),
n as (select *, case when coalesce(kind <> lag(kind) over (partition by doc_id order by line_no), true) or kind = 'heading' then 1 else 0 end as new from k),
b as (select *, sum(new) over (partition by doc_id order by line_no) as block from n)
select doc_id, cast(block as bigint) as block, kind, min(line_no) as first_line, count(*) as n_lines, string_agg(line, chr(10) order by line_no) as content
from b where kind <> 'blank' group by doc_id, block, kind
""")
def text_blocks(t: Tables) -> DataFrame:
    """WIN-12, SRC-17. Blocks of lines of one kind."""
    return L.blocks(markdown_lines(t.documents, "doc_id"), "doc_id")


@query("html_headings", f"with {HEADINGS} select page_id, position, level, title from headings")
def html_headings(t: Tables) -> DataFrame:
    """SRC-16. Headings of pages."""
    return L.html_headings(t.pages, "page_id", "html")


@query("heading_paths", f"""
with {HEADINGS}
select h.page_id, h.position, h.level, h.title,
  (select string_agg(a.title, ' > ' order by a.position) from headings a where a.page_id = h.page_id and a.position <= h.position and a.level <= h.level
     and not exists (select 1 from headings b where b.page_id = a.page_id and b.position > a.position and b.position <= h.position and b.level <= a.level)) as heading_path,
  (select min(b.position) from headings b where b.page_id = h.page_id and b.position > h.position and b.level <= h.level) as section_end
from headings h
""")
def heading_paths(t: Tables) -> DataFrame:
    """WIN-03, WIN-04, WIN-05. Each heading's path from the top and where its section ends."""
    rows = L.heading_paths(L.html_headings(t.pages, "page_id", "html"), "page_id", "position")
    return L.section_ends(rows, "page_id", "position")


@query("char_windows", """
with w as (select doc_id, text, unnest(generate_series(0, greatest(0, ceil((length(text) - 1000) / 850.0)::bigint))) as k from documents where length(text) > 0)
select doc_id, cast(k * 850 as integer) as start, substr(text, (k * 850 + 1)::bigint, 1000) as content from w
""")
def char_windows(t: Tables) -> DataFrame:
    """WIN-18. Windows of 1000 characters that share 150 with the next."""
    return t.documents.select("doc_id", F.explode(C.windows(F.col("text"), 1000, 150)).alias("w")).select("doc_id", "w.start", "w.content")


@query("token_windows", """
with d as (select doc_id, string_split_regex(trim(text), '\\s+') as toks from documents),
w as (select doc_id, toks, unnest(generate_series(0, greatest(0, ceil((len(toks) - 128) / 113.0)::bigint))) as k from d)
select doc_id, cast(k * 113 as integer) as start, cast(len(toks[(k * 113 + 1)::bigint:(k * 113 + 128)::bigint]) as integer) as n_tokens from w
""")
def token_windows(t: Tables) -> DataFrame:
    """WIN-19. Windows of 128 white space tokens with an overlap of 12 %."""
    tokens = F.split(F.btrim("text"), r"\s+")
    rows = t.documents.select("doc_id", F.explode(C.token_windows(tokens, 128)).alias("w"))
    return rows.select("doc_id", "w.start", F.size("w.tokens").alias("n_tokens"))


@query("exact_duplicates", """
select sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) as fingerprint, count(*) as n, min(doc_id) as first_doc
from documents group by 1 having count(*) > 1
""")
def exact_duplicates(t: Tables) -> DataFrame:
    """TXT-34. Groups of documents with one fingerprint."""
    rows = t.documents.groupBy(X.content_fingerprint(F.col("text")).alias("fingerprint")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    return rows.where("n > 1")


@query("leading_text_dedupe", """
select doc_id, n_chars from documents
qualify row_number() over (partition by left(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g'), 160) order by doc_id) = 1
""")
def leading_text_dedupe(t: Tables) -> DataFrame:
    """WIN-10. The first document of those whose first 160 normalised characters are the same."""
    key = F.substring(F.regexp_replace(F.lower(F.btrim("text")), r"\s+", " "), 1, 160)
    rows = t.documents.select("doc_id", "n_chars", key.alias("key"))
    return rows.groupBy("key").agg(F.min_by(F.struct("doc_id", "n_chars"), "doc_id").alias("first")).select("first.*")


@query("sentence_split")
def sentence_split(t: Tables) -> DataFrame:
    """TXT-12. Sentences of every document; the pattern looks behind, which DuckDB's engine can't."""
    rows = t.documents.select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("at", "sentence"))
    return rows.select("doc_id", "at", "sentence")


@query("paragraph_split", """
with p as (select doc_id, list_filter(list_transform(string_split_regex(text, '\\n[ \\t\\r]*\\n\\s*'), lambda x: trim(x)), lambda x: x <> '') as l from documents)
select doc_id, len(l) as n_paragraphs, coalesce(l[1], '') as first_paragraph from p
""")
def paragraph_split(t: Tables) -> DataFrame:
    """TXT-13, SRC-05. Paragraphs between blank lines."""
    parts = F.filter(F.transform(F.split("text", r"\n[ \t\r]*\n\s*"), lambda s: F.btrim(s)), lambda p: p != "")
    rows = t.documents.select("doc_id", parts.alias("l"))
    return rows.select("doc_id", F.size("l").cast("long").alias("n_paragraphs"), F.coalesce(F.try_element_at("l", F.lit(1)), F.lit("")).alias("first_paragraph"))


@query("estimated_tokens", """
select lang, cast(sum(case when length(text) = 0 then 0 else greatest(1, length(text) // 4) end) as bigint) as n_tokens,
       max(greatest(1, length(text) // 4)) as most from documents group by 1
""")
def estimated_tokens(t: Tables) -> DataFrame:
    """TXT-17, AGG-21. Estimated tokens by language."""
    n = X.estimated_tokens(F.col("text"))
    return t.documents.groupBy("lang").agg(F.sum(n).alias("n_tokens"), F.max(n).alias("most"))


@query("pack_units")
def pack_units(t: Tables) -> DataFrame:
    """WIN-15, WIN-16, WIN-17. Sentences of every document packed into chunks of 500 to 800 estimated tokens."""
    units = t.documents.select("doc_id", X.sentences(F.col("text")).alias("units"))
    sizes = F.transform("units", X.estimated_tokens)
    rows = units.withColumn("chunk", C.pack_units(sizes)).select("doc_id", F.posexplode(F.arrays_zip("units", "chunk")).alias("at", "u"))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "u.units"))), lambda s: s["units"]), "\n\n")
    return rows.groupBy("doc_id", F.col("u.chunk").alias("chunk_index")).agg(F.count("*").alias("n_units"), content.alias("content"))


@query("packed_lines", f"""
with recursive {LINES}, s as (select doc_id, line_no, greatest(1, length(line) // 4) as size from lines where length(line) > 0),
o as materialized (select doc_id, row_number() over (partition by doc_id order by line_no) as k, size from s),
b as (
  select doc_id, k, size as used, 0 as chunk from o where k = 1
  union all
  select o.doc_id, o.k, case when b.used + 1 + o.size <= 160 or (b.used + 1 + o.size <= 200 and b.used < 100) then b.used + 1 + o.size else least(b.used, 20) + 1 + o.size end,
         case when b.used + 1 + o.size <= 160 or (b.used + 1 + o.size <= 200 and b.used < 100) then b.chunk else b.chunk + 1 end
  from b join o on o.doc_id = b.doc_id and o.k = b.k + 1
)
select doc_id, chunk, count(*) as n_units, min(k) as first_unit from b group by 1, 2
""")
def packed_lines(t: Tables) -> DataFrame:
    """WIN-15. Lines of every document packed into chunks of 100 to 160 estimated tokens, 200 at most, with an overlap of 20."""
    units = F.filter(F.split("text", "\n", -1), lambda x: F.length(x) > 0)
    chunks = C.pack_units(F.transform(units, X.estimated_tokens), 100, 160, 200, 1, 20)
    rows = t.documents.select("doc_id", F.posexplode(chunks).alias("at", "chunk"))
    return rows.groupBy("doc_id", "chunk").agg(F.count("*").alias("n_units"), (F.min("at") + 1).cast("long").alias("first_unit"))


@query("batch_assignment", f"""
with recursive {LINES}, s as (select doc_id, line_no, greatest(1, length(line) // 4) as size from lines where length(line) > 0),
o as (select doc_id, row_number() over (partition by doc_id order by line_no) as k, size from s),
b as (
  select doc_id, k, size as used, 0 as batch from o where k = 1
  union all
  select o.doc_id, o.k, case when b.used > 0 and b.used + o.size > 400 then o.size else b.used + o.size end,
         case when b.used > 0 and b.used + o.size > 400 then b.batch + 1 else b.batch end
  from b join o on o.doc_id = b.doc_id and o.k = b.k + 1
)
select doc_id, batch, count(*) as n_units from b group by 1, 2
""")
def batch_assignment(t: Tables) -> DataFrame:
    """WIN-26, WIN-20. Lines of every document dealt to batches of at most 400 estimated tokens."""
    units = F.filter(F.split("text", "\n", -1), lambda x: F.length(x) > 0)
    rows = t.documents.select("doc_id", C.batches(F.transform(units, X.estimated_tokens), 400).alias("batches"))
    return rows.select("doc_id", F.explode("batches").alias("batch")).groupBy("doc_id", "batch").agg(F.count("*").alias("n_units"))


@query("context_budget", f"""
with {LINES}, s as (select doc_id, line_no, line, case when length(line) = 0 then 0 else greatest(1, length(line) // 4) end as tokens from lines),
b as (select *, coalesce(sum(tokens) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as before from s)
select doc_id, line_no, tokens > 300 - before as is_cut,
       case when tokens <= 300 - before then line else substr(line, 1, cast(4 * (300 - before) as bigint)) end as line
from b where tokens <= 300 - before or 300 - before >= 64
""")
def context_budget(t: Tables) -> DataFrame:
    """WIN-25, WIN-27. The lines of each document that fit 300 tokens, the last one cut."""
    rows = markdown_lines(t.documents, "doc_id").withColumn("tokens", X.estimated_tokens(F.col("line")))
    kept = C.fit_prefix(rows, ["doc_id"], [F.col("line_no")], "tokens", "line", 300)
    return kept.select("doc_id", "line_no", "is_cut", "line")


@query("lost_in_middle_order", """
with r as (select doc_id, source, n_chars, row_number() over (partition by source order by n_chars desc, doc_id) as r, count(*) over (partition by source) as n from documents)
select source, doc_id, case when r % 2 = 1 then (r + 1) // 2 else n - r // 2 + 1 end as place from r
""")
def lost_in_middle_order(t: Tables) -> DataFrame:
    """WIN-08. The strongest at both ends, the weakest in the middle."""
    own = Window.partitionBy("source")
    r, n = F.row_number().over(own.orderBy(F.desc("n_chars"), "doc_id")), F.count("*").over(own)
    rows = t.documents.select("source", "doc_id", r.alias("r"), n.alias("n"))
    place = F.when(F.col("r") % 2 == 1, F.floor((F.col("r") + 1) / 2)).otherwise(F.col("n") - F.floor(F.col("r") / 2) + 1)
    return rows.select("source", "doc_id", place.alias("place"))


@query("hash_embedding")
def hash_embedding(t: Tables) -> DataFrame:
    """FN-16. A deterministic unit vector for every document."""
    from ..functions.vectors import hash_embedding as embed

    return t.documents.select("doc_id", embed(64)(F.col("text")).alias("embedding"))


@query("gram_embedding")
def gram_embedding(t: Tables) -> DataFrame:
    """FN-17. A hashed n-gram vector for every user turn."""
    from ..functions.vectors import gram_embedding as embed

    return t.conversations.where("role = 'user'").select("conv_id", "turn", embed(64)(F.col("text")).alias("embedding"))


@query("file_types_of_urls", """
with f as (select lower(regexp_extract(lower(regexp_replace(url, '[?#].*$', '')), '\\.([a-z0-9]+)$', 1)) as e from pages)
select case when e in ('pdf', 'docx', 'xlsx', 'pptx', 'txt') then e end as file_type, count(*) as n from f group by 1
""")
def file_types_of_urls(t: Tables) -> DataFrame:
    """SRC-01. Known file types by extension."""
    rows = t.pages.select(detect_file_type(F.regexp_replace("url", r"[?#].*$", "")).alias("file_type"))
    return rows.groupBy("file_type").agg(F.count("*").alias("n"))


@query("running_headers", f"""
with {LINES}, k as (select source, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) as l, line from lines join documents using (doc_id)),
h as (select source, regexp_replace(regexp_replace(l, '\\b\\d{{1,2}}[/.-]\\d{{1,2}}[/.-]\\d{{2,4}}\\b', '<date>', 'g'), '\\d+', '#', 'g') as key, line from k),
c as (select source, key, count(*) as n, min(line) as line from h group by 1, 2),
r as (select *, n / sum(n) over (partition by source) as share, row_number() over (partition by source order by n desc, key) as rank from c)
select source, key, n, line, round(share, 6) as share from r where rank = 1 and share >= 0.005
""")
def running_headers(t: Tables) -> DataFrame:
    """AGG-19 in part, TXT-08. The most frequent line of each source, digits and dates aside."""
    rows = markdown_lines(t.documents, "doc_id").join(t.documents.select("doc_id", "source"), "doc_id")
    found = L.majority_line(rows, ["source"], "line", 0.005)
    return found.select("source", "key", "n", "line", F.round("share", 6).alias("share"))


EDGES = """
e as (select doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as l from documents),
edges as (select doc_id, source, 'header' as edge, l[1] as line from e where len(l) > 0
          union all select doc_id, source, 'footer', l[-1] from e where len(l) > 1),
k as (select *, strip_accents(regexp_replace(regexp_replace(lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))),
  '\\b\\d{1,2}[/.-]\\d{1,2}[/.-]\\d{2,4}\\b', '<date>', 'g'), '\\d+', '#', 'g')) as key from edges),
x as (select source, edge, key, line, count(*) as n from k where length(line) between 3 and 120 and key <> '' group by all),
g as (select source, edge, key, sum(n)::bigint as n, first(line order by n desc, line) as line from x group by all),
t as (select source, edge, count(*) as total from k group by all),
c as (select g.*, total from g join t using (source, edge) where n >= 0.1 * 0.02 * total),
s as (select c.source, c.edge, c.key, any_value(c.line) as line, any_value(c.n) as n_exact, sum(g.n)::bigint as n_fuzzy, any_value(total) as total
  from c join g on c.source = g.source and c.edge = g.edge and abs(length(c.key) - length(g.key)) <= 2 and levenshtein(c.key, g.key) <= 2 group by 1, 2, 3),
h as (select *, n_fuzzy / total as share from s where n_fuzzy / total >= 0.02
  qualify row_number() over (partition by source, edge order by n_fuzzy desc, n_exact desc, key) = 1)
"""


def _edges(t: Tables) -> DataFrame:
    return H.edge_lines(t.documents.select(F.struct("doc_id", "source").alias("of"), "text"), "of", "text").select("of.*", "edge", "line")


@query("noisy_running_headers", f"with {EDGES} select source, edge, key, line, n_exact, n_fuzzy, round(share, 6) as share from h")
def noisy_running_headers(t: Tables) -> DataFrame:
    """AGG-19, TXT-08. First and last lines of documents that most often recur in their source, within two edits."""
    found = H.clusters(_edges(t), ["source", "edge"], 0.02)
    return found.select("source", "edge", "key", "line", "n_exact", "n_fuzzy", F.round("share", 6).alias("share"))


@query("dropped_edge_lines", f"""
with {EDGES} select k.doc_id, k.source, k.edge, k.line from k join h on k.source = h.source and k.edge = h.edge
where length(k.line) between 3 and 120 and levenshtein(k.key, h.key) <= 2 and not regexp_matches(k.line, '^\\s*\\d+(\\.\\d+)*\\.?\\s+.+')
""")
def dropped_edge_lines(t: Tables) -> DataFrame:
    """AGG-19. Lines at the edges of documents that are their source's running header or footer."""
    lines = _edges(t)
    return H.dropped_edges(lines, H.clusters(lines, ["source", "edge"], 0.02), ["source", "edge"]).select("doc_id", "source", "edge", "line")
