"""Retrieval queries. embeddings stand for the vector collection, user turns and benchmark items for questions,
documents for the chunks that are searched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vectors import centroids, cosine, softmax
from ..operators import retrieval as R
from ..operators import search as S
from ..operators.containing import containing
from ..operators.nearest import nearest_vectors
from .registry import Tables, query

WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]+')"
EVIDENCE = "lower(trim(regexp_replace(regexp_replace(regexp_replace({0}, '\\s+', ' ', 'g'), '\\s+([,.;:!?])', '\\1', 'g'), '([(\\[])\\s+', '\\1', 'g')))"
BM25 = f"""asked as (select item_id as query_id, unnest(list_distinct({WORDS.format('text')})) as term from benchmark),
worded as materialized (select doc_id, {WORDS.format('text')} as w from documents),
words as materialized (select doc_id, len(w) as dl, unnest(w) as term from worded),
lengths as materialized (select count(*) as n, avg(len(w)) as average from worded),
tf as materialized (select term, doc_id, dl, count(*) as tf from words where term in (select term from asked) group by 1, 2, 3),
df as (select term, count(*) as df from tf group by 1),
scored as (
  select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average))), 6) as score
  from tf join df using (term) join asked using (term) cross join lengths group by 1, 2
),
lexical as materialized (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from scored qualify rank <= 20)"""
VECTORS = """asked_vectors as (select vec_id as query_id, embedding as query_vector from embeddings where vec_id % 20 = 0),
near as (
  select query_id, vec_id, round(list_cosine_similarity(embedding::double[], query_vector::double[]), 6) as score from embeddings, asked_vectors
),
nearest as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from near qualify rank <= 20)"""


def _containing(t: Tables) -> DataFrame:
    """item and doc_id of every document that holds a benchmark passage, both in normal form."""
    needles = t.benchmark.select("item_id", X.normalize_evidence(F.col("text")).alias("needle"))
    hay = t.documents.select("doc_id", X.normalize_evidence(F.col("text")).alias("hay"))
    return containing(hay, needles, "doc_id", "hay", "item_id", "needle")


def _lexical(t: Tables, k: int = 20) -> DataFrame:
    return S.bm25(t.documents, t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text")), "doc_id", "text", k)


def _nearest(t: Tables, k: int = 20) -> DataFrame:
    """The stated query set of vectors: those whose id is divisible by 20."""
    asked = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return nearest_vectors(t.embeddings, asked, "vec_id", "embedding", k)


@query("vector_topk", f"with {VECTORS} select query_id, vec_id, score, cast(rank as integer) as rank from nearest")
def vector_topk(t: Tables) -> DataFrame:
    """TOP-01, FN-14. The 20 nearest vectors of every 20th vector."""
    return _nearest(t)


@query("bm25_topk", f"with {BM25} select query_id, doc_id, score, cast(rank as integer) as rank from lexical")
def bm25_topk(t: Tables) -> DataFrame:
    """TXT-20, TOP-02. The 20 best documents of each question by BM25."""
    return _lexical(t)


#: DuckDB compares bytes of words, so each letter beyond ASCII becomes one capital (words are in lower case).
LETTERS = "translate({0}, 'àâäçèéêëíîïñóôöùúûüßœæ', 'ABCDEFGHIJKLMNOPQRSTUV')"
CLAUSES = f"""worded as materialized (select doc_id, {WORDS.format('text')} as w from documents),
words as materialized (select doc_id, len(w) as dl, unnest(w) as term, generate_subscripts(w, 1) as place from worded),
lengths as materialized (select count(*) as n_docs, avg(len(w)) as average from worded),
tf as materialized (select term, doc_id, dl, count(*) as tf from words group by 1, 2, 3),
df as materialized (select term, ln(1 + (any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5)) as idf from tf cross join lengths group by 1),
asked as materialized (select item_id as query_id, unnest({WORDS.format('text')}) as term, generate_subscripts({WORDS.format('text')}, 1) as place from benchmark),
terms as (select distinct term, {LETTERS.format('term')} as a, case when length(term) <= 2 then 0 when length(term) <= 5 then 1 else 2 end as edits from asked),
known as (select term as variant, {LETTERS.format('term')} as b from df),
variants as materialized (
  select term, variant, 1 - levenshtein(a, b) / least(length(a), length(b)) as boost from terms join known on abs(length(a) - length(b)) <= edits
  where case when edits = 0 then a = b else levenshtein(a, b) <= edits end
  qualify row_number() over (partition by term order by levenshtein(a, b), variant) <= 50
), weights as (select query_id, variant as term, sum(boost) as weight from (select distinct query_id, term from asked) join variants using (term) where boost > 0 group by 1, 2),
impacts as materialized (select term, doc_id, dl, idf, average, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average)) as impact from tf join df using (term) cross join lengths),
any_word as (select query_id, doc_id, sum(weight * impact) as score from weights join impacts using (term) group by 1, 2),
n_terms as (select query_id, count(distinct term) as n_terms, count(*) as n_words from asked group by 1),
all_words as materialized (select query_id, doc_id, sum(impact) as score from (select distinct query_id, term from asked) join impacts using (term) join n_terms using (query_id) group by 1, 2 having count(*) = any_value(n_terms)),
starts as (select a.query_id, w.doc_id, w.place - a.place as start, count(*) as n, sum(idf) as idf, any_value(w.dl) as dl from all_words join asked a using (query_id) join words w on w.term = a.term and w.doc_id = all_words.doc_id join df on df.term = a.term group by 1, 2, 3),
phrases as (select query_id, doc_id, count(*) as tf, any_value(idf) as idf, any_value(dl) as dl from starts join n_terms using (query_id) where n = n_words group by 1, 2),
summed as (
  select query_id, doc_id, round(any_word.score + coalesce(2 * all_words.score, 0) + coalesce(3 * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average)), 0), 6) as score
  from any_word left join all_words using (query_id, doc_id) left join phrases using (query_id, doc_id) cross join lengths
)"""


@query("bm25_clauses", f"""
with {CLAUSES}
select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank from summed qualify rank <= 20
""")
def bm25_clauses(t: Tables) -> DataFrame:
    """TXT-20, TOP-02. The 20 best documents of each question by its phrase, all its words and any word or spelling variant."""
    return S.clause_search(t.documents, t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text")), "doc_id", "text", 20)


@query("spelling_variants", f"""
with {CLAUSES} select term, variant, round(boost, 6) as boost from variants where boost > 0
""")
def spelling_variants(t: Tables) -> DataFrame:
    """TXT-20. Words of the documents that the questions' words may stand for."""
    terms = S.asked_words(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))).select("term").distinct()
    known = t.documents.select(F.explode(X.words(F.col("text"))).alias("variant")).distinct()
    return S.spelling_variants(terms, known).withColumn("boost", F.round("boost", 6))


@query("hybrid_merge_dedupe", f"""
with {BM25},
hay as materialized (select doc_id, {EVIDENCE.format('text')} as h from documents),
needles as materialized (select item_id, {EVIDENCE.format('text')} as t from benchmark),
hits as (select item_id as query_id, doc_id, 1.0 as score from needles join hay on contains(h, t)),
all_hits as (select query_id, doc_id, score, 'bm25' as method from lexical union all select query_id, doc_id, score, 'graph' as method from hits),
merged as (select query_id, doc_id, max(score) as raw_score, arg_max(method, (score, method)) as best_method, list_sort(list(distinct method)) as methods from all_hits group by 1, 2)
select query_id, doc_id, raw_score, best_method, array_to_string(methods, ',') as methods,
       cast(row_number() over (partition by query_id order by raw_score desc, doc_id) as integer) as rank from merged qualify rank <= 20
""")
def hybrid_merge_dedupe(t: Tables) -> DataFrame:
    """TOP-03, SET-01, SET-02, AGG-24. Two sources, each key once with its greatest score, the best 20."""
    hits = _containing(t).select(F.col("item_id").alias("query_id"), "doc_id", F.lit(1.0).alias("score"))
    merged = R.merge_candidates(("bm25", _lexical(t)), ("graph", hits), key="doc_id")
    ranked = R.top_per_query(merged.withColumnRenamed("raw_score", "score"), "doc_id", 20)
    return ranked.select("query_id", "doc_id", F.col("score").alias("raw_score"), "best_method", F.array_join("methods", ",").alias("methods"), "rank")


RERANK = f"""{BM25},
pairs as (
  select l.query_id, l.doc_id, l.score as raw, list_distinct({WORDS.format('b.text')}) as q, list_distinct(d.w) as w
  from lexical l join benchmark b on b.item_id = l.query_id join worded d using (doc_id)
),
reranked as (
  select query_id, doc_id, round(0.7 * case when len(q) = 0 then 0 else len(list_intersect(q, w)) / len(q) end + 0.3 * greatest(raw, 0) / (1 + greatest(raw, 0)), 6) as score from pairs
),
final as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from reranked)"""


def _reranked(t: Tables) -> DataFrame:
    rows = _lexical(t).join(t.documents.select("doc_id", "text"), "doc_id")
    rows = rows.join(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question")), "query_id")
    scored = rows.select("query_id", "doc_id", F.round(R.heuristic_score(F.col("question"), F.col("text"), F.col("score")), 6).alias("score"))
    return R.top_per_query(scored, "doc_id", 20)


@query("heuristic_rerank", f"with {RERANK} select query_id, doc_id, score, cast(rank as integer) as rank from final")
def heuristic_rerank(t: Tables) -> DataFrame:
    """TXT-18, WIN-01. Candidates ranked by words in common and raw score."""
    return _reranked(t)


@query("confidence_score", f"""
with {RERANK},
s as (select query_id, max(score) filter (rank = 1) as top_score, max(score) filter (rank = 2) as second, count(*) filter (score >= 0.65) as above from final group by 1),
p as (select *, coalesce(top_score - second, top_score) as score_spread, least(greatest(top_score, 0), 1) as top from s),
c as (select *, least(greatest(0.55 * top + 0.35 * top * least(greatest(score_spread, 0), 1) + 0.1 * least(1.0, above / 3), 0), 1) as confidence from p)
select query_id, top_score, round(score_spread, 6) as score_spread, above, round(confidence, 6) as confidence, case when confidence >= 0.65 then 'high' else 'low' end as level from c
""")
def confidence_score(t: Tables) -> DataFrame:
    """AGG-25, WIN-02. How far each question's candidates can be trusted."""
    rows = R.confidence(_reranked(t))
    return rows.select("query_id", "top_score", F.round("score_spread", 6).alias("score_spread"), "above", F.round("confidence", 6).alias("confidence"), "level")


@query("gated_second_pass", f"""
with {RERANK},
t as (select query_id, max(score) filter (rank = 1) as top_score, max(score) filter (rank = 2) as second, count(*) filter (score >= 0.65) as above from final group by 1),
sure as (select query_id from (select *, coalesce(top_score - second, top_score) as spread, least(greatest(top_score, 0), 1) as top from t)
  where least(greatest(0.55 * top + 0.35 * top * least(greatest(spread, 0), 1) + 0.1 * least(1.0, above / 3), 0), 1) >= 0.65),
rewritten as (select item_id as query_id, list_filter({WORDS.format('text')}, lambda w: length(w) > 4)[1:8] as w from benchmark where item_id not in (select query_id from sure)),
asked2 as (select query_id, unnest(list_distinct(w)) as term from rewritten),
lexical2 as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average))), 6) as raw
  from tf join df using (term) join asked2 using (term) cross join lengths group by 1, 2 qualify row_number() over (partition by query_id order by round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average))), 6) desc, doc_id) <= 20),
pairs2 as (select l.*, list_distinct(r.w) as q, list_distinct(d.w) as w from lexical2 l join rewritten r using (query_id) join worded d using (doc_id)),
second_pass as (select query_id, doc_id, round(0.7 * case when len(q) = 0 then 0 else len(list_intersect(q, w)) / len(q) end + 0.3 * greatest(raw, 0) / (1 + greatest(raw, 0)), 6) as score from pairs2)
select query_id, doc_id, score, cast(rank as integer) as rank, 1 as pass from final
union all select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer), 2 from second_pass
""")
def gated_second_pass(t: Tables) -> DataFrame:
    """RTE-17. Questions with an uncertain first result are cut to their first eight longer words and asked again."""
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))

    def retrieve(asked: DataFrame) -> DataFrame:
        rows = S.bm25(t.documents, asked, "doc_id", "text", 20).join(t.documents.select("doc_id", "text"), "doc_id").join(asked, "query_id")
        score = F.round(R.heuristic_score(F.col("query_text"), F.col("text"), F.col("score")), 6)
        return R.top_per_query(rows.select("query_id", "doc_id", score.alias("score")), "doc_id", 20)

    def rewrite(asked: DataFrame) -> DataFrame:
        longer = F.slice(F.filter(X.words(F.col("query_text")), lambda w: F.length(w) > 4), 1, 8)
        return asked.select("query_id", F.array_join(longer, " ").alias("query_text"))

    return R.gated_second_pass(queries, retrieve, rewrite)


@query("document_diversity", f"with {RERANK} select query_id, count(distinct case when rank <= 5 then source end) as n_documents from final join documents using (doc_id) group by 1")
def document_diversity(t: Tables) -> DataFrame:
    """AGG-26. Sources among the first five."""
    rows = _reranked(t).join(t.documents.select("doc_id", "source"), "doc_id")
    return R.document_diversity(rows, "source", 5)


@query("dominant_version", f"""
with {RERANK}, c as (select query_id, source, count(*) as n from final join documents using (doc_id) group by 1, 2)
select query_id, source, n from c qualify row_number() over (partition by query_id order by n desc, source) = 1
""")
def dominant_version(t: Tables) -> DataFrame:
    """AGG-28. The source that most of a question's candidates come from."""
    rows = _reranked(t).join(t.documents.select("doc_id", "source"), "doc_id")
    return R.dominant(rows, "query_id", "source")


@query("coverage_score", f"""
with {RERANK},
g as (select query_id, count(*) as n, count(distinct source) as sections, count(distinct doc_id // 50) as pages, max(doc_id // 50) - min(doc_id // 50) + 1 as span,
             avg(score) as relevance from final join documents using (doc_id) where rank <= 10 group by 1)
select query_id, round(0.35 * least(1.0, sections / greatest(1, least(n, 6))) + 0.15 * case when pages >= 2 then least(1.0, pages / span) when pages = 1 then 1.0 else 0.5 end
  + 0.35 * least(1.0, relevance) + 0.15 * least(1.0, n / 20), 4) as coverage from g
""")
def coverage_score(t: Tables) -> DataFrame:
    """AGG-27. How well the ten best candidates cover what was found."""
    rows = _reranked(t).join(t.documents.select("doc_id", "source"), "doc_id").where("rank <= 10")
    rows = rows.withColumn("page", F.floor(F.col("doc_id") / 50))
    return R.coverage_score(rows, "query_id", "source", "page", "score", F.lit(20))


@query("context_groups", f"""
with {RERANK}, g as (select f.query_id, d.source, f.doc_id, f.score, max(f.score) over (partition by f.query_id, d.source) as best from final f join documents d using (doc_id))
select query_id, source, doc_id, cast(row_number() over (partition by query_id order by best desc, source, doc_id) as integer) as place from g
""")
def context_groups(t: Tables) -> DataFrame:
    """WIN-09, RTE-19. Groups by their best candidate, inside in document order."""
    rows = _reranked(t).join(t.documents.select("doc_id", "source"), "doc_id")
    rows = rows.withColumn("best", F.max("score").over(Window.partitionBy("query_id", "source")))
    own = Window.partitionBy("query_id").orderBy(F.desc("best"), "source", "doc_id")
    return rows.select("query_id", "source", "doc_id", F.row_number().over(own).alias("place"))


@query("search_over_fetch", f"""
with {BM25.replace('rank <= 20', 'rank <= 60')}
select query_id, doc_id, score from lexical join documents using (doc_id) where lang in ('en', 'fr') and coalesce(score, 0) >= 0.6
qualify row_number() over (partition by query_id order by score desc, doc_id) <= 20
""")
def search_over_fetch(t: Tables) -> DataFrame:
    """TOP-04, FLT-16, FLT-17. Three times as many are fetched, then filtered by what is known of them, then cut."""
    rows = _lexical(t, 60).drop("rank").join(t.documents.where(F.col("lang").isin("en", "fr")).select("doc_id"), "doc_id")
    return R.top_per_query(rows.where(F.coalesce("score", F.lit(0.0)) >= 0.6), "doc_id", 20).select("query_id", "doc_id", "score")


@query("best_single_hit", f"""
with {RERANK} select query_id, arg_max(doc_id, (score, -doc_id)) as doc_id, max(score) as score from final group by 1 having max(score) >= 0.75
""")
def best_single_hit(t: Tables) -> DataFrame:
    """TOP-05, RTE-13. The best candidate of each question, if it reaches 0.75."""
    rows = _reranked(t).groupBy("query_id").agg(F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("doc_id"), F.max("score").alias("score"))
    return rows.where("score >= 0.75")


@query("snippet_in_source", f"""
with hay as materialized (select doc_id, {EVIDENCE.format('text')} as h from documents),
needles as materialized (select item_id, {EVIDENCE.format('text')} as t from benchmark)
select item_id, doc_id from needles join hay on contains(h, t)
""")
def snippet_in_source(t: Tables) -> DataFrame:
    """TXT-21, TXT-22. Documents that hold a benchmark passage."""
    return _containing(t)


CENTROIDS = """d as (select label, embedding, generate_subscripts(embedding, 1) as pos, unnest(embedding)::double as x from embeddings),
m as (select label, pos, avg(x) as m from d group by 1, 2), c as (select label, list(m order by pos) as mean from m group by 1)"""


@query("label_centroids", f"""
with {CENTROIDS} select label, unnest(generate_series(1, len(mean))) as pos, round(unnest(mean) / sqrt(list_sum(list_transform(mean, lambda x: x * x))), 6) as x from c
""")
def label_centroids(t: Tables) -> DataFrame:
    """AGG-23. Mean vector of each label, of unit length."""
    rows = centroids(t.embeddings, "label", "embedding").select("label", F.posexplode("centroid").alias("p", "x"))
    return rows.select("label", (F.col("p") + 1).cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("label_centroid_classify", f"""
with {CENTROIDS}, s as (select vec_id, e.label as actual, c.label as predicted, round(list_cosine_similarity(e.embedding::double[], c.mean), 6) as score from embeddings e, c)
select vec_id, actual, predicted, score from s qualify row_number() over (partition by vec_id order by score desc, predicted) = 1
""")
def label_centroid_classify(t: Tables) -> DataFrame:
    """AGG-23, RTE-04. Nearest centroid of every vector; there is one centroid for each label."""
    c = centroids(t.embeddings, "label", "embedding").withColumnRenamed("label", "predicted")
    rows = t.embeddings.join(c).select(
        "vec_id", F.col("label").alias("actual"), "predicted", F.round(cosine(F.col("embedding"), F.col("centroid")), 6).alias("score")
    )
    best = F.max_by(F.struct("actual", "predicted", "score"), F.struct("score", -F.col("predicted"))).alias("best")
    return rows.groupBy("vec_id").agg(best).select("vec_id", "best.actual", "best.predicted", "best.score")


@query("semantic_cache_lookup", f"""
with {VECTORS}, live as (select query_id, n.vec_id, score, rank, 0.2 + 0.05 * e.label as threshold from nearest n join embeddings e using (vec_id) where rank between 2 and 6)
select query_id, vec_id, score from live where score >= threshold qualify row_number() over (partition by query_id order by rank) = 1
""")
def semantic_cache_lookup(t: Tables) -> DataFrame:
    """RTE-02. The first of the five nearest entries that reaches its own threshold."""
    rows = _nearest(t).where("rank between 2 and 6").join(t.embeddings.select("vec_id", (0.2 + 0.05 * F.col("label")).alias("threshold")), "vec_id")
    first = rows.where("score >= threshold").groupBy("query_id").agg(F.min_by(F.struct("vec_id", "score"), "rank").alias("first"))
    return first.select("query_id", "first.vec_id", "first.score")


@query("softmax_scores", f"""
with {VECTORS}, g as (select query_id, list(score order by rank) as s from nearest group by 1),
e as (select query_id, list_transform(s, lambda v: exp(v - list_max(s))) as p from g)
select query_id, unnest(generate_series(1, len(p))) as rank, round(unnest(list_transform(p, lambda x: x / list_sum(p))), 6) as share from e
""")
def softmax_scores(t: Tables) -> DataFrame:
    """FN-13. Softmax of each query's scores."""
    rows = _nearest(t).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda s: s["score"]).alias("s"))
    rows = rows.select("query_id", F.posexplode(softmax(F.col("s"))).alias("p", "share"))
    return rows.select("query_id", (F.col("p") + 1).cast("long").alias("rank"), F.round("share", 6).alias("share"))


@query("lexical_jaccard_pairs", f"""
with w as (select doc_id, source, n_chars, list_distinct({WORDS.format('text')}) as w from documents)
select a.doc_id as left_id, b.doc_id as right_id,
       round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) as score
from w a join w b on a.source = b.source and a.n_chars = b.n_chars and a.doc_id < b.doc_id
""")
def lexical_jaccard_pairs(t: Tables) -> DataFrame:
    """SET-08, JOIN-18. Word overlap of candidate pairs: documents of one source and length."""
    w = t.documents.select("doc_id", "source", "n_chars", F.array_distinct(X.words(F.col("text"))).alias("w"))
    a, b = w.alias("a"), w.alias("b")
    rows = a.join(b, (F.col("a.source") == F.col("b.source")) & (F.col("a.n_chars") == F.col("b.n_chars")) & (F.col("a.doc_id") < F.col("b.doc_id")))
    return rows.select(F.col("a.doc_id").alias("left_id"), F.col("b.doc_id").alias("right_id"), F.round(X.jaccard(F.col("a.w"), F.col("b.w")), 6).alias("score"))


@query("neighbor_expand", f"""
with lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents),
seeds as (select doc_id, line_no from lines where contains(line, 'the of'))
select distinct l.doc_id, l.line_no, l.line from lines l join seeds s on l.doc_id = s.doc_id and abs(l.line_no - s.line_no) <= 1
where not exists (select 1 from seeds x where x.doc_id = l.doc_id and x.line_no = l.line_no)
""")
def neighbor_expand(t: Tables) -> DataFrame:
    """JOIN-08, FLT-02. Lines next to those that were found."""
    from ..operators.relational import neighbours
    from ..sources.tables import markdown_lines

    lines = markdown_lines(t.documents, "doc_id")
    return neighbours(lines, lines.where(F.col("line").contains("the of")), "doc_id", "line_no", 1)
