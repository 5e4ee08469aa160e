"""Hybrid retrieval (TOP-03..05, TXT-18, 19, AGG-24..28, SET-01..03, RTE-13, 19): vector and lexical search,
merging, ranking, confidence and context assembly. Queries come as a table, so all of them run in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vectors import clamp01
from ..sources.sinks import staged

CONFIDENCE = {"relevance": 0.65, "high": 0.65, "top": 0.55, "spread": 0.35, "count": 0.10, "cap": 3}


def top_per_query(scored: DataFrame, key: str, k: int) -> DataFrame:
    """WIN-01. First k of each query by score, with rank from 1."""
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def merge_candidates(*sources: tuple[str, DataFrame], key: str) -> DataFrame:
    """SET-01, SET-02, AGG-24. One row for each query and key: the greatest raw score of the sources, the source
    that gave it and all that found the key."""
    parts = [df.select("query_id", key, F.col("score").alias("raw_score"), F.lit(name).alias("method")) for name, df in sources]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("query_id", key).agg(
        F.max("raw_score").alias("raw_score"), F.max_by("method", F.struct("raw_score", "method")).alias("best_method"),
        F.array_sort(F.collect_set("method")).alias("methods"),
    )


def heuristic_score(query: Column, text: Column, raw: Column) -> Column:
    """TXT-18. 0.7 share of the query's words found and 0.3 raw / (1 + raw)."""
    positive = F.greatest(raw, F.lit(0.0))
    return 0.7 * X.overlap_share(X.words(query), X.words(text)) + 0.3 * positive / (1 + positive)


def confidence(ranked: DataFrame, config: dict = CONFIDENCE) -> DataFrame:
    """AGG-25, WIN-02. top, spread, above, confidence and level of each query's ranked candidates.

    A null score counts as 0; the spread of a single candidate is its score.
    """
    score = F.coalesce("score", F.lit(0.0))
    found = ranked.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, score)).alias("top_score"), F.max(F.when(F.col("rank") == 2, score)).alias("second"),
        F.count_if(score >= config["relevance"]).alias("above"),
    )
    found = found.withColumn("score_spread", F.coalesce(F.col("top_score") - F.col("second"), F.col("top_score")))
    top = clamp01(F.col("top_score"))
    count = F.least(F.lit(1.0), F.col("above") / config["cap"])
    total = clamp01(top * config["top"] + clamp01(F.col("score_spread")) * top * config["spread"] + count * config["count"])
    found = found.withColumn("confidence", total)
    return found.select(
        "query_id", "top_score", "score_spread", "above", "confidence", F.when(F.col("confidence") >= config["high"], "high").otherwise("low").alias("level")
    )


def document_diversity(ranked: DataFrame, document: str, k: int) -> DataFrame:
    """AGG-26. Distinct documents among the first k of each query."""
    return ranked.groupBy("query_id").agg(F.countDistinct(F.when(F.col("rank") <= k, F.col(document))).alias("n_documents"))


def dominant(rows: DataFrame, group: str, value: str) -> DataFrame:
    """AGG-28. Most frequent value of each group, the least one of a tie."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    own = Window.partitionBy(group).orderBy(F.desc("n"), value)
    return counts.withColumn("r", F.row_number().over(own)).where("r = 1").drop("r")


def coverage_score(rows: DataFrame, group: str, section: str, page: str, score: str, reranked: Column) -> DataFrame:
    """AGG-27. Section diversity, page continuity, relevance and share kept, weighted .35, .15, .35, .15."""
    found = rows.groupBy(group).agg(
        F.count("*").alias("n"), F.countDistinct(section).alias("sections"), F.countDistinct(page).alias("pages"),
        (F.max(page) - F.min(page) + 1).alias("span"), F.avg(score).alias("relevance"), F.max(reranked).alias("reranked"),
    )
    diversity = F.least(F.lit(1.0), F.col("sections") / F.greatest(F.lit(1), F.least("n", F.lit(6))))
    pages = F.when(F.col("pages") >= 2, F.least(F.lit(1.0), F.col("pages") / F.col("span"))).when(F.col("pages") == 1, 1.0).otherwise(0.5)
    relevance = F.least(F.lit(1.0), F.coalesce("relevance", F.lit(0.0)))
    kept = F.when(F.col("reranked") > 0, F.least(F.lit(1.0), F.col("n") / F.col("reranked"))).otherwise(0.0)
    return found.select(group, F.round(0.35 * diversity + 0.15 * pages + 0.35 * relevance + 0.15 * kept, 4).alias("coverage"))


def gated_second_pass(queries: DataFrame, retrieve, rewrite, config: dict = CONFIDENCE) -> DataFrame:
    """RTE-17. Rows of one or two passes, with `pass`: queries whose first result has low confidence, or none at all, are rewritten
    and retrieved once more; the others are kept from the second retrieval by the semi-join, and appear in pass 1 only.

    retrieve(queries) gives query_id, a key, score and rank; rewrite(queries) gives queries with another query_text.
    """
    first = staged(retrieve(queries), "first_pass")
    sure = confidence(first, config).where("level = 'high'").select("query_id")
    again = staged(rewrite(queries.join(sure, "query_id", "left_anti")), "rewritten")
    one = first.withColumn("pass", F.lit(1))
    return one.unionByName(retrieve(again).withColumn("pass", F.lit(2))) if again.first() else one
