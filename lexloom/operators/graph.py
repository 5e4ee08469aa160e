"""Entity graph (AGG-16, 17, JOIN-12..15, FLT-21): mentions, co-occurrence, bounded expansion, topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def mentions(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """key, name of every mention of a name in a chunk, repeats included."""
    return chunks.select(key, F.explode(X.names(F.col(text))).alias("name"))


def top_entities(found: DataFrame, n: int = 40) -> DataFrame:
    """AGG-16. The n names with most mentions, with their type; ties by name."""
    counts = found.groupBy("name").agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "name").limit(n)
    return counts.withColumn("type", X.entity_type(F.col("name")))


def cooccurrence(found: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """AGG-16. Pairs a < b of kept entities with the number of chunks that name both.

    Only kept entities are paired, so a chunk gives at most n (n - 1) / 2 pairs, whatever its length.
    """
    kept = found.join(F.broadcast(entities.select("name")), "name").groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("names"))
    pairs = F.flatten(F.transform("names", lambda a, i: F.transform(F.slice("names", i + 2, F.size("names")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return kept.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("weight"))


def expand(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """JOIN-14, JOIN-15. node, hops for all nodes at most `hops` undirected edges from a seed (column node)."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("next")).union(edges.select(F.col("b"), F.col("a")))
    reached = seeds.select("node", F.lit(0).alias("hops"))
    frontier = reached
    for k in range(1, hops + 1):
        found = frontier.select("node").join(both, "node").select(F.col("next").alias("node")).distinct()
        frontier = found.join(reached, "node", "left_anti").withColumn("hops", F.lit(k))
        reached = reached.union(frontier)
    return reached


def live_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """FLT-21. Edges both of whose ends are among the nodes kept."""
    kept = nodes.select("node")
    return edges.join(kept.withColumnRenamed("node", "a"), "a", "left_semi").join(kept.withColumnRenamed("node", "b"), "b", "left_semi")


def top_terms(docs: DataFrame, key: str, group: str, text: str, n: int, least: int = 4) -> DataFrame:
    """AGG-17. The n terms of at least `least` letters that most documents of each group hold."""
    terms = docs.select(group, key, F.explode(F.array_distinct(X.words(F.col(text)))).alias("term")).where(F.length("term") >= least)
    counts = terms.groupBy(group, "term").agg(F.count("*").alias("n_docs"))
    own = Window.partitionBy(group).orderBy(F.desc("n_docs"), "term")
    return counts.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= n)


def mentioning(chunks: DataFrame, names: DataFrame, text: Column) -> DataFrame:
    """JOIN-12, JOIN-13. Chunks with each of some names that they contain, in any case. The names are a stated set."""
    return chunks.withColumn("__low", F.lower(text)).join(F.broadcast(names.select("name", F.lower("name").alias("__name"))), F.col("__low").contains(F.col("__name"))).drop("__low", "__name")
