"""One-to-one matching in joins (JOIN-19..21): the results of sequential greedy choice, found in parallel rounds.

Greedy choice gives a stable matching: by best score, where both sides prefer the better pair; in the order of the sources,
where every target prefers the earlier source. Under a total order there is one such matching, and
deferred acceptance finds it: sources propose to the best target that hasn't refused them, targets keep the best
proposal. All groups and sources propose at once, so there are as many rounds as some source is refused in a row.
That is for groups of more than MOST_EDGES; all others are sorted and gone through in tasks, a group in one."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import release, staged


#: Edges of a group up to which one task goes through them.
MOST_EDGES = 1 << 20


def _greedy(edges: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Edges that are taken one after the other in `order`, each if its source and its target are still free; a group in one task."""
    ranked = edges.withColumn("__turn", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))

    def run(batches):
        sources, targets = set(), set()
        for batch in batches:
            taken = []
            for turn, source, target in zip(*(batch.column(c).to_pylist() for c in ("__turn", "source", "target"))):
                if turn == 1:
                    sources, targets = set(), set()
                free = source not in sources and target not in targets
                if free:
                    sources.add(source)
                    targets.add(target)
                taken.append(free)
            yield batch.filter(pa.array(taken, pa.bool_())).select(edges_columns)

    edges_columns = edges.columns
    return ranked.mapInArrow(run, edges.schema)


def _matched(edges: DataFrame, group: list[str], turns: list[Column], wish: list[Column], choice: list[Column]) -> DataFrame:
    edges = staged(edges, "matching_edges")
    large = staged(edges.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > MOST_EDGES).drop("n"), "large_groups")
    if not large.first():
        return _greedy(edges, group, turns)
    # Groups are compared as they are, nulls too; there are few large ones.
    named = large.select(F.struct(*group).alias("__group"))
    at = F.struct(*group).eqNullSafe(F.col("__group"))
    large_edges = edges.join(named, at, "left_semi")
    return _greedy(edges.join(named, at, "left_anti"), group, turns).unionByName(_rounds(large_edges, group, wish, choice))


def _rounds(edges: DataFrame, group: list[str], wish: list[Column], choice: list[Column]) -> DataFrame:
    source, target = [*group, "source"], [*group, "target"]
    ranked = edges.withColumn("wish", F.row_number().over(Window.partitionBy(*source).orderBy(*wish)))
    ranked = staged(ranked.withColumn("choice", F.row_number().over(Window.partitionBy(*target).orderBy(*choice))), "edges")
    state = staged(ranked.select(*source).distinct().withColumn("at", F.lit(1)), "proposals")
    while True:
        proposed = ranked.join(state, source).where("wish = at")
        # A source whose last target has refused it proposes nothing more.
        held = F.row_number().over(Window.partitionBy(*target).orderBy("choice")) == 1
        judged = staged(proposed.withColumn("held", held), "judged")
        release(state)
        if not judged.where("not held").first():
            return judged.drop("wish", "choice", "at", "held")
        state = staged(judged.select(*source, F.when(F.col("held"), F.col("at")).otherwise(F.col("at") + 1).alias("at")), "proposals")
        release(judged)


def best_first(edges: DataFrame, group: list[str], least: float) -> DataFrame:
    """JOIN-21. Edges (group, source, target, score) that greedy choice by score takes, ties by source, then target; one for each
    source and target at most. Edges below `least` and null scores take part in nothing."""
    order = [F.desc("score"), F.col("source"), F.col("target")]
    return _matched(edges.where(F.col("score") >= least), group, order, order, order)


def in_order(edges: DataFrame, group: list[str], least: float) -> DataFrame:
    """JOIN-19. Each source in ascending order takes its best target that is still free, ties by target."""
    wish = [F.desc("score"), F.col("target")]
    return _matched(edges.where(F.col("score") >= least), group, [F.col("source"), *wish], wish, [F.col("source")])


def by_best_option(edges: DataFrame, group: list[str], accepts: Column, margin: float, strong: float) -> DataFrame:
    """JOIN-20. Residual matching: sources in the order of their best score (ties by source) look at the targets that are still
    free. A source whose second option is `strong` and nearer than `margin` is AMBIGUOUS; one that `accepts` its best
    option, an expression over the edge and second (the next score or null), is MATCHED to it; others stay UNMATCHED.

    edges: group, source, target, score and what `accepts` needs. A round decides every source before which no
    undecided one shares any of its options. Returns group, source, target, score, second, status for each source with edges.
    """
    source, target = [*group, "source"], [*group, "target"]
    best = edges.groupBy(*source).agg(F.max("score").alias("best"))
    turn = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("best"), "source"))
    left = staged(edges.join(best.withColumn("turn", turn).drop("best"), source), "options")
    everyone = staged(left.select(*source).distinct(), "sources")
    out = None
    while left.first():
        first = F.min("turn").over(Window.partitionBy(*target))
        own = Window.partitionBy(*source)
        rows = left.withColumn("free", first == F.col("turn")).withColumn("free", F.min("free").over(own))
        order = own.orderBy(F.desc("score"), "target")
        rows = rows.where("free").withColumn("r", F.row_number().over(order)).withColumn("second", F.lead("score").over(order)).where("r = 1")
        unclear = (F.col("second") >= strong) & (F.col("score") - F.col("second") < margin)
        status = F.when(F.coalesce(unclear, F.lit(False)), "AMBIGUOUS").when(F.coalesce(accepts, F.lit(False)), "MATCHED").otherwise("UNMATCHED")
        decided = staged(rows.select(*source, "target", "score", "second", status.alias("status")), "decided")
        out = decided if out is None else out.unionByName(decided)
        before, rest = left, left.join(decided.select(*source), source, "left_anti")
        left = staged(rest.join(decided.where("status = 'MATCHED'").select(*target), target, "left_anti"), "options")
        release(before)
    if out is None:
        return edges.select(*source, "target", "score", F.lit(None).cast("double").alias("second"), F.lit("").alias("status"))
    found = everyone.join(out, source, "left")
    free = F.when(F.col("status") == "MATCHED", F.col("target")).alias("target")
    return found.select(*source, free, "score", "second", F.coalesce("status", F.lit("UNMATCHED")).alias("status"))
