"""Contract comparison (CMP-*, FN-02..11, TXT-28..34, JOIN-18, 22, SET-05, 06, VER-07): typed values, clause
diffs, mapping scores, risk scores and levels, the quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import release, staged

#: Risk score of each category, its direction policy, and the steps added to it (fixed values).
CATEGORY_BASE = {
    "LIABILITY": 40.0, "TERMINATION": 38.0, "DATA_PROTECTION": 38.0, "INTELLECTUAL_PROPERTY": 36.0, "DISPUTE_RESOLUTION": 32.0,
    "GOVERNING_LAW": 32.0, "PENALTY": 30.0, "PAYMENT": 26.0, "CONFIDENTIALITY": 26.0, "WARRANTY": 26.0, "FINANCIAL": 24.0,
    "SLA": 24.0, "CONTRACT_TERM": 22.0, "OTHER": 12.0,
}
PROTECTION = ("LIABILITY", "CONFIDENTIALITY", "WARRANTY", "SLA")
BURDEN = ("PENALTY",)
IMPACT = {"RISK_INCREASING": 12.0, "RISK_DECREASING": -8.0, "UNKNOWN": 4.0, "NEUTRAL": 0.0}
MAGNITUDE = (("VERY_SMALL", 5.0, 2.0), ("SMALL", 15.0, 6.0), ("MEDIUM", 35.0, 12.0), ("LARGE", 60.0, 18.0), ("VERY_LARGE", None, 24.0))
MAGNITUDE_UNKNOWN = 4.0
CHANGE = {"ADDED": 8.0, "REMOVED": 10.0, "MODIFIED": 0.0}
LEVELS = (("LOW", 25.0), ("MEDIUM", 50.0), ("HIGH", 75.0))
MAPPING_WEIGHTS = {"number": 0.38, "parent": 0.10, "title": 0.12, "lexical": 0.16, "semantic": 0.14, "position": 0.06, "alias": 0.04}


def parse_number(raw: Column) -> Column:
    """FN-04. Number written with either group mark: 1.234.567, 1,234.5, 1.234,5, 3,5; null for what is no number."""
    t = F.replace(F.btrim(raw), F.lit(" "), F.lit(""))
    number = lambda text: F.expr("null").cast("decimal(38,6)") if text is None else text.try_cast("decimal(38,6)")
    return (
        F.when(t.rlike("[oO]{2,}"), number(None))
        .when(t.rlike(r"^\d{1,3}(\.\d{3})+$"), number(F.replace(t, F.lit("."), F.lit(""))))
        .when(t.rlike(r"^\d{1,3}(,\d{3})+(\.\d+)?$"), number(F.replace(t, F.lit(","), F.lit(""))))
        .when(t.rlike(r"^\d{1,3}(\.\d{3})+,\d+$"), number(F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))))
        .when(t.rlike(r"^\d+,\d{1,2}$"), number(F.replace(t, F.lit(","), F.lit("."))))
        .otherwise(number(t))
    )


def relative_change(old: Column, new: Column) -> Column:
    """FN-09. Percentage of the old value, half up to 4 places; null where that is null or 0."""
    return F.when(old != 0, F.round((new - old) * 100 / F.nullif(old, F.lit(0)), 4))


def direction(old: Column, new: Column) -> Column:
    """FN-08."""
    return F.when(new > old, "INCREASED").when(new < old, "DECREASED").when(new == old, "UNCHANGED").otherwise("UNKNOWN")


def months(number: Column, unit: Column) -> Column:
    """FN-10. Years and months as months; other units don't convert."""
    return F.when(unit == "YEAR", number * 12).when(unit == "MONTH", number)


def impact(category: Column, change: Column, towards: Column) -> Column:
    """CMP-18. Whether a change raises the risk, by what the category protects."""
    return (
        F.when((change == "REMOVED") & category.isin(*PROTECTION), "RISK_INCREASING")
        .when(towards == "UNCHANGED", "NEUTRAL")
        .when(category.isin(*PROTECTION) & (towards == "DECREASED"), "RISK_INCREASING").when(category.isin(*PROTECTION) & (towards == "INCREASED"), "RISK_DECREASING")
        .when(category.isin(*BURDEN) & (towards == "INCREASED"), "RISK_INCREASING").when(category.isin(*BURDEN) & (towards == "DECREASED"), "RISK_DECREASING")
        .otherwise("UNKNOWN")
    )


def magnitude(relative: Column) -> Column:
    """CMP-19."""
    out = F.when(relative.isNull(), "UNKNOWN")
    for name, below, _ in MAGNITUDE[:-1]:
        out = out.when(F.abs(relative) < below, name)
    return out.otherwise(MAGNITUDE[-1][0])


def _lookup(key: Column, table: dict[str, float], default: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), F.lit(default))


def risk_score(category: Column, change: Column, towards: Column, relative: Column, n_secondary: Column, n_changes: Column) -> Column:
    """CMP-16. Base, direction, magnitude, kind of change, importance and number of changes, from 0 to 100."""
    steps = {name: step for name, _, step in MAGNITUDE}
    total = (
        _lookup(category, CATEGORY_BASE, CATEGORY_BASE["OTHER"]) + _lookup(impact(category, change, towards), IMPACT, IMPACT["UNKNOWN"])
        + _lookup(magnitude(relative), steps, MAGNITUDE_UNKNOWN) + _lookup(change, CHANGE, 0.0)
        + F.when(n_secondary > 0, 3.0).otherwise(0.0) + F.when(n_changes > 1, 2.0).otherwise(0.0)
    )
    return F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0)), 1)


def risk_level(score: Column) -> Column:
    """CMP-17."""
    out = F.when(score < LEVELS[0][1], LEVELS[0][0])
    for name, below in LEVELS[1:]:
        out = out.when(score < below, name)
    return out.otherwise("CRITICAL")


def clause_diff(source: DataFrame, target: DataFrame, keys: list[str], fingerprint: str) -> DataFrame:
    """CMP-11, SET-05, SET-06. Clauses of two versions by key: ADDED, REMOVED, MODIFIED or UNCHANGED."""
    a = source.select(*keys, F.col(fingerprint).alias("old"))
    b = target.select(*keys, F.col(fingerprint).alias("new"))
    status = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").when(F.col("old") == F.col("new"), "UNCHANGED").otherwise("MODIFIED")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def pair_score(signals: dict[str, Column]) -> Column:
    """CMP-06. Weighted signals of a clause pair; a missing one counts as 0."""
    total = F.lit(0.0)
    for name, weight in MAPPING_WEIGHTS.items():
        if name in signals:
            total = total + weight * F.coalesce(signals[name], F.lit(0.0))
    return total


def position_score(left: Column, right: Column) -> Column:
    """WIN-24."""
    return 1 / (1 + F.abs(left - right))


def confidence_class(best: Column, second: Column, margin: float = 0.05) -> Column:
    """CMP-08. Class of the best candidate's score, ambiguous if the second is too near."""
    return (
        F.when(best.isNull() | (best < 0.45), "UNMATCHED").when(second.isNotNull() & (best - second < margin), "AMBIGUOUS")
        .when(best >= 0.95, "EXACT").when(best >= 0.80, "HIGH").when(best >= 0.65, "MEDIUM").otherwise("LOW")
    )


def subtree_status(rows: DataFrame, key: str, status: str) -> DataFrame:
    """AGG-46. A clause is MODIFIED if any clause below it changed. Keys are paths like 1.2.3."""
    above = rows.select(F.col(status).alias("s"), F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split(key, r"\."))), lambda k: F.array_join(F.slice(F.split(key, r"\."), 1, k), "."))).alias(key))
    changed = above.groupBy(key).agg(F.bool_or(F.col("s") != "UNCHANGED").alias("changed"))
    return rows.join(changed, key).withColumn("subtree_status", F.when(F.col("changed"), "MODIFIED").otherwise(F.col(status))).drop("changed")


#: Classes that make an ancestor MODIFIED, and those that leave it open (fixed values).
DIRTY, OPEN = ("ADDED", "REMOVED", "MODIFIED"), ("AMBIGUOUS_MAPPING", "UNKNOWN")


def tree_status(rows: DataFrame, group: str, node: str, parent: str, status: str) -> DataFrame:
    """AGG-46. `rows` with subtree_status: MODIFIED if any node of the subtree changed, else AMBIGUOUS_MAPPING if any is open, else the
    node's own class. Trees may have any depth: each round sends what a node knows of its subtree twice as far up, to the
    ancestor that it points to, and doubles the pointers. Parents that aren't there are no parents; nodes are unique in a group.
    """
    rank = F.when(F.col(status).isin(*DIRTY), 2).when(F.col(status).isin(*OPEN), 1).otherwise(0)
    there = rows.select(group, F.col(node).alias("up"))
    known = rows.select(group, F.col(node).alias("node"), F.col(parent).alias("up"), rank.alias("worst"))
    state = staged(known.join(there, [group, "up"], "left_semi").unionByName(known.join(there, [group, "up"], "left_anti").withColumn("up", F.lit(None))), "subtrees")
    while state.where("up is not null").first():
        sent = state.where("up is not null and worst > 0").groupBy(group, F.col("up").alias("node")).agg(F.max("worst").alias("below"))
        further = state.select(group, F.col("node").alias("up"), F.col("up").alias("further"))
        moved = state.join(sent, [group, "node"], "left").join(further, [group, "up"], "left")
        before, state = state, staged(moved.select(group, "node", F.col("further").alias("up"), F.greatest("worst", F.coalesce("below", F.lit(0))).alias("worst")), "subtrees")
        release(before)
    worst = state.select(group, F.col("node").alias(node), "worst")
    found = F.when(F.col("worst") == 2, "MODIFIED").when(F.col("worst") == 1, "AMBIGUOUS_MAPPING").otherwise(F.col(status))
    return rows.join(worst, [group, node]).withColumn("subtree_status", found).drop("worst")


def unit_number(raw: Column, unit_type: Column) -> Column:
    """TXT-30. Number of a unit without leading zeros, an appendix's as it is."""
    bare = F.regexp_replace(F.btrim(raw), r"\.+$", "")
    return F.when(unit_type == "APPENDIX", F.upper(bare)).otherwise(F.regexp_replace(bare, r"(^|\.)0+(?=\d)", "$1"))


def priority(rows: DataFrame, level: str, order: str, n: int) -> DataFrame:
    """TOP-11. The n clauses with most risk, in document order within a level."""
    rank = F.when(F.col(level) == "CRITICAL", 0).when(F.col(level) == "HIGH", 1).when(F.col(level) == "MEDIUM", 2).otherwise(3)
    return rows.orderBy(rank, order).limit(n)


def strongest(rows: DataFrame, group: str, relative: str, delta: str) -> DataFrame:
    """TOP-13. The greatest relative change of each group, else the greatest delta."""
    size = F.coalesce(F.abs(relative), F.abs(delta), F.lit(0))
    own = Window.partitionBy(group).orderBy(F.desc(size), relative, delta)
    return rows.withColumn("__r", F.row_number().over(own)).where("__r = 1").drop("__r")


def quality_gate(invalid: Column, unverified: Column, calls: Column, most_calls: int) -> Column:
    """VER-07."""
    return F.when((invalid > 0) | (calls > most_calls), "FAIL").when(unverified > 0, "WARN").otherwise("PASS")
