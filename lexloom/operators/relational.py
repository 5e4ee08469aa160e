"""Relational operators over accounts, documents, chunks and logs: filters, joins, aggregations and orders.

Each takes DataFrames with the columns it names and returns a DataFrame; nothing is collected. Tenant keys and
other small sides are left to the optimizer, which sees their sizes.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_window(ts: Column, first: str, last: str) -> Column:
    """FLT-10. From the beginning of one day to the last microsecond of another."""
    return (ts >= F.lit(first).cast("timestamp_ntz")) & (ts < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz"))


def optional_filters(rows: DataFrame, *conditions: Column | None) -> DataFrame:
    """FLT-09, FLT-11. AND of those conditions that are given."""
    for condition in conditions:
        if condition is not None:
            rows = rows.where(condition)
    return rows


def contains_any(text: str, columns: Iterable[str]) -> Column:
    """FLT-03. Case-insensitive containment in any of some columns."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return found


def number_prefix(column: Column, number: str) -> Column:
    """FLT-04. A section number itself, its children `n.…` and titles that begin with it."""
    return (column == number) | column.startswith(number + ".") | column.startswith(number + " ")


def path_prefix(column: Column, path: str) -> Column:
    """FLT-05. A heading path and all below it."""
    return (column == path) | column.startswith(path + " > ")


def index_range(column: Column, start: int, end: int | None) -> Column:
    """FLT-06. Half-open range whose end may be missing."""
    return (column >= start) if end is None else (column >= start) & (column < end)


def neighbours(rows: DataFrame, seeds: DataFrame, group: str, index: str, window: int) -> DataFrame:
    """JOIN-08, FLT-02. Rows within `window` of a seed of their group, seeds left out, each once.

    Seeds are spread over their window first, so this is an equi join whatever the window is.
    """
    near = seeds.select(group, F.explode(F.sequence(F.col(index) - window, F.col(index) + window)).alias(index)).distinct()
    return rows.join(near, [group, index], "left_semi").join(seeds.select(group, index), [group, index], "left_anti")


def sorted_page(rows: DataFrame, column: str, descending: bool, key: str, n: int) -> DataFrame:
    """TOP-07. First n rows by any column, nulls last, ties by key in the same direction."""
    c = F.col(column)
    order = [c.desc_nulls_last(), F.col(key).desc()] if descending else [c.asc_nulls_last(), F.col(key).asc()]
    return rows.orderBy(*order).limit(n)


def latest_per(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """TOP-08, SNK-03. First row of each group in an order that has no ties."""
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")


def representatives(rows: DataFrame, group: str, index: str, is_heading: Column, n: int) -> DataFrame:
    """WIN-07. The first row, every step-th heading and the last row of each group, at most n of them, in order."""
    own = Window.partitionBy(group)
    inner = rows.withColumn("__first", F.min(index).over(own)).withColumn("__last", F.max(index).over(own))
    heading = is_heading & (F.col(index) > F.col("__first")) & (F.col(index) < F.col("__last"))
    inner = inner.withColumn("__heading", heading).withColumn("__headings", F.count_if("__heading").over(own))
    step = F.greatest(F.lit(1), F.ceil(F.col("__headings") / F.lit(max(n - 2, 1))))
    rank = F.count_if("__heading").over(own.orderBy(index))
    inner = inner.withColumn("__pick", F.col("__heading") & (F.pmod(rank - 1, step) == 0))
    picked = inner.where(F.col("__pick") | (F.col(index) == F.col("__first")) | (F.col(index) == F.col("__last")))
    picked = picked.withColumn("__rank", F.row_number().over(own.orderBy(index)))
    return picked.where(F.col("__rank") <= n).drop("__first", "__last", "__heading", "__headings", "__pick", "__rank")


def status_counts(rows: DataFrame, group: list[str], status: str, values: Iterable[str]) -> DataFrame:
    """AGG-05, AGG-33, AGG-35. Number of rows of each status in columns of its own, and all."""
    counts = [F.count_if(F.col(status) == v).alias(f"n_{v.lower()}") for v in values]
    return (rows.groupBy(*group) if group else rows).agg(F.count("*").alias("n_total"), *counts)


def integrity(rows: DataFrame, needed: Iterable[str]) -> DataFrame:
    """JOIN-05. Flag whether all of some columns that left joins may leave null are there."""
    whole = F.lit(True)
    for c in needed:
        whole = whole & F.col(c).isNotNull()
    return rows.withColumn("intact", whole)
