"""Chunking (WIN-15..20, 25..27). What depends only on lengths is a closed form over sequences or running sums;
greedy packing carries a state along a document and runs in one fold per document."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windows(text: Column, size: int, overlap: int) -> Column:
    """WIN-18. Windows of `size` code points that begin every `size - overlap`, until one reaches the end."""
    n, step = F.length(text), max(1, size - overlap)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step)))
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: (k * step).cast("int")))
    return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("content")))


def token_windows(tokens: Column, size: int, ratio: float = 0.12) -> Column:
    """WIN-19. Windows over an array of tokens with a share of overlap."""
    step = max(1, size - int(size * min(max(ratio, 0.0), 0.5)))
    n = F.size(tokens)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step)))
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: (k * step).cast("int")))
    return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda s: F.struct(s.alias("start"), F.slice(tokens, s + 1, F.lit(size)).alias("tokens")))


def _numbered(sizes: Column, separator: int, end_of) -> Column:
    """Number of the chunk of each unit. end_of(sums, first, used) gives where the chunk that starts at `first` ends, and what the next
    one carries over, by binary search in the running totals: time is linear in the units, however many there are."""

    def one(row) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(np.asarray(row, np.int64) + separator)])
        starts, first, carry = [], 0, 0
        while first < len(row):
            starts.append(first)
            first, carry = end_of(sums, first, carry)
        return np.repeat(np.arange(len(starts), dtype=np.int32), np.diff([*starts, len(row)]))

    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda row: None if row is None else one(row))

    return F.pandas_udf(run, "array<int>")(sizes)


def pack_units(sizes: Column, target_min: int = 500, target_max: int = 800, hard: int = 1000, separator: int = 1, overlap: int = 100) -> Column:
    """WIN-15. Chunk number of each unit, from the units' token counts in order.

    A unit joins the open chunk while the sum stays in the target, or under the hard limit if the chunk is
    still below the target; else it opens a new one, which begins with the overlap of the last.
    """

    def end_of(sums, first, carry):
        base = sums[first] + separator - carry  # a chunk of first to k - 1 has sums[k] - base tokens
        end = max(first + 1, int(np.searchsorted(sums, target_max + base, "right")) - 1)
        if end + 1 < len(sums) and sums[end] - base < target_min and sums[end + 1] - base <= hard:
            end += 1
        return end, min(sums[end] - base, overlap) + separator if overlap else 0

    return _numbered(sizes, separator, end_of)


def batches(sizes: Column, budget: int) -> Column:
    """WIN-26, WIN-20. Batch number of each unit: a unit that overflows the budget opens the next batch."""

    def end_of(sums, first, carry):
        end = int(np.searchsorted(sums, sums[first] + budget, "right")) - 1
        return (end + 1 if sums[end] == sums[first] else end), 0  # units without tokens go with the next

    return _numbered(sizes, 0, end_of)


def fit_prefix(rows: DataFrame, group: list[str], order: list[Column], tokens: str, content: str, budget: int, least: int = 64) -> DataFrame:
    """WIN-25, WIN-27. Rows of each group while they fit; the first that overflows is cut to what is left, if
    that is at least `least` tokens of four characters, and nothing follows it."""
    own = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(tokens).over(own), F.lit(0))
    left = F.lit(budget) - F.col("__before")
    rows = rows.withColumn("__before", before)
    whole = F.col(tokens) <= left
    cut = ~whole & (left >= least)
    return (
        rows.where(whole | cut)
        .withColumn(content, F.when(whole, F.col(content)).otherwise(F.expr(f"substring({content}, 1, cast(4 * ({budget} - __before) as int))")))
        .withColumn("is_cut", ~whole).drop("__before")
    )
