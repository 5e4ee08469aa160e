"""Mixing sources to target weights, exact to the word where documents allow it.

A source's target is whole passes over all of its documents and a budget of less than one pass. The budget is
fitted as a subset sum over counts: documents are counted by exact length, each length gives its share of all
but RESERVE words of the budget, and a bounded knapsack over the documents that are left fills what
is still open. Documents are then chosen by length: those with the least seeded hashes, as many as the count asks for.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, discard_since, save, saved_so_far
from .ranks import ranked, small

WEIGHTS, MOST_PASSES = (5, 2, 1), 3
SEED = 11
#: Words of a budget that the knapsack fills, besides those that whole documents left open; it keeps sums up to twice as many.
RESERVE = 1 << 14
#: A bucket of hashes has about so many documents of one length.
BUCKET_ROWS = 1 << 14
#: Rows that join with more counts than are broadcast are dealt to so many salts.
SALTS = 32


def words(text: Column) -> Column:
    """Number of runs of other characters than space and 09 to 0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def reachable(budget: int, lengths: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Number of documents of each length whose sizes add up as near to `budget` as documents that are `left` allow.

    Bounded knapsack over sums up to twice the budget, beyond which none is nearer than no document at all. Counts
    are split into powers of two; a set of reachable sums is the bits of an integer, and `by` remembers with which item a
    sum was first reached. That item's rest was reached by earlier items, so walking back uses no item twice.
    """
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return take
    top = 2 * budget
    mask = (1 << (top + 1)) - 1
    sums, items, by = 1, [], np.full(top + 1, -1, np.int64)
    for i, (length, n) in enumerate(zip(lengths.tolist(), left.tolist())):
        n, part = min(n, top // length), 1
        while n > 0 and not sums >> budget & 1:
            part = min(part, n)
            new = (sums << (part * length)) & mask & ~sums
            if new:
                at = np.flatnonzero(np.unpackbits(np.frombuffer(new.to_bytes(top // 8 + 1, "little"), np.uint8), bitorder="little"))
                by[at] = len(items)
            sums |= new
            items.append((i, part))
            n, part = n - part, 2 * part
    known = np.append(np.flatnonzero(by >= 0), 0)
    at = int(known[np.argmin(np.abs(known - budget))])
    while at:
        i, part = items[by[at]]
        take[i] += part
        at -= part * int(lengths[i])
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, reserve: int = RESERVE) -> np.ndarray:
    """How many documents of each length to take for `budget` words, which is at most what they all have.

    Shares are rounded down with the rest carried on, from the longest to the shortest, so the reserve and less than a
    shortest text stay open for the knapsack.
    """
    take = np.zeros(len(lengths), np.int64)
    total = sum(x * y for x, y in zip(lengths.tolist(), counts.tolist()))
    if total == 0 or budget <= 0:
        return take
    shared = max(0, budget - reserve)
    owed = 0  # words that longer texts have left open, times total
    order = np.argsort(-lengths)
    for i in order.tolist():
        length, n = int(lengths[i]), int(counts[i])
        if length:
            due = owed + n * length * shared
            take[i] = min(n, due // (length * total))
            owed = due - int(take[i]) * length * total
    rest = budget - sum(x * y for x, y in zip(lengths.tolist(), take.tolist()))
    chosen = order[lengths[order] > 0]
    take[chosen] += reachable(rest, lengths[chosen], (counts - take)[chosen])
    return take


def _fit_source(frame: pd.DataFrame) -> pd.DataFrame:
    """Counts of one source. Its rows are the distinct lengths of its texts, however many documents it has."""
    take = fit(frame["size"].to_numpy(), frame["n"].to_numpy(), int(frame["budget"].iloc[0]))
    return pd.DataFrame({"source": frame["source"], "size": frame["size"], "n": frame["n"], "take": take})


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """source, source_size and target for `sizes` (saved; source, non-null, and source_size).

    Sources in order get `weights` in turn, and share the total of all sizes. A target above `most` times its source's size
    stops there, and the others share the rest by weight, until none is above. Each round is one aggregate over the sources.
    """
    weight = F.get(F.lit(list(weights)), F.pmod("rank", F.lit(len(weights))).cast("int"))
    rows = save(ranked(sizes.withColumn("all", F.lit("")), "all", ["source"]).select("source", "source_size", weight.alias("weight")), "weights")
    limit = F.col("source_size") * most
    total, level = rows.agg(F.sum("source_size")).first()[0] or 0, None
    while True:
        stopped = F.lit(False) if level is None else F.col("weight") * level >= limit
        sums = rows.agg(F.sum(F.when(stopped, limit)), F.sum(F.when(~stopped, F.col("weight")))).first()
        now = (total - (sums[0] or 0)) / sums[1] if sums[1] else float("inf")
        if level is not None and now <= level:
            break
        level = now
    target = F.when(F.col("weight") * F.lit(level) >= limit, limit.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and taken for every row of `docs`.

    size counts the words of a text (null and empty: 0), taken the words that the mix takes, repeats counted: a
    document is taken whole, once for each pass and once more if it is chosen. A source without words has target 0; null
    is a source of its own, after all others. Among documents of one source and length those with the least hash of
    seed and doc_id are chosen, so reruns agree; rows that are equal in doc_id, source and size are ties, and any of
    them may be chosen. Other columns are ignored; an empty table has no rows.
    """
    source = F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1")).alias("source")  # null last
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source, words(F.col("text")).alias("size"))
    # Equal rows are one row with a count: groups of them need no ranks.
    rows = save(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")), "sized")
    lengths = save(rows.groupBy("source", "size").agg(F.sum("copies").alias("n")), "lengths")
    sizes = save(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "sizes")
    if not sizes.first():
        return rows.select("doc_id", "source", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budget = F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")
    aims = save(targets(sizes, weights, most).withColumn("passes", passes).withColumn("budget", budget), "targets")
    counts = lengths.join(small(aims).select("source", "budget"), "source").groupBy("source")
    counts = save(counts.applyInPandas(_fit_source, "source string, size long, n long, take long"), "counts")
    placed = _with_order(rows, counts, seed)
    mark = saved_so_far(docs.sparkSession)
    chosen = save(_chosen(placed), "chosen")
    discard_since(docs.sparkSession, mark, keep=[chosen])
    discard(rows, lengths, sizes, counts)
    passed = chosen.join(small(aims), "source")
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return passed.select("*", copy).select(
        "doc_id", F.when(F.col("source") != "1", F.substring("source", 2, 2**31 - 1)).alias("source"), "size", "source_size", "target",
        (F.col("size") * (F.col("passes") + F.when(F.col("copy") <= F.col("more"), 1).otherwise(0))).alias("taken"),
    )


def _with_order(rows: DataFrame, counts: DataFrame, seed: int) -> DataFrame:
    """rows with n and take of their source and size, a seeded hash of 31 bits and the bucket of hashes that it is in."""
    key = ["source", "size"]
    hashed = rows.withColumn("hash", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", *key), 33))
    few = small(counts)
    if few is counts:  # a source and size may hold a third of all rows: its rows are dealt to all salts
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        joined = hashed.withColumn("salt", F.pmod("hash", F.lit(SALTS)).cast("int")).join(counts.select("*", salts), [*key, "salt"]).drop("salt")
    else:
        joined = hashed.join(few, key)
    buckets = F.ceil(F.col("n") / BUCKET_ROWS)
    return joined.withColumn("bucket", F.shiftright(F.col("hash") * buckets, 31))


def _chosen(placed: DataFrame) -> DataFrame:
    """placed with `more`, the number of a row's copies that are chosen: the first `take` of each source and size by hash.

    Buckets ascend with the hash. Those before the one in which the count is reached are chosen whole, those after it not at
    all, and only its own rows are ordered.
    """
    key = ["source", "size"]
    open_ = save(placed.where("take > 0 and take < n"), "placed")
    sizes = open_.groupBy(*key, "bucket").agg(F.sum("copies").alias("own"))
    before = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = save(sizes.select(*key, "bucket", "own", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before")), "bucket_sizes")
    marked = open_.join(small(sizes), [*key, "bucket"])
    last = (F.col("before") < F.col("take")) & (F.col("before") + F.col("own") > F.col("take"))
    inside = Window.partitionBy(*key, "bucket").orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum("copies").over(inside), F.lit(0))
    ordered = marked.where(last).withColumn("more", F.greatest(F.lit(0), F.least("copies", F.col("take") - ahead)))
    whole = marked.where(~last).withColumn("more", F.when(F.col("before") < F.col("take"), F.col("copies")).otherwise(0))
    closed = placed.where("take = 0 or take = n").withColumn("more", F.when(F.col("take") > 0, F.col("copies")).otherwise(0))
    kept = ["doc_id", *key, "copies", "more"]
    return ordered.select(*kept).unionByName(whole.select(*kept)).unionByName(closed.select(*kept))


def mix_sources(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken, see mix()."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
