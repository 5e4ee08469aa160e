"""Ranks within groups of any size, without a group in one task.

Rows are dealt by ranges of (group, order), so a group that holds a third of all rows lies in a third of the
ranges; each range ranks its own rows of a group and moves them on by the number of rows in the ranges before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, save

#: Tables of at most so many rows, counted before, are broadcast; larger ones are joined by shuffles.
BROADCAST_ROWS = 1 << 17


def small(df: DataFrame) -> DataFrame:
    """`df`, which is saved, to be broadcast if a count shows that it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`rows`, a saved table, with rank (0 to n - 1 within the non-null `group`, by `order`, nulls first) and n.

    Rows that are equal in all of `order` may swap ranks; they are split like others. The offsets have a row for each range
    and group in it: as many as ranges and groups together, at most.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = save(tie.repartitionByRange(parts, group, *order, "tie").withColumn("part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(group, "part").agg(F.count("*").alias("own_n"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = save(
        sizes.select(group, "part", F.coalesce(F.sum("own_n").over(before), F.lit(0)).alias("moved"), F.sum("own_n").over(whole).alias("n")), "offsets"
    )
    own = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order, "tie")) - 1
    found = dealt.withColumn("own", own).join(small(offsets), [group, "part"]).withColumn("rank", F.col("own") + F.col("moved"))
    out = save(found.drop("tie", "part", "own", "moved"), "ranked")
    discard(dealt, offsets)
    return out
