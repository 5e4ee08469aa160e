"""Windowed counts of events, as batch and as stream (STR-01..04). Tumbling, sliding and session windows are an
extension; the fixed-window limiter is what the rest builds on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fixed_window(ts: Column, seconds: int) -> Column:
    """FN-28. Number of the window that a time falls in."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (seconds * 1_000_000)).cast("long")


def rate_limit(events: DataFrame, tenant: str, ts: str, limit: int, seconds: int) -> DataFrame:
    """STR-01, STR-02. Requests of each tenant and window, and how many of them are over the limit."""
    rows = events.groupBy(F.col(tenant).alias("tenant"), fixed_window(F.col(ts), seconds).alias("window_no")).agg(F.count("*").alias("n"))
    return rows.withColumn("n_rejected", F.greatest(F.lit(0), F.col("n") - limit))


def windowed_counts(events: DataFrame, ts: str, keys: list[str], size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Tumbling or sliding counts; with `late` as a stream's watermark."""
    rows = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    if late:
        rows = rows.withWatermark("__ts", late)
    counts = rows.groupBy(F.window("__ts", size, slide) if slide else F.window("__ts", size), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def session_counts(events: DataFrame, ts: str, keys: list[str], gap: str) -> DataFrame:
    """Sessions that end after a gap."""
    rows = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    counts = rows.groupBy(F.session_window("__ts", gap), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def stream_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Events of a folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def answer_events(answers: DataFrame, key: str, text: str, size: int = 24) -> DataFrame:
    """STR-03. The events of a streamed answer: status, pieces of `size` characters, done."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / F.lit(size))).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.lit("token").alias("type"), F.substring(F.col(text), k * size + 1, F.lit(size)).alias("data")))
    mark = lambda name: F.array(F.struct(F.lit(name).alias("type"), F.lit("").alias("data")))
    return answers.select(key, F.posexplode(F.concat(mark("status"), pieces, mark("done"))).alias("seq", "event")).select(key, "seq", "event.*")
