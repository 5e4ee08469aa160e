"""Which texts contain which passages (TXT-21, TXT-22), by rolling-hash anchors instead of all pairs.

Of every WINDOW consecutive hashes of GRAM code points the least one is an anchor, so a passage of at least
GRAM + WINDOW - 1 code points has an anchor at the same place in itself and wherever a text contains it. Passages
meet texts by equality of their rarest anchor, and the whole passage is compared at that place."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import staged

#: (least length of a passage, gram, window); shorter passages have grams of their own length, all of them anchors.
CLASSES = ((32, 16, 17), (8, 4, 5))
#: Places and passages that are broadcast to the texts at most, counted before.
BROADCAST_ROWS = 1 << 17
#: Anchors after which a task hands them on.
HELD_ANCHORS = 1 << 18
ANCHORS = "gram int, hash long, at long"


def class_of(length: int) -> tuple[int, int]:
    for least, gram, window in CLASSES:
        if length >= least:
            return gram, window
    return length, 1


def anchors(text: str, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of a text's anchors, ascending by place."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - gram + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = np.zeros(n, np.uint64)
    for k in range(gram):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    if window == 1:
        return hashes.view(np.int64), np.arange(n)
    least = np.lib.stride_tricks.sliding_window_view(hashes, window).argmin(axis=1)
    at = np.unique(least + np.arange(len(least)))
    return hashes[at].view(np.int64), at


def _anchors(kinds: list[tuple[int, int]] | None):
    """Anchors of each text in all of `kinds`, or in the kind of its own length; key, gram, hash, at."""

    def out(keys, lists):
        rows, grams, hashes, at = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in lists)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.array(grams.astype(np.int32)), pa.array(hashes), pa.array(at)], ["key", "gram", "hash", "at"])

    def run(batches):
        for batch in batches:
            keys, texts, lists, held = batch.column("key"), batch.column("text"), [[], [], [], []], 0
            for row in range(len(texts)):
                text = texts[row].as_py()
                for gram, window in kinds if kinds is not None else [class_of(len(text))]:
                    hashes, at = anchors(text, gram, window)
                    for column, values in zip(lists, (np.full(len(at), row), np.full(len(at), gram), hashes, at)):
                        column.append(values)
                    held += len(at)
                    if held > HELD_ANCHORS:  # a batch of texts has many times its size of anchors
                        yield out(keys, lists)
                        lists, held = [[], [], [], []], 0
            yield out(keys, lists)

    return run


def places(texts: DataFrame, passages: DataFrame, key: str, text: str, passage_key: str, passage: str, own: str | None = None) -> DataFrame:
    """passage_key, key and start (from 0) of every place where a text contains a passage. Empty and null ones are nowhere.

    With `own`, a field of the struct passage_key, a passage is looked for only in the text whose key that field is. Both are compared as they are, so bring them into one form before. Repeated keys have places of each row; rows
    without key have none.
    """
    needles = passages.where(F.col(passage) != "").select(F.col(passage_key).alias("key"), F.col(passage).alias("text"))
    needles = staged(needles, "passages")
    spark, kind = texts.sparkSession, lambda df: dict(df.dtypes)["key"]
    known = needles.mapInArrow(_anchors(None), f"key {kind(needles)}, {ANCHORS}")
    known = staged(known.withColumn("of", F.col(f"key.{own}") if own else F.lit(0)), "passage_anchors")
    on = ["of", "gram", "hash"]
    lengths = [r.n for r in needles.select(F.when(F.length("text") < 32, F.length("text")).otherwise(32).alias("n")).distinct().collect()]  # at most 32
    hay = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and text <> ''")
    hay_anchors = hay.mapInArrow(_anchors(sorted({class_of(n) for n in lengths})), f"key {kind(hay)}, {ANCHORS}")
    hay_anchors = hay_anchors.withColumn("of", F.col("key") if own else F.lit(0))
    hay_anchors = staged(hay_anchors.join(known.select(*on).distinct(), on, "left_semi"), "text_anchors")
    counts = known.join(hay_anchors.groupBy(*on).agg(F.count("*").alias("n")), on, "left")
    # An anchor that no text has rules its passage out.
    rarest = counts.groupBy(F.col("key").alias("item")).agg(F.min_by(F.struct(*on, F.col("at").alias("offset")), F.struct(F.coalesce("n", F.lit(0)), "at")).alias("a"))
    found = hay_anchors.join(rarest.select("item", "a.*"), on).select("key", "item", (F.col("at") - F.col("offset")).alias("start")).where("start >= 0").distinct()
    found = staged(found.join(needles.select(F.col("key").alias("item"), F.col("text").alias("needle")), "item"), "candidate_places")
    few = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    same = F.substring("text", (F.col("start") + 1).cast("int"), F.length("needle")) == F.col("needle")
    return hay.join(few, "key").where(same).select(F.col("item").alias(passage_key), F.col("key").alias(key), "start")


def containing(texts: DataFrame, passages: DataFrame, key: str, text: str, passage_key: str, passage: str) -> DataFrame:
    """passage_key and key of every text that contains a passage."""
    return places(texts, passages, key, text, passage_key, passage).select(passage_key, key).distinct()
