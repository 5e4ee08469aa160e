"""Best-fit packing: sequences are planned over the histogram of piece lengths, not over documents.

The plan assigns ranges of ranks within a length to ranges of sequences, so it has a few rows for each
length whatever the number of documents; pieces then take their places by joining on rank within length.
Ranks come from salted groups and their offsets, so no length is ranked in one task. Pieces that fill a
sequence need neither plan nor rank: each is a sequence of its own, numbered from its row.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, tokenizer_path
from .pretokens import blocks, encoder

#: A salted group has about so many pieces, and there are at most so many groups of a length.
GROUP_ROWS, MOST_SALTS = 1 << 14, 1 << 12
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _encode_pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        encode = encoder(path)
        for batch in batches:
            ids, texts, done = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), 0
            for block in blocks(texts):
                flat, counts = encode.encode(block)
                ends, rows = np.cumsum(counts), []
                for doc, end, count in zip(ids[done : done + len(block)], ends.tolist(), counts.tolist(), strict=True):
                    own = np.append(flat[end - count : end], end_id).astype("<u4")
                    first = len(own) % capacity or capacity
                    cuts = [0, *range(first, len(own) + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows.append((doc, piece, a, b - a, zlib.crc32(own[a:b].tobytes())))
                done += len(block)
                columns = list(zip(*rows))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ("doc_id", "piece", "start", "length", "ids_crc32")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


def encode_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Ids of each text and `end_id`, cut into pieces of `capacity` of which only the first may be shorter."""
    path = tokenizer or tokenizer_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_encode_pieces(path, capacity, end_id), PIECE)


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts, longest pieces first: (length, first rank, end rank, first sequence, offset).

    Open sequences are kept as ranges of equal room. A length fills the ranges with the least sufficient
    room first; what is left opens new sequences that each take as many pieces of it as fit. The plan is
    bounded by the lengths, at most `capacity` of them, and the ranges that each of them can split.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []
    ranges: dict[int, list[tuple[int, int]]] = {}
    sequences = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in ranges:
                insort(rooms, room)
            ranges.setdefault(room, []).append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left and (at := bisect_left(rooms, length)) < len(rooms):
            room = rooms[at]
            first, n = ranges[room].pop()
            if not ranges[room]:
                del ranges[room], rooms[at]
            used = min(n, left)
            plan.append((length, rank, rank + used, first, capacity - room))
            put(room, first + used, n - used)
            put(room - length, first, used)
            left, rank = left - used, rank + used
        each = capacity // length
        full, rest = divmod(left, each)
        for count, n in ((each, full), (rest, 1)):
            if count and n:
                for k in range(count):
                    plan.append((length, rank, rank + n, sequences, k * length))
                    rank += n
                put(capacity - count * length, sequences, n)
                sequences += n
    return plan


def rank_within(pieces: DataFrame, key: str, order: list[str], counts: dict[int, int]) -> DataFrame:
    """Adds `rank`, 0 to n - 1 within each value of the small integer `key`, without gathering a key in one task.

    Rows are dealt to salted groups by a hash of `order`, as many groups as the key's count asks for; each
    group is ranked by itself and moved on by the number of rows in the groups before it. Rows that are equal
    in all of `order` may swap ranks.
    """
    groups = {k: min(MOST_SALTS, -(-n // GROUP_ROWS)) for k, n in counts.items()}
    salts = F.lit([groups.get(k, 1) for k in range(max(groups, default=0) + 1)])
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*order), F.get(salts, F.col(key).cast("int")).cast("long")).cast("int"))
    sizes = salted.groupBy(key, "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("moved"))
    own = Window.partitionBy(key, "salt").orderBy(*order)
    return (
        salted.withColumn("own", F.row_number().over(own) - 1)
        .join(F.broadcast(offsets), [key, "salt"])  # one row for GROUP_ROWS pieces, at most (values of key) x MOST_SALTS
        .withColumn("rank", (F.col("own") + F.col("moved")).cast("long"))
        .drop("own", "moved", "salt")
    )


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Places in sequences of at most `capacity` tokens for every piece of every row of `docs`.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are the one
    token `end_id`. Repeated rows are packed each; rows with null doc_id keep it. Pieces of equal length are
    ties: which of them takes which of their places follows a hash and their ids, and matters to nothing else.
    Other columns are ignored and an empty table gives an empty result. Sequences of one full piece have
    negative numbers.
    """
    pieces = save(encode_pieces(docs, capacity, end_id, tokenizer), "pieces")
    full = pieces.where(F.col("length") == capacity).select("*", F.monotonically_increasing_id().alias("own"))
    full = full.select(*pieces.columns, (-1 - F.col("own")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts = pieces.where(F.col("length") < capacity)
    histogram = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # < capacity rows
    plan = docs.sparkSession.createDataFrame(
        plan_best_fit(histogram, capacity), "plan_length long, rank_from long, rank_to long, first long, offset long"
    )
    ranked = rank_within(parts, "length", ["doc_id", "piece", "start", "ids_crc32"], histogram)
    match = (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    placed = ranked.join(F.broadcast(plan), match).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset",
    )
    return placed.unionByName(full)
