"""Token counts: pieces are counted once per distinct pre-token and joined to the pre-token frequencies of
each document; token ids are never materialised.

Pre-tokens that are frequent in a sample of about HEAD_DOCUMENTS documents (the head) are counted first and
sent to all tasks, at most HEAD_ENTRIES of at most HEAD_CHARS code points. That only decides which of two joins a pre-token takes: the head is summed where the text is read, all others go through a shuffle join. So
frequent words never meet in one task, and results don't depend on the sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, tokenizer_path
from .pretokens import PieceTable, blocks, splitter

HEAD_DOCUMENTS = 8192
HEAD_ENTRIES, HEAD_CHARS = 1 << 18, 64


def _words(path: str):
    def run(batches):
        split = splitter(path)
        for batch in batches:
            for block in blocks(batch.column("text").to_pylist()):
                part = split.split(block)
                _, first, counts = np.unique(part.hashes, return_index=True, return_counts=True)
                at, size = part.starts[first].tolist(), part.lengths[first].tolist()
                words = [part.joined[a : a + n] for a, n in zip(at, size, strict=True)]
                yield pa.RecordBatch.from_pydict({"pretoken": pa.array(words, pa.string()), "n": pa.array(counts, pa.int64())})

    return run


def _head(docs: DataFrame, path: str) -> PieceTable:
    """Piece counts of pre-tokens that occur at least twice in the sample; at most HEAD_ENTRIES of them."""
    share = HEAD_DOCUMENTS / max(docs.count(), 1)
    place = F.xxhash64(F.monotonically_increasing_id()) / F.lit(2.0**64) + 0.5
    rows = (
        docs.where(place < share).select("text").mapInArrow(_words(path), "pretoken string, n long")
        .where(F.length("pretoken") <= HEAD_CHARS).groupBy("pretoken").agg(F.sum("n").alias("n")).where("n > 1")
        .orderBy(F.desc("n"), "pretoken").limit(HEAD_ENTRIES).select("pretoken").collect()
    )
    table = PieceTable(splitter(path), HEAD_ENTRIES + 1)
    if words := [r.pretoken for r in rows]:
        # Each word is its own text here, so the hashes are those that any text with the word gives.
        hashes = table.splitter.split(words).hashes
        order = np.argsort(hashes)
        keep = order[np.append(True, np.diff(hashes[order]) > 0)]
        table.add(hashes[keep], [words[i] for i in keep.tolist()])
    return table


def _frequencies(path: str, head):
    """Rows of a document's pre-tokens outside the head, and one row a document with the sum of the head."""
    names = ("keys", "slots", "counts", "code_at", "codes")

    def run(batches):
        split = splitter(path)
        table = PieceTable(split)
        for name, value in zip(names, head.value, strict=True):
            setattr(table, name, value)
        for batch in batches:
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            ids, texts, done = batch.column("doc_id"), batch.column("text").to_pylist(), 0
            for block in blocks(texts):
                part, row = split.split(block), rows[done : done + len(block)]
                distinct, first, inverse = np.unique(part.hashes, return_index=True, return_inverse=True)
                slots = table.find(distinct)
                if not table.same(part, slots[inverse]):  # a hash that two pre-tokens share
                    slots[:] = -1
                sums = np.zeros(len(block), np.int64)
                if len(distinct):
                    pieces = np.where(slots >= 0, table.counts[slots] if len(table.counts) else 0, 0)
                    sums = np.bincount(part.owner, pieces[inverse], len(block)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array(row), "doc_id": ids.slice(done, len(block)),
                    "n_bytes": pa.array([len((t or "").encode()) for t in block], pa.int64()),
                    # A key of its own spreads these rows over the join; n_bytes tells them from pre-tokens.
                    "pretoken": pa.array([f"\x00{r}" for r in row.tolist()], pa.string()), "n": pa.array(sums),
                })
                if len(tail := np.flatnonzero(slots < 0)):
                    rank = np.full(len(distinct), -1)
                    rank[tail] = np.arange(len(tail))
                    which = rank[inverse]
                    pairs, n = np.unique(part.owner[which >= 0] * len(tail) + which[which >= 0], return_counts=True)
                    at, size = part.starts[first[tail]].tolist(), part.lengths[first[tail]].tolist()
                    words = pa.array([part.joined[a : a + k] for a, k in zip(at, size, strict=True)], pa.string())
                    yield pa.RecordBatch.from_pydict({
                        "row": pa.array(row[pairs // len(tail)]), "doc_id": pa.nulls(len(pairs), pa.int64()),
                        "n_bytes": pa.nulls(len(pairs), pa.int64()), "pretoken": words.take(pa.array(pairs % len(tail))),
                        "n": pa.array(n.astype(np.int64)),
                    })
                done += len(block)

    return run


def _pieces(path: str):
    def run(batches):
        encode = splitter(path).tokenizer.encode_batch_fast
        for batch in batches:
            words = batch.column("pretoken")
            found = [len(e.ids) for e in encode(words.to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_pydict({"pretoken": words, "pieces": pa.array(found, pa.int64())})

    return run


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of `docs` (doc_id, text).

    Null and empty texts have 0 bytes and 0 tokens. Null doc_ids stay null. Repeated rows and repeated
    doc_ids are counted row by row. Other columns are ignored; an empty table gives an empty result.
    """
    path = tokenizer or tokenizer_path()
    docs = docs.select("doc_id", "text")
    table = _head(docs, path)
    head = docs.sparkSession.sparkContext.broadcast((table.keys, table.slots, table.counts, table.code_at, table.codes))
    rows = docs.withColumn("row", F.monotonically_increasing_id()).select("row", F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = save(rows.mapInArrow(_frequencies(path, head), "row long, doc_id long, n_bytes long, pretoken string, n long"), "pretokens")
    in_head = F.col("n_bytes").isNotNull()
    words = found.where(~in_head).select("pretoken").distinct()
    pieces = words.mapInArrow(_pieces(path), "pretoken string, pieces long")
    counted = F.coalesce("pieces", F.raise_error(F.lit("a pre-token has no piece count")).cast("long"))
    return (
        found.join(pieces, "pretoken", "left")
        .select("row", "doc_id", "n_bytes", F.when(in_head, F.col("n")).otherwise(F.col("n") * counted).alias("n"))
        .groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
