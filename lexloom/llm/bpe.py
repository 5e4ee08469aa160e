"""BPE encoding and decoding by tree concatenation.

A long text is cut in halves until the parts are short. Spark deals the parts to all tasks, which encode
them in parallel; then neighbours are joined pairwise, level by level. Around each join a window of tokens
is encoded again and grown until on either side of the join it has a token that the part has at the same
place. From such tokens outwards both parts are what the whole text gives: byte pair merges depend on
neighbouring tokens only, and pre-tokens split alike from a common boundary on. Common tokens count only at
some distance from the join and from the window's ends, because a split looks ahead a few characters and an
added token may lie across the join; a window that reaches a text's end needs none there.

Only ids travel between tasks. Neighbouring parts are joined in groups of FAN first, each group in a task of
its own; then a document's groups meet in one task, since the digest of its ids needs them all in order.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tokenizer_path
from .pretokens import blocks, encoder, load_tokenizer

PART_CHARS, FAN = 1 << 15, 64
MIN_WINDOW = 128


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """Bytes of each token. Byte-level vocabularies write byte b as the b-th of these characters: the
    printable Latin-1 characters stand for themselves, the rest for characters from U+0100 on."""
    tokenizer = load_tokenizer(path)
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    table = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        known = [byte_of.get(ch) for ch in token]
        table[i] = token.encode() if None in known else bytes(known)
    return table


def decode_ids(ids: np.ndarray, path: str) -> str:
    """Text of `ids`, with U+FFFD for bytes that are no UTF-8, as the library decodes."""
    return b"".join(map(token_bytes(path).__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _sizes(path: str) -> tuple[np.ndarray, int]:
    """Bytes of each token, and how far from the end of a text a split may depend on that end, in bytes."""
    added = [len(t.content) for t in load_tokenizer(path).get_added_tokens_decoder().values()]
    return np.array([len(b) for b in token_bytes(path)], np.int64), 4 * max([16, *added])


def _meet(ids: np.ndarray, at: np.ndarray, other: np.ndarray, other_at: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices in both sequences of the tokens that are the same and begin at the same byte, from low to high."""
    _, i, j = np.intersect1d(at, other_at, assume_unique=True, return_indices=True)
    good = (ids[i] == other[j]) & (at[i] >= low) & (at[i] <= high)
    return i[good], j[good]


def join_parts(left: np.ndarray, right: np.ndarray, path: str, window: int = MIN_WINDOW) -> np.ndarray:
    """Ids of the concatenated text from the ids of its two parts."""
    if not len(left) or not len(right):
        return np.concatenate([left, right])
    table, (sizes, margin) = token_bytes(path), _sizes(path)
    inner = lambda i: bool(table[i]) and table[i][0] & 0xC0 == 0x80  # noqa: E731  begins inside a character
    while True:
        a, b = max(0, len(left) - window), min(len(right), window)
        while a > 0 and inner(left[a]):
            a -= 1
        while b < len(right) and inner(right[b]):
            b += 1
        text = b"".join(table[i] for i in (*left[a:].tolist(), *right[:b].tolist())).decode("utf-8")
        middle = np.array(load_tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)
        # Places of tokens in bytes from the beginning of the window.
        before, after = sizes[left[a:]], sizes[right[:b]]
        cut, end = int(before.sum()), int(before.sum() + after.sum())
        at = np.cumsum(sizes[middle]) - sizes[middle]
        i = [0], [0]
        if a:
            i = _meet(left[a:], np.cumsum(before) - before, middle, at, margin, cut - margin)
        j = [b], [len(middle)]
        if b < len(right):
            j = _meet(right[:b], cut + np.cumsum(after) - after, middle, at, cut + margin, end - margin)
        if len(i[0]) and len(j[0]):
            return np.concatenate([left[: a + i[0][-1]], middle[i[1][-1] : j[1][0]], right[j[0][0] :]])
        window *= 2


def join_tree(parts: list[np.ndarray], path: str) -> np.ndarray:
    """Joins neighbours level by level."""
    while len(parts) > 1:
        parts = [join_parts(parts[i], parts[i + 1], path) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else np.zeros(0, np.uint32)


OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(ids: list, found: list[np.ndarray], path: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array([len(x) for x in found], pa.int64()),
        "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found], pa.string()),
        "decoded_sha256": pa.array([hashlib.sha256(decode_ids(x, path).encode()).hexdigest() for x in found], pa.string()),
    })


def _encode(batch: pa.RecordBatch, path: str):
    """(first row, ids of each text) for blocks of the batch's texts."""
    done = 0
    for block in blocks(batch.column("text").to_pylist()):
        flat, counts = encoder(path).encode(block)
        yield done, np.split(flat, np.cumsum(counts)[:-1])
        done += len(block)


def _whole(path: str):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for done, found in _encode(batch, path):
                yield _digests(ids[done : done + len(found)], found, path)

    return run


def _parts(path: str):
    def run(batches):
        for batch in batches:
            for done, found in _encode(batch, path):
                own = batch.slice(done, len(found))
                yield pa.RecordBatch.from_arrays(
                    [*map(own.column, ("row", "doc_id", "part", "n_parts")), pa.array([x.astype("<u4").tobytes() for x in found], pa.binary())],
                    ["row", "doc_id", "part", "n_parts", "ids"],
                )

    return run


def _whole_ids(table: pa.Table, path: str) -> np.ndarray:
    return join_tree([np.frombuffer(x, "<u4").astype(np.uint32) for x in table.sort_by("part").column("ids").to_pylist()], path)


GROUP = "row long, doc_id long, part int, ids binary, digests struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>"


def _joined(path: str):
    """The ids of a group of neighbouring parts; their digests instead if the group is the whole document."""

    def run(table: pa.Table) -> pa.Table:
        whole = _whole_ids(table, path)
        first = {name: table.column(name)[0].as_py() for name in ("row", "doc_id", "part", "n_parts")}
        done = first.pop("n_parts") == table.num_rows
        digests = _digests([0], [whole], path).drop_columns(["doc_id"]).to_pylist()[0] if done else None
        first |= {"part": first["part"] // FAN, "ids": None if done else whole.astype("<u4").tobytes(), "digests": digests}
        return pa.Table.from_pylist([first], GROUP_ARROW)

    return run


def _finished(path: str):
    def run(table: pa.Table) -> pa.Table:
        doc, digests = table.column("doc_id").to_pylist()[:1], table.column("digests")[0].as_py()
        if digests is None:
            return pa.Table.from_batches([_digests(doc, [_whole_ids(table, path)], path)])
        return pa.Table.from_pylist([{"doc_id": doc[0], **digests}], OUT_ARROW)

    return run


DIGESTS = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
OUT_ARROW = pa.schema([("doc_id", pa.int64()), *DIGESTS])
GROUP_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("ids", pa.binary()), ("digests", pa.struct(DIGESTS))])


def encode_decode(docs: DataFrame, tokenizer: str | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of `docs` (doc_id, text).

    Texts of at most `part_chars` code points are one part and need no join. Null and empty texts have no
    ids. Repeated rows and null doc_ids give a row each; other columns are ignored; an empty table gives an
    empty result.
    """
    path = tokenizer or tokenizer_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = F.length(F.coalesce("text", F.lit("")))
    short = docs.where(size <= part_chars).mapInArrow(_whole(path), OUT)
    # Halving k times gives parts of this size. One pass over the text cuts it.
    each = F.ceil(size / F.pow(F.lit(2), F.ceil(F.log2(size / part_chars)))).cast("int")
    cut = F.regexp_extract_all("text", F.concat(F.lit("(?s).{1,"), each.cast("string"), F.lit("}")), F.lit(0))
    long = (
        docs.withColumn("row", F.monotonically_increasing_id()).where(size > part_chars).select("row", "doc_id", cut.alias("cut"))
        .select("row", "doc_id", F.size("cut").alias("n_parts"), F.posexplode("cut").alias("part", "text"))
    )
    parts = long.repartition("row", "part").mapInArrow(_parts(path), "row long, doc_id long, part int, n_parts int, ids binary")
    groups = parts.groupBy("row", F.floor(F.col("part") / FAN).alias("at")).applyInArrow(_joined(path), GROUP)
    return short.unionByName(groups.groupBy("row").applyInArrow(_finished(path), OUT))
