"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds sum(c_j * B^j) for j < i, modulo two primes. Any span's hash is the
difference of two entries, brought to exponent 0, so spans of one or two texts are compared in constant time
and longest common extensions are found by binary search. The fingerprint of a text is its whole hash, its
length and the least hashes of its spans of SPAN code points, and of SHORT code points for texts below
BOTH code points; the likeness of two fingerprints is the Dice share of common spans that these estimate.
Two texts are compared by short spans if one has fewer than FEW code points and the other has them, else by
long ones. Common extensions need the texts themselves, so they give a column of their own.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The largest primes below 2^31 of which the first is 2^31 - 1, with a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353)
SPAN, SHORT, FEW, BOTH, SKETCH = 24, 4, 192, 2304, 96


@lru_cache(maxsize=8)
def _powers(k: int, n: int, inverse: bool) -> np.ndarray:
    """First n powers (n a power of two) of base k, or of its inverse."""
    p = np.uint64(PRIMES[k])
    base = pow(BASES[k], -1, PRIMES[k]) if inverse else BASES[k]
    out = np.ones(n, np.uint64)
    size = 1
    while size < n:
        out[size : 2 * size] = out[:size] * np.uint64(pow(base, size, PRIMES[k])) % p
        size *= 2
    return out


def _padded(n: int) -> int:
    return max(1 << 16, 1 << max(n - 1, 1).bit_length())


class PrefixHash:
    """Prefix arrays of one text given as code points."""

    def __init__(self, codes: np.ndarray):
        self.n = n = len(codes)
        self.size = _padded(n + 1)
        values = codes.astype(np.uint64) + np.uint64(1)
        self.prefix = []
        for k, p in enumerate(PRIMES):
            terms = values * _powers(k, self.size, False)[:n] % np.uint64(p)
            self.prefix.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms) % np.uint64(p)]))

    def spans(self, starts: np.ndarray, length: int) -> np.ndarray:
        """62-bit hashes of the spans of one length that begin at `starts`."""
        out = np.zeros(len(starts), np.uint64)
        for k, p in enumerate(PRIMES):
            prefix = self.prefix[k]
            h = (prefix[starts + length] + np.uint64(p) - prefix[starts]) % np.uint64(p)
            h = h * _powers(k, self.size, True)[starts] % np.uint64(p)
            out = (out << np.uint64(31)) | h
        return out

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all spans of one length, in order."""
        m = self.n - length + 1
        out = np.zeros(m, np.uint64)
        for k, p in enumerate(PRIMES):
            prefix = self.prefix[k]
            h = (prefix[length:] + np.uint64(p) - prefix[:m]) % np.uint64(p)
            out = (out << np.uint64(31)) | (h * _powers(k, self.size, True)[:m] % np.uint64(p))
        return out

    def span(self, start: int, length: int) -> int:
        return int(self.spans(np.array([start]), length)[0])


def codes_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), np.uint32)


def spans_equal(a: PrefixHash, i: int, b: PrefixHash, j: int, length: int) -> bool:
    """Whether a[i:i+length] equals b[j:j+length]; spans that don't lie inside both texts are unequal."""
    if i < 0 or j < 0 or length < 0 or i + length > a.n or j + length > b.n:
        return False
    return length == 0 or a.span(i, length) == b.span(j, length)


def common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """Length of the longest common prefix of a[i:] and b[j:], by binary search on span equality."""
    low, high = 0, max(0, min(a.n - i, b.n - j))
    while low < high:
        middle = (low + high + 1) // 2
        if spans_equal(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def _least(hashes: PrefixHash, span: int) -> np.ndarray:
    """The SKETCH least scrambled hashes of distinct spans; texts shorter than a span are one span."""
    if not hashes.n:
        return np.zeros(0, np.uint64)
    h = hashes.windows(min(span, hashes.n))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h &= np.uint64(0xFFFFFFFF)
    share = 2 * SKETCH / len(h)
    while share < 1:
        if len(least := np.unique(h[h < np.uint64(int(share * 2**32))])) >= SKETCH:
            return least[:SKETCH]
        share *= 4
    return np.unique(h)[:SKETCH]


class Print:
    """What a fingerprint holds: whole hash, length, and the sketches of long and short spans."""

    __slots__ = ("long", "n", "short", "whole")

    def __init__(self, hashes: PrefixHash):
        self.n = hashes.n
        self.whole = hashes.span(0, hashes.n) if hashes.n else 0
        self.long = _least(hashes, SPAN)
        self.short = _least(hashes, SHORT) if hashes.n < BOTH else None

    def text(self) -> str:
        """Hex digits: whole hash (16), length (8), then 8 for each entry of the long sketch and, for texts below
        BOTH code points, of the short one."""
        entries = self.long if self.short is None else np.concatenate([self.long, self.short])
        return f"{self.whole:016x}{self.n & 0xFFFFFFFF:08x}" + entries.astype(">u4").tobytes().hex()


def likeness(a: Print, b: Print) -> float:
    """Estimated share of common spans, 2 |A and B| / (|A| + |B|); 1 for equal texts, also empty ones."""
    if (a.whole, a.n) == (b.whole, b.n):
        return 1.0
    by_short = min(a.n, b.n) < FEW and a.short is not None and b.short is not None
    x, y = (a.short, b.short) if by_short else (a.long, b.long)
    union = np.union1d(x, y)[:SKETCH]
    jaccard = len(np.intersect1d(np.intersect1d(x, y, True), union, True)) / len(union) if len(union) else 0.0
    return 2 * jaccard / (1 + jaccard)


OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, same_prefix_next long"
)


def _consecutive(batches):
    """Describes each row with the row after it; rows come sorted, and each part ends with a row to look at."""

    def pairs():
        part, before = None, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text")), strict=True):
                if before and row[0] == part:
                    yield before, row
                part, before = row[0], row

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
    names = [c.split()[0] for c in OUT.split(", ")]

    def batch_of(done):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)

    done = []
    for (_, doc_id, text), (_, _, after) in pairs():
        done.append(_pair(doc_id, text, after))
        if len(done) == 1024:
            yield batch_of(done)
            done = []
    if done:
        yield batch_of(done)


_last: dict = {}


def _pair(doc_id, text, after):
    """The described row. The second text of a pair is the first of the next, so its arrays are kept once."""
    if _last.get("text") is not text:
        codes = codes_of(text)
        hashes = PrefixHash(codes)
        _last.update(text=text, made=(codes, hashes, Print(hashes)))
    old, old_hashes, own = _last["made"]
    codes = codes_of(after)
    hashes = PrefixHash(codes)
    following = Print(hashes)
    half = len(old) // 2
    edited = np.concatenate([old[: len(old) - half], codes[:half]])
    changed = Print(PrefixHash(edited))
    _last.update(text=after, made=(codes, hashes, following))
    return (
        doc_id, len(old), hashlib.sha256(edited.tobytes().decode("utf-32-le").encode()).hexdigest(), own.text(), changed.text(),
        likeness(own, changed), likeness(own, following), common_extension(old_hashes, 0, hashes, 0),
    )


def document_fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of
    the next document in ascending doc_id; the first one follows the last. Rows that share a doc_id follow one
    another in the order of a hash of their texts. Null texts are empty and null doc_ids come first. Rows with equal
    doc_id and text are ties of equal results, but for the last of them. A single row follows itself. Other
    columns are ignored; an empty table gives an empty result.

    Rows are dealt by ranges of (doc_id, hash), so only one copy of the texts is shuffled; the first row of
    each range is also sent to the range before it.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("hash", F.xxhash64("text"))
    parts = parts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The ranges that Spark's own sampling finds, without the texts; a row for each range comes to the driver.
    ranges = docs.select("key", "hash").repartitionByRange(parts, "key", "hash").groupBy(F.spark_partition_id().alias("range"))
    firsts = sorted({(r.least.key, r.least.hash) for r in ranges.agg(F.min(F.struct("key", "hash")).alias("least")).collect()})
    if not firsts:
        return spark.createDataFrame([], OUT)
    dealt = docs.withColumn("part", _part_of(firsts))
    before = [((i - 1) % len(firsts), *first) for i, first in enumerate(firsts)]
    before = spark.createDataFrame(before, "part int, first_key long, first_hash long")
    looked = (
        docs.join(F.broadcast(before), (F.col("key") == F.col("first_key")) & (F.col("hash") == F.col("first_hash")))  # a row for each range
        .groupBy("part").agg(F.min(F.struct("text", "doc_id", "key", "hash")).alias("row")).select("part", "row.*", F.lit(1).alias("last"))
    )
    rows = dealt.withColumn("last", F.lit(0)).unionByName(looked)
    return (
        rows.repartitionById(len(firsts), F.col("part"))
        .sortWithinPartitions("part", "last", "key", "hash", "text")
        .select("part", "last", "doc_id", "text")
        .mapInArrow(_consecutive, OUT)
    )


def _part_of(firsts: list[tuple[int, int]]):
    """Index of the last range that begins at or before (key, hash), by binary search in a literal array."""
    keys, hashes = F.lit([k for k, _ in firsts]), F.lit([h for _, h in firsts])
    powers = [1 << b for b in reversed(range(len(firsts).bit_length()))]

    def step(at, jump):
        k, h = F.get(keys, at + jump), F.get(hashes, at + jump)
        return F.when((k < F.col("key")) | ((k == F.col("key")) & (h <= F.col("hash"))), at + jump).otherwise(at)

    return F.aggregate(F.lit(powers), F.lit(0), step)
