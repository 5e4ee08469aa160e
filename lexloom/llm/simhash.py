"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint's 64 bits are split into blocks. Two fingerprints that differ in at most `distance` bits agree
in all but `distance` blocks, so they share the key of at least one choice of the other blocks. Distinct
fingerprints are joined on these keys and each candidate's Hamming distance is verified. Copies count once:
rows with one fingerprint are one node, so a group of copies makes no pairs. Connected components of the
links are found with large-star and small-star steps.

Texts with a Jaccard similarity of 0.8 differ in too many bits of one fingerprint for that. `keep_one` uses
the same idea on a fingerprint of many 64-bit blocks, each the SimHash of one class of the text's shingles.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, save

BITS, DISTANCE, BLOCKS, SHINGLE, SEED = 64, 2, 6, 3, 42
#: Members of a block's bucket that are paired directly; larger buckets are split further.
BUCKET = 64
#: A key with more than 1 / SHARE of all rows is joined by broadcast; fewer than SHARE keys can have as many.
SHARE, LEAST_HOT = 4096, 16


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of all word shingles, repeats included; of all words together if they are fewer; none without a word."""
    # Bytes are lower-cased and split as ASCII, so only A-Z and the six ASCII white space characters count.
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    spans = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in spans), np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 for none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].byteswap().view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint_text(text: str | None, shingle: int = SHINGLE) -> int:
    return majority_bits(shingle_hashes(text, shingle))


def _fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint_text(t) for t in text], np.uint64).view(np.int64), dtype=np.int64)


def fingerprint(text: str):
    """Fingerprint of a text column as a signed 64-bit integer."""
    return F.pandas_udf(_fingerprints, "long")(F.coalesce(text, F.lit("")))


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Masks of every choice of blocks - distance blocks."""
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(masks, blocks - distance)]


def _flips(mask: int, distance: int) -> list[int]:
    """All ways to flip at most half of `distance` bits (rounded up) outside of `mask`."""
    free = [1 << b for b in range(BITS) if not mask >> b & 1]
    return [_signed(sum(c)) for k in range((distance + 1) // 2 + 1) for c in combinations(free, k)]


def near_pairs(nodes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """Pairs a > b of distinct fingerprints (column fp) that differ in at most `distance` bits.

    Buckets of at most `bucket` fingerprints are joined with themselves. In larger ones, whose members agree
    in all bits of the choice, each member flips up to half of `distance` of the other bits: two members
    within the distance meet at a value between them, so work grows with the bucket, not with its square.
    """
    masks = block_masks(blocks, distance)
    keys = save(nodes.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("choice", "key")
    ), "keys")
    keys = _with_size(keys, ["choice", "key"])
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    a, b = (keys.where((F.col("size") > 1) & (F.col("size") <= bucket)).select(F.col("fp").alias(name), "choice", "key") for name in "ab")
    small = a.join(b, ["choice", "key"]).where((F.col("a") > F.col("b")) & close).select("a", "b")
    flips = F.array(*[F.array(*[F.lit(x) for x in _flips(m, distance)]) for m in masks])
    met = keys.where(F.col("size") > bucket).select("fp", "choice", F.explode(F.get(flips, F.col("choice"))).alias("flip"))
    met = met.withColumn("between", F.col("fp").bitwiseXOR(F.col("flip")))
    a, b = (met.select(F.col("fp").alias(name), "choice", "between") for name in "ab")
    large = a.join(b, ["choice", "between"]).where((F.col("a") > F.col("b")) & close).select("a", "b")
    return small.unionByName(large).distinct()


def _with_size(rows: DataFrame, key: list[str]) -> DataFrame:
    """`rows`, a saved table, with the number of rows of their key, without those of a single one.

    Sizes join back by the key; those of keys that hold more than 1 / SHARE of the rows are broadcast, fewer than SHARE.
    """
    sizes = save(rows.groupBy(*key).agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    most = max(LEAST_HOT, rows.count() // SHARE)
    if not sizes.where(F.col("size") > most).first():
        return rows.join(sizes, key)
    hot = F.broadcast(sizes.where(F.col("size") > most))
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(sizes.where(F.col("size") <= most), key))


def _with_least(rows: DataFrame, n_rows: int) -> DataFrame:
    """`rows` (u, v) with m, the least v of all rows of u.

    The least values join back by u. Keys that hold more than n_rows / SHARE rows (and more than LEAST_HOT)
    are joined by broadcast where their rows are: at most SHARE keys can be as large, whatever the input.
    """
    most = max(LEAST_HOT, n_rows // SHARE)
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if (least.agg(F.max("n")).first()[0] or 0) <= most:
        return rows.join(least, "u").select("u", "v", "m")
    hot = F.broadcast(least.where(F.col("n") > most))
    others = rows.join(hot, "u", "left_anti").join(least.where(F.col("n") <= most), "u")
    return rows.join(hot, "u").unionByName(others).select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of `links` (columns a, b); root is the least node of the component.

    Each round points neighbours at the least node they know (large star), then joins the parents of each
    node (small star), until nothing changes. Every step is written to the shared folder, and the one
    before it deleted.
    """
    edges = save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    sum_of = (F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
    state = edges.agg(*sum_of).first()
    while state.n:
        both = edges.union(edges.select("v", "u"))
        near = _with_least(both, 2 * state.n).withColumn("m", F.least("u", "m"))
        large = save(near.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large_star")
        joined = _with_least(large, 2 * state.n)
        pairs = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = joined.select(F.explode(pairs).alias("e")).select("e.*").where("u <> v").distinct()
        before, edges = edges, save(small, "edges")
        now = edges.agg(*sum_of).first()
        discard(before, large)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select("root", "root").distinct())


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, class_size, n_links for every row of `docs`.

    component_id is the least doc_id of the rows that are linked, directly or not; n_links counts the other
    fingerprints within `distance` bits. Null and empty texts have fingerprint 0 and are linked like others.
    A null doc_id is never a component's id unless its component has no other. Repeated rows have a row
    each. Other columns are ignored and an empty table gives an empty result.
    """
    marked = save(docs.select("doc_id", fingerprint("text").alias("fp")), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"))
    pairs = save(near_pairs(nodes.select("fp"), distance, blocks), "pairs")
    links = pairs.select("a").union(pairs.select("b")).groupBy(F.col("a").alias("fp")).agg(F.count("*").alias("n_links"))
    roots = components(pairs).select(F.col("node").alias("fp"), "root")
    known = nodes.join(roots, "fp", "left").join(links, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = known.groupBy("root").agg(F.min("least_id").alias("component_id"), F.sum("copies").alias("class_size"))
    node = known.join(classes, "root").select("fp", "component_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return marked.join(node, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_size", "n_links"
    )
