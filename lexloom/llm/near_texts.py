"""Near-duplicate texts by Jaccard similarity of their word shingles: SimHash blocks, Hamming check, components.

The steps are those of `simhash.near_duplicates`, with a longer fingerprint: fingerprints, a join on every choice of
blocks by which the pigeonhole lets near ones meet, the Hamming check of each candidate, and components of the links.
Between the last two comes an exact check: the similarity of the sets of shingle hashes.

Fingerprint and blocks. A text's shingles are dealt by hash to M classes, and each class has a SimHash of its own: the fingerprint is
the row of these 64-bit blocks. If two texts have n shingles and a similarity of at least 0.8, at most n / 4
shingles are in one of them alone. These can't reach all of M > n / 4 classes, so some class is equal: the
pigeonhole, and every choice of one block is joined. The equal class may be empty in both; then both have shingles in at most n / 4
classes, and such texts have one more block in common. Texts of fewer than CLASSES * 4 shingles have all their blocks joined.
Longer ones have blocks for every 4 to 8 shingles, and CLASSES of them are joined: a pair with a similarity of 0.8 misses
them all with a probability of about 0.05 at most. Texts whose numbers of shingles fall on both sides of a step of M have the
blocks of both steps.

Hamming check. A candidate stays if its fingerprints differ in at most n / 4 blocks (n of the shorter text), which all pairs of
similarity 0.8 do, and, if both have at least CLASSES * 4 shingles, so that n / 4 blocks are all of them, in at most FAR of
the bits. 16,600 random pairs of similarity 0.8 and 64 to 5,000 shingles differed in 0.11 of the bits on the average and
in 0.23 at most. Half of a class's shingles replaced change 0.28 of its bits, so a pair beyond FAR would need about four times
the changes in its classes that it has on the average.

Texts with equal sets are one node. Buckets of at most BUCKET nodes give all pairs. Larger buckets are split by the finest
blocks: classes of one shingle, whose SimHash is the shingle's hash. Two sets of n shingles and similarity 0.8 differ in
at most n - ceil(0.8 n) of them, so they share one of each one's first n - ceil(0.8 n) + 1 in any order, and the rarest come first.
Where more than RARE_BUCKET nodes share such a block, each is compared with one of them, and
only nodes that aren't yet in the component of most of them are compared with all the others. So m near copies cost
about m comparisons, and no link between components is lost. These candidates pass the same Hamming and exact checks.
Components of the links are the groups.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, save
from .ranks import BROADCAST_ROWS, small
from .simhash import BUCKET, LEAST_HOT, SHARE, components, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
CLASSES = 16
#: Nodes that share a rare shingle give all pairs up to so many.
RARE_BUCKET = 8
#: Class of the block that texts with few classes have in common.
SPARSE = -1
#: Fingerprints of long texts that differ in more than this part of their bits are too far from each other.
FAR = 5 / 16
#: Frequencies of shingles are counted in so many buckets, as a power of two.
COUNT_BITS = 16
MARKS = "node string, n_shingles int, prints array<struct<step:int,sparse:boolean,blocks:array<long>>>"


def steps(n: int, similarity: float = SIMILARITY) -> list[int]:
    """Numbers of classes, as powers of two, in which a text of n shingles has blocks: its own, and that of
    texts which have up to n / similarity shingles."""

    def own(n: float) -> int:
        if n < 4:
            return 0
        return int(np.log2(n / 2)) if n < 4 * CLASSES else int(np.log2(n / 4))

    return sorted({own(n), own(n / similarity)})


def blocks_of(hashes: np.ndarray) -> list[tuple[int, int, int]]:
    """(step, class, SimHash of the class) of a sorted set of shingle hashes."""
    found = []
    for step in steps(len(hashes)):
        of = (hashes & np.uint64((1 << step) - 1)).astype(np.int64)
        chosen = np.flatnonzero(of < CLASSES)
        chosen = chosen[np.argsort(of[chosen], kind="stable")]
        kept = of[chosen]
        if not len(kept):
            continue
        first = np.flatnonzero(np.diff(kept, prepend=-1))
        bits = np.unpackbits(hashes[chosen].byteswap().view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        sizes = np.diff(np.append(first, len(kept)))
        prints = np.packbits(2 * ones > sizes[:, None], axis=1).reshape(-1).view(">u8").astype(np.uint64).view(np.int64)
        found += zip([step] * len(first), kept[first].tolist(), prints.tolist())
        if len(hashes) < 4 * CLASSES and 4 * len(first) <= len(hashes):
            found.append((step, SPARSE, 0))
    return found


def fingerprints_of(hashes: np.ndarray) -> list[dict]:
    """The fingerprint of a sorted set of shingle hashes in each of its steps: the blocks of all classes, None for an empty
    one, and whether the text has the block of texts with few classes."""
    found = {s: {"step": s, "sparse": False, "blocks": [None] * min(CLASSES, 1 << s)} for s in steps(len(hashes))}
    for s, c, p in blocks_of(hashes):
        if c == SPARSE:
            found[s]["sparse"] = True
        else:
            found[s]["blocks"][c] = p
    return list(found.values())


def _mark(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        hashes = np.unique(shingle_hashes(t, SHINGLE))
        rows.append((hashlib.blake2b(hashes.tobytes(), digest_size=16).hexdigest(), len(hashes), fingerprints_of(hashes)))
    return pd.DataFrame(rows, columns=["node", "n_shingles", "prints"])


def _blocks(nodes: DataFrame) -> DataFrame:
    """id, step, class and print of all blocks of `nodes`."""
    each = nodes.select("id", F.explode("prints").alias("p")).select("id", "p.*")
    own = F.filter(F.transform("blocks", lambda b, c: F.struct(c.alias("class"), b.alias("print"))), lambda b: b["print"].isNotNull())
    common = F.array(F.struct(F.lit(SPARSE).alias("class"), F.lit(0).cast("long").alias("print")))
    return each.select("id", "step", F.explode(F.when(F.col("sparse"), F.concat(own, common)).otherwise(own)).alias("b")).select("id", "step", "b.*")


def close(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The Hamming check: pairs a, b of ids of `nodes` (id, n_shingles, prints) whose fingerprints differ in few enough blocks
    and bits. Pairs without a common step differ too much in length."""
    one, two = (nodes.select(F.col("id").alias(name), F.col("n_shingles").alias(f"{name}_n"), F.col("prints").alias(f"{name}_prints")) for name in "ab")
    n = F.least("a_n", "b_n")

    def total(x: Column, y: Column, differ) -> Column:
        return F.aggregate(F.zip_with(x["blocks"], y["blocks"], differ), F.lit(0), lambda s, d: s + d)

    def near(x: Column, y: Column) -> Column:
        blocks = total(x, y, lambda p, q: (~p.eqNullSafe(q)).cast("int"))
        bits = total(x, y, lambda p, q: F.bit_count(F.coalesce(p, F.lit(0)).bitwiseXOR(F.coalesce(q, F.lit(0)))))
        few = blocks <= F.lit(1 / similarity - 1) * n + 1e-6
        return (x["step"] == y["step"]) & few & ((n < 4 * CLASSES) | (bits <= F.lit(64 * FAR) * F.size(x["blocks"])))

    met = pairs.join(one, "a").join(two, "b")
    return met.where(F.exists("a_prints", lambda x: F.exists("b_prints", lambda y: near(x, y)))).select("a", "b")


def _sets(batches):
    for batch in batches:
        sets = [np.unique(shingle_hashes(t, SHINGLE)).view(np.int64) for t in batch.column("text").to_pylist()]
        ends = np.cumsum([0, *map(len, sets)])
        values = pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["id", "hashes"])


def _text_key(text: str = "text") -> list[Column]:
    """128 bits that tell a text from others; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("__t1"), F.xxhash64(F.lit("second"), t).alias("__t2")]


def _pairs(keys: DataFrame, key: list[str]) -> DataFrame:
    """All pairs a > b of ids that share a key."""
    a, b = (keys.select(F.col("id").alias(name), *key) for name in "ab")
    return a.join(b, key).where("a > b").select("a", "b").distinct()


def _sets_of(docs: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """id and hashes, the sorted set of shingle hashes, of the nodes that have `ids`. Texts that aren't needed aren't
    shuffled where the keys of the others are few enough to be broadcast."""
    needed = nodes.join(ids, "id", "left_semi").select("id", F.col("of.doc_id").alias("__id"), F.col("of.__t1").alias("__a"), F.col("of.__t2").alias("__b"))
    needed = save(needed, "needed")
    texts = docs.select("doc_id", "text", *_text_key())
    same = (F.col("doc_id") == F.col("__id")) & (F.col("__t1") == F.col("__a")) & (F.col("__t2") == F.col("__b"))
    found = texts.join(small(needed), same).select("id", "text").mapInArrow(_sets, "id long, hashes array<long>")
    sets = save(found.dropDuplicates(["id"]), "sets")
    discard(needed)
    return sets


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose sets have at least `similarity`."""
    one, two = (sets.select(F.col("id").alias(name), F.col("hashes").alias(f"{name}_set")) for name in "ab")
    both = F.size(F.array_intersect("a_set", "b_set"))
    checked = pairs.join(one, "a").join(two, "b").where(both >= F.lit(similarity) * (F.size("a_set") + F.size("b_set") - both))
    return save(checked.select("a", "b"), "links")


def _counts(batches):
    """Numbers of hashes in each of 2 ** COUNT_BITS buckets, as bytes: one row for each task."""
    total = np.zeros(1 << COUNT_BITS, np.int64)
    for batch in batches:
        for row in batch.column("hashes").to_pylist():
            total += np.bincount(np.array(row, np.int64) & (len(total) - 1), minlength=len(total))
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])


def _sums(batches):
    total = np.zeros(1 << COUNT_BITS, np.int64)
    for batch in batches:
        for row in batch.column("counts").to_pylist():
            total += np.frombuffer(row, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])


def rare_shingles(sets: DataFrame, similarity: float) -> DataFrame:
    """id, hash, place, n and central: the rarest shingles of each set, of which two sets of at least `similarity` share
    one, with their places in the set's order.

    That holds under any order that is the same for all sets. This one is by the number of shingles in a bucket of
    hashes, so frequent shingles come last, and only the rare ones of a set become rows. `central` is the mean logarithm
    of these numbers over the whole set: a text of which others are edited copies has a greater one than they have.
    16 sums come to the driver.
    """
    parts = sets.select("hashes").mapInArrow(_counts, "counts binary").repartition(16).mapInArrow(_sums, "counts binary").collect()
    counts = np.sum([np.frombuffer(r.counts, np.int64) for r in parts], axis=0)
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def first(batches):
        for batch in batches:
            ids, hashes, places, sizes, central = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], []
            for i, row in zip(batch.column("id").to_pylist(), batch.column("hashes").to_pylist()):
                values = np.array(row, np.int64)
                often = shared.value[values & (len(shared.value) - 1)]
                order = np.lexsort((values, often))
                values = values[order[: len(values) - math.ceil(len(values) * similarity - 1e-9) + 1]]
                hashes.append(values)
                places.append(np.arange(len(values)))
                ids += [i] * len(values)
                sizes += [len(row)] * len(values)
                central += [float(np.log(often).mean()) if len(row) else 0.0] * len(values)
            columns = [
                pa.array(ids, pa.int64()), pa.array(np.concatenate(hashes), pa.int64()), pa.array(np.concatenate(places), pa.int32()),
                pa.array(sizes, pa.int32()), pa.array(central, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "hash", "place", "n", "central"])

    return sets.select("id", "hashes").mapInArrow(first, "id long, hash long, place int, n int, central double")


def _in_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """`rows`, a saved table, with the row of `groups` of their hash, without those that have none. More groups than can be
    broadcast join by the hash, but for those of more than 1 / SHARE of the rows, of which there are fewer than SHARE."""
    if groups.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), "hash")
    most = max(LEAST_HOT, rows.count() // SHARE)
    hot = F.broadcast(groups.where(F.col("size") > most))
    others = rows.join(hot, "hash", "left_anti").join(groups.where(F.col("size") <= most), "hash")
    return rows.join(hot, "hash").unionByName(others)


def _crowded_links(sets: DataFrame, nodes: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Links of sets that share rare shingles, the finest blocks. `known` are links found elsewhere. Sets that are joined by
    others needn't have their own link, so the components are those of all links."""
    rare = save(rare_shingles(sets, similarity), "rare")
    first = F.max(F.struct("central", F.xxhash64("id").alias("h"), F.col("id")))["id"]  # one order, so groups have few different ones
    groups = save(rare.groupBy("hash").agg(F.count("*").alias("size"), first.alias("first")).where("size > 1"), "groups")
    pairs = _pairs(rare.join(groups.where(F.col("size") <= RARE_BUCKET).select("hash"), "hash"), ["hash"])
    large = groups.where(F.col("size") > RARE_BUCKET)
    members = save(_in_groups(rare, large).select("hash", "id", "place", "n", "first"), "members")
    stars = members.select("id", F.col("first").alias("other")).where("id <> other")
    pairs = pairs.union(stars.select(F.greatest("id", "other"), F.least("id", "other"))).distinct()
    links = _linked(close(pairs, nodes, similarity), sets, similarity)
    if members.first():
        pairs = _separate_pairs(members, known.union(links), similarity)
        links = links.union(_linked(close(pairs, nodes, similarity), sets, similarity))
    discard(rare, groups, members)
    return links


def _separate_pairs(members: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """Pairs a > b of sets in different components of `links` that can have `similarity` by the place of the first shingle
    they share. Each row of `members` is the place of a shingle that many sets share; pairs that share another are
    compared elsewhere.

    In each group of a shingle the sets outside of its largest component meet all others. Two sets of n and m shingles
    with the similarity t share at least t / (1 + t) (n + m), so neither can have fewer than that from the first shared one
    on. The shorter set has its first shared one among its first n - 2 t n / (1 + t) + 1, which are the rows it is met at.
    """
    roots = components(links).select(F.col("node").alias("id"), "root")
    placed = save(members.join(roots, "id", "left").select("hash", "id", "place", "n", F.coalesce("root", "id").alias("root")), "placed")
    most = placed.groupBy("hash", "root").agg(F.count("*").alias("m")).groupBy("hash").agg(F.max_by("root", F.struct("m", "root")).alias("most"))
    met = save(placed.join(small(save(most, "most")), "hash").withColumn("minor", F.col("root") != F.col("most")), "met")
    x, y = (met.select("hash", *[F.col(c).alias(f"{c}_{i}") for c in ("id", "place", "n", "root", "minor")]) for i in "xy")
    share = similarity / (1 + similarity)
    x = x.where(F.col("n_x") - F.col("place_x") >= F.lit(2 * share) * F.col("n_x") - 1e-6)
    shorter = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("id_x") < F.col("id_y")))
    near = (F.col("root_x") != F.col("root_y")) & shorter & (F.col("n_x") >= F.col("n_y") * F.lit(similarity) - 1e-6)
    left = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))
    near &= left >= F.lit(share) * (F.col("n_x") + F.col("n_y")) - 1e-6
    found = x.where("minor_x").join(y, "hash").where(near).union(x.where("not minor_x").join(y.where("minor_y"), "hash").where(near))
    out = save(found.select(F.greatest("id_x", "id_y").alias("a"), F.least("id_x", "id_y").alias("b")).distinct(), "separate")
    discard(placed, met)
    return out


def links(docs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs a > b of node ids whose components are those of all candidates with at least `similarity`. `nodes` has id,
    n_shingles, prints and one text of each node, as doc_id and text key."""
    key = ["step", "class", "print"]
    keys = save(_blocks(nodes), "blocks")
    buckets = save(keys.groupBy(*key).agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    pairs = _pairs(keys.join(buckets.where(F.col("size") <= BUCKET).select(*key), key), key)
    pairs = save(close(pairs, nodes, similarity), "close")
    crowded = save(keys.join(small(buckets.where(F.col("size") > BUCKET).select(*key)), key).select("id").distinct(), "crowded")
    sets = _sets_of(docs, nodes, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(crowded).distinct())
    found = _linked(pairs, sets, similarity)
    if crowded.first():
        prints = save(nodes.join(crowded, "id", "left_semi").select("id", "n_shingles", "prints"), "prints")
        found = found.union(_crowded_links(sets.join(crowded, "id", "left_semi"), prints, found, similarity))
        discard(prints)
    discard(keys, buckets, pairs)
    return found


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` with one row of each group of near-duplicates: the one with the least doc_id (then text key).

    Texts are linked if the Jaccard similarity of their sets of five-word shingles (A-Z in lower case) is at
    least `similarity`; groups are the components of the links. Texts of fewer words are one shingle; null
    and empty texts and those without a word have none and are one group. Of repeated rows one stays. Rows
    with null doc_id stay and belong to no group: none of them can be told from the others. Other columns are kept as
    they are; an empty table stays empty.
    """
    marks = F.pandas_udf(_mark, MARKS)(F.coalesce("text", F.lit("")))
    whole = docs.select(F.struct("*").alias("row"))  # so that no column of the operator meets one of the input
    rows = whole.select("row", F.col("row.doc_id").alias("doc_id"), *_text_key("row.text"))
    known = docs.where("doc_id is not null").select("doc_id", "text")
    marked = save(known.select("doc_id", *_text_key(), marks.alias("m")).select("doc_id", "__t1", "__t2", "m.*"), "marked")
    nodes = save(
        marked.groupBy("node").agg(
            F.min(F.struct("doc_id", "__t1", "__t2")).alias("of"), F.first("n_shingles").alias("n_shingles"), F.first("prints").alias("prints")
        ).withColumn("id", F.monotonically_increasing_id()), "nodes",
    )
    roots = components(links(known, nodes, similarity)).select(F.col("node").alias("id"), "root")
    groups = nodes.select("id", "node", "of").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    chosen = groups.groupBy("root").agg(F.min("of").alias("chosen"))
    placed = marked.select("node", F.struct("doc_id", "__t1", "__t2").alias("key")).join(groups.join(chosen, "root").select("node", "chosen"), "node")
    key = ["doc_id", "__t1", "__t2"]
    own = placed.groupBy("key").agg(F.first(F.col("key") == F.col("chosen")).alias("kept"), F.count("*").alias("n"))
    own = save(own.where("not kept or n > 1").select("key.*", "kept"), "not_one")  # rows that go, and rows that are repeated
    found = rows.join(small(own), key, "left")
    repeated = rows.join(small(own.where("kept")), key).dropDuplicates(key)
    once = found.where("kept is null")
    discard(marked)
    return once.select("row.*").union(repeated.select("row.*"))
