"""The near dedup stage loses no link: common openings, groups of near copies, texts in few classes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import near_texts
from lexloom.llm.simhash import shingle_hashes


def word(rng):
    return "".join(rng.choices("abcdefghij", k=7))


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in near_texts.keep_one(docs).collect()}


def brute_force(texts):
    """The least place of each component of texts with a similarity of 0.8, by an index of all shingles."""
    sets = [frozenset(shingle_hashes(t, near_texts.SHINGLE).tolist()) for t in texts]
    holders, parent = {}, list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        near = set().union(*(holders.get(h, ()) for h in s))
        for j in near:
            if 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
        for h in s:
            holders.setdefault(h, []).append(i)
    return {i for i in range(len(texts)) if top(i) == i}


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_pairs_behind_a_common_opening(spark, seed):
    rng = random.Random(seed)
    opening = [word(rng) for _ in range(12)]
    texts = []
    for _ in range(600):
        middle = [word(rng) for _ in range(3)]
        texts += [" ".join([*opening, *middle, word(rng)]) for _ in range(2)]
    rng.shuffle(texts)
    found = kept(spark, texts)
    assert found == brute_force(texts) and len(found) == 600


def test_groups_of_near_copies(spark):
    """Several large groups of near copies of one template, chains between them, and texts that share only boilerplate."""
    rng = random.Random(3)
    base = [word(rng) for _ in range(60)]
    texts = []
    for _ in range(3):
        own = base[:30] + [word(rng) for _ in range(30)]
        for _ in range(150):
            t = list(own)
            for _ in range(rng.choice([0, 1, 1, 2])):
                t[rng.randrange(60)] = word(rng)
            texts.append(" ".join(t))
    texts += [" ".join(base[:40] + [word(rng) for _ in range(20)]) for _ in range(150)]
    rng.shuffle(texts)
    assert kept(spark, texts) == brute_force(texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_edited_copies_without_links_among_each_other(spark, seed):
    """Copies of a text that differ more from one another than from it, of different lengths, some too far from it to be
    linked and linked to one another instead; the text itself isn't the first in any order of ids."""
    rng = random.Random(seed)
    base, texts = [word(rng) for _ in range(150)], []
    for edits in [0] + [rng.choice([1, 2, 3, 4, 6]) for _ in range(250)]:
        t = base[: rng.randrange(120, 151)] if rng.random() < 0.3 else list(base)
        for _ in range(edits):
            t[rng.randrange(len(t))] = word(rng)
        texts.append(" ".join(t))
        if edits == 6 and rng.random() < 0.5:
            t[0] = word(rng)
            texts.append(" ".join(t))
    rng.shuffle(texts)
    assert kept(spark, texts) == brute_force(texts)


def test_texts_in_few_classes_share_a_block():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(4, 60))
        step = near_texts.steps(n)[0]
        few = max(1, n // 4)
        hashes = np.unique((rng.integers(0, 1 << 40, n, dtype=np.uint64) << np.uint64(step)) | rng.integers(0, min(few, 1 << step), n, dtype=np.uint64))
        if 4 * len(np.unique(hashes & np.uint64((1 << step) - 1))) <= len(hashes):
            assert (step, near_texts.SPARSE, 0) in near_texts.blocks_of(hashes)


def test_rare_shingles_are_shared(spark):
    rng = random.Random(2)
    sets = []
    for i in range(0, 300, 2):
        own = [rng.getrandbits(40) for _ in range(rng.randrange(5, 60))] + list(range(20))
        other = list(own)
        for _ in range(len(own) // 10):
            other[rng.randrange(len(own))] = rng.getrandbits(40)
        sets += [(i, sorted(set(own))), (i + 1, sorted(set(other)))]
    rare = near_texts.rare_shingles(spark.createDataFrame(sets, "id long, hashes array<long>"), 0.8)
    found = {r.id: set(r.hashes) for r in rare.groupBy("id").agg(F.collect_set("hash").alias("hashes")).collect()}
    for (i, a), (j, b) in zip(sets[::2], sets[1::2]):
        a, b = set(a), set(b)
        assert 5 * len(a & b) < 4 * len(a | b) or found[i] & found[j]


def blocks_and_bits(a, b):
    """Blocks and bits in which two sets of hashes differ at the least, of the steps that they share; None without one."""
    one, two = ({f["step"]: f["blocks"] for f in near_texts.fingerprints_of(x)} for x in (a, b))
    found = []
    for step in one.keys() & two.keys():
        pairs = list(zip(one[step], two[step], strict=True))
        bits = sum((((p or 0) ^ (q or 0)) & (1 << 64) - 1).bit_count() for p, q in pairs)
        found.append((sum(p != q for p, q in pairs), bits, 64 * len(pairs)))
    return min(found, default=None)


def near_enough(a, b):
    found = blocks_and_bits(a, b)
    n = min(len(a), len(b))
    return found is not None and 4 * found[0] <= n and (n < 4 * near_texts.CLASSES or found[1] <= near_texts.FAR * found[2])


def test_hamming_check_keeps_all_pairs_of_the_similarity(spark):
    """Pairs at 0.8 or just above, with all changes on one side or on both, from 1 to 1,500 shingles; and far ones that go."""
    rng = np.random.default_rng(9)
    rows, near, far = [], set(), set()
    for k in range(1500):
        n = int(rng.integers(1, 80)) if k % 3 else int(rng.integers(80, 1500))
        shared = rng.integers(0, 1 << 64, n, np.uint64)
        extra = int(rng.integers(0, n // 4 + 1))
        a = np.unique(np.append(shared, rng.integers(0, 1 << 64, extra, np.uint64)))
        b = np.unique(np.append(shared, rng.integers(0, 1 << 64, n // 4 - extra, np.uint64)))
        other = np.unique(np.append(shared[: n // 8], rng.integers(0, 1 << 64, n - n // 8, np.uint64)))
        rows += [(3 * k + i, len(x), near_texts.fingerprints_of(x)) for i, x in enumerate((a, b, other))]
        near.add((3 * k + 1, 3 * k))
        if not near_enough(a, other):
            far.add((3 * k + 2, 3 * k))
    nodes = spark.createDataFrame(rows, "id long, n_shingles int, prints array<struct<step:int,sparse:boolean,blocks:array<long>>>")
    pairs = nodes.select(F.col("id").alias("a"), F.explode(F.array(F.col("id") - 1, F.col("id") - 2)).alias("b")).where("a % 3 > 0 and b % 3 = 0 and floor(a / 3) = floor(b / 3)")
    found = {tuple(r) for r in near_texts.close(pairs, nodes, 0.8).collect()}
    assert near <= found and not far & found and len(far) > 1400


@pytest.mark.parametrize("crowd", [20, 150])
def test_only_pairs_of_near_fingerprints_are_compared(spark, monkeypatch, crowd):
    """Texts behind a common opening meet in blocks (20 texts) or by rare shingles (150); the exact check sees only those whose
    fingerprints are near."""
    rng = random.Random(crowd)
    opening = [word(rng) for _ in range(40)]
    texts = []
    for _ in range(crowd // 2):
        t = opening + [word(rng) for _ in range(60)]
        texts += [" ".join(t), " ".join([*t[:-1], word(rng)])]
    seen, linked = [], near_texts._linked

    def spy(pairs, sets, similarity):
        hashes = {r.id: np.array(r.hashes, np.int64).view(np.uint64) for r in sets.collect()}
        seen.extend((np.sort(hashes[r.a]), np.sort(hashes[r.b])) for r in pairs.collect())
        return linked(pairs, sets, similarity)

    monkeypatch.setattr(near_texts, "_linked", spy)
    assert kept(spark, texts) == brute_force(texts)
    assert seen and all(near_enough(a, b) for a, b in seen)


@pytest.mark.parametrize("share", [4096, 4])
def test_more_groups_than_are_broadcast(spark, monkeypatch, share):
    monkeypatch.setattr(near_texts, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(near_texts, "SHARE", share)
    rng = random.Random(share)
    words = [word(rng) for _ in range(80)]
    texts = [" ".join([*words, word(rng)]) for _ in range(90)] + [" ".join([*words[:20], *(word(rng) for _ in range(60))]) for _ in range(20)]
    rng.shuffle(texts)
    assert kept(spark, texts) == brute_force(texts)
