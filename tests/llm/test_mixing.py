"""The mix against exact targets, an exhaustive subset sum and the chosen documents by brute force."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import product

import numpy as np
import pytest

from lexloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, `all` string, n int, copies int, rank int, target string"


def exact_targets(sizes):
    """Targets by resharing the excess until none is above; sources by UTF-8, null last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in stopped]
        left = total - sum(3 * sizes[s] for s in stopped)
        share = {s: Fraction(left * weight[s], sum(weight[f] for f in free)) for s in free}
        above = {s for s in free if share[s] > 3 * sizes[s]}
        if not above:
            return share | {s: Fraction(3 * sizes[s]) for s in stopped}
        stopped |= above


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["hot", "hot", "hot", "a", "é", "\U0001f600", "", None, f"s{i % 7}"])
        text = rng.choice([None, "", " \n", " ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([1, 3, 3, 50, rng.randrange(400)])))])
        rows.append((rng.choice([i, i, i, None, 5]), text, source))
    return rows + [(None, "x\x0by z", "hot")] * 20 + [(5, "same words", "hot")] * 20


def run(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3, 4, "t") for r in rows], SCHEMA)
    return [tuple(r) for r in mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken").collect()]


def nearest(lengths, target):
    """Distance from the target to what whole passes and some subset of documents can give."""
    passes = target // max(sum(lengths), 1)
    sums = 1
    for length in lengths:
        sums |= sums << length
    return min(abs(target - passes * sum(lengths) - k) for k in range(sum(lengths) + 1) if sums >> k & 1)


@pytest.mark.parametrize(("seed", "n", "reserve", "bucket"), [(1, 40, 1 << 14, 1 << 14), (2, 900, 300, 8), (3, 900, 0, 1)])
def test_mix_by_brute_force(spark, monkeypatch, seed, n, reserve, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(mixing.fit, "__defaults__", (reserve,))
    rows = made(seed, n)
    out = run(spark, rows)
    word_counts = Counter((i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows)
    assert Counter(r[:3] for r in out) == word_counts
    sizes = defaultdict(int)
    for (_, s, size), n_rows in word_counts.items():
        sizes[s] += size * n_rows
    targets, taken = exact_targets(sizes), defaultdict(int)
    for _, s, size, source_size, target, words in out:
        assert source_size == sizes[s] and abs(target - targets[s]) < 1e-6 * max(1, target)
        assert words % max(size, 1) == 0 and words <= 3 * size
        taken[s] += words
    for s in sizes:
        lengths = [size for (_, source, size), k in word_counts.items() if source == s and size for _ in range(k)]
        assert abs(taken[s] - targets[s]) <= nearest(lengths, targets[s]) + (0 if reserve > 1000 else min(lengths, default=0)), s
    random.Random(9).shuffle(rows)
    assert Counter(run(spark, rows)) == Counter(out)
    # Of one source and length the documents with the least hashes have one pass more.
    key = [(i, s, size) for i, s, size in {r[:3] for r in out} if size]
    order = "doc_id long, source string, size long"
    source = "coalesce(concat('0', source), '1')"
    hashes = {tuple(r[:3]): r.h for r in spark.createDataFrame(key, order).selectExpr("*", f"shiftrightunsigned(xxhash64({mixing.SEED}, doc_id, {source}, size), 33) as h").collect()}
    for s, size in {k[1:] for k in key}:
        own = sorted((hashes[r[:3]], r[0] is not None, r[0] or 0, -r[5]) for r in out if r[1:3] == (s, size))
        passes = [-r[3] // size for r in own]
        assert passes == sorted(passes, reverse=True) and passes[0] - passes[-1] <= 1


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert [r[4:] for r in run(spark, [(1, None, "a"), (2, " ", None)])] == [(0.0, 0)] * 2


def test_knapsack_against_all_subsets():
    rng = random.Random(4)
    for _ in range(300):
        k = rng.randrange(1, 5)
        lengths = np.array(rng.sample(range(1, 30), k))
        left = np.array([rng.randrange(4) for _ in range(k)])
        budget = rng.randrange(0, 80)
        take = mixing.reachable(budget, lengths, left)
        assert (take >= 0).all() and (take <= left).all()
        best = min(abs(budget - sum(x * y for x, y in zip(c, lengths))) for c in product(*[range(n + 1) for n in left]))
        assert abs(budget - int(take @ lengths)) == best


def test_fit_keeps_the_spread_of_lengths():
    lengths, counts = np.arange(1, 2001), np.full(2000, 10)
    take = mixing.fit(lengths, counts, int(lengths @ counts) // 4)
    assert take @ lengths == int(lengths @ counts) // 4
    for part in np.array_split(np.arange(2000), 8)[1:]:
        assert 0.2 < take[part].sum() / counts[part].sum() < 0.3
