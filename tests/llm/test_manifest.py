"""The Merkle manifest against a plain tree in Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lexloom.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, `group` string, rank int, h string, node string, now string, part int, tie int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    values = (*row[:3], None if row[3] is None else row[3] + more, row[4])
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path_of(levels, i):
    for level in levels[:-1]:
        first = i // 2 * 2
        run = level[first : first + 2]
        yield (run[1 - i % 2], i % 2) if len(run) == 2 else (None, 0)
        i //= 2


def brute_force(rows):
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for own in langs.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {x: levels_of([leaf(r) for r in langs[x]]) for x in names}
    top = levels_of([trees[x][-1][0] for x in names])
    for k, name in enumerate(names):
        for i, r in enumerate(langs[name]):
            path = [*path_of(trees[name], i), *path_of(top, k)]
            now = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)
            for h, right in path:
                now = digest(now) if h is None else digest(h, now) if right else digest(now, h)
            root = top[-1][0]
            yield r[0], leaf(r), trees[name][-1][0], root, digest(*(h for h, _ in path if h)), now, now == root


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize(("n", "bits"), [(0, 2), (1, 2), (8, 2), (150, 2), (300, 10)])
def test_manifest_by_brute_force(spark, monkeypatch, n, bits):
    """Null and repeated rows, one or several rounds of blocks, extra columns named like the operator's own."""
    monkeypatch.setattr(manifest, "BITS", bits)
    rng = random.Random(n)
    langs = ["one"] if n == 8 else [None, "en", "en", "en", "", "ü"]
    rows = [
        (rng.choice([None, *range(-5, 200)]), rng.choice(["a", None, "é"]), rng.choice(langs), rng.choice([None, 5, 70]), rng.choice([None, "", "tüxt\n", "b" * 50]))
        for _ in range(n)
    ]
    docs = spark.createDataFrame([(*r, "x", 1, "y", "z", "w", 2, 3) for r in rows], SCHEMA)
    assert ordered(manifest.merkle_manifest(docs).collect()) == ordered(brute_force(rows))


def test_proofs_of_a_manifest_fold_to_the_root(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in manifest.manifest(docs).collect():
        now = r.leaf
        for s in r.path:
            now = digest(now) if s.side == 0 else digest(s.h, now) if s.side < 0 else digest(now, s.h)
        assert now == r.root and r.now is None and r.lang
