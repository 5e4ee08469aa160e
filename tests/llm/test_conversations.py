"""The conversation trie against plain dictionaries, over one and many ranges, and its radix tree."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lexloom.llm import conversations
from lexloom.llm.radix import Full, Indexed, Node, Sorted, Tree

SCHEMA = "conv_id long, turn long, role string, text string, turns int, `key` string, id string, `range` int, length int"


def brute_force(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: (t[0], hashlib.sha256(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).digest()))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(t[1:] for t in own.get(c - c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, s in sorted(built.items()):
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if built[c] == p)
        parent = members[p[:-1]][0] if p else None
        yield m[0], len(p), parent, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()


def made(seed, n, long):
    """Nulls, ties, repeated rows, copies, a shared first turn, turnless conversations, one long one."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-250, 950), n):
        if rng.random() < 0.5:
            rows += [(c, t, "user", "hot" * (t + 1)) for t in range(3)]  # exact copies
        else:
            rows += [(c, rng.choice([None, 0, 1, 2, 3, 4]), rng.choice([None, "user", "bot"]), rng.choice([None, "", "a", "b", "é\U0001f600"])) for _ in range(rng.randrange(1, 7))]
    rows += [(900, t, "user", str(t // 50)) for t in range(long)] + [(None, 1, "user", "x")] * 3
    rng.shuffle(rows)
    return rows


def nodes_of(spark, rows):
    return conversations.conversation_trie(spark.createDataFrame([(*r, 1, "k", "i", 2, 3) for r in rows], SCHEMA))


@pytest.mark.parametrize(("seed", "n", "long", "turns"), [(1, 0, 0, 50), (2, 40, 0, 1 << 18), (3, 300, 400, 40), (4, 200, 5, 7), (5, 300, 0, 25)])
def test_trie_by_brute_force(spark, monkeypatch, seed, n, long, turns):
    """Ranges of few turns make many borders, also within the copies of one conversation."""
    monkeypatch.setattr(conversations, "RANGE_TURNS", turns)
    monkeypatch.setattr(conversations, "CHUNK", 10)
    rows = made(seed, n, long)
    assert sorted(map(tuple, nodes_of(spark, rows).collect()), key=str) == sorted(brute_force(rows), key=str)


def test_empty_table_has_no_node(spark):
    assert nodes_of(spark, []).count() == 0


def test_tree_layouts():
    """Nodes grow through all four layouts; keys that begin others, and compressed paths that split."""
    rng = random.Random(8)
    keys = {bytes(rng.choice([0, 1, 255, rng.randrange(256)]) for _ in range(4 * rng.randrange(4))) for _ in range(4000)}
    keys |= {bytes([7, b]) for b in range(256)} | {bytes([8, b]) for b in range(30)} | {bytes([9, b]) for b in range(12)}
    order = sorted(keys)
    rng.shuffle(order)
    tree = Tree()
    for key in order:
        tree.insert(key, key)
    found, layouts = [], set()

    def walk(node: Node, before: bytes):
        here = before + node.path
        if node.end is not None:
            assert node.end == here
            found.append(here)
        layouts.add((type(node.below), getattr(node.below, "limit", 0)))
        for byte, kid in node.items():
            walk(kid, here + bytes([byte]))

    walk(tree.root, b"")
    assert found == sorted(keys)
    assert layouts == {(type(None), 0), (Sorted, 4), (Sorted, 16), (Indexed, 0), (Full, 0)}
