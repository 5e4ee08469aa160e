"""Registered queries and the pipeline on the smallest tables, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

import __spark_entry__
import corpus_pipeline
from lexloom.llm.common import save, tokenizer_path
from lexloom.llm.pretokens import load_tokenizer

FOLDER = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
PATTERNS = (
    (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 12),
    (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
)
KINDS = ("assign", "access", "hex")


@pytest.fixture(scope="module")
def texts():
    table = pq.read_table(f"{FOLDER}/documents.parquet")
    return dict(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (p, good) in enumerate(PATTERNS) for m in p.finditer(text) if good(m))


def print_of(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    spans = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(texts):
    """Groups under a Jaccard similarity of 0.8 or more of five-word shingles."""
    sets = {}
    for i, t in texts.items():
        words = [w for w in re.split(f"[{SPACE}]+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()
    return groups(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))


def components(prints):
    return groups(prints, lambda a, b: (a ^ b).bit_count() <= 2)


def groups(values, linked):
    ids, parent = sorted(values), {i: i for i in values}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if linked(values[a], values[b]):
                p, q = top(a), top(b)
                parent[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


def line_key(line):
    return line.strip(SPACE).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def without_repeats(texts):
    holders = defaultdict(set)
    for i, t in texts.items():
        for s in t.split("\n"):
            holders[line_key(s)].add(i)
    drop = lambda i, s: len(k := line_key(s)) >= 40 and len(holders[k]) >= 5 and max(holders[k]) != i
    return {i: "\n".join(s for s in t.split("\n") if not drop(i, s)) for i, t in texts.items()}


def test_secret_scan(spark, texts):
    for r in __spark_entry__.queries()["op3_secret_scan"](spark, FOLDER).collect():
        found = base_spans(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in found) for k in range(3)]
        written = [f"{KINDS[k]}:{a}:{b}" for a, k, b in found]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(written) <= set(r.spans.split(",")) or not written


def test_quality_counts(spark, texts):
    for r in __spark_entry__.queries()["op8_quality_rules"](spark, FOLDER).collect():
        text = texts[r.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        counts = Counter(windows)
        covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in (i, i + 1, i + 2)}
        lines = [s for s in text.split("\n") if s.strip(SPACE)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(covered))
        assert (r.n_symbols, r.n_dup_lines) == (sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r.base_failed and r.kept)


def test_near_duplicates(spark, texts):
    prints = {i: print_of(t) for i, t in texts.items()}
    roots = components(prints)
    for r in __spark_entry__.queries()["op9_simhash"](spark, FOLDER).collect():
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", roots[r.doc_id])


def test_pipeline(spark, texts):
    docs, known = spark.read.parquet(f"{FOLDER}/documents.parquet"), texts
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = save(stage(spark, docs, FOLDER), name.replace(" ", "_"))
        if name == "toxicity":
            scores = {r.doc_id: r.predicted for r in __spark_entry__.queries()["op2_toxicity"](spark, FOLDER).collect()}
            known = {i: t for i, t in known.items() if not scores[i]}
            assert rows(docs) == known
        elif name == "line dedup":
            known = without_repeats(known)
            assert rows(docs) == known
        elif name == "near dedup":
            roots = near_groups(known)
            known = {i: t for i, t in known.items() if roots[i] == i}
            assert rows(docs) == known
        elif name == "secrets":
            clean = rows(docs)
            assert clean.keys() == known.keys()
            for i, t in known.items():
                found = base_spans(t)
                assert bool(found) <= ("[SECRET]" in clean[i]) and not any(t[a:b] in clean[i] for a, _, b in found)
                assert found or "[SECRET]" in clean[i] or clean[i] == t
            known = clean
        else:
            tokenizer = load_tokenizer(tokenizer_path())
            found = docs.collect()
            assert Counter(r.doc_id for r in found).keys() == known.keys()
            for r in found:
                ids = np.array([*tokenizer.encode(known[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
                assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
