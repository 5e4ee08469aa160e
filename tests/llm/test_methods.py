"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import zlib
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import bpe, fingerprints, packing, pretokens, simhash
from lexloom.llm.common import tokenizer_path

BITS = ["'", "s", "t", "re", "ve", "ll", " ", "  ", "\n", "\t", "a", "B", "é", "中", "1", "²", "!", "..", "<|endoftext|>", "<|endof", "text|>", "\U0001f600", "́", "\x1c", "\x85", "　", "x" * 40, "don't", "\U00010d40"]


@pytest.fixture(scope="module")
def tokenizer():
    return pretokens.load_tokenizer(tokenizer_path())


def texts(n, seed, length=14):
    rng = random.Random(seed)
    return ["".join(rng.choices(BITS, k=rng.randint(0, length))) for _ in range(n)]


def test_encoder_equals_library(tokenizer):
    made = pretokens.BatchEncoder(tokenizer_path(), limit=50)
    for seed in range(200):
        batch = texts(8, seed)
        ids, counts = made.encode(batch)
        expected = [e.ids for e in tokenizer.encode_batch(batch, add_special_tokens=False)]
        assert counts.tolist() == [len(e) for e in expected]
        assert ids.tolist() == [x for e in expected for x in e]


def test_tree_equals_whole(tokenizer):
    rng = random.Random(5)
    encode = lambda s: np.array(tokenizer.encode(s, add_special_tokens=False).ids, np.uint32)
    for text in texts(300, 9, 120):
        if len(text) > 8:
            cuts = [0, *sorted(rng.sample(range(1, len(text)), rng.choice([1, 2, 3, 7]))), len(text)]
            parts = [encode(text[a:b]) for a, b in zip(cuts, cuts[1:])]
            assert bpe.join_tree(parts, tokenizer_path()).tolist() == encode(text).tolist()
            assert bpe.decode_ids(encode(text), tokenizer_path()) == tokenizer.decode(encode(text).tolist(), skip_special_tokens=False)


def test_bpe_and_counts_on_documents(spark, tokenizer):
    from lexloom.llm.token_counts import token_counts

    data = list(enumerate(texts(40, 3, 300)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    expected = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in data}
    for r in bpe.encode_decode(docs, part_chars=50).collect():
        assert r.ids_sha256 == hashlib.sha256(np.array(expected[r.doc_id], "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(expected[r.doc_id], skip_special_tokens=False).encode()).hexdigest()
    for r in token_counts(docs).collect():
        assert (r.n_tokens, r.n_bytes) == (len(expected[r.doc_id]), len(dict(data)[r.doc_id].encode()))


def test_counts_of_nul_runs(spark, tokenizer):
    from lexloom.llm.token_counts import token_counts

    # Each run occurs once, so none is in the head; the last text is a key that a row's sum may have.
    data = list(enumerate(["\x00" * 4, "a \x00!? b", "x\x00\x00\x01y", "\x00" * 900, "\x00", "\x00" * 3 + "1", "\x000"]))
    rows = {r.doc_id: r for r in token_counts(spark.createDataFrame(data, "doc_id long, text string"), limit=100).collect()}
    for i, t in data:
        n = len(tokenizer.encode(t, add_special_tokens=False).ids)
        assert (rows[i].n_tokens, rows[i].over_limit) == (n, n > 100), t[:10]


def test_packing(spark, tokenizer):
    data = list(enumerate(texts(300, 4, 60)))
    out = packing.pack(spark.createDataFrame(data, "doc_id long, text string"), capacity=64).collect()
    places = {}
    for i, t in data:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r for r in out if r.doc_id == i), key=lambda r: r.piece)
        assert sum(r.length for r in own) == len(ids) and all(r.length == 64 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 64
    assert len(places) <= 1.05 * sum(r.length for r in out) / 64 + 1


def test_plan_is_best_fit():
    rng = random.Random(1)
    lengths = [rng.randint(1, 100) for _ in range(500)]
    rooms, used = [], 0
    for n in sorted(lengths, reverse=True):  # document by document
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            used += 1
            rooms.append(100 - n)
        else:
            rooms.remove(fit)
            rooms.append(fit - n)
    plan = packing.plan_best_fit({n: lengths.count(n) for n in set(lengths)}, 100)
    assert len({first + k for _, a, b, first, _ in plan for k in range(b - a)}) <= used + 1


def test_prefix_hash():
    rng = random.Random(2)
    a = "".join(rng.choices("ab", k=200))
    b = a[:120] + "c" + a[121:]
    x, y = (fingerprints.PrefixHash(fingerprints.codes_of(t)) for t in (a, b))
    for _ in range(300):
        i, j, n = rng.randrange(200), rng.randrange(200), rng.randrange(30)
        inside = i + n <= 200 and j + n <= 200
        assert fingerprints.spans_equal(x, i, y, j, n) == (inside and a[i : i + n] == b[j : j + n])
        k = 0
        while i + k < 200 and j + k < 200 and a[i + k] == b[j + k]:
            k += 1
        assert fingerprints.common_extension(x, i, y, j) == k


def test_fingerprint_query(spark):
    data = [(i, t) for i, t in enumerate(texts(60, 8, 200))]
    rows = {r.doc_id: r for r in fingerprints.document_fingerprints(spark.createDataFrame(data, "doc_id long, text string"), parts=7).collect()}
    for k, (i, t) in enumerate(data):
        after = data[(k + 1) % len(data)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[i].n_chars == len(t)
        assert 0 <= rows[i].near_next <= 1 and 0 <= rows[i].near_edited <= 1


def test_likeness_against_brute_force():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(2, 8)))

    def spans(t, n):
        n = min(n, len(t))
        return {t[i : i + n] for i in range(len(t) - n + 1)} if t else set()

    for k in range(200):
        a = " ".join(word() for _ in range(rng.choice([3, 6, 12, 30, 200, 800])))
        keep = len(a) - len(a) // 2 if k % 2 else rng.randint(0, len(a))
        b = a[:keep] + " ".join(word() for _ in range(200))[: len(a) - keep]
        x, y = (fingerprints.Print(fingerprints.PrefixHash(fingerprints.codes_of(t))) for t in (a, b))
        n = fingerprints.SHORT if min(len(a), len(b)) < fingerprints.FEW else fingerprints.SPAN
        p, q = spans(a, n), spans(b, n)
        assert abs(fingerprints.likeness(x, y) - 2 * len(p & q) / (len(p) + len(q))) < 0.2, (len(a), keep)
        assert abs(fingerprints.likeness(x, y) - keep / len(a)) < 0.35
        assert fingerprints.likeness(x, x) == 1 and (x.text() == y.text()) == (a == b)


def test_fingerprints_of_ties(spark):
    """Rows that share a doc_id or have none are dealt over ranges like all others."""
    texts_of = [f"text number {k} " * 3 for k in range(40)]
    data = [(7, t) for t in texts_of] + [(None, t) for t in texts_of] + [(8, "a"), (8, "a"), (8, None)]
    rows = fingerprints.document_fingerprints(spark.createDataFrame(data, "doc_id long, text string"), parts=5).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in data)
    sizes = {(r.doc_id, r.fingerprint): r.n_chars for r in rows}
    assert len(sizes) == 82 and all(r.near_edited == 1 for r in rows if r.n_chars < 2)


@pytest.mark.parametrize("bucket", [64, 3])
def test_simhash_pairs_and_components(spark, bucket):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = list({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(8)} | set(base))
    prints += [base[0] ^ (1 << b) for b in range(64)]  # a node with many neighbours
    prints = list(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    pairs = simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp long"), bucket=bucket)
    found = {(r.a, r.b) for r in pairs.collect()}
    expected = {(max(a, b), min(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert found == expected
    roots = {r.node: r.root for r in simhash.components(pairs).collect()}
    for a, b in expected:
        assert roots[a] == roots[b]
    parent = {p: p for p in signed}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in expected:
        p, q = top(a), top(b)
        parent[max(p, q)] = min(p, q)
    assert all(roots[p] == top(p) for p in roots)


def test_near_duplicates_brute_force(spark):
    data = [(10, "a b c d"), (11, "A B c d"), (12, ""), (13, None), (14, "one two"), (15, "other words that are far from the rest of them all")]
    rows = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert rows[10].component_id == rows[11].component_id == 10 and rows[13].component_id == 12
    assert rows[12].fingerprint == "0" * 16 and rows[14].component_id == 14 and rows[10].class_size == 2


def near_copies(rng, n):
    """Texts of 3 to 400 words, each with copies of which about 2 % of the words are replaced."""
    out = []
    for _ in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 6, 9, 20, 60, 150, 400]))]
        for _ in range(rng.randint(1, 3)):
            out.append(" ".join(w if rng.random() > 0.02 else f"x{rng.randrange(3000)}" for w in words))
    return out


def test_keep_one_brute_force(spark):
    from lexloom.llm import near_texts

    data = list(enumerate(near_copies(random.Random(8), 120)))
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in data}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                p, q = top(a), top(b)
                parent[max(p, q)] = min(p, q)
    kept = {r.doc_id for r in near_texts.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert kept == {i for i in sets if top(i) == i}


def test_a_large_group_of_near_copies(spark, monkeypatch):
    from lexloom.llm import near_texts, simhash

    rng = random.Random(4)
    words = [f"w{rng.randrange(3000)}" for _ in range(300)]
    data = [(i, " ".join([*words, f"end{i}"])) for i in range(300)] + [(1000 + i, " ".join(f"v{rng.randrange(3000)}" for _ in range(100))) for i in range(30)]
    for share in (4096, 4):  # representatives by a join, and by broadcast
        monkeypatch.setattr(near_texts, "SHARE", share)
        monkeypatch.setattr(simhash, "SHARE", share)
        kept = {r.doc_id for r in near_texts.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect()}
        assert kept == {0, *range(1000, 1030)}


def test_blocks_meet_by_pigeonhole():
    from lexloom.llm.near_texts import CLASSES, blocks_of

    rng = np.random.default_rng(3)
    for n in range(1, 4 * CLASSES):
        shared = rng.integers(0, 1 << 63, n, np.uint64)
        for extra_a in range(n // 4 + 1):
            for extra_b in range(n // 4 + 1):
                if 5 * n >= 4 * (n + extra_a + extra_b) and n + max(extra_a, extra_b) < 4 * CLASSES:
                    a, b = (np.unique(np.append(shared, rng.integers(0, 1 << 63, k, np.uint64))) for k in (extra_a, extra_b))
                    assert set(blocks_of(a)) & set(blocks_of(b)), (n, extra_a, extra_b)


def test_line_dedup_brute_force(spark):
    from lexloom.llm.line_dedup import drop_repeated_lines

    rng = random.Random(6)
    pool = [f"line number {k} " + "abc" * 14 for k in range(12)] + ["short", "", "  Padded LINE " + "x" * 40 + "  "]
    data = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 6)))) for i in range(60)]
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").lower()
    holders = {}
    for i, t in data:
        for s in t.split("\n"):
            holders.setdefault(key(s), set()).add(i)
    for batches in (1, 5):
        out = {r.doc_id: r for r in drop_repeated_lines(spark.createDataFrame(data, "doc_id long, text string"), batches=batches).collect()}
        for i, t in data:
            kept = [s for s in t.split("\n") if not (len(key(s)) >= 40 and len(holders[key(s)]) >= 5 and max(holders[key(s)]) != i)]
            assert out[i].kept_text == "\n".join(kept) and out[i].n_dropped == t.count("\n") + 1 - len(kept)


def test_binomial_tail(spark):
    from lexloom.llm.quality import binomial_tail

    for n, k, p in ((50, 3, 0.2), (400, 0, 0.01), (1000, 5, 0.02), (20, 19, 0.5), (300, 2, 0.05)):
        got = spark.range(1).select(binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert got == 1.0 if k >= n * p else abs(got - want) < 1e-9 * max(want, 1e-12) + 1e-12


def test_toxicity_and_language_held_out(spark):
    from lexloom.llm.language_id import identify
    from lexloom.llm.toxicity import score_documents, toxicity

    rng = random.Random(7)
    words = {"xx": [f"ba{c}o" for c in "dfgklmn"], "yy": [f"ut{c}i" for c in "dfgklmn"]}
    data, labels = [], []
    for i in range(600):
        lang, bad = rng.choice(("xx", "yy")), rng.random() < 0.3
        said = [rng.choice(words[lang]) for _ in range(40)]
        if bad:
            said[10] = said[20] = "grumpf"
        data.append((i, ". ".join(" ".join(said[k : k + 8]) for k in range(0, 40, 8)), lang))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = [r for r in toxicity(docs, known).collect() if r.held_out]
    truth = {i: y for i, _, y in labels}
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.97
    spotted = next(r for r in out if r.predicted)
    assert all("grumpf" in data[spotted.doc_id][1][s.start : s.end] for s in spotted.spans)
    spoken = {i: lang for i, _, lang in data}
    said = [r for r in identify(docs).collect() if r.held_out]
    assert np.mean([r.lang_pred == spoken[r.doc_id] for r in said]) > 0.98
    assert score_documents is not None


def test_quality_cutoffs_and_kept_by_brute_force(spark):
    """Cutoffs and verdicts recomputed with exact binomial sums; no more good documents are lost than allowed."""
    from lexloom.llm import quality

    rng = random.Random(11)
    data, labels = [], []
    for i in range(6000):
        lang = ("aa", "bb", "cc")[i % 3] if i % 50 else "rare"
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(60)]
        noisy = rng.random() < 0.3
        for k in range(rng.randint(0, 30) if noisy else 0):
            words[k] = rng.choice(["##", "WORD", "stop!", "x|y"])
        data.append((i, " ".join(words), lang))
        labels.append((i, int(not noisy or rng.random() < 0.02), 0))
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = quality.measures(docs).select("doc_id", "lang", *[s.alias(r) for r, s in quality._statistics().items()]).collect()
    good = {i for i, q, _ in labels if q}
    strata = {r.lang for r in rows if r.doc_id in good}
    limits = {}
    for lang in strata:
        own = [r for r in rows if r.lang == lang and r.doc_id in good]
        for rule, grid in quality.RULES.items():
            for cutoff in grid:
                lost, n, p = sum(r[rule] > cutoff for r in own), len(own), quality.RISK / len(quality.RULES)
                tail = sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(lost + 1))
                if tail > quality.ERROR / len(quality.RULES) / len(strata):
                    break
                limits[lang, rule] = cutoff
    assert any(lang == "aa" for lang, _ in limits) and not any(lang == "rare" for lang, _ in limits)
    out = {r.doc_id: r for r in quality.quality_rules(docs, known).collect()}
    for r in rows:
        failed = [rule for rule in quality.RULES if r[rule] > limits.get((r.lang, rule), float("inf"))]
        assert out[r.doc_id].failed_rules == failed and out[r.doc_id].kept == (not out[r.doc_id].base_failed and not failed)
    assert any(out[i].failed_rules for i in out)
    for lang in strata:
        own = [r.doc_id for r in rows if r.lang == lang and r.doc_id in good]
        assert sum(bool(out[i].failed_rules) for i in own) <= quality.RISK * len(own)
