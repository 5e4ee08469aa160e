"""Running headers under noise, against a loop over all keys."""

import random
from collections import Counter

from lexloom.operators import headers as H


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def noisy(rng, line, edits):
    for _ in range(edits):
        at, kind = rng.randrange(len(line) or 1), rng.choice("ids")
        line = line[:at] + ("" if kind == "d" else rng.choice("xyz")) + line[at + (kind != "i") :]
    return line


def test_noisy_headers_are_found_and_dropped(spark):
    rng = random.Random(4)
    head, pages = "annual report of the harbour office", []
    for i in range(120):
        own = "".join(rng.choices("abcdefgh ", k=30)).strip()
        top = noisy(rng, head, rng.choice([0, 0, 1, 2])) if i % 3 else own
        pages.append((i, f"\n{top}\nbody {own}\nmore\n  "))
    pages += [(200, None), (201, ""), (202, "only line"), (203, "\n \n")]
    lines = H.edge_lines(spark.createDataFrame(pages, "doc_id long, text string").selectExpr("struct(doc_id, 'a' as source) as of", "text"), "of", "text")
    lines = lines.select("of.*", "edge", "line")
    rows = lines.where("edge = 'header'").collect()
    counts = Counter(r.line for r in rows)
    near = {k: sum(n for o, n in counts.items() if edit_distance(k, o) <= 2) for k, n in counts.items() if n >= 0.1 * 0.3 * len(rows)}
    best = max(near, key=lambda k: (near[k], counts[k]))
    found = H.clusters(lines, ["source", "edge"], 0.3)
    header = {r.edge: r for r in found.collect()}
    assert header["header"].line == best == head and header["header"].n_fuzzy == near[best] > header["header"].n_exact
    assert header["footer"].line == "more" and header["footer"].share == 1.0
    dropped = {r.doc_id for r in H.dropped_edges(lines, found, ["source", "edge"]).where("edge = 'header'").collect()}
    assert dropped == {r.doc_id for r in rows if edit_distance(r.line, head) <= 2} and 202 not in dropped
    assert H.clusters(lines.limit(0), ["source", "edge"], 0.3).count() == 0


def test_keys_within_two_edits_share_a_piece(spark):
    rng = random.Random(9)
    pairs = [(w, noisy(rng, w, rng.choice([1, 2]))) for w in ("".join(rng.choices("abc", k=rng.randrange(1, 40))) for _ in range(300))]
    pairs = [(a, b) for a, b in pairs if a and b and edit_distance(a, b) <= 2]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.select(H._pieces(df.a, 2).alias("p"), H._probes(df.b, 2).alias("q")).where("not arrays_overlap(p, q)").count() == 0


def test_numbered_headings_stay(spark):
    lines = spark.createDataFrame([(i, "a", "header", "4.1 scope of work") for i in range(5)], "doc_id long, source string, edge string, line string")
    found = H.clusters(lines, ["source", "edge"], 0.5)
    assert found.count() == 1 and H.dropped_edges(lines, found, ["source", "edge"]).count() == 0
