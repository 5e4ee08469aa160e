"""Snippets and blocks in texts, against sequential search in plain Python."""

import random
import re

from lexloom.operators import locate

QUOTES = str.maketrans("‘’“” ", "''\"\" ")


def normal(text):
    """Normal form, and the place of each of its code points in the text."""
    out, places = [], []
    for i, ch in enumerate(text.translate(QUOTES)):
        if ch.isspace():
            if out and out[-1] != " ":
                out.append(" ")
                places.append(i)
        else:
            out.append(ch.lower())
            places.append(i)
    if out and out[-1] == " ":
        out.pop(), places.pop()
    return "".join(out), places


def find(text, block, cursor):
    if (at := text.find(block, cursor)) >= 0:
        return at, at + len(block)
    needle = normal(block)[0]
    for m in re.finditer(r"(?m)^#{1,6}[ ]+(.+?)[ ]*$", text):
        if m.start() >= cursor and normal(m[1])[0] == needle:
            return m.start(), m.end()
    hay, places = normal(text)
    if len(needle) >= 12:
        at = -1
        while (at := hay.find(needle, at + 1)) >= 0:
            if places[at] >= cursor:
                return places[at], places[at + len(needle) - 1] + 1
    return None


def spans(text, blocks):
    cursor, out = 0, []
    for block in blocks:
        hit = block.strip() and (find(text, block.strip(), cursor) or find(text, block.strip(), 0))
        out.append(hit or (None, None))
        cursor = hit[1] if hit else cursor
    return out


def made(rng):
    """Texts with repeated lines, headings, odd blanks and quotes; blocks in and out of order, recased, missing, empty."""
    lines = [" ".join(rng.choice(["Alpha", "beta", "“gamma”", "don’t", "ε"]) for _ in range(rng.randrange(1, 5))) for _ in range(8)]
    written = [rng.choice(["", "  ", "\t"]) + (f"## {rng.choice(lines)}" if rng.random() < 0.2 else rng.choice(lines).replace(" ", rng.choice([" ", "  ", " "]))) for _ in range(20)]
    text = rng.choice(["", "\n  "]) + "\n".join(written)
    blocks = [rng.choice([rng.choice(lines), rng.choice(lines).upper(), rng.choice(written), "nowhere in this text", "", f"{rng.choice(lines)}\n{rng.choice(lines)}"]) for _ in range(25)]
    return text, [b.lstrip("# ") for b in blocks]


def test_block_spans_equal_sequential_search(spark):
    rng = random.Random(7)
    cases = [made(rng) for _ in range(12)] + [("", ["a block", ""]), ("aaaa aaaa", ["aa", "aa", "aa", "aa", "aa", "aa"])]
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)] + [(99, None)], "doc_id long, text string")
    blocks = spark.createDataFrame([(i, k, b) for i, (_, own) in enumerate(cases) for k, b in enumerate(own)], "doc_id long, k long, block string")
    found = {(r.doc_id, r.k): (r.start, r.end) for r in locate.block_spans(texts, blocks, "doc_id", "text", "k", "block").collect()}
    for i, (text, own) in enumerate(cases):
        assert [found[i, k] for k in range(len(own))] == spans(text, own), i


def test_snippet_spans_map_back(spark):
    text = "\n  It  is “Agreed”\n\nthat THE fee\tis due.  It is due."
    cases = {"It is due.": "It is due.", 'it is "agreed" that': "It  is “Agreed”\n\nthat", "the fee is due": "THE fee\tis due", "fee is": None, "absent text here": None}
    snippets = spark.createDataFrame(list(enumerate(cases)), "item int, snippet string")
    found = {r["item"]: r for r in locate.snippet_spans(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), snippets, "doc_id", "text", "item", "snippet").collect()}
    for i, (snippet, raw) in enumerate(cases.items()):
        assert (found[i] and text[found[i].start : found[i].end] if i in found else None) == raw, snippet
    assert found[0].confidence == "exact" and found[1].confidence == "normalized"


def test_block_spans_by_joins_equal_walks(spark, monkeypatch):
    """Texts over the limit go by joins, with the same places; one text above and others below it."""
    rng = random.Random(8)
    cases = [made(rng) for _ in range(6)]
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)] + [(99, None)], "doc_id long, text string")
    blocks = spark.createDataFrame([(i, k, b) for i, (_, own) in enumerate(cases) for k, b in enumerate(own)] + [(77, 0, "of no text at all"), (99, 3, "of a null text")], "doc_id long, k long, block string")
    find = lambda: sorted(map(str, locate.block_spans(texts, blocks, "doc_id", "text", "k", "block").collect()))
    walked = find()
    monkeypatch.setattr(locate, "WALKED", 25 * sorted(len(t) for t, _ in cases)[2])
    assert find() == walked and len(walked) == 152


def test_anchors_are_handed_on_in_parts(monkeypatch):
    import pyarrow as pa

    from lexloom.operators import containing

    monkeypatch.setattr(containing, "HELD_ANCHORS", 50)
    texts = ["some words of a text " * 9, "", "another text"]
    batch = pa.RecordBatch.from_pydict({"key": [5, 6, 7], "text": texts})
    parts = list(containing._anchors([(3, 1), (4, 5)])([batch]))
    assert len(parts) > 1 and max(len(p) for p in parts) < 400
    assert sum(len(p) for p in parts) == sum(len(containing.anchors(t, *kind)[0]) for t in texts for kind in ((3, 1), (4, 5)))
