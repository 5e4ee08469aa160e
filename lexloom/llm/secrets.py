"""Secret scans with DataFrame functions only.

Base patterns are found by splitting a text at their matches: the lengths of the pieces and of the matches
give every match's place. Further candidates are long strings that mix letters with digits; over each one a
window slides whose character counts are updated by one character that enters and one that leaves, and the
greatest Shannon entropy of a window is compared with the limit of the candidate's character class.
Candidates on the allow-list are suppressed. No row leaves its partition, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, scan, without

#: Base patterns, kinds in the order in which they are listed (fixed values).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "entropy")

#: Candidates: whole runs of at least 20 of these characters with a letter and a digit.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
#: Class of a candidate (pattern of the whole string) and the entropy in bits from which it is a secret.
CLASSES = (("^[0-9a-fA-F]+$", 3.0), ("^[a-z0-9]+$|^[A-Z0-9]+$", 3.5), ("^[A-Za-z0-9+/_=-]+$", 3.7))
#: Candidates that are never secrets: UUIDs and stand-ins.
ALLOWED = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "(?i)example|sample|dummy|placeholder|changeme",
)
#: Lower-case words, each with at most a short number after it, and short numbers, with separators; never a
#: secret either, unless one of the parts by itself has the entropy of a secret.
WORDS, SEPARATOR, WORD_BITS = "^/?[a-z]+([-_/=]([a-z]+[0-9]{0,3}|[0-9]{1,4}))+$", "[-_/=]", 3.5

SPANS = "array<struct<start:int,rank:int,end:int>>"
#: Counts of the window are bytes, eight to a long, for 128 characters.
LONGS, PER_LONG, BYTE = 16, 8, 255
#: Texts are cut in chunks of so many code points before pieces are taken from them.
CHUNK = 4096


def _spans(text: Column, pattern: str, rank: int, keep) -> Column:
    """Spans of the leftmost non-overlapping matches for which `keep(match, second group or match)` holds."""
    second = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if rank == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), second.alias("value")
    )

    def with_places(parts: Column) -> Column:
        size = lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["match"]), F.lit(0))
        ends = F.transform(scan(F.transform(parts, size), lambda a, b: a + b), lambda e: F.struct(e.alias("end")))
        placed = F.arrays_zip(parts.alias("part"), ends.alias("place"))
        good = F.filter(placed, lambda x: x["part"]["match"].isNotNull() & keep(x["part"]["match"], x["part"]["value"]))
        return F.transform(good, lambda x: F.struct(
            (x["place"]["end"] - F.length(x["part"]["match"])).alias("start"), F.lit(rank).alias("rank"), x["place"]["end"].alias("end")
        ))

    return let(parts, with_places).cast(SPANS)


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """Greatest Shannon entropy (bits a character) of the windows of an ASCII string; of all of it if shorter.

    The state holds the count of each of 128 characters, packed in bytes, and the sum of c log2 c; each step
    changes the counts of the character that enters and of the one that leaves. `window` is at most 127.
    """
    size = F.least(F.length(text), F.lit(window))
    weight = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), LONGS).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    place = lambda c: F.shiftright(c, 3)
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (c % PER_LONG) * 8)  # noqa: E731  a count of one, at its byte

    def count(counts: Column, c: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, place(c)), (c % PER_LONG) * 8).bitwiseAND(F.lit(BYTE).cast("long"))

    def step(state: Column, item: Column) -> Column:
        new, old = item["code"], item["old"]
        grown, less = count(state["counts"], new), count(state["counts"], old)
        same = F.coalesce(new == old, F.lit(False))
        delta = weight(grown + 1) - weight(grown) + F.coalesce(weight(less - 1) - weight(less), F.lit(0.0))
        total = F.when(same, state["sum"]).otherwise(state["sum"] + delta)
        counts = F.when(same, state["counts"]).otherwise(F.transform(state["counts"], lambda packed, i: (
            packed + F.when(i == item["place"], item["one"]).otherwise(F.lit(0).cast("long"))
            - F.when(i == item["old_place"], item["old_one"]).otherwise(F.lit(0).cast("long"))
        )))
        full = item["i"] >= size - 1
        bits = F.when(full, F.log2(size) - total / size).otherwise(F.lit(0.0))
        return F.struct(counts.alias("counts"), total.alias("sum"), F.greatest(state["best"], bits).alias("best"))

    def entropy(codes: Column) -> Column:
        pairs = F.transform(codes, lambda c, i: F.struct(c.alias("code"), F.get(codes, i - size).alias("old"), i.alias("i")))
        items = F.transform(pairs, lambda p: F.struct(
            p["code"].alias("code"), p["old"].alias("old"), p["i"].alias("i"), place(p["code"]).alias("place"), one(p["code"]).alias("one"),
            place(p["old"]).alias("old_place"), one(p["old"]).alias("old_one"),
        ))
        return F.aggregate(items, start, step, lambda s: s["best"])

    return let(F.transform(F.split(text, ""), F.ascii), entropy)


def _suspect(match: Column, _value: Column) -> Column:
    limit = F.lit(None).cast("double")
    for pattern, bits in reversed(CLASSES):
        limit = F.when(match.rlike(pattern), F.lit(bits)).otherwise(limit)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | match.rlike(pattern)
    odd = F.exists(F.split(match, SEPARATOR), lambda part: window_entropy(part) >= WORD_BITS)
    allowed = allowed | F.when(match.rlike(WORDS), ~odd).otherwise(F.lit(False))
    return ~allowed & (window_entropy(match) >= limit)


def find_secrets(docs: DataFrame) -> DataFrame:
    """`docs` with base_spans and spans, arrays of (start, rank, end) in code points, sorted; rank indexes KINDS.

    An entropy span that overlaps a base span is left out. Null and empty texts have none. Each row is taken
    by itself; input columns with these names are replaced; an empty table stays empty.
    """
    none = F.array().cast(SPANS)
    plain = without(docs, "base_spans", "spans")
    columns = [F.col(f"`{c}`") for c in plain.columns]
    text = F.coalesce("text", F.lit(""))
    low = F.lower(text)
    words = ("password", "passwd", "secret", "token", "apikey", "api_key")
    named = low.contains(words[0])
    for word in words[1:]:
        named = named | low.contains(word)

    def longer(kind):
        return lambda match, value: F.length(value) >= LEAST[kind]

    # The patterns with a least length decide quickly which texts are worth splitting; both forms of the two
    # patterns without groups find the same long matches, since their runs are maximal.
    access, hexes = f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}+", f"(?<![0-9a-f])[0-9a-f]{{{LEAST['hex']},}}+"
    found = plain.select(
        *columns,
        F.when(named, _spans(text, ASSIGN, 0, longer("assign"))).otherwise(none).alias("__assign"),
        F.when(text.contains("AKIA"), _spans(text, access, 1, longer("access"))).otherwise(none).alias("__access"),
        F.when(text.rlike(hexes), _spans(text, hexes, 2, longer("hex"))).otherwise(none).alias("__hex"),
        F.when(text.rlike(CANDIDATE), _spans(text, CANDIDATE, 3, _suspect)).otherwise(none).alias("__entropy"),
    )
    found = found.select(*columns, F.array_sort(F.concat("__assign", "__access", "__hex")).alias("base_spans"), "__entropy")
    more = F.when((F.size("base_spans") > 0) & (F.size("__entropy") > 0), _apart(F.col("__entropy"), F.col("base_spans"))).otherwise(F.col("__entropy"))
    return found.select(*columns, "base_spans", F.array_sort(F.concat("base_spans", more)).alias("spans"))


def _apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of `others`: one sorted merge, in which the greatest end of all others that
    begin before a span's end tells whether one of them reaches into the span."""
    event = lambda at, end, start: F.struct(at.alias("at"), end.alias("end"), start.alias("start"))
    merged = F.array_sort(F.concat(
        F.transform(others, lambda o: event(o["start"], o["end"], F.lit(-1))),
        F.transform(spans, lambda s: event(s["end"], F.lit(-1), s["start"])),  # -1 sorts before the others that begin there
    ))

    def alone(events: Column) -> Column:
        reach = scan(F.transform(events, lambda e: e["end"]), F.greatest)
        judged = F.arrays_zip(events.alias("event"), F.transform(reach, lambda r: F.struct(r.alias("to"))).alias("reach"))
        free = F.filter(judged, lambda j: (j["event"]["start"] >= 0) & (j["reach"]["to"] <= j["event"]["start"]))
        return F.transform(free, lambda j: F.struct(j["event"]["start"].alias("start"), F.lit(KINDS.index("entropy")).alias("rank"), j["event"]["at"].alias("end")))

    return let(merged, alone).cast(SPANS)


def _written(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (written kind:start:end) for every row of `docs`."""
    found = find_secrets(docs.select("doc_id", "text"))
    count = lambda rank: F.size(F.filter("base_spans", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_written("base_spans").cast("binary"), 256).alias("base_sha256"), _written("spans").alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every span of a secret in `text` replaced by `mark`. Overlapping spans get one mark; null
    texts stay null; the columns stay as they are. Repeated rows are changed alike; an empty table stays empty."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = find_secrets(docs.select(F.struct(*columns).alias("__row"), "text"))
    text = F.col("text")

    def between(cuts: Column) -> Column:
        """The pieces of the text between the spans, which are sorted by start."""
        reach = scan(F.transform(cuts, lambda s: s["end"]), F.greatest)
        return let(reach, lambda ends: F.concat(
            F.filter(
                F.transform(cuts, lambda s, i: F.struct(F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("a"), s["start"].alias("b"))),
                lambda gap: gap["a"] <= gap["b"],
            ),
            F.array(F.struct(F.get(ends, F.size(ends) - 1).alias("a"), F.length(text).alias("b"))),
        ))

    def clean(chunks: Column) -> Column:
        def piece(gap: Column) -> Column:
            first, last = (F.floor(gap[x] / CHUNK).cast("int") for x in "ab")
            head = F.substring(F.get(chunks, first), gap["a"] % CHUNK + 1, F.lit(CHUNK))
            inner = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
            tail = F.substring(F.coalesce(F.get(chunks, last), F.lit("")), F.lit(1), gap["b"] % CHUNK)
            short = F.substring(F.coalesce(F.get(chunks, first), F.lit("")), gap["a"] % CHUNK + 1, gap["b"] - gap["a"])
            return F.when(first == last, short).otherwise(F.concat(head, inner, tail))

        return F.array_join(F.transform(let(F.col("spans"), between), piece), mark)

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    kept = F.when(F.size("spans") > 0, let(chunks, clean)).otherwise(text)
    return found.select(*[kept.alias(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
