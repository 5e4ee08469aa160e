"""Where snippets and blocks stand in a document's text (TXT-23, VER-08, WIN-29): exactly, or in a normal form whose
places are mapped back to the text as it is."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import release, staged
from .containing import places

#: Least lengths in normal form of a snippet and of a block (fixed values).
LEAST_SNIPPET, LEAST_BLOCK = 8, 12
#: Code points of a text times its blocks up to which one task walks through them; larger texts go by joins of all places.
WALKED = 1 << 32
BLANKS, HEADING = re.compile(r"[ \t\n\x0b\f\r\xa0]+"), re.compile(r"#{1,6}\s+\S", re.ASCII)


def normal_form(text: Column) -> Column:
    """Plain quotes, single blanks, lower case, nothing but the blanks dropped. Letters whose lower case is longer stay as long as
    they are, so places map back."""
    plain = F.translate(F.coalesce(text, F.lit("")), "‘’“” İ", "''\"\" i")
    return F.btrim(F.regexp_replace(F.lower(plain), r"\s+", " "))


def raw_places(texts: DataFrame, hits: DataFrame, key: str, text: str) -> DataFrame:
    """`hits` (key, start, end in normal form, and more) with start and end in the text as it is.

    What was dropped before a word is the running total of the blanks before it, less one for each; a hit takes that of the last
    word that begins before it. Words and hits are merged by one sort.
    """
    body = F.coalesce(F.col(text), F.lit("")).alias("body")
    split = texts.select(key, body).select(key, F.split(F.regexp_replace("body", " ", " "), r"\s+", -1).alias("words"), F.regexp_extract_all("body", F.lit(r"[\s ]+"), F.lit(0)).alias("gaps"))
    lead = F.when(F.get("words", F.lit(0)) == "", 1).otherwise(0)  # a text that begins with blanks
    words = split.select(key, lead.alias("lead"), "gaps", F.posexplode("words").alias("i", "word")).select(
        key, "i", "lead", F.length("word").alias("n"), F.coalesce(F.length(F.get("gaps", F.col("i") - 1)), F.lit(0)).alias("gap")
    )
    own = Window.partitionBy(key).orderBy("i")
    before = F.sum("n").over(own) - F.col("n")
    words = words.withColumn("at", before + F.col("i") - F.col("lead")).withColumn("dropped", F.sum("gap").over(own) - F.col("i") + F.col("lead"))
    marks = words.where("n > 0").select(key, F.col("at").cast("long").alias("at"), F.lit(0).alias("order"), F.col("dropped").cast("long").alias("dropped"), F.lit(None).cast(hits.schema["start"].dataType).alias("start"))
    id_ = hits.withColumn("hit", F.monotonically_increasing_id())
    id_ = staged(id_, "hits")
    edges = id_.select(key, "hit", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("side")), F.struct((F.col("end") - 1).alias("at"), F.lit(2).alias("side")))).alias("e"))
    merged = marks.select(key, "at", "order", "dropped", F.lit(None).cast("long").alias("hit"), F.lit(0).alias("side")).unionByName(
        edges.select(key, F.col("e.at").cast("long").alias("at"), F.lit(1).alias("order"), F.lit(None).cast("long").alias("dropped"), "hit", "e.side")
    )
    moved = F.last("dropped", ignorenulls=True).over(Window.partitionBy(key).orderBy("at", "order").rowsBetween(Window.unboundedPreceding, 0))
    found = merged.withColumn("raw", F.col("at") + moved).where("order = 1").groupBy("hit").agg(
        F.max(F.when(F.col("side") == 1, F.col("raw"))).alias("raw_start"), (F.max(F.when(F.col("side") == 2, F.col("raw"))) + 1).alias("raw_end")
    )
    return id_.join(found, "hit").drop("hit", "start", "end").withColumnsRenamed({"raw_start": "start", "raw_end": "end"})


def _places(texts: DataFrame, snippets: DataFrame, key: str, text: str, item: str, snippet: str, least: int, own: str | None) -> DataFrame:
    """item, key, start, end, tier of all places: 1 word for word, 3 in normal form, for snippets of at least `least` code points."""
    needles = snippets.select(item, F.btrim(F.col(snippet), F.lit(" \t\r\n")).alias("needle"))
    size = needles.select(item, F.length("needle").alias("n"))
    exact = places(texts, needles, key, text, item, "needle", own).join(size, item).select(item, key, "start", (F.col("start") + F.col("n")).alias("end"), F.lit(1).alias("tier"))
    normal = needles.select(item, normal_form(F.col("needle")).alias("needle")).where(F.length("needle") >= least)
    found = places(texts.select(key, normal_form(F.col(text)).alias("hay")), normal, key, "hay", item, "needle", own)
    found = found.join(normal.select(item, F.length("needle").alias("n")), item).select(item, key, "start", (F.col("start") + F.col("n")).alias("end"))
    loose = raw_places(texts, found, key, text).select(item, key, "start", "end", F.lit(3).alias("tier"))
    return exact.unionByName(loose)


def snippet_spans(texts: DataFrame, snippets: DataFrame, key: str, text: str, item: str, snippet: str) -> DataFrame:
    """TXT-23, VER-08. item, key, start, end and confidence (exact, normalized) of the first place of each snippet in each text that
    holds it; places in normal form count where there is no exact one."""
    every = _places(texts, snippets, key, text, item, snippet, LEAST_SNIPPET, None)
    best = every.groupBy(item, key).agg(F.min(F.struct("tier", "start", "end")).alias("b"))
    return best.select(item, key, "b.start", "b.end", F.when(F.col("b.tier") == 1, "exact").otherwise("normalized").alias("confidence"))


def block_spans(texts: DataFrame, blocks: DataFrame, key: str, text: str, order: str, block: str) -> DataFrame:
    """WIN-29. key, order, start and end of the blocks of each text (unique by key and order), found by an advancing cursor.

    A block is looked for after the end of the last one that was found: word for word, then as a heading line's title, then
    in normal form; then again from the beginning, which moves the cursor back. Blocks that are nowhere have nulls. Every place of
    every block knows its successor, the place that is chosen for the next block from there; the places on the
    path from the beginning are marked by doubling these pointers, so rounds grow with the logarithm of the blocks. That is for
    texts whose length times blocks exceeds WALKED; all others are walked through in tasks, a text with its blocks at once.
    """
    sizes = blocks.groupBy(F.col(key).alias("doc")).agg(F.count("*").alias("n")).join(texts.select(F.col(key).alias("doc"), F.length(text).alias("length")), "doc")
    large = staged(sizes.where(F.col("n") * F.coalesce("length", F.lit(0)).cast("double") > WALKED).select(F.col("doc").alias(key)).distinct(), "large_texts")
    if not large.first():
        return _walked(texts, blocks, key, text, order, block)
    small = _walked(*[df.join(large, key, "left_anti") for df in (texts, blocks)], key, text, order, block)
    return small.unionByName(_by_joins(*[df.join(large, key, "left_semi") for df in (texts, blocks)], key, text, order, block))


def _titles(text: Column) -> Column:
    """Normal forms of the titles of a text's heading lines, in order."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"^#{1,6}\s+\S"))
    return F.transform(lines, lambda line: normal_form(F.regexp_replace(line, r"^#{1,6}\s+", "")))


def _walk(text: str, hay: str, titles: list[str], blocks) -> list[tuple[int | None, int | None]]:
    """Start and end of each block (needle, normal form) in a text whose normal form and headings' titles are given."""
    raw, at, p = [], [], 0  # where words begin, in the text and in normal form
    ends = []
    begin = 0
    for gap in BLANKS.finditer(text):
        if gap.start() > begin:
            raw.append(begin)
            at.append(p)
            p += gap.start() - begin + 1
            ends.append(gap.start())
        begin = gap.end()
    if begin < len(text):
        raw.append(begin)
        at.append(p)
        ends.append(len(text))
    headings: dict[str, list[tuple[int, int]]] = {}
    if titles:
        begin, named = 0, iter(titles)
        for line in text.split("\n"):
            if HEADING.match(line):
                headings.setdefault(next(named), []).append((begin, begin + len(line.rstrip(" "))))
            begin += len(line) + 1

    def normal(cursor: int) -> int:
        j = bisect_right(raw, cursor) - 1
        return 0 if j < 0 else at[j] + min(cursor - raw[j], ends[j] - raw[j] + 1)

    def place(p: int) -> int:
        j = bisect_right(at, p) - 1
        return raw[j] + p - at[j]

    found, cursor, nowhere = [], 0, set()
    for needle, form in blocks:
        spot = None
        if needle not in nowhere:
            spots = headings.get(form, []) if form else []
            for since in (cursor, 0):
                if needle and (i := text.find(needle, since)) >= 0:
                    spot = i, i + len(needle)
                elif spots and (i := bisect_left(spots, (since, -1))) < len(spots):
                    spot = spots[i]
                elif len(form) >= LEAST_BLOCK and (i := hay.find(form, normal(since))) >= 0:
                    spot = place(i), place(i + len(form) - 1) + 1
                if spot or not since:
                    break
            if not spot:
                nowhere.add(needle)
        found.append(spot or (None, None))
        cursor = spot[1] if spot else cursor
    return found


def _walked(texts: DataFrame, blocks: DataFrame, key: str, text: str, order: str, block: str) -> DataFrame:
    """block_spans() where a text and its blocks are one row."""
    needle = F.btrim(F.col(block), F.lit(" \t\r\n"))
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("k"), F.coalesce(needle, F.lit("")).alias("needle"))))
    body = F.coalesce(F.col(text), F.lit(""))
    hay = texts.select(F.col(key).alias("doc"), body.alias("text"))
    rows = blocks.groupBy(F.col(key).alias("doc")).agg(listed.alias("blocks")).join(hay, "doc", "left").select(
        "doc", F.col("blocks.k").alias("k"), F.coalesce("text", F.lit("")).alias("text"), normal_form(F.col("text")).alias("hay"), F.col("blocks.needle").alias("needles"),
        F.transform("blocks.needle", normal_form).alias("forms"), F.when(F.col("text").contains("#"), _titles(F.col("text"))).alias("titles"),
    )
    kind = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            k, spans = batch.column("k"), []
            for row in range(len(batch)):
                text, hay, needles, forms, titles = (batch.column(c)[row].as_py() for c in ("text", "hay", "needles", "forms", "titles"))
                spans.extend(_walk(text, hay, titles or [], zip(needles, forms)))
            starts, ends = (pa.array([s[i] for s in spans], pa.int64()) for i in (0, 1))
            docs = batch.column("doc").take(pc.list_parent_indices(k))
            yield pa.RecordBatch.from_arrays([docs, k.flatten(), starts, ends], ["doc", "k", "start", "end"])

    found = rows.mapInArrow(run, f"doc {kind['doc']}, k {kind['k'][6:-1]}, start long, end long")
    return found.select(F.col("doc").alias(key), F.col("k").alias(order), "start", "end")


def _by_joins(texts: DataFrame, blocks: DataFrame, key: str, text: str, order: str, block: str) -> DataFrame:
    """block_spans() where any text may be of any size."""
    item = F.struct(F.col(key).alias("doc"), F.col(order).alias("k")).alias("item")
    named = staged(blocks.select(item, F.col(block).alias("block")), "blocks")
    every = _places(texts, named, key, text, "item", "block", LEAST_BLOCK, "doc").select(F.col("item.doc").alias("doc"), F.col("item.k").alias("k"), "tier", "start", "end")
    lines = texts.select(F.col(key).alias("doc"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line_no", "line"))
    before = Window.partitionBy("doc").orderBy("line_no")
    lines = lines.withColumn("start", F.sum(F.length("line") + 1).over(before) - F.length("line") - 1).where(F.col("line").rlike(r"^#{1,6}\s+\S"))
    titles = lines.select("doc", normal_form(F.regexp_replace("line", r"^#{1,6}\s+", "")).alias("title"), F.lit(2).alias("tier"), "start", (F.col("start") + F.length(F.rtrim("line"))).alias("end"))
    wanted = named.select("item.doc", "item.k", normal_form(F.col("block")).alias("title")).where("title <> ''")
    every = every.unionByName(wanted.join(titles, ["doc", "title"]).select("doc", "k", "tier", "start", "end"))
    every = staged(every, "block_places")
    numbered = every.select("doc", "k").distinct().withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("k")))
    spots = staged(every.join(numbered, ["doc", "k"]).select("doc", "n", "k", F.struct("tier", "start", "end").alias("spot")), "spots")
    # Cursors that look for block n: the ends of all places of the block before, and the beginning for the first.
    cursors = spots.select("doc", (F.col("n") + 1).alias("n"), F.col("spot").alias("of"), F.col("spot.end").alias("at")).unionByName(
        spots.where("n = 1").select("doc", "n", F.lit(None).cast(spots.schema["spot"].dataType).alias("of"), F.lit(0).cast(spots.schema["spot"].dataType["end"].dataType).alias("at")).distinct()
    )
    merged = spots.select("doc", "n", F.col("spot.start").alias("at"), F.lit(0).alias("side"), "spot", F.lit(None).cast(spots.schema["spot"].dataType).alias("of")).unionByName(
        cursors.select("doc", "n", "at", F.lit(1).alias("side"), F.lit(None).cast(spots.schema["spot"].dataType).alias("spot"), "of")
    )
    near = Window.partitionBy("doc", "n").orderBy(F.desc("at"), "side").rowsBetween(Window.unboundedPreceding, 0)
    after = [F.last(F.when(F.col("spot.tier") == tier, F.col("spot")), ignorenulls=True).over(near) for tier in (1, 2, 3)]
    chosen = F.coalesce(*after, F.min("spot").over(Window.partitionBy("doc", "n")))
    jumps = merged.withColumn("to", chosen).where("side = 1 and to is not null").select("doc", (F.col("n") - 1).alias("n"), "of", F.col("n").alias("to_n"), "to")
    jumps = staged(jumps, "jumps")
    marked = staged(jumps.where("of is null").select("doc", F.col("to_n").alias("n"), F.col("to").alias("of")), "marked")
    jumps = staged(jumps.where("of is not null"), "jumps")
    for _ in range(((numbered.agg(F.max("n")).first()[0] or 1) - 1).bit_length()):
        reached = marked.join(jumps, ["doc", "n", "of"]).select("doc", F.col("to_n").alias("n"), F.col("to").alias("of"))
        twice = jumps.join(jumps.select("doc", F.col("n").alias("to_n"), F.col("of").alias("to"), F.col("to_n").alias("next_n"), F.col("to").alias("next")), ["doc", "to_n", "to"])
        old_marked, old_jumps = marked, jumps
        marked = staged(marked.union(reached), "marked")
        jumps = staged(twice.select("doc", "n", "of", F.col("next_n").alias("to_n"), F.col("next").alias("to")), "jumps")
        release(old_marked, old_jumps)
    found = marked.join(numbered, ["doc", "n"]).select(F.struct("doc", "k").alias("item"), "of")
    return named.join(found, "item", "left").select(F.col("item.doc").alias(key), F.col("item.k").alias(order), F.col("of.start").cast("long").alias("start"), F.col("of.end").cast("long").alias("end"))
