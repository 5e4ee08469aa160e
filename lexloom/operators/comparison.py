"""The chain that compares two versions of a contract (CMP-02..15, 20..26, JOIN-16..18, 22, VER-03, VER-05, FN-11,
TXT-31, TXT-32, TXT-38, AGG-36, AGG-48): structure with spans, comparable units, mapping level by level, signals,
exact differences, categories, adjustments, evidence, report and evaluation. Every step is a DataFrame of many
documents or pairs at once; `key` names the column of a document, `pair` that of a pair of versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.sinks import staged
from . import contracts as C
from .legal import heading_place, heading_type, normalize_title
from .lines import mark_fences
from .mapping import title_similarity
from .matching import in_order
from .values import repeats_type, single_value_changes, typed_values, value_changes

#: Lines of running headers that begin no unit (fixed values).
BOILERPLATE = r"(?iu)^\s*(?:trang\s+\d+|tài\s+liệu\s+mẫu\b|page\s+\d+(?:\s+of\s+\d+)?)\s*$"
#: Words that name a unit of each type (fixed values).
ALIAS_LABELS = {
    "ARTICLE": ("điều", "dieu", "article", "art"),
    "CLAUSE": ("khoản", "khoan", "clause", "điều", "dieu", "article"),
    "POINT": ("điểm", "diem", "item"),
    "APPENDIX": ("phụ lục", "phu luc", "appendix", "annex", "schedule"),
    "CHAPTER": ("chương", "chuong", "chapter"),
    "SECTION": ("mục", "muc", "section", "phần", "phan"),
}
#: Weights, floors and limits of the mapping score (fixed values).
WEIGHTS = {"number": 0.38, "type": 0.10, "parent": 0.12, "title": 0.16, "lexical": 0.14, "semantic": 0.06, "position": 0.04}
EXACT_MIN, HIGH_MIN, MEDIUM_MIN, LOW_MIN, MARGIN = 0.97, 0.85, 0.70, 0.55, 0.05
ORDER_WINDOW, MOST_CANDIDATES = 4, 8
#: Weights and gates of the semantic score (fixed values).
SEMANTIC = {"type": 0.10, "title": 0.14, "lexical": 0.16, "semantic": 0.30, "reranker": 0.08, "parent": 0.12, "position": 0.04}
SEMANTIC_ACCEPT, SEMANTIC_HIGH, SEMANTIC_LOW, SEMANTIC_MARGIN, SEMANTIC_STRONG = 0.72, 0.84, 0.58, 0.06, 0.80
NUMBER_BONUS, SIBLING_PENALTY, TYPE_PENALTY = 0.08, 0.22, 0.45
#: Weights of the alignment of two values (fixed values).
#: Layers in which a rule is tried, with their weights, and the least score that counts (fixed values).
LAYERS = {"title": 1.00, "parent": 0.90, "heading": 0.90, "local": 0.95, "body": 0.85}
ACCEPT_MIN, SECONDARY_MIN, AMBIGUOUS, TITLE_MIN, CONFIDENT = 0.62, 0.62, 0.08, 0.70, 0.80


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def is_boilerplate(line: Column) -> Column:
    """TXT-32."""
    return F.btrim(line).rlike(BOILERPLATE)


def marked_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """CMP-02. All lines, trimmed; those that begin a unit have its type, level, number, title and heading_lines.

    The state is the last article before a line: `3.1 ...` is a clause only after an article or section has
    begun. A chapter, section or article without words after its number takes the next line as its title,
    if that is not empty and begins no unit itself; that line then belongs to the heading. Lines in fences, tables
    and boilerplate begin none. One sort by key and place serves all windows.
    """
    rows = mark_fences(lines, keys).withColumn("line", F.btrim("line"))
    rows = rows.select(*keys, "line_no", "line", "in_fence", is_boilerplate(F.col("line")).alias("boilerplate"))
    plain = ~F.col("in_fence") & ~F.col("line").startswith("|") & ~F.col("boilerplate")
    rows = rows.withColumn("type", F.when(plain, heading_type(F.col("line"))))
    level, number = heading_place(F.col("type"), F.col("line"))
    rest = r"(?iu)^(?:chương|chapter|phụ lục|appendix|annex|mục|section|điều|article)\s+\S+?\s*(?:[.:\-–—]\s*|\s+|$)"
    rows = rows.withColumn("level", level).withColumn("number", C.unit_number(number, F.col("type")))
    rows = rows.withColumn("title", F.when(F.col("level") <= 3, F.regexp_replace("line", rest, "")).otherwise(F.regexp_replace("line", r"^\s*(?:\d+(?:\.\d+)*\.?|[a-zđ]\))\s+", "")))
    own = Window.partitionBy(*keys).orderBy("line_no")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    above = F.last(F.when(F.col("type").isin("CHAPTER", "SECTION", "ARTICLE", "APPENDIX"), F.col("type")), ignorenulls=True).over(so_far)
    rows = rows.select("*", above.alias("above"), F.lead("line").over(own).alias("following"), F.lead("type").over(own).alias("following_type"))
    takes = (F.col("level") <= 3) & (F.col("title") == "") & (F.coalesce("following", F.lit("")) != "") & F.col("following_type").isNull()
    rows = rows.withColumn("in_article", F.col("above").isin("ARTICLE", "SECTION")).withColumn("heading_lines", F.when(takes, 2).otherwise(1))
    rows = rows.withColumn("title", F.when(F.col("heading_lines") == 2, F.col("following")).otherwise(F.col("title")))
    good = F.col("type").isNotNull() & (~F.col("type").isin("CLAUSE", "POINT") | F.coalesce("in_article", F.lit(False)))
    fields = [F.when(good, F.col(c)).alias(c) for c in ("type", "level", "number", "title", "heading_lines")]
    return rows.select(*keys, "line_no", "line", "boilerplate", "in_article", *fields)


def markers(lines: DataFrame, key: str | list[str]) -> DataFrame:
    """CMP-02. Heading lines outside of fences, tables and boilerplate, see marked_lines()."""
    keys = _keys(key)
    return marked_lines(lines, keys).where("type is not null").select(*keys, "line_no", "type", "level", "number", "title", "heading_lines", "in_article")


def _units(lines: DataFrame, keys: list[str]) -> DataFrame:
    """All lines with the unit that each belongs to (order_index, body_line), those that begin one with all of it."""
    rows = marked_lines(lines, keys)
    begins = F.col("type").isNotNull()
    own = Window.partitionBy(*keys).orderBy("line_no")
    so_far, before = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    identity = F.when(begins, F.struct("type", "number"))
    above = [F.last(F.when(F.col("level") < k, identity), ignorenulls=True).over(before).alias(f"above{k}") for k in range(2, 6)]
    rows = rows.select(
        "*", *above, (F.count_if(begins).over(so_far) - 1).cast("int").alias("order_index"),
        F.last(F.when(begins, F.col("line_no") + F.col("heading_lines")), ignorenulls=True).over(so_far).alias("body_line"),
    )
    parent = F.coalesce(*[F.when(F.col("level") == k, F.col(f"above{k}")) for k in range(2, 6)])
    rows = rows.withColumn("parent", parent).drop(*[f"above{k}" for k in range(2, 6)])
    # From the last line up, so that the nearest unit after a line is the last one so far.
    up = Window.partitionBy(*keys).orderBy(F.desc("line_no"))
    below, all_below = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(Window.unboundedPreceding, 0)
    ends = [F.last(F.when(F.col("level") <= k, F.col("line_no")), ignorenulls=True).over(below).alias(f"end{k}") for k in range(1, 6)]
    rows = rows.select("*", *ends, F.last(F.when(begins, F.col("line_no")), ignorenulls=True).over(below).alias("next_unit"), F.first("line_no").over(all_below).alias("last_line"))
    end = F.coalesce(*[F.when(F.col("level") == k, F.col(f"end{k}")) for k in range(1, 6)])
    named = lambda t, n: F.concat(t, F.lit(":"), n)
    return rows.select(
        *keys, "line_no", "line", "boilerplate", "order_index", "type", "level", "number", "title", named(F.col("type"), F.col("number")).alias("identity_key"),
        named(F.col("parent.type"), F.col("parent.number")).alias("parent_key"), F.col("parent.number").alias("parent_number"),
        F.col("line_no").alias("start_line"), (F.coalesce(end, F.col("last_line") + 1) - 1).alias("end_line"),
        "body_line", (F.coalesce("next_unit", F.col("last_line") + 1) - 1).alias("own_end"),
    )


UNIT_COLUMNS = ("order_index", "type", "level", "number", "title", "identity_key", "parent_key", "parent_number", "start_line", "end_line", "body_line", "own_end")


def structure(lines: DataFrame, key: str | list[str]) -> DataFrame:
    """CMP-03, CMP-04. Units of each document with parent, place, path and the lines they span.

    A unit's parent is the nearest unit before it that is less deep; it ends before the next unit that is as
    deep or less. `own_end` is where its own text ends, before its first sub-unit.
    """
    keys = _keys(key)
    return _units(lines, keys).where("type is not null").select(*keys, *UNIT_COLUMNS)


def aliases(unit_type: Column, number: Column, parent_number: Column, title: Column) -> Column:
    """TXT-31. Sorted names under which a numbered unit may be cited; none without a number."""
    return _aliases(unit_type, number, parent_number, normalize_title(title))


def _aliases(unit_type: Column, number: Column, parent_number: Column, title: Column) -> Column:
    none = F.array().cast("array<string>")
    name = lambda *parts: F.lower(F.btrim(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])))
    labelled = none
    for kind, labels in ALIAS_LABELS.items():
        labelled = F.when(unit_type == kind, F.array(*[name(f"{label} ", number) for label in labels])).otherwise(labelled)
    rest = F.substr(number, F.length(parent_number) + 2)
    below = F.when((unit_type == "CLAUSE") & number.startswith(F.concat(parent_number, F.lit("."))), F.array(
        name("điều ", parent_number, " khoản ", rest), name("dieu ", parent_number, " khoan ", rest), name("article ", parent_number, " clause ", rest),
    )).otherwise(none)
    found = F.concat(F.array(name(number)), labelled, below, F.when(title != "", F.array(title)).otherwise(none))
    return F.when(number.isNull(), none).otherwise(F.sort_array(F.array_distinct(found)))


def _prepared(units: DataFrame) -> DataFrame:
    """Units with body (null where there is none) ready for comparison: normal title, aliases, hash of the text."""
    body = F.coalesce("body", F.lit(""))
    titled = units.withColumn("title", normalize_title(F.col("title"))).withColumn("body", body)
    return titled.withColumn("aliases", _aliases(F.col("type"), F.col("number"), F.col("parent_number"), F.col("title"))).withColumn(
        "content_hash", F.sha2(F.when(F.col("body") == "", F.col("title")).otherwise(F.col("body")).cast("binary"), 256)
    )


def _joined(parts: Column) -> Column:
    return F.lower(F.regexp_replace(F.array_join(parts, " "), r"\s+", " "))


def comparable_units(units: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """CMP-05. Units with normalised title and body, aliases and a hash of the body (TXT-29..31, TXT-34).

    The body is the unit's own text without boilerplate, in lower case and single blanks; the title stands for it
    where there is none. Lines are joined to the unit that begins last before them, so the join is on equal keys.
    """
    begins = units.select(key, F.col("start_line").alias("line_no"), F.col("order_index").alias("at"), "body_line")
    own = Window.partitionBy(key).orderBy("line_no")
    marked = lines.join(begins, [key, "line_no"], "left").select(
        key, "line_no", "line", F.last("at", ignorenulls=True).over(own).alias("order_index"), F.last("body_line", ignorenulls=True).over(own).alias("body_line")
    )
    text = marked.where((F.col("line_no") >= F.col("body_line")) & ~is_boilerplate(F.col("line")) & (F.btrim("line") != ""))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.btrim(x["line"]))
    return _prepared(units.join(text.groupBy(key, "order_index").agg(_joined(parts).alias("body")), [key, "order_index"], "left"))


def units_of(lines: DataFrame, key: str | list[str]) -> DataFrame:
    """CMP-03..05. comparable_units() of structure() in one pass: no join, and no exchange where lines lie by a part of the key."""
    keys = _keys(key)
    rows = _units(lines, keys)
    text = F.when((F.col("line_no") >= F.col("body_line")) & ~F.col("boilerplate") & (F.col("line") != ""), F.col("line"))
    of_unit = Window.partitionBy(*keys, "order_index").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("parts", F.collect_list(text).over(of_unit)).where("type is not null")
    return _prepared(rows.select(*keys, *UNIT_COLUMNS, F.when(F.size("parts") > 0, _joined(F.col("parts"))).alias("body")))


def embedding_text(path: Column, title: Column, body: Column, most: int = 800) -> Column:
    """TXT-38. Path, title and body with bars between, each only if it says something new; cut to `most`."""
    t, b = F.btrim(F.coalesce(title, F.lit(""))), F.btrim(F.coalesce(body, F.lit("")))
    p = F.btrim(F.coalesce(path, F.lit("")))
    kept = F.array(F.when((p != "") & (F.lower(p) != F.lower(t)), p), F.when(t != "", t), F.when((b != "") & (F.lower(b) != F.lower(t)), b))
    return F.substring(F.array_join(F.array_compact(kept), " | "), 1, most)


def _last_part(number: Column) -> Column:
    return F.element_at(F.split(number, r"\."), -1)


def pair_signals(a: str, b: str, parents: Column) -> dict[str, Column]:
    """Signals of two units, struct columns named `a` and `b`; `parents` tells whether their parents are mapped."""
    x, y = F.col(a), F.col(b)
    same_parent = F.coalesce(x["parent_key"] == y["parent_key"], F.lit(False)) | F.coalesce(parents, F.lit(False))
    shared = F.coalesce(F.arrays_overlap(x["aliases"], y["aliases"]), F.lit(False))
    lexical = F.greatest(X.jaccard(X.words(x["body"]), X.words(y["body"])), X.jaccard(X.words(x["title"]), X.words(y["title"])))
    similar = F.when((x["title"] == "") | (y["title"] == ""), F.lit(0.0)).otherwise(title_similarity(x["title"], y["title"]))
    return {
        "number": F.coalesce(x["identity_key"] == y["identity_key"], F.lit(False)), "type": x["type"] == y["type"], "parent": same_parent,
        "relative": (x["type"] == y["type"]) & F.coalesce(_last_part(x["number"]) == _last_part(y["number"]), F.lit(False)),
        "title": F.greatest(similar, shared.cast("double")), "lexical": lexical,
        "position": F.greatest(F.lit(0.0), 1 - F.abs(x["order_index"] - y["order_index"]) / 12.0),
    }


def score_pair(s: dict[str, Column], semantic: Column | None = None, reranker: Column | None = None) -> Column:
    """CMP-06. Weighted signals with floors for equal numbers and for equal titles; from 0 to 1."""
    as_number = lambda c: c.cast("double")
    total = sum(WEIGHTS[n] * as_number(s[n]) for n in ("number", "type", "parent", "title", "lexical", "position"))
    meant = as_number(s["number"]) if semantic is None else F.coalesce(semantic, as_number(s["number"]))
    total = total + WEIGHTS["semantic"] * meant
    if reranker is not None:
        total = F.when(reranker.isNull(), total).otherwise(F.least(F.lit(1.0), 0.85 * total + 0.15 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), reranker))))
    floors = (
        (s["number"] & s["type"], EXACT_MIN), (s["relative"] & s["parent"] & (s["title"] >= 0.8), HIGH_MIN),
        ((s["title"] >= 0.99) & s["type"] & (s["lexical"] >= 0.45), HIGH_MIN),
    )
    for holds, floor in floors:
        total = F.when(holds, F.greatest(total, F.lit(floor))).otherwise(total)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def mapping_class(score: Column, exact: Column, second: Column) -> Column:
    """CMP-08. Class of a scored pair; ambiguous if the second best is nearer than MARGIN."""
    return (
        F.when(score.isNull() | (score < LOW_MIN), "UNMATCHED").when(exact & (score >= EXACT_MIN), "EXACT")
        .when(second.isNotNull() & (score - second < MARGIN), "AMBIGUOUS").when(score >= HIGH_MIN, "HIGH_CONFIDENCE")
        .when(score >= MEDIUM_MIN, "MEDIUM_CONFIDENCE").otherwise("LOW_CONFIDENCE")
    )


def combined_semantic_score(s: dict[str, Column], semantic: Column, reranker: Column, sibling_mismatch: Column) -> Column:
    """CMP-10. Weighted signals with a bonus for the relative number and penalties for structure; from 0 to 1."""
    meant = F.coalesce(semantic, F.lit(0.0))
    total = sum(SEMANTIC[n] * s[n].cast("double") for n in ("type", "title", "lexical", "parent", "position")) + SEMANTIC["semantic"] * meant
    total = total + SEMANTIC["reranker"] * F.when(reranker.isNull(), meant).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), reranker)))
    total = total + F.when(s["relative"], NUMBER_BONUS).otherwise(0.0) - F.when(sibling_mismatch, SIBLING_PENALTY).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total - F.when(s["type"], 0.0).otherwise(TYPE_PENALTY)))


def can_accept_semantic(score: Column, s: dict[str, Column], semantic: Column, margin: Column, sibling_mismatch: Column) -> Column:
    """CMP-09. Gates of a semantic match; likeness of meaning alone never accepts."""
    meant = F.coalesce(semantic, F.lit(0.0))
    refused = (
        ~s["type"] | (score < SEMANTIC_LOW) | F.coalesce(margin < SEMANTIC_MARGIN, F.lit(False))
        | ((s["title"] >= 0.9) & (s["lexical"] < 0.25) & (meant < SEMANTIC_STRONG))
        | (sibling_mismatch & (s["title"] < 0.8) & (s["lexical"] < 0.85))
    )
    reworded = (meant >= SEMANTIC_STRONG) & (s["lexical"] >= 0.15) & ~sibling_mismatch & ((s["title"] >= 0.55) | s["relative"] | s["parent"])
    backed = (
        (s["relative"] & (s["parent"] | (s["title"] >= 0.70))) | ((s["title"] >= 0.75) & (s["lexical"] >= 0.32))
        | ((s["lexical"] >= 0.55) & s["parent"]) | (score >= SEMANTIC_HIGH)
    )
    return ~refused & (reworded | ((score >= SEMANTIC_ACCEPT) & backed))


def candidates(a: DataFrame, b: DataFrame, pair: str, mapped: DataFrame | None = None) -> DataFrame:
    """JOIN-18. At most MOST_CANDIDATES target units for each source unit of the same type and pair: those with an equal title, a
    common alias, the same last number under mapped or equal parents, or within ORDER_WINDOW places. Every
    reason is a join on equal keys; `mapped` holds pair, parent_a, parent_b of the levels above."""
    x = a.select(pair, "type", F.struct(*a.columns).alias("a"))
    y = b.select(pair, "type", F.struct(*b.columns).alias("b"))
    on = lambda left, right, name: (
        left.withColumn(name, F.explode(left["__k"])).drop("__k").join(right.withColumn(name, F.explode(right["__k"])).drop("__k"), [pair, "type", name]).drop(name)
    )
    near = lambda c, w: F.sequence(c - w, c + w)
    key = lambda df, value: df.withColumn("__k", value)
    one = lambda c: F.when(c != "", F.array(c)).otherwise(F.array().cast("array<string>"))
    child = lambda parent, number: F.when(parent.isNotNull() & number.isNotNull(), F.array(F.concat_ws("|", parent, _last_part(number)))).otherwise(F.array().cast("array<string>"))
    parent_a = F.col("a.parent_key")
    if mapped is not None:
        x = x.join(mapped.select(pair, F.col("parent_a").alias("__pa"), F.col("parent_b").alias("__pb")), (x[pair] == mapped[pair]) & (parent_a == F.col("__pa")), "left").select(x["*"], "__pb")
        parent_a = F.coalesce(F.col("__pb"), parent_a)
    else:
        x = x.withColumn("__pb", F.lit(None).cast("string"))
    found = on(key(x, one(F.col("a.title"))), key(y, one(F.col("b.title"))), "k")
    found = found.unionByName(on(key(x, F.col("a.aliases")), key(y, F.col("b.aliases")), "k"))
    found = found.unionByName(on(key(x, child(parent_a, F.col("a.number"))), key(y, child(F.col("b.parent_key"), F.col("b.number"))), "k"))
    found = found.unionByName(on(key(x, near(F.col("a.order_index"), ORDER_WINDOW)), key(y, F.array(F.col("b.order_index"))), "k"))
    found = found.dropDuplicates([pair, "type", "a", "b"])
    signals = pair_signals("a", "b", F.col("__pb") == F.col("b.parent_key"))
    scored = found.withColumn("score", F.round(score_pair(signals), 6))
    own = Window.partitionBy(pair, F.col("a.order_index")).orderBy(F.desc("score"), F.col("b.order_index"))
    ranked = scored.withColumn("rank", F.row_number().over(own)).withColumn("second", F.lead("score").over(own))
    return ranked.where(F.col("rank") <= MOST_CANDIDATES)


def exact_matches(a: DataFrame, b: DataFrame, pair: str) -> DataFrame:
    """Units whose identity key occurs once on either side: pair, source, target, score, status."""
    once = lambda df, name: df.where("identity_key is not null").groupBy(pair, "identity_key").agg(F.min("order_index").cast("long").alias(name), F.count("*").alias("n")).where("n = 1").drop("n")
    return once(a, "source").join(once(b, "target"), [pair, "identity_key"]).select(pair, "source", "target", F.lit(1.0).alias("score"), F.lit("EXACT").alias("status"))


def map_level(a: DataFrame, b: DataFrame, pair: str, mapped: DataFrame | None) -> DataFrame:
    """Units of one level: equal identity keys that occur once on either side first, then the other units' candidates
    in document order, each taking its best target that is still free."""
    exact = exact_matches(a, b, pair)
    free = lambda df, at: df.join(exact.select(pair, F.col(at).alias("order_index")), [pair, "order_index"], "left_anti").select(df.columns)
    rest = candidates(free(a, "source"), free(b, "target"), pair, mapped)
    rest = rest.select(pair, F.col("a.order_index").cast("long").alias("source"), F.col("b.order_index").cast("long").alias("target"), "score", "rank", "second")
    rest = staged(rest, "mapping_candidates")
    chosen = in_order(rest.select(pair, "source", "target", "score"), [pair], LOW_MIN).withColumnRenamed("score", "best")
    second = rest.where("rank = 1").select(pair, "source", F.col("second"))
    status = mapping_class(F.col("best"), F.lit(False), F.col("second"))
    taken = chosen.join(second, [pair, "source"], "left").select(pair, "source", "target", F.col("best").alias("score"), status.alias("status"))
    return staged(exact.unionByName(taken), "mapped_level")


def map_units(a: DataFrame, b: DataFrame, pair: str, levels: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    """CMP-07. Mapping of the units of two versions, level by level: what is mapped above tells which parents
    belong together below. Returns pair, source, target, score, status for mapped units."""
    out, mapped = None, None
    for level in levels:
        x, y = a.where(F.col("level") == level), b.where(F.col("level") == level)
        found = map_level(x, y, pair, mapped)
        out = found if out is None else out.unionByName(found)
        keys = found.join(x.select(pair, F.col("order_index").alias("source"), F.col("identity_key").alias("parent_a")), [pair, "source"]).join(
            y.select(pair, F.col("order_index").alias("target"), F.col("identity_key").alias("parent_b")), [pair, "target"]
        )
        keys = keys.where("parent_a is not null and parent_b is not null").select(pair, "parent_a", "parent_b")
        mapped = keys if mapped is None else mapped.unionByName(keys)
    return out


def _signals(rows: DataFrame, pair: str) -> DataFrame:
    changed = F.col("a.content_hash") != F.col("b.content_hash")
    status = F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "REMOVED").when(changed, "MODIFIED").otherwise("UNCHANGED")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    differs = lambda name: F.when(both, ~F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}")))
    return rows.select(
        pair, "source", "target", "a", "b", "score", F.col("status").alias("mapping"), status.alias("classification"), differs("number").alias("number_changed"),
        differs("title").alias("title_changed"), differs("parent_key").alias("parent_changed"), differs("order_index").alias("position_changed"),
    )


def diff_signals(mapped: DataFrame, a: DataFrame, b: DataFrame, pair: str) -> DataFrame:
    """CMP-11, CMP-12. Every unit of either version once: ADDED, REMOVED, MODIFIED or UNCHANGED by the hash of its
    text, and whether number, title, parent or place changed."""
    x = a.select(pair, F.col("order_index").alias("source"), F.struct(*a.columns).alias("a"))
    y = b.select(pair, F.col("order_index").alias("target"), F.struct(*b.columns).alias("b"))
    return _signals(x.join(mapped, [pair, "source"], "left").join(y, [pair, "target"], "full_outer"), pair)


def paired_units(units: DataFrame, pair: str, side: str, columns: list[str]) -> DataFrame:
    """Units of either version (side 0 and 1) once, as structs a and b of `columns`: those that exact_matches() maps in one row, the
    others alone. A unit and its equal are neighbours in one sort, so there is no join, and no exchange where units lie by pair."""
    same = Window.partitionBy(pair, "identity_key")
    rows = units.select(pair, side, "identity_key", F.struct(*columns).alias("u"))
    once = lambda s: F.count_if(F.col(side) == s).over(same) == 1
    rows = rows.select("*", (once(0) & once(1) & F.col("identity_key").isNotNull()).alias("met"), F.lead("u").over(same.orderBy(side)).alias("next"))
    rows = rows.where(~(F.col("met") & (F.col(side) == 1)))
    return rows.select(pair, F.when(F.col(side) == 0, F.col("u")).alias("a"), F.when(F.col(side) == 1, F.col("u")).when(F.col("met"), F.col("next")).alias("b"))


def exact_diffs(units: DataFrame, pair: str, side: str, columns: list[str]) -> DataFrame:
    """CMP-11, CMP-12. diff_signals() of exact_matches() in one pass; a and b have `columns` and what the signals need."""
    needed = list(dict.fromkeys([*columns, "identity_key", "order_index", "content_hash", "number", "title", "parent_key"]))
    rows = paired_units(units, pair, side, needed)
    met = F.col("a").isNotNull() & F.col("b").isNotNull()
    place = lambda u: F.col(f"{u}.order_index").cast("long")
    return _signals(rows.select(pair, place("a").alias("source"), place("b").alias("target"), "a", "b", F.when(met, 1.0).alias("score"), F.when(met, "EXACT").alias("status")), pair)


def diff_counters(diffs: DataFrame, pair: str) -> DataFrame:
    """AGG-36. Counters of a run by pair; the rate of unchanged units is rounded to 4 places."""
    n = lambda name: F.count_if(F.col("classification") == name)
    return diffs.groupBy(pair).agg(
        F.count("*").alias("total_diffs"), n("UNCHANGED").alias("unchanged_count"), n("MODIFIED").alias("modified_count"), n("ADDED").alias("added_count"),
        n("REMOVED").alias("removed_count"), F.count_if(F.coalesce(F.col("mapping"), F.lit("")).isin("AMBIGUOUS", "LOW_CONFIDENCE")).alias("needs_review_count"),
        F.round(n("UNCHANGED") / F.count("*"), 4).alias("exact_unchanged_rate"),
    )


def exact_changes(diffs: DataFrame, pair: str) -> DataFrame:
    """CMP-13. Values of modified units that changed, with their identity_key, see value_changes(). Only units that have two values of one
    type somewhere need the choice among values; the others find theirs by type."""
    key = [pair, "source", "target", "identity_key"]
    bodies = diffs.where("classification = 'MODIFIED'").select(*key[:3], F.coalesce("a.identity_key", "b.identity_key").alias("identity_key"), F.col("a.body").alias("a"), F.col("b.body").alias("b"))
    rows = staged(bodies.withColumn("contested", repeats_type(F.col("a")) | repeats_type(F.col("b"))), "modified_units")
    found = single_value_changes(rows.where("not contested"), key, "a", "b")
    if not (contested := rows.where("contested")).first():
        return found
    return found.unionByName(value_changes(typed_values(contested, key, "a"), typed_values(contested, key, "b"), key))


def folded(text: Column) -> Column:
    return F.btrim(F.regexp_replace(X.fold_accents(F.coalesce(text, F.lit(""))), r"\s+", " "))


def matched_rules(text: Column, rules) -> Column:
    """Places (from 1) of the rules that match a folded text: one of their patterns does, and none of their negatives."""
    found = []
    for i, (_, _, _, patterns, negatives) in enumerate(rules):
        hit = text.rlike("|".join(f"(?:{p})" for p in patterns))
        if negatives:
            hit = hit & ~text.rlike("|".join(f"(?:{p})" for p in negatives))
        found.append(F.when(hit, F.lit(i + 1)))
    return F.array_compact(F.array(*found))


def _layer_hits(matched: Column, layer: str, rules) -> Column:
    table = F.array(*[
        F.struct(F.lit(category).alias("category"), F.lit(round(weight * LAYERS[layer], 6)).alias("score"), F.lit(rule).alias("rule"), F.lit(layer).alias("layer"))
        for rule, category, weight, _, _ in rules
    ])
    return F.transform(matched, lambda i: F.element_at(table, i))


def match_rules(rows: DataFrame, key: list[str], fields: dict[str, Column], rules) -> DataFrame:
    """CMP-15, AGG-48. The best hit of every category: a rule matches a layer if one of its patterns does and none of
    its negatives; its score is its weight times the layer's. `rules` are (rule, category, weight, patterns, negatives), for
    folded text, so the fields are folded: lower case, without accents, single blanks."""
    rows = rows.select(*key, *[folded(text).alias(f"__{layer}") for layer, text in fields.items()])
    hits = F.concat(*[_layer_hits(matched_rules(F.col(f"__{layer}"), rules), layer, rules) for layer in fields])
    every = rows.select(*key, F.explode(hits).alias("h"))
    order = F.struct(F.col("h.score"), F.col("h.layer") == "title", F.col("h.rule"))
    return every.groupBy(*key, F.col("h.category").alias("category")).agg(F.max_by("h", order).alias("h")).select(*key, "category", "h.score", "h.rule", "h.layer")


def _place(category: Column, order: list[str]) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(c) for c in order]), category), F.lit(len(order) + 1))


def assign_categories(hits: DataFrame, rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """CMP-14, TOP-12. Primary and secondary categories: a strong title hit wins, then the best hit; two near hits of
    neither title nor parent need review; without a hit the category is OTHER."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), _place(F.col("category"), order).alias("place"), "category", "score", "rule", "layer")))
    return _assigned(rows.select(*key).distinct().join(hits.groupBy(*key).agg(listed.alias("hits")), key, "left"), key)


def categorized(rows: DataFrame, key: list[str], matched: dict[str, Column], rules, order: list[str]) -> DataFrame:
    """CMP-14, CMP-15. assign_categories() of match_rules() for each row by itself; `matched` has the matched_rules() of each layer."""
    every = F.concat(*[_layer_hits(places, layer, rules) for layer, places in matched.items()])
    ranked = F.sort_array(F.transform(every, lambda h: F.struct(h["score"], (h["layer"] == "title").alias("is_title"), h["rule"], h["category"], h["layer"])), asc=False)
    rows = rows.select(*key, ranked.alias("ranked"))
    best = F.filter("ranked", lambda h, i: F.array_position(F.col("ranked.category"), h["category"]) == i + 1)
    listed = F.sort_array(F.transform(best, lambda h: F.struct((-h["score"]).alias("minus"), _place(h["category"], order).alias("place"), h["category"], h["score"], h["rule"], h["layer"])))
    return _assigned(rows.select(*key, listed.alias("hits")), key)


def _assigned(found: DataFrame, key: list[str]) -> DataFrame:
    first, runner = F.get("hits", F.lit(0)), F.get("hits", F.lit(1))
    strong = F.get(F.filter("hits", lambda h: (h["layer"] == "title") & (h["score"] >= TITLE_MIN)), F.lit(0))
    plain = lambda h: ~h["layer"].isin("title", "parent")
    unclear = strong.isNull() & (runner["score"] >= ACCEPT_MIN) & (first["score"] - runner["score"] < AMBIGUOUS) & plain(first) & plain(runner)
    none = first.isNull() | (strong.isNull() & (first["score"] < ACCEPT_MIN))
    primary = F.coalesce(strong, first)
    other = none | F.coalesce(unclear, F.lit(False))
    second = F.transform(F.filter("hits", lambda h: (h["category"] != primary["category"]) & (h["score"] >= SECONDARY_MIN)), lambda h: h["category"])
    score = F.coalesce(primary["score"], F.lit(0.0))
    return found.select(
        *key, F.when(other, "OTHER").otherwise(primary["category"]).alias("category"), F.when(other, F.array().cast("array<string>")).otherwise(second).alias("secondary"), score.alias("score"),
        F.when(none, "OTHER").when(F.coalesce(unclear, F.lit(False)), "NEEDS_REVIEW").otherwise("CLASSIFIED").alias("status"),
        F.when(other | (score < ACCEPT_MIN), "LOW").when(score >= CONFIDENT, "HIGH").otherwise("MEDIUM").alias("confidence"),
        F.when(none, "other.fallback").when(F.coalesce(unclear, F.lit(False)), "other.ambiguous").otherwise(primary["rule"]).alias("rule"),
    )


def apply_adjustments(scores: DataFrame, adjustments: DataFrame, key: list[str]) -> DataFrame:
    """CMP-20. Scores with the sum of their adjustments (column delta), clamped to 0..100, and the level anew."""
    extra = adjustments.groupBy(*key).agg(F.sum(F.round("delta", 1)).alias("__delta"), F.count("*").alias("n_adjustments"))
    joined = scores.join(extra, key, "left").withColumn("score", F.round(F.least(F.greatest(F.col("score") + F.coalesce("__delta", F.lit(0.0)), F.lit(0.0)), F.lit(100.0)), 1))
    return joined.drop("__delta").withColumn("level", C.risk_level(F.col("score"))).withColumn("n_adjustments", F.coalesce("n_adjustments", F.lit(0)))


def required_sides(classification: Column) -> Column:
    """Sides that must have evidence: the new one of what was added, the old one of what was removed, else both."""
    return F.when(classification == "ADDED", F.array(F.lit("NEW"))).when(classification == "REMOVED", F.array(F.lit("OLD"))).otherwise(F.array(F.lit("OLD"), F.lit("NEW")))


def bind_evidence(findings: DataFrame, sources: DataFrame, pair: str) -> DataFrame:
    """CMP-21, JOIN-22. Evidence of each finding and side from the catalogue of sources (pair, side, identity_key, order_index,
    start_line, end_line, text): by identity key, else by place. Documents agree since pair and side are keys."""
    sides = findings.select("*", F.explode(F.array(
        F.struct(F.lit("OLD").alias("side"), F.col("a.identity_key").alias("k"), F.col("source").alias("i")), F.struct(F.lit("NEW").alias("side"), F.col("b.identity_key").alias("k"), F.col("target").alias("i"))
    )).alias("s")).select(*findings.columns, "s.*")
    sides = sides.where(F.array_contains(required_sides(F.col("classification")), F.col("side")))
    span = F.struct("start_line", "end_line", "text")
    once = sources.where("identity_key is not null").groupBy(pair, "side", F.col("identity_key").alias("k")).agg(F.min(span).alias("by_key"), F.count("*").alias("n")).where("n = 1").drop("n")
    placed = sources.select(pair, "side", F.col("order_index").alias("i"), span.alias("by_place"))
    found = sides.join(once, [pair, "side", "k"], "left").join(placed, [pair, "side", "i"], "left").withColumn("found", F.coalesce("by_key", "by_place"))
    snippet = F.substring("found.text", 1, 240)
    return found.select(
        pair, "source", "target", "classification", "side", "k", F.col("found.start_line").alias("start_line"), F.col("found.end_line").alias("end_line"), snippet.alias("snippet"),
        F.when(F.col("by_key").isNotNull(), "identity").when(F.col("by_place").isNotNull(), "place").alias("bound_by"),
    )


def evidence_reasons(bound: DataFrame, lines: DataFrame, pair: str) -> DataFrame:
    """VER-03. Checks of each bound evidence against the lines of its document (pair, side, n_lines, text): reasons that
    fail, in order, and the status. Documents are normalised before the join."""
    return _checked(bound.join(lines.select(pair, "side", "n_lines", _hay("text").alias("__hay")), [pair, "side"], "left"))


def own_evidence(findings: DataFrame, texts: DataFrame, pair: str) -> DataFrame:
    """CMP-21, JOIN-22, VER-03. evidence_reasons() of bind_evidence() where the catalogue is the findings' own units (exact_diffs() with
    start_line and end_line): a finding's side names its unit by identity key if no other unit of that version has it, else by place. `texts`
    (pair, old, new) are joined by pair alone, so nothing is exchanged where both lie by pair."""
    named = [F.when(F.col(u).isNotNull(), F.struct(F.lit(side).alias("side"), *[F.col(f"{u}.{c}").alias(n) for c, n in (("identity_key", "k"), ("start_line", "start_line"), ("end_line", "end_line"), ("title", "title"))])) for side, u in (("OLD", "a"), ("NEW", "b"))]
    sides = findings.select(pair, "source", "target", "classification", F.explode(F.array_compact(F.array(*named))).alias("s")).select(pair, "source", "target", "classification", "s.*")
    once = (F.count("*").over(Window.partitionBy(pair, "side", "k")) == 1) & F.col("k").isNotNull()
    bound = sides.withColumn("snippet", F.substring("title", 1, 240)).withColumn("bound_by", F.when(once, "identity").otherwise("place")).drop("title")
    n_lines = lambda c: F.size(F.split(c, "\n"))
    both = texts.select(pair, _hay("old").alias("__old"), _hay("new").alias("__new"), n_lines("old").alias("__n_old"), n_lines("new").alias("__n_new"))
    of_side = lambda old, new: F.when(F.col("side") == "OLD", F.col(old)).otherwise(F.col(new))
    rows = bound.join(both, pair, "left").withColumn("__hay", of_side("__old", "__new")).withColumn("n_lines", of_side("__n_old", "__n_new"))
    return _checked(rows.drop("__old", "__new", "__n_old", "__n_new"))


def _hay(text: str) -> Column:
    return F.when(F.col(text).isNotNull(), X.normalize_evidence(F.col(text)))


def _checked(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("__needle", X.normalize_evidence(F.col("snippet")))
    inside = (F.col("__needle") != "") & (F.col("__hay") != "") & F.col("__hay").contains(F.col("__needle"))
    checks = (
        (F.col("__hay").isNull(), "SOURCE_MISSING"), (F.col("start_line").isNull(), "CLAUSE_MISSING"),
        (F.col("end_line") < F.col("start_line"), "SPAN_EMPTY"), (F.col("end_line") > F.col("n_lines"), "SPAN_BEYOND"),
        ((F.coalesce("snippet", F.lit("")) != "") & ~F.coalesce(inside, F.lit(False)), "TEXT_MISMATCH"),
    )
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(fails, F.lit(False)), name) for fails, name in checks]))
    status = F.when(F.array_contains("reasons", F.lit("SOURCE_MISSING")) | F.array_contains("reasons", F.lit("CLAUSE_MISSING")), "UNAVAILABLE").when(
        F.array_contains("reasons", F.lit("TEXT_MISMATCH")), "MISMATCH"
    ).when(F.size("reasons") > 0, "INVALID").otherwise("VALID")
    return rows.withColumn("reasons", reasons).withColumn("status", status).drop("__hay", "__needle", "n_lines")


def finding_status(checked: DataFrame, key: list[str]) -> DataFrame:
    """VER-05. Status of a finding from its sides: invalid evidence first, then whether all required sides are valid."""
    valid = F.array_distinct(F.collect_list(F.when(F.col("status") == "VALID", F.col("side"))))
    rows = checked.groupBy(*key, "classification").agg(F.bool_or(F.col("status").isin("INVALID", "MISMATCH")).alias("bad"), valid.alias("valid_sides"))
    missing = F.size(F.array_except(required_sides(F.col("classification")), F.col("valid_sides")))
    status = (
        F.when(F.col("bad"), "INVALID").when(missing == 0, "VERIFIED")
        .when((F.size("valid_sides") > 0) & (F.col("classification") == "MODIFIED"), "PARTIALLY_VERIFIED").otherwise("INSUFFICIENT_EVIDENCE")
    )
    return rows.select(*key, "classification", status.alias("verification"))


def report(diffs: DataFrame, changes: DataFrame, categories: DataFrame, scores: DataFrame, verified: DataFrame, key: list[str]) -> DataFrame:
    """CMP-22. One row for each finding with its changes, category, score, level and verification."""
    listed = changes.groupBy(*key).agg(F.count("*").alias("n_changes"), F.max(F.abs("relative")).alias("most_relative"))
    plain = diffs.select(*key, F.coalesce("a.identity_key", "b.identity_key").alias("identity_key"), "classification")
    for df in (listed, categories.select(*key, "category"), scores.select(*key, "score", "level"), verified.select(*key, "verification")):
        named = df.select(*[F.col(k).alias(f"__{k}") for k in key], *[c for c in df.columns if c not in key])
        plain = plain.join(named, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key], "left").drop(*[f"__{k}" for k in key])
    return plain.withColumn("n_changes", F.coalesce("n_changes", F.lit(0)))


def evaluate(found: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """CMP-24. True and false positives and negatives of each class, with precision, recall and F1; empty ones are 1."""
    rows = found.select(*key, F.col("classification").alias("p")).join(expected.select(*key, F.col("classification").alias("e")), key, "full_outer")
    each = rows.select(F.explode(F.array_distinct(F.array_compact(F.array("p", "e")))).alias("class"), "p", "e")
    is_p, is_e = F.coalesce(F.col("p") == F.col("class"), F.lit(False)), F.coalesce(F.col("e") == F.col("class"), F.lit(False))
    n = each.groupBy("class").agg(F.count_if(is_p & is_e).alias("tp"), F.count_if(is_p & ~is_e).alias("fp"), F.count_if(~is_p & is_e).alias("fn"))
    share = lambda a, b: F.when(b == 0, F.lit(1.0)).otherwise(F.round(a / F.nullif(b, F.lit(0)), 4))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select("class", "tp", "fp", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def stable_payload(rows: DataFrame, pair: str, columns: list[str]) -> DataFrame:
    """CMP-25. Sorted rows of a pair as text, without ids and clocks, so that two runs can be compared."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])
    return rows.groupBy(pair).agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("payload"))


def apply_reviews(existing: DataFrame, incoming: DataFrame, key: list[str], at: str) -> DataFrame:
    """CMP-26. Reviews by clause: the latest of stored and new ones stays, a new one wins a tie."""
    every = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    columns = [c for c in existing.columns if c not in key]
    best = every.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(at, "__new")).alias("r"), F.count("*").alias("n_reviews"))
    return best.select(*key, "r.*", "n_reviews")
