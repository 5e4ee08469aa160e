"""Answers from metadata, filters of result lists, checks of generated answers and small formats (RTE-07, 12, 14, 18,
FLT-07, 08, 18, 20, 24, JOIN-16, 17, VER-06, TXT-09, 11, 19, 26, 42, FN-21, 27, SRC-08, 14, 18, WIN-21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import FILE_TYPES

#: Terms that are added to a lexical query of each intent, at most six.
HINTS = {"contract": ("party", "obligation", "term", "payment", "liability", "termination"), "overview": ("summary", "purpose", "scope", "content", "section", "conclusion")}
#: Answers by language and kind, with places for a count and a name.
TEMPLATES = {
    ("en", "count"): "There are %d documents in %s.", ("vi", "count"): "Có %d tài liệu trong %s.",
    ("en", "list"): "%d documents of %s are listed.", ("vi", "list"): "Liệt kê %d tài liệu của %s.",
}
#: Keys of metadata that are never stored (fixed values).
BLOCKED = ("password", "token", "secret", "authorization", "api_key")


def known_file_types(value: Column) -> Column:
    """FLT-18. Known types of a comma-separated list, sorted; unknown ones are dropped silently."""
    given = F.transform(F.split(F.lower(F.coalesce(value, F.lit(""))), ","), lambda x: F.btrim(x))
    return F.array_sort(F.array_distinct(F.array_intersect(given, F.array(*[F.lit(x) for x in FILE_TYPES]))))


def snippet(text: Column, most: int = 500) -> Column:
    """FLT-24. The first `most` code points, with an ellipsis if there are more."""
    t = F.btrim(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most)), F.lit("…"))).otherwise(t)


def children(units: DataFrame, key: str, order: str, headings_only: bool = True) -> DataFrame:
    """FLT-07, FLT-08, RTE-12. Units with a parent as rows of that parent, in document order. `units` has parent and
    is_heading."""
    rows = units.where(F.col("parent").isNotNull())
    if headings_only:
        rows = rows.where("is_heading")
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, "title"))), lambda x: x["title"])
    return rows.groupBy(key, "parent").agg(F.count("*").alias("n_children"), F.array_join(listed, " > ").alias("titles"))


def clause_filter(rows: DataFrame, levels=(), statuses=(), categories=(), keyword: str = "") -> DataFrame:
    """FLT-20. Every filter that is given must hold; those that aren't given hold always."""
    for column, wanted in (("level", levels), ("status", statuses), ("category", categories)):
        if wanted:
            rows = rows.where(F.col(column).isin(*wanted))
    return rows.where(F.lower("text").contains(keyword.lower())) if keyword else rows


def hydrate(hits: DataFrame, stored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """JOIN-16. Hits with the stored columns where the row exists, else with those of their own payload."""
    named = stored.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    rest = [c for c in hits.columns if c not in columns]
    return hits.join(named, key, "left").select(*rest, *[F.coalesce(f"__{c}", c).alias(c) for c in columns])


def with_fallback(hits: DataFrame, group: str, fallback: DataFrame, top_k: int, score: float = 0.6) -> DataFrame:
    """JOIN-17. Hits that have a chunk, then fallback chunks of the entities whose hit has none, up to top_k a group.
    `hits` and `fallback` have group, entity, chunk_id; hits also score."""
    found = hits.where("chunk_id is not null").select(group, "entity", "chunk_id", "score")
    lost = hits.where("chunk_id is null").select(group, "entity")
    more = lost.join(fallback, [group, "entity"]).select(group, "entity", "chunk_id", F.lit(score).alias("score"))
    every = found.unionByName(more).groupBy(group, "chunk_id").agg(F.max("score").alias("score"), F.min("entity").alias("entity"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "chunk_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= top_k)


def expand_query(normalized: Column, intent: Column, most: int = 6) -> Column:
    """TXT-19. A query with up to `most` hint terms of its intent that it doesn't hold yet."""
    out = normalized
    for name, terms in HINTS.items():
        new = F.filter(F.array(*[F.lit(x) for x in terms[:most]]), lambda x: ~F.array_contains(X.words(normalized), x))
        out = F.when(intent == name, F.concat_ws(" ", normalized, F.array_join(new, " "))).otherwise(out)
    return F.btrim(out)


def unsupported_numbers(answer: Column, evidence: Column) -> Column:
    """VER-06. Numbers of an answer that its evidence doesn't hold; an answer with any isn't valid."""
    numbers = lambda t: F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"[0-9]+(?:[.,][0-9]+)*"), F.lit(0))
    return F.array_sort(F.array_except(numbers(answer), numbers(evidence)))


def template_answer(language: Column, kind: Column, count: Column, name: Column) -> Column:
    """RTE-18, TXT-42. The template of a language and kind, filled; English where there is none."""
    out = F.format_string(TEMPLATES["en", "count"], count, name)
    for (lang, k), template in TEMPLATES.items():
        out = F.when((language == lang) & (kind == k), F.format_string(template, count, name)).otherwise(out)
    return out


def is_protected(line: Column) -> Column:
    """TXT-09. Lines that cleaning never drops: amounts, dates, signatures and numbered clauses."""
    return F.btrim(line).rlike(r"(?iu)^(?:\d+(?:\.\d+)+\.?\s+\S|(?:signed|signature|date)\b|.*\d{1,2}[/.-]\d{1,2}[/.-]\d{4}|.*\d+(?:[.,]\d+)*\s*(?:usd|vnd|eur|%))")


def looks_like_heading(line: Column) -> Column:
    """TXT-11. Short lines without a full stop that begin with a capital or a number and have letters."""
    t = F.btrim(line)
    return (F.length(t) >= 3) & (F.length(t) <= 80) & t.rlike(r"^(?:\d+(?:\.\d+)*\.?\s+)?\p{Lu}") & ~t.rlike(r"[.!?;,]$")


def markdown_table(headers: list[str], rows: Column) -> Column:
    """SRC-18. Markdown of an array of rows (arrays of cells); bars inside cells are escaped."""
    cell = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, cell), " | "), F.lit(" |"))
    head = line(F.array(*[F.lit(h) for h in headers]))
    rule = F.lit("| " + " | ".join("---" for _ in headers) + " |")
    return F.concat_ws("\n", head, rule, F.array_join(F.transform(rows, line), "\n"))


def semantic_row(headers: list[str], cells: Column) -> Column:
    """TXT-26. `H: v` of the cells that have a value, with semicolons between."""
    named = F.transform(F.arrays_zip(F.array(*[F.lit(h) for h in headers]).alias("h"), cells.alias("v")), lambda x: F.when(F.btrim(F.coalesce(x["v"], F.lit(""))) != "", F.concat(x["h"], F.lit(": "), x["v"])))
    return F.array_join(F.array_compact(named), "; ")


def header_row(rows: DataFrame, group: str, order: str, cells: str, most: float = 0.4) -> DataFrame:
    """SRC-08. The first row of each group of which at most `most` of the filled cells are numbers."""
    filled = F.filter(cells, lambda c: F.btrim(F.coalesce(c, F.lit(""))) != "")
    numbers = F.filter(filled, lambda c: F.btrim(c).rlike(r"^[-+]?\d+(?:[.,]\d+)*%?$"))
    return rows.where((F.size(filled) > 0) & (F.size(numbers) <= most * F.size(filled))).groupBy(group).agg(F.min(order).alias("header_row"))


def can_fall_back(enabled: Column, status: Column, timed_out: Column) -> Column:
    """SRC-14. Whether a failed remote parse may be done locally: time-outs and server errors, if it is enabled."""
    return enabled & F.coalesce(timed_out | (status >= 500) | status.isin(408, 429), F.lit(False))


def context_hash(facts: Column, prompt_version: str) -> Column:
    """FN-21. First 32 hex digits of SHA-256 over facts as JSON and the prompt's version."""
    return F.substring(F.sha2(F.concat(F.to_json(facts), F.lit("|"), F.lit(prompt_version)).cast("binary"), 256), 1, 32)


def sanitize_metadata(raw: Column, most_chars: int = 200, most_keys: int = 20) -> Column:
    """FN-27. A map of strings without blocked keys, with values cut to size and at most `most_keys` keys in order."""
    entries = F.filter(F.map_entries(raw), lambda e: ~F.lower(e["key"]).isin(*BLOCKED))
    cut = F.transform(F.slice(F.array_sort(entries), 1, most_keys), lambda e: F.struct(e["key"], F.substring(e["value"], 1, most_chars)))
    return F.map_from_entries(cut)


def merge_fragments(rows: DataFrame, group: str, order: str, shape: str) -> DataFrame:
    """WIN-21. Neighbouring table fragments of one shape as one table: group, first place, fragments."""
    own = Window.partitionBy(group).orderBy(order)
    starts = F.coalesce(F.col(shape) != F.lag(shape).over(own), F.lit(True)).cast("int")
    islands = rows.withColumn("__start", starts).withColumn("__island", F.sum("__start").over(own))
    return islands.groupBy(group, "__island").agg(F.min(order).alias("first"), F.max(shape).alias(shape), F.count("*").alias("n_fragments")).drop("__island")
