"""Structure of legal texts (CMP-02, TXT-24, 28..33, FN-06, 07, 31, RTE-11, WIN-06): markers, numbers, titles,
parents, contexts and citation marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of units with their level and the pattern of their heading line (fixed values).
UNITS: tuple[tuple[str, int, str], ...] = (
    ("CHAPTER", 1, r"(?iu)^\s*(?:chương|chapter)\s+([ivxlc]+|\d+)\b"),
    ("APPENDIX", 1, r"(?iu)^\s*(?:phụ lục|appendix|annex)\s+([a-z]|\d+)\b"),
    ("SECTION", 2, r"(?iu)^\s*(?:mục|section)\s+([ivxlc]+|\d+(?:\.\d+)*)\b"),
    ("ARTICLE", 3, r"(?iu)^\s*(?:điều|article)\s+(\d+)\b"),
    ("CLAUSE", 4, r"^\s*(\d+\.\d+(?:\.\d+)*)\.?\s+\S"),
    ("POINT", 5, r"^\s*([a-zđ])\)\s+\S"),
)
QUALIFIERS = (("AT_LEAST", r"(?iu)(at least|minimum of|not less than|tối thiểu|ít nhất)\s*$"), ("AT_MOST", r"(?iu)(at most|up to|maximum of|not more than|tối đa|không quá)\s*$"))


def heading_type(line: Column) -> Column:
    """TXT-33. Type of the unit that a heading line begins; null for other lines."""
    kind = F.when(F.lit(False), F.lit(None))
    for name, _, pattern in UNITS:
        kind = kind.when(line.rlike(pattern), name)
    return kind


def heading_place(kind: Column, line: Column) -> tuple[Column, Column]:
    """TXT-33. (level, number) of a heading line of a known type."""
    level, number = (F.when(F.lit(False), F.lit(None)) for _ in range(2))
    for name, depth, pattern in UNITS:
        level, number = level.when(kind == name, depth), number.when(kind == name, F.regexp_extract(line, pattern, 1))
    return level.cast("int"), number


def classify_heading(line: Column) -> tuple[Column, Column, Column]:
    """TXT-33. (type, level, number) of a heading line; nulls for other lines."""
    kind = heading_type(line)
    return kind, *heading_place(kind, line)


def markers(lines: DataFrame, key: str) -> DataFrame:
    """CMP-02. Heading lines of each document in order, outside of fences and tables."""
    from .lines import mark_fences

    kind, level, number = classify_heading(F.col("line"))
    rows = mark_fences(lines, key).where(~F.col("in_fence") & ~F.col("line").rlike(r"^\s*\|"))
    return rows.select(key, "line_no", kind.alias("type"), level.alias("level"), number.alias("number"), "line").where("type is not null")


def parents(units: DataFrame, key: str, order: str) -> DataFrame:
    """WIN-06, RTE-11. Adds parent: place of the nearest unit before that is less deep."""
    own = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = [F.when(F.col("level") == k, F.max(F.when(F.col("level") < k, F.col(order))).over(own)) for k in range(1, 7)]
    return units.withColumn("parent", F.coalesce(*found))


def normalize_title(title: Column) -> Column:
    """TXT-28. Lower case, single blanks, no punctuation at the ends."""
    t = F.coalesce(title, F.lit(""))
    single = F.when(t.rlike(r"\s\s|[^\S ]"), F.regexp_replace(t, r"\s+", " ")).otherwise(t)
    return F.btrim(F.lower(F.btrim(single)), F.lit(" \t\n\x0b\f\r.:;,-–"))


def normalize_body(body: Column, heading: Column) -> Column:
    """TXT-29. The text without its heading, single blanks, lower case."""
    t = F.when(body.startswith(heading), F.substr(body, F.length(heading) + 1)).otherwise(body)
    return F.lower(F.btrim(F.regexp_replace(t, r"\s+", " ")))


def qualifier(before: Column) -> Column:
    """FN-06. What the words before a value make of it."""
    out = F.when(F.lit(False), "")
    for name, pattern in QUALIFIERS:
        out = out.when(before.rlike(pattern), name)
    return out.otherwise("EXACT")


def context(text: Column, start: Column, end: Column, size: int) -> tuple[Column, Column]:
    """FN-07. Characters before and after a span."""
    return F.substr(text, F.greatest(start - size, F.lit(0)) + 1, F.least(start, F.lit(size))), F.substr(text, end + 1, F.lit(size))


def span_reason(start: Column, end: Column, length: Column) -> Column:
    """FN-31. Why a span is invalid, null if it is valid."""
    return F.when(start.isNull() | end.isNull(), "missing").when(start < 0, "negative").when(end <= start, "empty").when(end > length, "beyond")


def rewrite_markers(answer: Column, ids: Column) -> Column:
    """TXT-24. `[id]` as `[n]` by the place of the id in an array; marks of unknown ids are dropped."""
    parts = F.split(answer, r"\[(?=[0-9a-fA-F-]{8,}\])", -1)

    def one(part):
        mark = F.regexp_extract(part, r"^([0-9a-fA-F-]{8,})\]", 1)
        rest = F.regexp_replace(part, r"^[0-9a-fA-F-]{8,}\]", "")
        at = F.array_position(ids, mark)
        return F.when(at > 0, F.concat(F.lit("["), at.cast("string"), F.lit("]"), rest)).otherwise(rest)

    return F.concat(F.get(parts, 0), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one), ""))
