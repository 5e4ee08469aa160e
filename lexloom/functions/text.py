"""Text functions on columns (TXT-*, FN-19..21). All are built-in expressions but for the compatibility form."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters in both engines' regular expressions.
NOT_WORD = r"[^\p{L}\p{N}_\s]+"
#: Zero-width characters (fixed values).
ZERO_WIDTH = "​‌‍⁠﻿"
#: Words that never name an entity (fixed values).
NAME_STOP = (
    "The", "This", "That", "These", "Those", "And", "For", "With", "From", "Into", "About", "After", "Before",
    "While", "Where", "When", "What", "Which", "Who", "How", "Table", "Figure", "Section", "Chapter", "Page",
)
#: Patterns of names and acronyms (fixed values).
PROPER = r"(?<![A-Za-z0-9_])([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})(?![A-Za-z0-9_])"
ACRONYM = r"(?<![A-Za-z0-9_])([A-Z]{2,6})(?![A-Za-z0-9_])"


def normal_form(form: str):
    """A pandas function for one of the Unicode normal forms, which Spark lacks."""

    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return F.pandas_udf(run, "string")


def _unaccented() -> tuple[str, str]:
    """Every letter of the first plane that is a letter with combining marks, and that letter; d for the one with a stroke."""
    pairs = [("đ", "d"), ("Đ", "D")]
    for code in range(0xA0, 0xFB50):
        if 0xAC00 <= code <= 0xDFFF:  # syllables that decompose into letters, and surrogates
            continue
        first, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and all(unicodedata.category(m) == "Mn" for m in marks):
            pairs.append((chr(code), first))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, UNACCENTED = _unaccented()


def fold_accents(text: Column) -> Column:
    """TXT-03, TXT-04. Lower case without combining marks; the letter with stroke has no decomposition. Within the JVM."""
    return F.lower(F.regexp_replace(F.translate(text, ACCENTED, UNACCENTED), r"\p{Mn}+", ""))


def normalize_query(text: Column, compatibility: bool = False) -> Column:
    """TXT-01, TXT-02. Lower case, possessives and punctuation as blanks, single blanks; null becomes empty."""
    t = F.coalesce(text, F.lit(""))
    if compatibility:
        t = normal_form("NFKC")(t)
    t = F.btrim(F.lower(t))
    t = F.regexp_replace(t, r"['‘’′]s\b", " ")
    t = F.regexp_replace(t, r"['‘’′]", " ")
    t = F.regexp_replace(t, NOT_WORD, " ")
    return F.btrim(F.regexp_replace(t, r"\s+", " "))


def query_hash(normalized: Column) -> Column:
    """FN-19."""
    return F.sha2(normalized.cast("binary"), 256)


def evidence_id(*parts: Column) -> Column:
    """FN-20. First 32 hex digits of SHA-256 over the parts with bars between."""
    return F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 32)


def normalize_evidence(text: Column) -> Column:
    """TXT-21. Single blanks, none before closing or after opening punctuation, lower case."""
    t = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), " ​", " "), r"\s+", " ")
    t = F.regexp_replace(t, r"\s+([,.;:!?])", "$1")
    return F.lower(F.btrim(F.regexp_replace(t, r"([(\[])\s+", "$1")))


def snippet_in_source(snippet: Column, source: Column) -> Column:
    """TXT-22. Whether a snippet is part of a source in normalised form; empty ones never are."""
    needle, hay = normalize_evidence(snippet), normalize_evidence(source)
    return (needle != "") & (hay != "") & hay.contains(needle)


def fix_encoding(text: Column) -> Column:
    """TXT-05. Zero-width and control characters removed, no-break space and line ends made plain."""
    t = F.translate(F.coalesce(text, F.lit("")), " " + ZERO_WIDTH, " ")
    t = F.regexp_replace(t, "\r\n?", "\n")
    return F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def is_heading(line: Column) -> Column:
    return line.rlike(r"^#{1,6}\s+\S")


def is_fence(line: Column) -> Column:
    return (line.contains("```") | line.contains("~~~")) & line.rlike(r"^\s*(```|~~~)")


def is_table_row(line: Column) -> Column:
    return line.rlike(r"^\s*\|.*\|\s*$")


def repeat_key(line: Column, longest: int = 120) -> Column:
    """TXT-07. Key by which short running lines repeat; null for blank, structural and long lines."""
    stripped = F.btrim(line, F.lit(" \t\r\n"))
    plain = ~(is_heading(stripped) | is_fence(stripped) | is_table_row(stripped))
    good = (stripped != "") & plain & (F.length(stripped) <= longest)
    return F.when(good, F.lower(F.regexp_replace(stripped, r"\s+", " ")))


def header_footer_key(line: Column) -> Column:
    """TXT-08. Key of a running header: dates and digits as marks."""
    t = F.lower(F.btrim(F.regexp_replace(line, r"\s+", " ")))
    t = F.regexp_replace(t, r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b", "<date>")
    return F.regexp_replace(t, r"\d+", "#")


def is_page_number(line: Column) -> Column:
    """TXT-06. Lines that only number a page."""
    return F.btrim(line).rlike(r"(?i)^(page\s+)?[-–—]?\s*\d{1,4}\s*[-–—]?(\s*(/|of)\s*\d{1,4})?$")


def sentences(text: Column) -> Column:
    """TXT-12. Sentences of a text: after . ! ? … and white space, before a capital or digit."""
    parts = F.split(F.btrim(text), "(?<=[.!?…])\\s+(?=[\"'“‘(\\[]?[A-ZÀ-Ỹ0-9])")
    return F.filter(F.transform(parts, lambda s: F.btrim(s)), lambda s: s != "")


def numbered_heading(text: Column) -> tuple[Column, Column]:
    """TXT-15. (number, title) of `4.1 Title`; number is empty where there is none."""
    pattern = r"^\s*(\d+(?:\.\d+)*)\.?\s+(.+?)\s*$"
    number = F.regexp_extract(text, pattern, 1)
    return number, F.when(number != "", F.regexp_extract(text, pattern, 2)).otherwise(F.btrim(text))


def is_direct_child(parent: Column, child: Column) -> Column:
    """TXT-16. `4.1` is a direct child of `4`, `4.1.1` is not."""
    return F.regexp_replace(child, r"\.\d+$", "") == parent


def estimated_tokens(text: Column) -> Column:
    """TXT-17. A quarter of the characters, at least 1; 0 for empty texts."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def overlap_share(query_words: Column, text_words: Column) -> Column:
    """Share of a query's distinct words that a text has; 0 for a query without words."""
    q = F.array_distinct(query_words)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, text_words)) / F.size(q))


def jaccard(left: Column, right: Column) -> Column:
    """SET-08, TXT-37. Distinct common over distinct all elements; 0 for two empty arrays."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / union)


def names(text: Column) -> Column:
    """TXT-39. Runs of capitalised words, then acronyms, without stop words, in order of appearance."""
    proper = F.filter(F.regexp_extract_all(text, F.lit(PROPER), F.lit(1)), lambda n: (F.length(n) > 2) & ~n.isin(*NAME_STOP))
    return F.concat(proper, F.filter(F.regexp_extract_all(text, F.lit(ACRONYM), F.lit(1)), lambda n: ~n.isin(*NAME_STOP)))


def entity_type(name: Column) -> Column:
    """TXT-40."""
    return F.when(name.rlike("^[A-Z]{2,6}$"), "ORG").when(name.contains(" "), "ENTITY").otherwise("CONCEPT")


def file_name(path: Column) -> Column:
    """TXT-41."""
    return F.nullif(F.element_at(F.split(path, "[/\\\\]"), -1), F.lit(""))


def content_fingerprint(text: Column) -> Column:
    """TXT-34. SHA-256 of the text with single blanks in lower case."""
    return F.sha2(F.lower(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))).cast("binary"), 256)


def unescape_html(text: Column) -> Column:
    """TXT-44. The five named entities of markup, the ampersand last."""
    for entity, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(ch))
    return text


def table_cells(row: Column) -> Column:
    """TXT-25. Cells of a pipe table's row."""
    inner = F.regexp_replace(F.btrim(row), r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|", -1), lambda s: F.btrim(s))


def list_preview(titles: Column, most: int) -> Column:
    """TXT-43. The first titles, and how many more there are."""
    more = F.size(titles) - most
    return F.concat(F.array_join(F.slice(titles, 1, most), ", "), F.when(more > 0, F.format_string(" (+%d)", more)).otherwise(""))
