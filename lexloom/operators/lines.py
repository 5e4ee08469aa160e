"""Operators over the lines of documents: repeated lines, fences, headings, blocks (WIN-03..05, 11..14, 22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def drop_running_lines(lines: DataFrame, key: str, least: int = 3) -> DataFrame:
    """AGG-18. Lines whose repeat key occurs at least `least` times in their document are dropped."""
    counts = lines.withColumn("__key", X.repeat_key(F.col("line")))
    n = F.count("*").over(Window.partitionBy(key, "__key"))
    return counts.withColumn("__n", n).where(F.col("__key").isNull() | (F.col("__n") < max(2, least))).drop("__key", "__n")


def mark_fences(lines: DataFrame, key: str | list[str]) -> DataFrame:
    """WIN-11. Adds in_fence: whether a line is a code fence or inside one."""
    own = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("__fence", X.is_fence(F.col("line")))
    return marked.withColumn("in_fence", F.col("__fence") | (F.pmod(F.count_if(F.col("__fence")).over(own), F.lit(2)) == 1)).drop("__fence")


def heading_paths(headings: DataFrame, key: str, order: str, deepest: int = 6) -> DataFrame:
    """WIN-03, WIN-04. Adds heading_path `A > B > C` to rows with level and title.

    For each level the last title counts unless a shallower heading came after it.
    """
    own = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows, parts = headings, []
    for level in range(1, deepest + 1):
        rows = rows.withColumn(f"__at{level}", F.max(F.when(F.col("level") == level, F.col(order))).over(own))
        rows = rows.withColumn(f"__cut{level}", F.max(F.when(F.col("level") < level, F.col(order))).over(own))
        rows = rows.withColumn(f"__t{level}", F.last(F.when(F.col("level") == level, F.col("title")), True).over(own))
        alive = F.col(f"__at{level}").isNotNull() & (F.col(f"__cut{level}").isNull() | (F.col(f"__at{level}") > F.col(f"__cut{level}")))
        parts.append(F.when(alive & (F.col("level") >= level), F.col(f"__t{level}")))
    rows = rows.withColumn("heading_path", F.concat_ws(" > ", *parts))
    return rows.drop(*[f"__{c}{k}" for c in ("at", "cut", "t") for k in range(1, deepest + 1)])


def section_ends(headings: DataFrame, key: str, order: str) -> DataFrame:
    """WIN-05. Adds section_end: place of the next heading that is not deeper, null at the end."""
    own = Window.partitionBy(key).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    ends = [F.when(F.col("level") == k, F.min(F.when(F.col("level") <= k, F.col(order))).over(own)) for k in range(1, 7)]
    return headings.withColumn("section_end", F.coalesce(*ends))


def blocks(lines: DataFrame, key: str) -> DataFrame:
    """WIN-12, SRC-17. Runs of lines of one kind (heading, list, table, text) as blocks; blank lines part them."""
    line = F.col("line")
    kind = (
        F.when(F.btrim(line) == "", "blank").when(X.is_heading(line), "heading").when(X.is_table_row(line), "table")
        .when(line.rlike(r"^\s*([-*+]|\d+[.)])\s+"), "list").otherwise("paragraph")
    )
    own = Window.partitionBy(key).orderBy("line_no")
    rows = lines.withColumn("kind", kind)
    new = F.coalesce(F.col("kind") != F.lag("kind").over(own), F.lit(True)) | (F.col("kind") == "heading")
    rows = rows.withColumn("__new", new.cast("int"))
    rows = rows.withColumn("block", F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0))).where("kind <> 'blank'")
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n")
    return rows.groupBy(key, "block", "kind").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"), content.alias("content"))


def collapse_blank_lines(lines: DataFrame, key: str) -> DataFrame:
    """WIN-13. At most one blank line in a row."""
    own = Window.partitionBy(key).orderBy("line_no")
    blank = F.btrim("line") == ""
    rows = lines.withColumn("__blank", blank).withColumn("__was", F.lag("__blank").over(own))
    return rows.where(~F.col("__blank") | ~F.coalesce("__was", F.lit(False))).drop("__blank", "__was")


def insert_table_delimiters(lines: DataFrame, key: str) -> DataFrame:
    """WIN-14. A delimiter row after the first row of a pipe table that has none."""
    own = Window.partitionBy(key).orderBy("line_no")
    row, delimiter = X.is_table_row(F.col("line")), F.col("line").rlike(r"^\s*\|(\s*:?-+:?\s*\|)+\s*$")
    rows = lines.withColumn("__row", row).withColumn("__delimiter", delimiter)
    first = F.col("__row") & ~F.coalesce(F.lag("__row").over(own), F.lit(False))
    follows = F.coalesce(F.lead("__delimiter").over(own), F.lit(False))
    made = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(X.table_cells(F.col("line")))))
    out = F.when(first & ~follows, F.array(F.col("line"), made)).otherwise(F.array("line"))
    rows = rows.withColumn("__out", out)
    return rows.select(key, "line_no", F.posexplode("__out").alias("part", "line"))


def join_soft_lines(lines: DataFrame, key: str) -> DataFrame:
    """WIN-22. Lines that end without a full stop and are followed by a lower-case letter belong together."""
    own = Window.partitionBy(key).orderBy("line_no")
    before = F.lag("line").over(own)
    rows = lines.withColumn("__before", before)
    soft = F.col("__before").isNotNull() & ~F.col("__before").rlike(r"[.!?:;…]\s*$") & F.col("line").rlike(r"^\s*\p{Ll}")
    rows = rows.withColumn("__new", (~soft).cast("int"))
    rows = rows.withColumn("paragraph", F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: F.btrim(s["line"])), " ")
    return rows.groupBy(key, "paragraph").agg(content.alias("content"), F.count("*").alias("n_lines"))


def markdown_metrics(lines: DataFrame, key: str) -> DataFrame:
    """AGG-20. Headings, table rows, list items, words and characters of each document, outside of fences."""
    rows, line = mark_fences(lines, key), F.col("line")
    open_ = ~F.col("in_fence")
    return rows.groupBy(key).agg(
        F.count("*").alias("n_lines"), F.count_if(open_ & X.is_heading(line)).alias("n_headings"), F.count_if(open_ & X.is_table_row(line)).alias("n_table_rows"),
        F.count_if(open_ & line.rlike(r"^\s*[-*+]\s+")).alias("n_list_items"), F.sum(F.size(X.words(line))).cast("long").alias("n_words"),
        F.sum(F.length(line)).cast("long").alias("n_chars"),
    )


def html_headings(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Headings of markup in order: key, position, level, title (tags dropped, entities resolved)."""
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<h([1-6])[^>]*>.*?</h\1>"), F.lit(0))
    rows = pages.select(key, F.posexplode(tags).alias("position", "tag"))
    title = F.btrim(F.regexp_replace(X.unescape_html(F.regexp_replace("tag", r"<[^>]*>", "")), r"\s+", " "))
    return rows.select(key, (F.col("position") + 1).cast("long").alias("position"), F.regexp_extract("tag", r"(?i)^<h([1-6])", 1).cast("int").alias("level"), title.alias("title"))


def majority_line(rows: DataFrame, group: list[str], line: str, share: float) -> DataFrame:
    """AGG-19 in part: keys are compared exactly. Most frequent header key of each group, if it has at least a share of the group's lines."""
    counts = rows.withColumn("key", X.header_footer_key(F.col(line))).groupBy(*group, "key").agg(F.count("*").alias("n"), F.min(line).alias("line"))
    top = F.min_by(F.struct("key", "n", "line"), F.struct(-F.col("n"), F.col("key")))  # sums and tops merge, no window holds a group
    best = counts.groupBy(*group).agg(top.alias("top"), F.sum("n").alias("total"))
    return best.select(*group, "top.*", (F.col("top.n") / F.col("total")).alias("share")).where(F.col("share") >= share)


def percent(part: Column, whole: Column) -> Column:
    """AGG-42. Percentage, 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(100.0 * part / whole)
