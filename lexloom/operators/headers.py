"""Running headers and footers under noise: lines at the edges of pages that differ by a few edits count together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

EDITS, SHORTEST, LONGEST = 2, 3, 120
#: A key is the centre of a cluster if it holds at least this part of the share that a header must reach.
CENTRE_PART = 0.1
#: So few centres, counted before, are sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 17


def edge_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, edge (header, footer) and line: the first and the last line of each text that isn't blank. A single line is
    the header only. Null and empty texts have none; repeated rows count one by one."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.btrim(x)), lambda x: x != "")
    pick = lambda name, line: F.struct(F.lit(name).alias("edge"), line.alias("line"))
    rows = docs.select(key, lines.alias("lines")).where(F.size("lines") > 0)
    both = F.array(pick("header", F.element_at("lines", 1)), pick("footer", F.when(F.size("lines") > 1, F.element_at("lines", -1))))
    return rows.select(key, F.explode(both).alias("e")).select(key, "e.*").where("line is not null")


def noisy_key(line: Column) -> Column:
    """TXT-08. Header key without accents, which recognised text often loses."""
    return X.fold_accents(X.header_footer_key(line))


def _pieces(key: Column, edits: int) -> Column:
    """(length, number, piece) of the edits + 1 pieces into which a key is cut: `edits` edits leave one of them as it is."""
    n = F.length(key)
    cut = lambda k: F.floor(n * k / (edits + 1)).cast("int")
    return F.array(*[F.struct(n.alias("n"), F.lit(k).alias("k"), F.substring(key, cut(k) + 1, cut(k + 1) - cut(k)).alias("piece")) for k in range(edits + 1)])


def _probes(key: Column, edits: int) -> Column:
    """What the pieces of keys within `edits` edits can be in this one: for each length in reach, each piece moved by up to `edits`."""
    found = []
    for more in range(-edits, edits + 1):
        n = F.length(key) + more
        for k in range(edits + 1):
            at, end = (F.floor(n * j / (edits + 1)).cast("int") for j in (k, k + 1))
            for move in range(-edits, edits + 1):
                start = at + move
                piece = F.when((start >= 0) & (start + end - at <= F.length(key)), F.substring(key, start + 1, end - at))
                found.append(F.struct(n.alias("n"), F.lit(k).alias("k"), piece.alias("piece")))
    return F.array_distinct(F.filter(F.array(*found), lambda s: s["piece"].isNotNull() & (s["n"] > 0)))


def clusters(lines: DataFrame, group: list[str], share: float, edits: int = EDITS) -> DataFrame:
    """AGG-19. The header of each group: group, key, line, n_exact, n_fuzzy, share.

    Keys of lines of SHORTEST to LONGEST code points count, digits, dates, case and accents aside. A centre is a key that
    holds at least CENTRE_PART of `share` of its group's lines, so a group has at most 1 / (CENTRE_PART * share) centres. Its
    cluster is all keys within `edits` edits. The largest cluster (then the most frequent, then the least key) is the header if it
    holds at least `share` of all lines of the group, also those too long or short; `line` is the centre's most frequent line.

    Keys meet centres on equal pieces, so no two keys of a group are compared that have no piece in common. Groups without a
    header have no row; an empty table has none.
    """
    rows = lines.select(*group, "line", noisy_key(F.col("line")).alias("key"))
    usable = F.length("line").between(SHORTEST, LONGEST) & (F.col("key") != "")
    exact = rows.where(usable).groupBy(*group, "key", "line").agg(F.count("*").alias("n"))
    keys = exact.groupBy(*group, "key").agg(F.sum("n").alias("n"), F.min_by("line", F.struct(-F.col("n"), F.col("line"))).alias("line"))
    totals = rows.groupBy(*group).agg(F.count("*").alias("total"))
    centres = keys.join(totals, group).where(F.col("n") >= F.lit(CENTRE_PART * share) * F.col("total"))
    centres = centres.select(*group, F.col("key").alias("centre"), "line", F.col("n").alias("n_exact"), "total")
    cut = centres.select("*", F.explode(_pieces(F.col("centre"), edits)).alias("p"))
    cut = cut.select(*group, "centre", "line", "n_exact", "total", "p.*")
    if centres.count() <= BROADCAST_ROWS // (edits + 1):
        cut = F.broadcast(cut)
    probed = keys.select(*group, "key", "n", F.explode(_probes(F.col("key"), edits)).alias("p")).select(*group, "key", F.col("n").alias("n_key"), "p.*")
    met = probed.join(cut, [*group, "n", "k", "piece"]).where(F.levenshtein("key", "centre") <= edits)
    once = met.groupBy(*group, "centre", "key").agg(F.first("n_key").alias("n_key"), *[F.first(c).alias(c) for c in ("line", "n_exact", "total")])
    sized = once.groupBy(*group, "centre").agg(F.sum("n_key").alias("n_fuzzy"), *[F.first(c).alias(c) for c in ("line", "n_exact", "total")])
    order = F.struct(-F.col("n_fuzzy"), -F.col("n_exact"), F.col("centre"))
    best = sized.groupBy(*group).agg(F.min_by(F.struct(F.col("centre").alias("key"), "line", "n_exact", "n_fuzzy", "total"), order).alias("b"))
    best = best.select(*group, "b.*").withColumn("share", F.col("n_fuzzy") / F.col("total"))
    return best.where(F.col("share") >= share).drop("total")


def dropped_edges(lines: DataFrame, headers: DataFrame, group: list[str], edits: int = EDITS) -> DataFrame:
    """The rows of `lines` that are their group's header within `edits` edits of the key, numbered headings aside: these
    are content. `headers` has one row for each group."""
    own = headers.select(*group, F.col("key").alias("__header"))
    rows = lines.join(own, group)
    number, _ = X.numbered_heading(F.col("line"))
    near = F.levenshtein(noisy_key(F.col("line")), F.col("__header")) <= edits
    return rows.where(near & F.length("line").between(SHORTEST, LONGEST) & F.coalesce(number == "", F.lit(True))).drop("__header")
