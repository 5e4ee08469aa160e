"""Quality rules with risk-controlled cutoffs, with DataFrame functions only.

Each rule is a statistic of a text that is high for bad texts. A stratum is a language. For each stratum and
rule the cutoffs of a fixed grid are tested from the loosest on: a cutoff is safe if the exact binomial test
on the labelled good documents rejects that its rate of false rejections is above RISK / (number of rules),
at level ERROR / (strata x rules). The tightest safe cutoff is used; without one the rule rejects nothing in
that stratum. Cutoffs are nested, so testing them in order needs no further correction, and with probability
1 - ERROR no stratum loses more than RISK of its good documents. All labelled rows are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

BLANKS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
RISK, ERROR = 0.05, 0.05

#: Rules and their cutoffs, from the loosest to the tightest.
RULES: dict[str, tuple[float, ...]] = {
    "symbols": (0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01),
    "exclamations": (0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01),
    "capitals": (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08),
    "word_length": (30.0, 20.0, 15.0, 12.0, 11.0, 10.0, 9.5, 9.0, 8.5, 8.0),
    "repeated_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15),
    "repeated_words": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2),
}


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS, -1), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, the first occurrence included.

    Windows are sorted by content with their places, so equal ones are neighbours; their places in order then
    cover three words each, less what the next one covers again.
    """
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), F.hash(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("g"), i.alias("i")),
    )

    def covered(ordered: Column) -> Column:
        same = lambda a, b: (a["h"] == b["h"]) & (a["g"] == b["g"])
        twice = F.filter(
            ordered,
            lambda w, k: F.coalesce(same(w, F.get(ordered, k - 1)), F.lit(False)) | F.coalesce(same(w, F.get(ordered, k + 1)), F.lit(False)),
        )
        places = F.array_sort(F.transform(twice, lambda w: w["i"]))
        return F.aggregate(
            F.transform(F.array(places), lambda p: F.aggregate(
                F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))),
                F.lit(0), lambda s, x: s + x,
            )),
            F.lit(0), lambda s, x: s + x,
        )

    return F.when(n < 3, F.lit(0)).otherwise(
        F.aggregate(F.transform(F.array(F.array_sort(windows)), covered), F.lit(0), lambda s, x: s + x)
    )


def measures(docs: DataFrame) -> DataFrame:
    """Counts of every row of `docs` (doc_id, text, lang): n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, lines with a word, and what the rules need."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), text.alias("text"))
    blanks, upper = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    size = lambda without: F.length(F.translate("text", without, ""))
    rows = rows.select(
        "doc_id", "lang", _words(F.col("text")).alias("words"),
        size(blanks).alias("word_chars"), (F.length("text") - size(SYMBOLS)).alias("n_symbols"),
        (F.length("text") - size("!")).alias("n_marks"), (F.length("text") - size(upper)).alias("n_capitals"),
        F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(blanks)) != "").alias("lines"),
    )
    long = lambda c: c.cast("long")
    return rows.select(
        "doc_id", "lang", long(F.size("words")).alias("n_words"), long(F.col("word_chars")).alias("word_chars"),
        long(F.col("n_symbols")).alias("n_symbols"), long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(repeated_words(F.col("words"))).alias("n_repeat_words"), F.size("lines").alias("n_lines"), "n_marks", "n_capitals",
    )


def _statistics() -> dict[str, Column]:
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return {
        "symbols": F.col("n_symbols") / chars,
        "exclamations": F.col("n_marks") / chars,
        "capitals": F.col("n_capitals") / chars,
        "word_length": F.col("word_chars") / words,
        "repeated_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeated_words": F.col("n_repeat_words") / words,
    }


def log_gamma(x: Column) -> Column:
    """Logarithm of gamma(x) for x >= 1, by Stirling's series after moving x up by 8."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    moved = F.log(x)
    for k in range(1, 8):
        moved = moved + F.log(x + k)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - moved


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for a binomial X. Terms shrink downwards from k if k < n p; they are added from the greatest
    on as far as a double can tell. For k >= n p the result is at least about a half and 1 is returned."""
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p))
    # below k the ratio of neighbouring terms is less than k (1 - p) / ((n - k + 1) p) < 1
    reach = F.least(k, F.ceil(40 * F.sqrt(n * p) + 60)).cast("int")
    step = lambda s, i: F.struct((s["t"] * (k - i) * (1 - p) / ((n - k + i + 1) * p)).alias("t"), (s["sum"] + s["t"]).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(0), reach), F.struct(top.alias("t"), F.lit(0.0).alias("sum")), step, lambda s: s["sum"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(total, F.lit(1.0)))


def cutoffs(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """lang, rule, cutoff for each language with good documents and each rule that has a safe cutoff. `rows` has doc_id, lang and the counts; labels are doc_id, quality (several of one doc_id
    count as good only if all are 1; nulls are left out)."""
    good = (
        labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .where("quality = 1").select(F.col("doc_id").alias("good_id"))
    )
    known = rows.join(good, F.col("doc_id") == F.col("good_id"))
    # How many cutoffs of a rule each good document exceeds: the tightest of them, which come last.
    over = [
        F.struct(F.lit(rule).alias("rule"), sum((stat > c).cast("int") for c in RULES[rule]).alias("over"))
        for rule, stat in _statistics().items()
    ]
    hist = known.select("lang", F.explode(F.array(*over)).alias("x")).groupBy("lang", "x.rule", "x.over").agg(F.count("*").alias("n"))
    total = hist.groupBy("lang", "rule").agg(F.sum("n").alias("n_good"))
    strata = total.where(F.col("rule") == "symbols").select("lang", "n_good")
    grid = F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(k + 1).alias("step"), F.lit(float(c)).alias("cutoff"), F.lit(len(cs) - k).alias("least_over"))
        for r, cs in RULES.items() for k, c in enumerate(cs)
    ])
    tests = strata.select("lang", "n_good", F.explode(grid).alias("g")).select("lang", "n_good", "g.*")
    lost = (
        tests.alias("t").join(hist.alias("h"), (F.col("t.lang") == F.col("h.lang")) & (F.col("t.rule") == F.col("h.rule")) & (F.col("h.over") >= F.col("t.least_over")), "left")
        .groupBy("t.lang", "t.rule", "step", "cutoff", "n_good").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lost"))
    )
    n_tests = strata.agg(F.count("*").alias("n_strata"))
    risk, level = RISK / len(RULES), ERROR / len(RULES)
    judged = lost.crossJoin(F.broadcast(n_tests)).withColumn(  # n_tests is one row
        "safe", binomial_tail(F.col("lost"), F.col("n_good"), risk) <= F.lit(level) / F.col("n_strata")
    )
    in_order = Window.partitionBy("lang", "rule").orderBy("step")
    return (
        judged.withColumn("all_safe", F.min("safe").over(in_order)).where("all_safe")
        .groupBy("lang", "rule").agg(F.min("cutoff").alias("cutoff"))
    )


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules for
    every row of `docs` (doc_id, text, lang).

    Null texts have no words and fail the base. A null language is a stratum of its own. Languages without
    enough good labelled documents have no cutoffs, so only the base decides. Repeated rows have equal
    results; other columns are ignored; an empty table gives an empty result.
    """
    rows = save(measures(docs.select("doc_id", "text", "lang")), "measures")
    limits = cutoffs(rows, labels).groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits"))
    judged = rows.join(limits.withColumnRenamed("lang", "stratum"), F.col("lang") == F.col("stratum"), "left")
    failed = F.filter(
        F.array(*[F.when(stat > F.try_element_at("limits", F.lit(rule)), F.lit(rule)) for rule, stat in _statistics().items()]),
        lambda r: r.isNotNull(),
    )
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & (F.size(failed) == 0)).alias("kept"), failed.alias("failed_rules"),
    )
