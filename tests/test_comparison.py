"""The contract chain in one pass: equal to the joins of its steps, with few exchanges and without stages."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lexloom.operators import comparison as K
from lexloom.sources.sinks import staged_so_far
from lexloom.sources.tables import markdown_lines

FOLDER = "/root/testdata/sf0.001"
OLD = "Preamble\nChapter 1 General\nArticle 1. Payment terms\n1.1 The buyer pays 100 usd.\nwithin  two weeks\n\n1.2 Late sums.\na) first\nb) second\nArticle 2\nWarranty\n2.1 Twelve months.\nPage 1\nArticle 2. Again\nAppendix A\nends"
NEW = "```\nArticle 9. Sample\n```\n| Article 8 |\nSection 2 Terms\nArticle 1. Payment terms\n1.1 The buyer pays 120 usd.\nMORE text\n01.2 Late sums.\na) first\nArticle 2. Warranty\n2.1 Twelve months.\n3. none\nArticle 7.\n7.1 New clause"


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(line.lstrip(" :+-").startswith("Exchange") for line in plan.split("\n"))


@pytest.fixture(scope="module")
def contracts(spark):
    docs = [(7, 0, OLD), (7, 1, NEW), (8, 0, NEW), (8, 1, OLD), (9, 0, "no units"), (9, 1, OLD)]
    return spark.createDataFrame(docs, "pair long, side int, text string").withColumn("key", F.col("pair") * 2 + F.col("side"))


def test_units_in_one_pass(contracts):
    lines = markdown_lines(contracts, "key")
    want = K.comparable_units(K.structure(lines, "key"), lines, "key")
    got = K.units_of(markdown_lines(contracts, ["pair", "side"]), ["pair", "side"]).withColumn("key", F.col("pair") * 2 + F.col("side"))
    rows = lambda df: sorted(map(str, df.select(sorted(want.columns)).collect()))
    assert rows(got) == rows(want) and len(rows(want)) > 40
    found = {(r.key, r.order_index): r for r in got.collect()}
    one = found[14, 2]  # by hand
    assert (one.identity_key, one.parent_key, one.body, one.start_line, one.end_line, one.own_end) == ("CLAUSE:1.1", "ARTICLE:1", "within two weeks", 4, 6, 6)
    assert (found[14, 1].end_line, found[14, 1].own_end, found[14, 0].end_line) == (9, 3, 14)


def test_diffs_in_one_pass(contracts):
    units = K.units_of(markdown_lines(contracts.repartition("pair"), ["pair", "side"]), ["pair", "side"])
    columns = [c for c in units.columns if c not in ("pair", "side")]
    a, b = (units.where(f"side = {s}").select("pair", *columns) for s in (0, 1))
    want = K.diff_signals(K.exact_matches(a, b, "pair"), a, b, "pair")
    got = K.exact_diffs(units, "pair", "side", columns)
    plain = lambda df: sorted(map(str, df.select(
        "pair", "source", "target", "score", "mapping", "classification", *[c for c in df.columns if c.endswith("_changed")],
        *[F.when(F.col(u).isNotNull(), F.struct(*[f"{u}.{c}" for c in columns])).alias(u) for u in ("a", "b")],
    ).collect()))
    assert plain(got) == plain(want)
    assert exchanges(got) == 1  # that of the documents


@pytest.mark.parametrize(("name", "most"), [("contract_diff", 4), ("contract_diff_counters", 4), ("comparable_units", 4), ("contract_articles_mapped", 4), ("contract_categories", 4), ("contract_evidence", 8)])
def test_few_exchanges(spark, name, most):
    before = staged_so_far(spark)
    found = __spark_entry__.queries()[name](spark, FOLDER)
    assert exchanges(found) <= most and staged_so_far(spark) == before


def test_categories_by_row(spark):
    """In one row as by the joins of match_rules() and assign_categories()."""
    from lexloom.operators.taxonomy import RULES, TIE_BREAK

    texts = ("Payment terms", "limitation of liability and late payment penalty", "", "the warranty may terminate early", "Bảo mật thông tin", "payment of a fee", "nothing")
    rows = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)], "i long, j long, title string, body string")
    fields = {"title": F.col("title"), "parent": F.col("body"), "body": F.concat_ws(" ", "title", "body")}
    want = K.assign_categories(K.match_rules(rows, ["i", "j"], fields, RULES), rows, ["i", "j"], list(TIE_BREAK))
    got = K.categorized(rows, ["i", "j"], {n: K.matched_rules(K.folded(c), RULES) for n, c in fields.items()}, RULES, list(TIE_BREAK))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_own_evidence(contracts):
    """As by the joins of bind_evidence() and evidence_reasons(), also of units whose number is there twice."""
    units = K.units_of(markdown_lines(contracts, ["pair", "side"]), ["pair", "side"])
    diffs = K.exact_diffs(units, "pair", "side", ["start_line", "end_line"]).where("classification <> 'UNCHANGED'")
    side = F.when(F.col("side") == 0, "OLD").otherwise("NEW").alias("side")
    catalogue = units.select("pair", side, "identity_key", "order_index", "start_line", "end_line", F.col("title").alias("text"))
    lines = contracts.select("pair", side, "text", F.size(F.split("text", "\n")).alias("n_lines"))
    want = K.evidence_reasons(K.bind_evidence(diffs, catalogue, "pair"), lines, "pair")
    texts = contracts.groupBy("pair").agg(*[F.max(F.when(F.col("side") == s, F.col("text"))).alias(n) for s, n in ((0, "old"), (1, "new"))])
    got = K.own_evidence(diffs, texts, "pair")
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert {"place", "identity"} == {r.bound_by for r in got.collect()}
