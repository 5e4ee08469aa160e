"""Operators on literal rows: ties, nulls, published examples, a stream."""

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.functions.vectors import cosine, softmax
from lexloom.operators import chunking, contracts, graph, lines, relational, retrieval, routing
from lexloom.streaming import windows


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(column).collect()]


def test_confidence(spark):
    cases = {"dominant": [0.97, 0.55, 0.43, 0.40], "tie": [0.66, 0.65, 0.64, 0.63], "weak": [0.42, 0.40, 0.39, 0.38], "single": [0.5], "none": [None]}
    rows = [(k, i + 1, s) for k, v in cases.items() for i, s in enumerate(v)]
    out = {r.query_id: r for r in retrieval.confidence(spark.createDataFrame(rows, "query_id string, rank int, score double")).collect()}
    assert (round(out["dominant"].confidence, 4), out["dominant"].level, out["dominant"].above) == (0.7094, "high", 1)
    assert (round(out["tie"].confidence, 4), out["tie"].level) == (0.4320, "low")
    assert round(out["weak"].confidence, 4) == 0.2339 and out["single"].score_spread == 0.5 and out["none"].confidence == 0


def test_parse_number(spark):
    found = values(spark, contracts.parse_number(F.col("x")), ["480.000.000", "500,000,000", "1.500,50", "10,5", "500.000.OOO", "1.5", None])
    assert [None if v is None else float(v) for v in found] == [480000000, 500000000, 1500.50, 10.5, None, 1.5, None]


def test_change_and_risk(spark):
    rows = spark.createDataFrame([(0.0, 10.0), (480.0, 600.0), (10.0, 5.0)], "a double, b double")
    out = rows.select(contracts.relative_change(F.col("a"), F.col("b")).alias("r"), contracts.direction(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.r for r in out] == [None, 25.0, -50.0] and [r.d for r in out] == ["INCREASED", "INCREASED", "DECREASED"]
    score = contracts.risk_score(F.lit("LIABILITY"), F.lit("MODIFIED"), F.lit("DECREASED"), F.lit(-70.0), F.lit(1), F.lit(2))
    assert spark.range(1).select(score, contracts.risk_level(score)).first()[:] == (81.0, "CRITICAL")


def test_normalize_and_route(spark):
    found = values(spark, X.normalize_query(F.col("x")), ["What is Apple's CEO?", "  HOW MANY   DOCUMENTS??? ", None, ""])
    assert found == ["what is apple ceo", "how many documents", "", ""]
    assert values(spark, routing.route(F.col("x")), found) == ["factoid", "metadata", "complex", "complex"]


def test_text_functions(spark):
    assert values(spark, X.sentences(F.col("x")), ["One is. Two is! three. Four"]) == [["One is.", "Two is! three.", "Four"]]
    assert values(spark, X.names(F.col("x")), ["The Acme Corp met IBM in New York City"]) == [["The Acme Corp", "New York City", "IBM"]]
    assert values(spark, X.estimated_tokens(F.col("x")), ["", "abc", "a" * 41, None]) == [0, 1, 10, 0]
    assert values(spark, X.fold_accents(F.col("x")), ["Điều Khoản", "été"]) == ["dieu khoan", "ete"]
    assert values(spark, X.is_page_number(F.col("x")), ["12", "Page 3 of 9", "- 4 -", "4 apples"]) == [True, True, True, False]
    assert values(spark, X.table_cells(F.col("x")), ["| a | b |"]) == [["a", "b"]]


def test_vectors(spark):
    row = spark.range(1).select(cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))), softmax(F.array(F.lit(1000.0), F.lit(1000.0)))).first()
    assert row[0] == 0.0 and row[1] == [0.5, 0.5]


def test_windows_and_packing(spark):
    out = values(spark, chunking.windows(F.col("x"), 4, 1), ["abcdefgh", "abc", ""])
    assert [[w.content for w in row] for row in out] == [["abcd", "defg", "gh"], ["abc"], []]
    sizes = F.transform(F.split("x", ","), lambda s: s.cast("int"))
    assert values(spark, chunking.batches(sizes, 10), ["4,4,4,11,1"]) == [[0, 0, 1, 2, 3]]
    assert values(spark, chunking.pack_units(sizes, 5, 8, 10, 1, 0), ["4,4,3,9"]) == [[0, 0, 1, 2]]


def test_heading_paths(spark):
    rows = [(1, 1, 1, "A"), (1, 2, 2, "B"), (1, 3, 3, "C"), (1, 4, 2, "D"), (1, 5, 1, "E")]
    df = lines.section_ends(lines.heading_paths(spark.createDataFrame(rows, "doc int, position int, level int, title string"), "doc", "position"), "doc", "position")
    out = {r.title: (r.heading_path, r.section_end) for r in df.collect()}
    assert out == {"A": ("A", 5), "B": ("A > B", 4), "C": ("A > B > C", 4), "D": ("A > D", 5), "E": ("E", None)}


def test_neighbours_and_graph(spark):
    rows = spark.createDataFrame([(1, i) for i in range(6)], "g int, i int")
    near = relational.neighbours(rows, rows.where("i in (2, 3)"), "g", "i", 1)
    assert sorted(r.i for r in near.collect()) == [1, 4]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "a string, b string")
    out = {r.node: r.hops for r in graph.expand(edges, spark.createDataFrame([("a",)], "node string"), 2).collect()}
    assert out == {"a": 0, "b": 1, "c": 2}


def test_subtree_and_diff(spark):
    rows = spark.createDataFrame([("1", "UNCHANGED"), ("1.1", "UNCHANGED"), ("1.2", "MODIFIED"), ("2", "UNCHANGED")], "key string, status string")
    out = {r.key: r.subtree_status for r in contracts.subtree_status(rows, "key", "status").collect()}
    assert out == {"1": "MODIFIED", "1.1": "UNCHANGED", "1.2": "MODIFIED", "2": "UNCHANGED"}
    a = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "z")], "k string, f string")
    b = spark.createDataFrame([("1", "x"), ("2", "w"), ("4", "v")], "k string, f string")
    assert {r.k: r.status for r in contracts.clause_diff(a, b, ["k"], "f").collect()} == {"1": "UNCHANGED", "2": "MODIFIED", "3": "REMOVED", "4": "ADDED"}


def test_merge_keeps_greatest(spark):
    a = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.2)], "query_id int, doc int, score double")
    b = spark.createDataFrame([(1, 10, 0.9)], "query_id int, doc int, score double")
    out = {r.doc: (r.raw_score, r.best_method, r.methods) for r in retrieval.merge_candidates(("v", a), ("b", b), key="doc").collect()}
    assert out == {10: (0.9, "b", ["b", "v"]), 11: (0.2, "v", ["v"])}


@pytest.mark.parametrize("late", ["1 hour"])
def test_stream_equals_batch(spark, tmp_path, late):
    folder = str(tmp_path / "in")
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.repartition(2).write.parquet(folder)
    stream = windows.stream_events(spark, folder, batch.schema)
    counts = windows.windowed_counts(stream, "ts", ["event_type"], "1 hour", late=late)
    job = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    job.awaitTermination(120)
    ours = {(r.start, r.event_type): r.n for r in spark.table("counts").collect()}
    assert ours == {(r.start, r.event_type): r.n for r in windows.windowed_counts(batch, "ts", ["event_type"], "1 hour").collect()}


def test_dates(spark):
    from lexloom.functions.dates import partial_date

    precision, date = partial_date(F.col("x"))
    texts = ["2024-03-05", "05/03/2024", "2024-03", "Q2 2024", "2024", "31/02/2024", "soon", None]
    out = spark.createDataFrame([(t,) for t in texts], "x string").select(precision, date.cast("string")).collect()
    assert [r[1] for r in out] == ["2024-03-05", "2024-03-05", "2024-03-01", "2024-04-01", "2024-01-01", None, None, None]
    assert [r[0] for r in out] == ["day", "day", "month", "quarter", "year", "unknown", "unknown", "unknown"]


def test_legal_structure(spark):
    from lexloom.operators import legal

    rows = [(1, i + 1, s) for i, s in enumerate(["CHƯƠNG I", "Điều 1. Scope", "1.1 First", "a) point", "plain text", "Điều 2. Price", "2.1 Second", "PHỤ LỤC A"])]
    found = legal.parents(legal.markers(spark.createDataFrame(rows, "doc int, line_no int, line string"), "doc"), "doc", "line_no").collect()
    assert [(r.type, r.number, r.parent) for r in sorted(found, key=lambda r: r.line_no)] == [
        ("CHAPTER", "I", None), ("ARTICLE", "1", 1), ("CLAUSE", "1.1", 2), ("POINT", "a", 3), ("ARTICLE", "2", 1), ("CLAUSE", "2.1", 6), ("APPENDIX", "A", None),
    ]
    ids = F.array(F.lit("aaaaaaaa-1"), F.lit("bbbbbbbb-2"))
    assert values(spark, legal.rewrite_markers(F.col("x"), ids), ["x [bbbbbbbb-2] y [cccccccc-3]z", "none"]) == ["x [2] y z", "none"]
    assert values(spark, legal.qualifier(F.col("x")), ["pay at least ", "not more than", "pay "]) == ["AT_LEAST", "AT_MOST", "EXACT"]


def test_mapping_and_citations(spark):
    from lexloom.operators import mapping
    from lexloom.operators.matching import in_order
    from lexloom.sources import sinks

    a = spark.createDataFrame([(1, 1, "pay the fee"), (1, 2, "pay the fee now")], "pair long, place long, body string")
    b = spark.createDataFrame([(1, 1, "pay the fee now"), (1, 2, "pay the fee")], "pair long, place long, body string")
    out = in_order(mapping.candidates(a, b, "pair").select("pair", "source", "target", "score"), ["pair"], 0.5).collect()
    assert {(r.source, r.target) for r in out} == {(1, 2), (2, 1)}
    assert {(r.old_place, r.new_place) for r in mapping.moved(a, b, "pair").collect()} == {(1, 2), (2, 1)}
    change = spark.createDataFrame([("the fee is 5 now", "the fee is 7 now")], "a string, b string").select(mapping.token_changes(F.col("a"), F.col("b"))).first()[0]
    assert [(c.op, c.old, c.new) for c in change] == [("replace", "5", "7")]
    refs = spark.createDataFrame([(1, 1, "c1", "x"), (1, 2, "c1", "y"), (1, 3, "c2", " "), (1, 4, "c3", "z")], "message_id int, place int, chunk_id string, snippet string")
    latest = spark.createDataFrame([(1, "c1", 10), (1, "c3", 11)], "message_id int, chunk_id string, retrieval_id int")
    assert [(r.chunk_id, r.order_index) for r in sinks.citation_rows(refs, latest).orderBy("order_index").collect()] == [("c1", 0), ("c3", 1)]


def test_sinks(spark, tmp_path):
    from lexloom.sources import sinks

    path = str(tmp_path / "chunks")
    rows = lambda *r: spark.createDataFrame(list(r), "id int, v string")
    sinks.overwrite_versions(rows((1, "a"), (2, "b")), path, "v")
    sinks.overwrite_versions(rows((3, "b")), path, "v")
    assert {(r.id, r.v) for r in spark.read.parquet(path).collect()} == {(1, "a"), (3, "b")}
    assert [r.id for r in sinks.delete_versions(rows((1, "a"), (2, "b")), rows((0, "a")), "v").collect()] == [2]
    new = sinks.upsert(spark.createDataFrame([(1, 5, "old")], "id int, t int, p string"), spark.createDataFrame([(1, 6, "new")], "id int, t int, p string"), ["id"], "t")
    assert [r.p for r in new.collect()] == ["new"]


def test_keys_of_long_documents(spark):
    from types import SimpleNamespace

    from lexloom.plans import events, graphs

    docs = spark.createDataFrame([(1, "\n" * 100000 + "Acme"), (2, "Zeta\nAcme met Zeta")], "doc_id long, text string")
    assert [tuple(r) for r in graphs.entity_cooccurrence(SimpleNamespace(documents=docs)).collect()] == [("Acme", "Zeta", 1)]
    said = spark.createDataFrame([(1, 1001, "assistant", "x" * 30), (2, 1, "assistant", "y")], "conv_id long, turn long, role string, text string")
    out = events.answer_stream(SimpleNamespace(conversations=said)).collect()
    assert sorted((r.n_events, r.first_piece) for r in out) == [(3, "y"), (4, "x" * 24)]


def test_majority_line_has_no_window(spark):
    rows = [("s", x) for x in ("Page 1", "Page 2", "b", "b", "c")] + [("t", "z"), ("u", None)]
    found = lines.majority_line(spark.createDataFrame(rows, "source string, line string"), ["source"], "line", 0.3)
    assert {(r.source, r.key, r.n, r.line, r.share) for r in found.where("source <> 'u'").collect()} == {("s", "b", 2, "b", 0.4), ("t", "z", 1, "z", 1.0)}
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_units_are_mapped_level_by_level(spark):
    from lexloom.operators import comparison as K
    from lexloom.sources.tables import markdown_lines

    old = "Article 1. Payment terms\n1.1 The buyer pays 100 usd.\n1.2 Late sums bear 5 percent.\nArticle 2. Warranty\n2.1 The warranty lasts 12 months."
    new = "```\nArticle 9. Sample\n```\nArticle 1. Definitions\nArticle 2. Payment terms\n2.1 The buyer pays 120 usd.\n2.2 Late sums bear 5 percent.\nArticle 3\nWarranty\n3.1 The warranty lasts 12 months.\nPage 1"
    docs = spark.createDataFrame([(0, old), (1, new)], "key long, text string")
    lines = markdown_lines(docs, "key")
    units = K.comparable_units(K.structure(lines, "key"), lines, "key").withColumn("pair", F.lit(7)).collect()
    titles = {(r.key, r.identity_key): r.title for r in units}
    assert (1, "ARTICLE:9") not in titles and titles[1, "ARTICLE:3"] == "warranty"
    assert next(r for r in units if r.key == 1 and r.identity_key == "CLAUSE:3.1").parent_key == "ARTICLE:3"
    rows = spark.createDataFrame(units)
    a, b = rows.where("key = 0").drop("key"), rows.where("key = 1").drop("key")
    # Articles 1 and 2 are there twice by number, so numbers map them first; the warranty's clause finds its equal.
    mapped = {(r.source, r.target): r.status for r in K.map_units(a, b, "pair", levels=(3, 4)).collect()}
    place = {(r.key, r.identity_key): r.order_index for r in units}
    assert mapped[place[0, "ARTICLE:1"], place[1, "ARTICLE:1"]] == "EXACT"
    assert mapped[place[0, "CLAUSE:2.1"], place[1, "CLAUSE:2.1"]] == "EXACT"
    assert (place[0, "CLAUSE:1.1"], place[1, "CLAUSE:3.1"]) not in mapped


def test_score_floors(spark):
    from lexloom.operators import comparison as K

    t, f, x = F.lit(True), F.lit(False), F.lit(0.0)
    base = {"number": f, "type": t, "parent": f, "relative": f, "title": x, "lexical": x, "position": x}
    cases = (({}, 0.1), ({"number": t}, 0.97), ({"title": F.lit(1.0), "lexical": F.lit(0.5)}, 0.85), ({"relative": t, "parent": t, "title": F.lit(0.8)}, 0.85))
    got = spark.range(1).select(*[K.score_pair(base | c).alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert [round(v, 6) for v in got] == [w for _, w in cases]
