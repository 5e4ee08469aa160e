"""Typed values, their changes, and matchings against sequential choice."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import matching, values


def values_of(spark, *texts):
    rows = values.typed_values(spark.createDataFrame(list(enumerate(texts)), "id long, body string"), ["id"], "body").collect()
    return [[r for r in sorted(rows, key=lambda r: r.start) if r.id == i] for i in range(len(texts))]


def changes_of(spark, old, new):
    side = lambda text: values.typed_values(spark.createDataFrame([(1, text)], "id long, body string"), ["id"], "body")
    return sorted(values.value_changes(side(old), side(new), ["id"]).collect(), key=lambda r: (r.old or r.new).start)


def test_values_of_clauses(spark):
    cases = {
        "pay 1,200 usd within 30 days, then 5% or 7 percent of 2 units": [("MONEY", 1200, "USD"), ("DURATION", 30, "DAY"), ("PERCENTAGE", 5, "PERCENT"), ("PERCENTAGE", 7, "PERCENT"), ("QUANTITY", 2, "unit")],
        "giá 480.000.000 đồng và 500 triệu đồng": [("MONEY", 480e6, "VND"), ("MONEY", 500e6, "VND")],
        "theo Điều 5 và khoản 8.2, trang 12": [],
        "hợp đồng số HD-01/01/2025": [],
        "không quá 100% giá trị": [("PERCENTAGE", 100, "PERCENT")],
        "lỗ (500.000.000 đồng), từ 30 đến 60 ngày, 10-20%": [("MONEY", -500e6, "VND"), ("DURATION", 30, "DAY"), ("PERCENTAGE", 10, "PERCENT")],
        "trong 10 ngày làm việc và 3 tuần": [("DURATION", 10, "DAY"), ("DURATION", 3, "WEEK")],
        "ngày 1 tháng 4 năm 2025, 2024-02-30, 05/06/2024": [("DATE", None, "DATE"), ("DATE", None, "DATE")],
        "cung cấp 15 sản phẩm tại Hà Nội": [("QUANTITY", 15, "sản phẩm"), ("LOCATION", None, "LOC")],
        "Công ty TNHH Sao Mai": [("ORGANIZATION", None, "ORG")],
        "": [],
    }
    for text, found in zip(cases, values_of(spark, *cases), strict=True):
        assert [(v.type, v.number, v.unit) for v in found] == cases[text], text
        assert all(text[v.start : v.end] == v.raw for v in found), text
    (a,), (b, c, d) = values_of(spark, "không quá 100% giá trị", "lỗ (500.000.000 đồng), từ 30 đến 60 ngày, 10-20%")
    assert a.qualifier == "AT_MOST" and (c.number_max, d.number_max, c.qualifier) == (60, 20, "RANGE")


@pytest.mark.parametrize(("old", "new", "expected"), [
    ("giá 500.000.000 đồng", "giá 600.000.000 đồng", [("MONEY", "INCREASED", 100e6, 20.0)]),
    ("phạt 10%", "phạt 15%", [("PERCENTAGE", "INCREASED", 5, 50.0)]),
    ("từ 2025-01-01", "từ 2025-04-01", [("DATE", "LATER", 90, None)]),
    ("bảo hành 12 tháng", "bảo hành 24 tháng", [("DURATION", "INCREASED", 12, 100.0)]),
    ("bảo hành 1 năm", "bảo hành 12 tháng", []),
    ("trả 10 ngày", "trả 20 ngày", [("DURATION", "INCREASED", 10, 100.0)]),
    ("2024-01-05 in 3 weeks", "2024-02-05 in 4 weeks", [("DATE", "LATER", 31, None), ("DURATION", "REPLACED", None, None)]),
    ("không có gì", "tạm ứng 1.000.000.000 đồng", [("MONEY", "ADDED", 1e9, None)]),
    ("tạm ứng 1.000.000.000 đồng", "không có gì", [("MONEY", "REMOVED", None, None)]),
    ("giá 500.000.000 đồng", "giá 500 triệu đồng", []),
    ("giá 100 USD", "giá 100 EUR", [("MONEY", "REPLACED", None, None)]),
    ("phạt 0%", "phạt 10%", [("PERCENTAGE", "INCREASED", 10, None)]),
    ("trả 10 ngày làm việc", "trả 10 ngày", [("DURATION", "REPLACED", None, None)]),
    ("giao tại Hà Nội", "giao tại Đà Nẵng", [("LOCATION", "REPLACED", None, None)]),
    ("từ 30 đến 60 ngày", "từ 45 đến 90 ngày", [("DURATION", "INCREASED", 15, 50.0)]),
    ("từ 30 đến 60 ngày", "từ 30 đến 90 ngày", [("DURATION", "UNCHANGED", 0, 0.0)]),
    ("pay within 10 days pay within 20 days", "pay within 11 days refund after holiday 21 days", [("DURATION", "INCREASED", 1, 10.0), ("DURATION", "INCREASED", 1, 5.0)]),
    ("đợt 1 trả 30% trong 45 ngày, đợt 2 trả 70% trong 15 ngày", "đợt 1 trả 40% trong 60 ngày, đợt 2 trả 60% trong 15 ngày", [("PERCENTAGE", "INCREASED", 10, 33.3333), ("DURATION", "INCREASED", 15, 33.3333), ("PERCENTAGE", "DECREASED", -10, -14.2857)]),
])
def test_changes_of_values(spark, old, new, expected):
    assert [(r.type, r.direction, r.delta, r.relative) for r in changes_of(spark, old, new)] == expected


def edges_of(seed):
    """Few score levels, so targets are contested and ties are common; two groups."""
    rng = random.Random(seed)
    return [(g, s, t, rng.choice([0.1, 0.28, 0.3, 0.5, 0.7, 0.9])) for g in "xy" for s in range(25) for t in rng.sample(range(25), rng.randrange(9))]


def as_frame(spark, rows):
    return spark.createDataFrame(rows, "g string, source long, target long, score double")


@pytest.mark.parametrize("seed", [1, 2])
def test_matchings_equal_sequential_choice(spark, seed):
    rows = edges_of(seed)
    good = [r for r in rows if r[3] >= 0.28]
    for operator, order in ((matching.best_first, lambda r: (-r[3], r[1], r[2])), (matching.in_order, lambda r: (r[1], -r[3], r[2]))):
        taken, used = set(), set()
        for r in sorted(good, key=order):
            if not {(r[0], "s", r[1]), (r[0], "t", r[2])} & used:
                used |= {(r[0], "s", r[1]), (r[0], "t", r[2])}
                taken.add(r)
        assert {tuple(r) for r in operator(as_frame(spark, rows), ["g"], 0.28).select("g", "source", "target", "score").collect()} == taken


@pytest.mark.parametrize("seed", [3, 4])
def test_residual_matching_equals_sequential_choice(spark, seed):
    rows, expected = edges_of(seed), {}
    for g in "xy":
        own = [r for r in rows if r[0] == g]
        best = {s: max(r[3] for r in own if r[1] == s) for s in {r[1] for r in own}}
        used = set()
        for s in sorted(best, key=lambda s: (-best[s], s)):
            options = sorted((-r[3], r[2]) for r in own if r[1] == s and r[2] not in used)
            status, target = "UNMATCHED", None
            if options:
                score, second = -options[0][0], -options[1][0] if len(options) > 1 else None
                if second is not None and second >= 0.5 and score - second < 0.05:
                    status = "AMBIGUOUS"
                elif score >= 0.3 and (second is None or score - second >= 0.1):
                    status, target = "MATCHED", options[0][1]
                    used.add(target)
            expected[g, s] = (status, target)
    accepts = (F.col("score") >= 0.3) & (F.col("second").isNull() | (F.col("score") - F.col("second") >= 0.1))
    found = matching.by_best_option(as_frame(spark, rows), ["g"], accepts, 0.05, 0.5)
    assert {(r.g, r.source): (r.status, r.target) for r in found.collect()} == expected


def test_categories_of_folded_text(spark):
    """Rules are for folded text; accents, capitals and wide blanks make no difference, in any layer."""
    from lexloom.operators import comparison as K
    from lexloom.operators.taxonomy import RULES

    texts = ["Giới hạn  trách nhiệm", "gioi han trach nhiem", "Limitation of Liability", "LIMITATION OF LIABILITY", "weather report", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for layer in ("title", "heading", "local", "body"):
        hits = {(r.id, r.category) for r in K.match_rules(rows, ["id"], {layer: F.col("t")}, RULES).collect()}
        assert {i for i, c in hits if c == "LIABILITY"} == {0, 1, 2, 3}, layer
        assert not {i for i, _ in hits} & {4, 5}


@pytest.mark.parametrize("most", [0, 99, 1 << 20])
def test_matchings_in_tasks_and_by_rounds(spark, monkeypatch, most):
    """Groups above the limit go by rounds and smaller ones through tasks, with equal results; without large groups nothing but the edges is written."""
    from lexloom.sources.sinks import staged_so_far

    rows = edges_of(5) + [("z", s, t, 0.5) for s in range(6) for t in range(5)]
    for operator in (matching.best_first, matching.in_order):
        monkeypatch.setattr(matching, "MOST_EDGES", 1 << 20)
        before = staged_so_far(spark)
        want = operator(as_frame(spark, rows), ["g"], 0.28).collect()
        assert staged_so_far(spark) - before == 2
        monkeypatch.setattr(matching, "MOST_EDGES", most)
        assert sorted(map(tuple, operator(as_frame(spark, rows), ["g"], 0.28).select("g", "source", "target", "score").collect())) == sorted((r.g, r.source, r.target, r.score) for r in want)


def test_candidates_by_brute_force(spark):
    """Windows of places with gaps, of clauses that are on one side only; no clause is sent more than once."""
    from lexloom.operators import mapping

    rng = random.Random(6)
    made = lambda: [(p, place, " ".join(rng.choices("abcde", k=rng.randrange(5)))) for p in range(4) for place in sorted(rng.sample(range(40), 20)) if p != 3]
    old, new = made(), [*made(), (9, 1, "a")]
    a, b = (spark.createDataFrame(rows, "pair long, place long, body string") for rows in (old, new))
    expected = set()
    for p, s, x in old:
        near = []
        for q, t, y in new:
            if p == q and abs(s - t) <= 4:
                u, v = set(x.split()), set(y.split())
                near.append((-round(len(u & v) / len(u | v), 6) if u | v else -0.0, abs(s - t), t))
        expected |= {(p, s, t, -score) for score, _, t in sorted(near)[:3]}
    found = mapping.candidates(a, b, "pair", most=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sum(line.lstrip(" :+-").startswith("Exchange") for line in plan.split("\n")) == 1
    assert {(r.pair, r.source, r.target, r.score) for r in found.collect()} == expected


def test_single_value_changes_equal_the_matching(spark):
    """Texts without two values of one type: by neighbours as by the choice among values, also where values don't align or one side lacks them."""
    from lexloom.operators import values as V

    texts = ["pay 100 usd within 7 days", "pay 120 usd within 7 days at 5 percent", "", None, "5 %", "the long lead of words before it says 3 months after", "at most 12 years", "công ty ABC Viet at hà nội", "2024-01-05", "on 06/02/2025 nothing", "300 units"]
    rows = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)], "i long, j long, a string, b string")
    assert rows.where(V.repeats_type(F.col("a"))).count() == 0
    assert spark.createDataFrame([("1 day or 2 days",), ("1 day, 2 usd",)], "a string").where(V.repeats_type(F.col("a"))).count() == 1
    want = V.value_changes(V.typed_values(rows, ["i", "j"], "a"), V.typed_values(rows, ["i", "j"], "b"), ["i", "j"])
    got = V.single_value_changes(rows, ["i", "j"], "a", "b")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sum(line.lstrip(" :+-").startswith("Exchange") for line in plan.split("\n")) == 1
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and want.count() > 50


def test_exact_changes_of_contested_and_other_units(spark):
    from lexloom.operators import comparison as K

    unit = lambda body: F.struct(F.lit("CLAUSE:1.1").alias("identity_key"), body.alias("body"))
    bodies = [("pay 5 usd", "pay 7 usd"), ("1 day then 2 days", "1 day then 3 days"), ("2 days", "1 day or 4 days")]
    diffs = spark.createDataFrame([(i, 0, 0, "MODIFIED", a, b) for i, (a, b) in enumerate(bodies)], "pair long, source long, target long, classification string, x string, y string")
    found = K.exact_changes(diffs.select("pair", "source", "target", "classification", unit(F.col("x")).alias("a"), unit(F.col("y")).alias("b")), "pair").collect()
    assert {(r.pair, r.identity_key, r.delta) for r in found if r.change == "REPLACED"} >= {(0, "CLAUSE:1.1", 2.0), (1, "CLAUSE:1.1", 1.0)}
    assert {r.pair for r in found} == {0, 1, 2}
