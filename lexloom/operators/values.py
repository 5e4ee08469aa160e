"""Typed values of clauses and what became of them (CMP-13, FN-03, FN-05..08, FN-10, FN-11, JOIN-21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import contracts as C
from .matching import best_first

#: Words of the values and of what isn't one (fixed values).
CURRENCIES = {"vnđ": "VND", "vnd": "VND", "đồng": "VND", "dong": "VND", "usd": "USD", "$": "USD", "eur": "EUR"}
SCALES = {"tỷ": 10**9, "ty": 10**9, "triệu": 10**6, "trieu": 10**6, "ngàn": 1000, "nghin": 1000, "nghìn": 1000}
DAYS = {"ngày làm việc": "BUSINESS", "ngay lam viec": "BUSINESS", "business day": "BUSINESS", "ngày": "CALENDAR", "ngay": "CALENDAR", "day": "CALENDAR"}
PERIODS = {"tuần": "WEEK", "tuan": "WEEK", "week": "WEEK", "tháng": "MONTH", "thang": "MONTH", "month": "MONTH", "năm": "YEAR", "nam": "YEAR", "year": "YEAR"}
THINGS = ("sản phẩm", "san pham", "người", "nguoi", "bản", "ban", "bộ", "bo", "lần", "lan", "unit", "product")
NO_VALUE_AFTER = ("điều", "dieu", "khoản", "khoan", "article", "clause", "trang", "page", "mục", "muc", "phụ lục", "phu luc", "hợp đồng", "hop dong", "hd")
NO_DATE_AFTER = ("hd", "so", "số", "no.", "no", "id")
COMPANY_FORMS = ("tnhh", "cp", "cổ phần", "co phan", "trách nhiệm hữu hạn", "trach nhiem huu han")
PLACE_KINDS = ("tp.", "tp", "thành phố", "thanh pho", "tỉnh", "tinh", "quận", "quan")
PLACES = ("hồ chí minh", "hà nội", "đà nẵng", "hải phòng", "cần thơ")
QUALIFIERS = {
    "AT_LEAST": ("ít nhất", "it nhat", "tối thiểu", "toi thieu", "không dưới", "khong duoi", "at least", "not less than"),
    "AT_MOST": ("không vượt quá", "khong vuot qua", "không quá", "khong qua", "tối đa", "toi da", "at most", "up to", "not more than"),
    "GREATER": ("hơn", "hon"), "LESS": ("dưới", "duoi"), "EQUAL": ("bằng", "bang"),
}
#: Weights of the alignment, its least score and the context's length (fixed values).
WEIGHTS = {"base": 0.35, "context": 0.25, "lead": 0.20, "unit": 0.10, "index": 0.07, "qualifier": 0.03}
OTHER_UNIT, OTHER_INDEX, OTHER_QUALIFIER = 0.35, 0.4, 0.6
LEAST_ALIGNMENT, CONTEXT = 0.28, 48


def _any(words, plural: bool = False) -> str:
    """One of the words, the longest first, with any white space for a blank."""
    quoted = (w.replace(".", r"\.").replace("$", r"\$").replace(" ", r"\s*") for w in sorted(words, key=len, reverse=True))
    return "(?:" + "|".join(quoted) + ")" + ("s?" if plural else "")


_NUMBER = r"\d+(?:[.,]\d+)*"
_TO = r"\s*(?:–|—|-|đến|den)\s*"
_MINUS = r"(?:-|(?:âm|giảm|giam)\s+)?"
_END = r"(?![\p{L}\d])"
_PERIOD = _any([*DAYS, *PERIODS], plural=True) + _END
_SCALED = rf"\s*{_any(SCALES)}{_END}"
_MONEY_UNIT = rf"\s*(?:{_any([c for c in CURRENCIES if c != '$'])}{_END}|\$)"
_GROUPED = r"\d{1,3}(?:[., ]\d{3})+(?:[.,]\d+)?"
_YEAR, _MONTH, _DAY = r"(?:19|20)\d{2}", r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12]\d|3[01])"
_NO_DATE = rf"(?<!{_any(NO_DATE_AFTER).replace('*', '{0,3}')}[\s\-]{{0,3}})"
#: (type, pattern) in the order in which they are tried at a place.
KINDS = (
    ("PERCENTAGE", rf"{_NUMBER}{_TO}{_NUMBER}\s*%"),
    ("PERCENTAGE", rf"{_MINUS}{_NUMBER}\s*(?:%|percent{_END}|phần\s*trăm|phan\s*tram)"),
    ("MONEY", rf"\(?{_MINUS}(?:{_GROUPED}|{_NUMBER})(?:(?:{_SCALED})?{_MONEY_UNIT}|{_SCALED})\)?|\(?{_MINUS}\d{{1,3}}(?:[.,]\d{{3}}){{2,}}(?!\d)\)?"),
    ("DATE", rf"{_NO_DATE}(?:{_YEAR}-{_MONTH}-{_DAY}(?!\d)|{_DAY}\s*tháng\s*{_MONTH}\s*năm\s*{_YEAR}(?!\d)|{_DAY}(?:/{_MONTH}/|-{_MONTH}-|\.{_MONTH}\.){_YEAR}(?!\d))"),
    ("DURATION", rf"{_NUMBER}{_TO}{_NUMBER}\s*{_PERIOD}"),
    ("DURATION", rf"{_NUMBER}\s*{_PERIOD}"),
    ("QUANTITY", rf"{_NUMBER}\s*{_any(THINGS, plural=True)}{_END}"),
)
_NOT_INSIDE = r"(?<![\p{L}\d])(?<!\d[.,])"
_NO_VALUE = rf"(?<!{_any(NO_VALUE_AFTER).replace('*', '{0,3}')}[\s.\-]{{0,3}})"
_COMPANY = rf"(?<![\p{{L}}\d])công ty(?:\s+{_any(COMPANY_FORMS)})?(?:\s+[\p{{L}}\d][\p{{L}}\d.&/-]{{1,40}}){{1,4}}"
_PLACE = rf"(?<![\p{{L}}\d])(?:{_any(PLACE_KINDS)}\s+(?:{_any(PLACES)}|[\p{{L}}][\p{{L}}\d]{{2,20}})|{_any(PLACES)})(?![\p{{L}}\d])"
VALUE = "(?iu)" + rf"{_NO_VALUE}{_NOT_INSIDE}(?:" + "|".join(f"(?:{p})" for _, p in KINDS) + rf")|(?:{_COMPANY})|(?:{_PLACE})"


def _kind(raw: Column) -> Column:
    out = F.when(raw.rlike(f"(?iu)^(?:{_COMPANY})$"), "ORGANIZATION").when(raw.rlike(f"(?iu)^(?:{_PLACE})$"), "LOCATION")
    for name, pattern in KINDS:
        out = out.when(raw.rlike(f"(?iu)^(?:{pattern})$"), name)
    return out


def _lookup(text: Column, table: dict[str, object]) -> Column:
    """Value of the longest key that the text holds as a word."""
    out = F.lit(None)
    for word in sorted(table, key=len):
        out = F.when(text.rlike(rf"(?<!\p{{L}}){_any([word])}s?(?!\p{{L}})"), F.lit(table[word])).otherwise(out)
    return out


def _date(raw: Column) -> Column:
    """The day of a date in any of the three notations; null for days that don't exist."""
    parts = F.regexp_extract_all(raw, F.lit(r"\d+"), F.lit(0))
    iso = F.length(F.get(parts, F.lit(0))) == 4
    year, day = F.when(iso, F.get(parts, F.lit(0))).otherwise(F.get(parts, F.lit(2))), F.when(iso, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(0)))
    return F.concat_ws("-", year, F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lpad(day, 2, "0")).try_cast("date")


def typed_values(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """FN-05..07, FN-10. The values of a text in order: key, start, end, raw, type, number, number_max, unit, currency, kind
    (of days), date, entity, qualifier, place (index within the type), left and right (context).

    Numbers after words such as article or page, and dates after number signs, aren't values. A scale word multiplies, a minus,
    its words or brackets negate. Days that don't exist are no dates. Work is linear in the values of a text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    split = rows.select(*key, body.alias("body"), F.regexp_extract_all(body, F.lit(VALUE), F.lit(0)).alias("raws"), F.split(body, VALUE, -1).alias("between"))
    each = split.select(*key, "body", F.posexplode(F.arrays_zip(F.col("raws").alias("raw"), F.slice("between", 1, F.size("raws")).alias("before"))).alias("at", "v"))
    each = each.select(*key, "body", "at", F.col("v.raw").alias("raw"), F.length("v.before").alias("gap"))
    own = Window.partitionBy(*key).orderBy("at")
    each = each.withColumn("start", F.sum("gap").over(own) + F.sum(F.length("raw")).over(own) - F.length("raw")).withColumn("end", F.col("start") + F.length("raw"))
    low = F.lower("raw")
    numbers = F.regexp_extract_all("raw", F.lit(rf"{_GROUPED}|{_NUMBER}"), F.lit(0))
    number = lambda i: C.parse_number(F.get(numbers, F.lit(i))).cast("decimal(38,6)")
    each = each.withColumn("type", _kind(F.col("raw")))
    ranged = F.col("type").isin("PERCENTAGE", "DURATION") & (F.size(numbers) == 2)
    sign = F.when(F.col("type").isin("MONEY", "PERCENTAGE") & ~ranged & low.rlike(r"^\(|^-|^(?:âm|giảm|giam)\s"), -1).otherwise(1)
    scale = F.when(F.col("type") == "MONEY", F.coalesce(_lookup(low, SCALES).cast("long"), F.lit(1))).otherwise(1)
    counted = F.col("type").isin("PERCENTAGE", "MONEY", "DURATION", "QUANTITY")
    currency = F.when(F.col("type") == "MONEY", F.when(low.contains("$"), "USD").otherwise(_lookup(low, {c: n for c, n in CURRENCIES.items() if c != "$"})))
    days = F.when(F.col("type") == "DURATION", _lookup(low, DAYS))
    unit = (
        F.when(F.col("type") == "PERCENTAGE", "PERCENT").when(F.col("type") == "MONEY", F.coalesce(currency, F.lit("AMOUNT"))).when(F.col("type") == "DATE", "DATE")
        .when(F.col("type") == "DURATION", F.when(days.isNotNull(), "DAY").otherwise(_lookup(low, PERIODS))).when(F.col("type") == "QUANTITY", _lookup(low, {t: t for t in THINGS}))
        .when(F.col("type") == "ORGANIZATION", "ORG").otherwise("LOC")
    )
    before = F.substring("body", F.greatest(F.col("start") - 31, F.lit(1)), F.least(F.col("start"), F.lit(32)))
    said = F.when(ranged, "RANGE")
    for name, words in QUALIFIERS.items():
        said = said.when(before.rlike(rf"(?iu)(?<!\p{{L}}){_any(words)}\s*$"), name)
    found = each.select(
        *key, "start", "end", "raw", "type", F.when(counted, number(0) * sign * scale).cast("double").alias("number"), F.when(ranged, number(1)).cast("double").alias("number_max"),
        unit.alias("unit"), currency.alias("currency"), days.alias("kind"), F.when(F.col("type") == "DATE", _date(F.col("raw"))).alias("date"),
        F.when(F.col("type").isin("ORGANIZATION", "LOCATION"), F.lower(F.regexp_replace(F.btrim("raw", F.lit(" .,")), r"\s+", " "))).alias("entity"),
        said.otherwise("EQUAL").alias("qualifier"),
        F.btrim(F.substring("body", F.greatest(F.col("start") - CONTEXT + 1, F.lit(1)), F.least(F.col("start"), F.lit(CONTEXT)))).alias("left"),
        F.btrim(F.substring("body", F.col("end") + 1, F.lit(CONTEXT))).alias("right"),
    ).where("coalesce(number is not null or date is not null or entity is not null, false)")
    place = F.row_number().over(Window.partitionBy(*key, "type").orderBy("start")) - 1
    return found.withColumn("place", place)


def alignment_score(a: str, b: str) -> Column:
    """FN-11. How well two values of one type belong together; columns a and b are structs of typed_values()."""
    x, y = (lambda n: F.col(f"{a}.{n}")), (lambda n: F.col(f"{b}.{n}"))
    words = lambda *parts: F.array_distinct(X.words(F.concat_ws(" ", *parts)))
    same = lambda n, other: F.when(x(n).eqNullSafe(y(n)), 1.0).otherwise(other)
    w = WEIGHTS
    return (
        w["base"] + w["context"] * X.jaccard(words(x("left"), x("right")), words(y("left"), y("right"))) + w["lead"] * X.jaccard(words(x("left")), words(y("left")))
        + w["unit"] * same("unit", OTHER_UNIT) + w["index"] * same("place", OTHER_INDEX) + w["qualifier"] * same("qualifier", OTHER_QUALIFIER)
    )


def value_changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """CMP-13, JOIN-21, FN-03, FN-08. What became of the values (typed_values() of both versions under `key`).

    Values align by the best alignment score, one with one; those that reach LEAST_ALIGNMENT with nothing are added or removed.
    Returns key, type, change (REPLACED, ADDED, REMOVED), direction, delta, relative, delta_unit, currency_changed, needs_review and both
    values as structs; values that only changed their form are left out. Money in other currencies, days of another kind and
    units that don't convert have no delta; years and months are compared as months, dates by days.
    """
    fields = [c for c in old.columns if c not in key]
    of = F.struct(*key).alias("of")
    a = old.select(of, F.col("type").alias("t"), F.struct(*fields).alias("old"))
    b = new.select(of, F.col("type").alias("t"), F.struct(*fields).alias("new"))
    edges = a.join(b, ["of", "t"]).select("of", F.col("old.start").alias("source"), F.col("new.start").alias("target"), alignment_score("old", "new").alias("score"))
    met = best_first(edges, ["of"], LEAST_ALIGNMENT).select("of", "source", "target")
    left = a.withColumn("source", F.col("old.start")).drop("t").join(met, ["of", "source"], "left")
    rows = left.join(b.withColumn("target", F.col("new.start")).drop("t"), ["of", "target"], "full_outer")
    return _described(rows.select(*[F.col(f"of.{k}").alias(k) for k in key], "old", "new"), key)


def repeats_type(text: Column) -> Column:
    """Whether a text may have two values of one type."""
    types = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(VALUE), F.lit(0)), _kind)
    return F.size(types) > F.size(F.array_distinct(types))


def single_value_changes(rows: DataFrame, key: list[str], old: str, new: str) -> DataFrame:
    """As value_changes() of the typed_values() of two text columns, where no text has two values of one type (not repeats_type()):
    rows are dealt by key once, and the values of a type are neighbours in one sort."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("text")) for s, c in enumerate((old, new))])
    each = rows.repartition(*key).select(*key, F.explode(sides).alias("s")).select(*key, "s.side", "s.text")
    values = typed_values(each, [*key, "side"], "text")
    me = F.struct(*[c for c in values.columns if c not in (*key, "side")]).alias("v")
    own = Window.partitionBy(*key, "type").orderBy("side")
    values = values.select(*key, "type", "side", me).select("*", F.lead("v").over(own).alias("new"), F.lag("v").over(own).alias("before"))
    values = values.where("side = 0 or before is null").select(*key, F.when(F.col("side") == 0, F.col("v")).alias("old"), F.when(F.col("side") == 0, F.col("new")).otherwise(F.col("v")).alias("new"))
    apart = F.col("old").isNotNull() & F.col("new").isNotNull() & ~F.coalesce(alignment_score("old", "new") >= LEAST_ALIGNMENT, F.lit(False))
    pair = lambda a, b: F.struct(a.alias("old"), b.alias("new"))
    none = F.when(F.lit(False), F.col("old"))
    met = F.explode(F.when(apart, F.array(pair(F.col("old"), none), pair(none, F.col("new")))).otherwise(F.array(pair(F.col("old"), F.col("new"))))).alias("m")
    return _described(values.select(*key, met).select(*key, "m.old", "m.new"), key)


def _described(rows: DataFrame, key: list[str]) -> DataFrame:
    x, y = (lambda n: F.col(f"old.{n}")), (lambda n: F.col(f"new.{n}"))
    kind = F.coalesce(x("type"), y("type"))
    number = lambda v: F.when(v("type") != "DURATION", v("number")).when(v("unit") == "YEAR", v("number") * 12).when(v("unit").isin("MONTH", "DAY"), v("number"))
    months = x("unit").isin("YEAR", "MONTH") & y("unit").isin("YEAR", "MONTH")
    other_money = F.coalesce(x("currency") != y("currency"), F.lit(False))
    other_days = F.coalesce(x("kind") != y("kind"), F.lit(False))
    known = number(x).isNotNull() & number(y).isNotNull()
    measured = known & ~other_money & (x("unit").eqNullSafe(y("unit")) | months) & ~other_days
    days = F.datediff(y("date"), x("date")).cast("double")
    delta = F.when(x("type").isNull(), y("number")).when(y("type").isNull(), F.lit(None)).when(kind == "DATE", days).when(measured, number(y) - number(x))
    # Values of equal number and unit are only written in another way, whether or not they convert; a range also has its end.
    equal = F.coalesce(
        F.when(kind.isin("ORGANIZATION", "LOCATION"), x("entity") == y("entity")).when(kind == "DATE", days == 0)
        .otherwise((x("number") == y("number")) & x("unit").eqNullSafe(y("unit")) & x("kind").eqNullSafe(y("kind")) | (measured & (number(x) == number(y)))),
        F.lit(False),
    ) & x("number_max").eqNullSafe(y("number_max"))
    up, down = (F.when(kind == "DATE", n).otherwise(m) for n, m in (("LATER", "INCREASED"), ("EARLIER", "DECREASED")))
    direction = (
        F.when(x("type").isNull(), "ADDED").when(y("type").isNull(), "REMOVED").when(kind.isin("ORGANIZATION", "LOCATION") | other_money | other_days, "REPLACED")
        .when(delta > 0, up).when(delta < 0, down).when(delta == 0, "UNCHANGED").when(known, "UNKNOWN").otherwise("REPLACED")
    )
    unit = F.when(delta.isNull(), F.lit(None)).when(kind == "DATE", "DAY").when(kind == "PERCENTAGE", "PERCENTAGE_POINTS").when(months, "MONTH").otherwise(F.coalesce(x("unit"), y("unit")))
    change = F.when(x("type").isNull(), "ADDED").when(y("type").isNull(), "REMOVED").otherwise("REPLACED")
    relative = F.when((change == "REPLACED") & (kind != "DATE") & (number(x) != 0), F.round(delta * 100 / number(x), 4))
    review = (change == "REPLACED") & kind.isin("MONEY", "DURATION", "QUANTITY", "PERCENTAGE") & ~measured & ~other_money
    return rows.where(~equal).select(
        *key, kind.alias("type"), change.alias("change"), direction.alias("direction"), delta.alias("delta"), relative.alias("relative"), unit.alias("delta_unit"),
        other_money.alias("currency_changed"), review.alias("needs_review"), "old", "new",
    )
