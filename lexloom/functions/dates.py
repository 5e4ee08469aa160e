"""Dates and periods (FN-01..03, 28..30, TOP-09)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Precision of a partial date, finest first.
PRECISIONS = ("day", "month", "quarter", "year", "unknown")


def partial_date(text: Column) -> tuple[Column, Column]:
    """FN-01. (precision, first day) of 2024-03-05, 05/03/2024 (day first), 2024-03, 03/2024, Q2 2024 and 2024;
    unknown and null for anything else and for days that don't exist."""
    t = F.btrim(text)
    get = lambda pattern, k: F.regexp_extract(t, pattern, k)
    iso, dmy = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$"
    ym, my, quarter = r"^(\d{4})-(\d{1,2})$", r"^(\d{1,2})/(\d{4})$", r"^[Qq]([1-4])[ /-](\d{4})$"

    def made(year: Column, month: Column, day) -> Column:
        padded = [F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")]
        return F.concat_ws("-", *padded).try_cast("date")

    first = F.lit("1")
    date = (
        F.when(t.rlike(iso), made(get(iso, 1), get(iso, 2), get(iso, 3))).when(t.rlike(dmy), made(get(dmy, 3), get(dmy, 2), get(dmy, 1)))
        .when(t.rlike(ym), made(get(ym, 1), get(ym, 2), first)).when(t.rlike(my), made(get(my, 2), get(my, 1), first))
        .when(t.rlike(quarter), made(get(quarter, 2), (get(quarter, 1).try_cast("int") * 3 - 2).cast("string"), first))
        .when(t.rlike(r"^\d{4}$"), made(t, first, first))
    )
    kind = (
        F.when(t.rlike(iso) | t.rlike(dmy), "day").when(t.rlike(ym) | t.rlike(my), "month").when(t.rlike(quarter), "quarter").when(t.rlike(r"^\d{4}$"), "year")
    )
    return F.when(date.isNotNull(), kind).otherwise("unknown"), date


def timeline_order(text: Column) -> list[Column]:
    """TOP-09. Sort keys: known dates first, by date, coarser periods before finer ones of one day."""
    precision, date = partial_date(text)
    rank = F.when(precision == "year", 0).when(precision == "quarter", 1).when(precision == "month", 2).otherwise(3)
    return [date.asc_nulls_last(), rank.asc(), text.asc()]


def date_change(old: Column, new: Column) -> tuple[Column, Column]:
    """FN-03. (direction, days) between two dates."""
    days = F.datediff(new, old)
    return F.when(days > 0, "LATER").when(days < 0, "EARLIER").when(days == 0, "UNCHANGED"), days


def preset(ts: Column, now: Column, name: str) -> Column:
    """FN-30. Whether a time lies in the last 7 days, this month or the previous month."""
    month = F.date_trunc("month", now)
    if name == "7d":
        return (ts > now - F.expr("interval 7 days")) & (ts <= now)
    if name == "month":
        return (ts >= month) & (ts <= now)
    return (ts >= F.add_months(month, -1).cast("timestamp_ntz")) & (ts < month)
