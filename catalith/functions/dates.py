"""Partial dates: YYYY, YYYY-MM, YYYY-MM-DD, decades and ranges stay text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ONE = r"([0-9]{4})(?:-([0-9]{2})(?:-([0-9]{2}))?)?"


def _edge(c: Column, last: bool) -> Column:
    y = F.regexp_extract(c, f"^{_ONE}", 1).try_cast("int")
    m = F.regexp_extract(c, f"^{_ONE}(?![0-9])", 2).try_cast("int")
    d = F.regexp_extract(c, f"^{_ONE}(?![0-9])", 3).try_cast("int")
    decade = c.rlike("^[0-9]{3}0s$")
    year = F.when(decade & F.lit(last), y + 9).otherwise(y)
    month = F.coalesce(m, F.lit(12 if last else 1))
    first = F.try_make_timestamp(year, month, F.coalesce(d, F.lit(1)), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    return F.when(d.isNull() & F.lit(last), F.last_day(first)).otherwise(first)


def partial_date(c: Column) -> Column:
    """struct(date_from, date_to, precision); nulls and ``other`` where the form is unknown.

    Precisions: day, month, year, decade, range, other. A range goes from the
    start of its first to the end of its last part.
    """
    s = F.trim(c)
    one, decade = s.rlike(f"^{_ONE}$"), s.rlike("^[0-9]{3}0s$")
    spanning = s.rlike("^[0-9]{4}s?-[0-9]{4}s?$")
    left, right = F.substring_index(s, "-", 1), F.substring_index(s, "-", -1)
    precision = (
        F.when(spanning, "range")
        .when(decade, "decade")
        .when(one & (F.length(s) == 10), "day")
        .when(one & (F.length(s) == 7), "month")
        .when(one, "year")
        .when(s.isNotNull(), "other")
    )
    known = one | decade
    return F.struct(
        F.when(spanning, _edge(left, False)).when(known, _edge(s, False)).alias("date_from"),
        F.when(spanning, _edge(right, True)).when(known, _edge(s, True)).alias("date_to"),
        precision.alias("precision"),
    )
