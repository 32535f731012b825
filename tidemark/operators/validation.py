"""Checks of what is asked, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators.reports import SHAPES

MONTH = "^(0[1-9]|1[0-2])$"


def wrong(query: Column, year: Column, month_start: Column, month_end: Column, shape: Column | None = None, hops: Column | None = None) -> Column:
    """The first input that is wrong, null where none is: query, year, month_start, month_end, filter, report_shape or hops.

    A query must not be blank, a year be from 2006 to 9999, months 01 to 12; an
    end needs a start not after it, and a start needs a year.
    """
    blank = F.coalesce(F.regexp_replace(query, r"(?U)\s", ""), F.lit("")) == ""
    bad = F.when(blank, "query").when(year.isNotNull() & ~year.between(2006, 9999), "year")
    bad = bad.when(month_start.isNotNull() & ~month_start.rlike(MONTH), "month_start").when(month_end.isNotNull() & ~month_end.rlike(MONTH), "month_end")
    bad = bad.when((month_end.isNotNull() & month_start.isNull()) | (month_start.isNotNull() & year.isNull()) | F.coalesce(month_end < month_start, F.lit(False)), "filter")
    if shape is not None:
        bad = bad.when(~F.coalesce(shape.isin(list(SHAPES)), F.lit(False)), "report_shape")
    if hops is not None:
        bad = bad.when(~F.coalesce(hops.between(1, 2), F.lit(False)), "hops")
    return bad
