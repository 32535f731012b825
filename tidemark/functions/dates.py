"""Dates of posts, months and recency."""

from __future__ import annotations

from calendar import monthrange
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def post_time(created_at: Column) -> Column:
    """The time of an export date such as ``Sun Nov 09 11:05:17 +0000 2025``; null for anything else.

    Spark's parser takes no weekday, so it is checked and cut off first.
    """
    ok = created_at.rlike(r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun) [A-Z][a-z]{2} [0-9]{1,2} [0-9]{2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4} [0-9]{4}$")
    return F.try_to_timestamp(F.when(ok, F.substring(created_at, 5, 40)), F.lit("MMM d HH:mm:ss Z yyyy"))


def month_key(created_at: Column) -> Column:
    """yyyy-MM of a post in its own offset; null where the date can't be read."""
    wall = F.regexp_replace(F.substring(created_at, 5, 40), "[+-][0-9]{4} ", "+0000 ")
    return F.when(post_time(created_at).isNotNull(), F.date_format(F.try_to_timestamp(wall, F.lit("MMM d HH:mm:ss Z yyyy")), "yyyy-MM"))


def month_number(key: Column) -> Column:
    """The number of a month yyyy-MM, counted from the year 0: months of a span are a range of numbers."""
    return F.substring(key, 1, 4).cast("int") * 12 + F.substring(key, 6, 2).cast("int") - 1


def span_of(year, month_start=None, month_end=None) -> tuple[int, int] | None:
    """The first and last month number a filter means, None for no filter.  ValueError for a filter that makes no sense."""
    given = [x is not None for x in (year, month_start, month_end)]
    if not any(given):
        return None
    if given not in ([True, False, False], [True, True, False], [True, True, True]):
        raise ValueError("a month needs a year, and a last month a first one")
    ends = ("01", "12") if month_start is None else (month_start, month_start if month_end is None else month_end)
    if not all(str(m).isdigit() and 1 <= int(m) <= 12 for m in ends) or int(ends[0]) > int(ends[1]):
        raise ValueError("months are numbers from 01 to 12, the first not after the last")
    return tuple(int(year) * 12 + int(m) - 1 for m in ends)


def months_of(year: int | None, month_start: str | None = None, month_end: str | None = None) -> list[str] | None:
    """The months a filter means, or None for no filter.  ValueError for a filter that makes no sense."""
    span = span_of(year, month_start, month_end)
    return span and [f"{n // 12}-{n % 12 + 1:02d}" for n in range(span[0], span[1] + 1)]


def anchor(year: int | None, month_start: str | None = None, month_end: str | None = None, now: datetime | None = None) -> datetime:
    """The moment recency is measured from: the end of the filtered span, else now."""
    if year is None:
        return now or datetime.now(UTC)
    month = int(month_end or month_start or 12)
    end = datetime(year, month, monthrange(year, month)[1], 23, 59, 59, tzinfo=UTC)
    return end if month == 12 else end + timedelta(microseconds=999_999)


def recency(created_at: Column, at: Column, scale_days: float) -> Column:
    """exp(-days before at / scale_days); posts after at count as at it; 0 where the date can't be read."""
    days = (F.unix_micros(at) - F.unix_micros(post_time(created_at))) / F.lit(86_400_000_000.0)
    # greatest skips nulls, so the unreadable date is asked for first
    return F.when(days.isNull(), 0.0).otherwise(F.exp(-F.greatest(F.lit(0.0), days) / F.lit(float(scale_days))))
