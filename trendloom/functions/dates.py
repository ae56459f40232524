"""Dates, months and ages. The current time is always an argument."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V

ISO_DAY = r"^\d{4}-\d{2}-\d{2}"
DATE_FORMATS = ("M/d/yyyy", "MMM d, yyyy", "d MMM yyyy")


def instant(as_of: datetime | str) -> Column:
    """A timestamp literal in UTC from a datetime or ISO text."""
    if isinstance(as_of, str):
        as_of = datetime.fromisoformat(as_of.replace("Z", "+00:00"))
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=timezone.utc)
    return F.lit(as_of)


def days_before(as_of: Column, days: int) -> Column:
    """Whole 24-hour days earlier."""
    return as_of - F.make_dt_interval(F.lit(days))


def month_start(month: str, shift: int = 0) -> datetime:
    """First instant (UTC) of a YYYY-MM month, moved by a number of months."""
    year, number = (int(x) for x in month.split("-"))
    index = year * 12 + number - 1 + shift
    return datetime(index // 12, index % 12 + 1, 1, tzinfo=timezone.utc)


def in_month(ts: Column, month: str, shift: int = 0) -> Column:
    """Half-open month range with literal bounds, so that it reaches the scan."""
    return (ts >= F.lit(month_start(month, shift))) & (ts < F.lit(month_start(month, shift + 1)))


def parse_date(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """ISO text first, then the listed formats; NULL when none fits."""
    iso = F.when(text.rlike(ISO_DAY), text.try_cast("timestamp"))
    # A failed format is slow, so only texts with a digit are tried.
    return F.when(text.rlike(r"\d"), F.coalesce(iso, *[F.try_to_timestamp(text, F.lit(f)) for f in formats]))


def created_at(text: Column, as_of: Column) -> Column:
    return F.coalesce(parse_date(text), as_of)


def coerce_to_month(text: Column, month: str) -> Column:
    """Keep an ISO date whose own wall clock lies in the month, else take the first of the month."""
    stripped = F.btrim(text, F.lit(V.WHITESPACE))
    parsed = F.when(stripped.rlike(ISO_DAY), stripped.try_cast("timestamp"))
    keep = parsed.isNotNull() & (F.substring(stripped, 1, 7) == month)
    return F.when(keep, stripped).otherwise(F.lit(f"{month}-01T00:00:00+00:00"))


def age_text(ts: Column, as_of: Column) -> Column:
    seconds = F.unix_micros(as_of) / 1e6 - F.unix_micros(ts) / 1e6
    minutes, hours, days = (F.floor(seconds / n) for n in (60, 3600, 86400))
    return (
        F.when(minutes < 1, "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.concat(days.cast("string"), F.lit("d ago")))
    )
