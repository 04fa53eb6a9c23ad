"""Dates from text, epochs and labels; all results are UTC timestamps, null where a value says nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MILLIS_FROM = 100_000_000_000  #: epochs of this size and more are milliseconds
LAST_SECOND = 253_402_300_799  #: of the year 9999
ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"


def epoch_seconds(value: Column) -> Column:
    """Seconds since 1970, whole or not, as a number or its text."""
    v = value.try_cast("double")
    return F.when((v >= -62_135_596_800) & (v <= LAST_SECOND), F.timestamp_micros((v * 1_000_000).cast("long")))


def epoch_millis(value: Column) -> Column:
    return epoch_seconds(value.try_cast("double") / 1000)


def epoch_auto(value: Column) -> Column:
    """Seconds, or milliseconds from a size that seconds do not have."""
    v = value.try_cast("double")
    return F.when(F.abs(v) >= MILLIS_FROM, epoch_millis(v)).otherwise(epoch_seconds(v))


def iso(text: Column) -> Column:
    """ISO 8601, extended or the basic date; without an offset it is UTC. Spark's own cast takes more, so a pattern guards it."""
    t = F.trim(text)
    basic = F.when(t.rlike(r"^\d{8}$"), F.try_to_timestamp(t, F.lit("yyyyMMdd")))
    return F.coalesce(F.when(t.rlike(ISO), F.replace(t, F.lit(","), F.lit(".")).try_cast("timestamp")), basic)


def parse_date(text: Column) -> Column:
    """A digit string is an epoch of either unit, else ISO 8601."""
    t = F.trim(text)
    return F.when(t.rlike(r"^-?\d+$"), epoch_auto(t)).otherwise(iso(t))


def posted_ago(text: Column, as_of: Column) -> Column:
    """``3 days ago`` and the like before ``as_of``; a month has 30 days, hours and minutes count as now."""
    t = F.lower(F.trim(text))
    n = F.regexp_extract(t, r"(\d+)\s*(minute|hour|day|week|month)s?\s+ago", 1)
    unit = F.regexp_extract(t, r"(\d+)\s*(minute|hour|day|week|month)s?\s+ago", 2)
    days = n.try_cast("int") * F.when(unit == "day", 1).when(unit == "week", 7).when(unit == "month", 30).otherwise(0)
    today = t.isin("today", "just now") | (t.contains("hour") & t.contains("ago") & ~t.rlike(r"^\d"))
    return F.when(today, as_of).when(n != "", as_of - F.make_dt_interval(days))
