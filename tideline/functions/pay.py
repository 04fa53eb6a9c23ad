"""Pay: loose numbers, conversion to one currency and month, and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A pay period's share of a month; 52 weeks, 260 days and 2080 hours make a year.
MONTHS = {"month": 1.0, "year": 1 / 12, "week": 52 / 12, "day": 260 / 12, "hour": 2080 / 12}
#: Each board's words for a period and for a currency.
PERIOD_WORDS = {
    "board": {"annual": "year", "yearly": "year", "monthly": "month", "hourly": "hour", "weekly": "week"},
    "lever": {"per-year-salary": "year", "per-month-salary": "month", "per-week-salary": "week", "per-hour-salary": "hour"},
    "unstop": {"month": "month", "year": "year", "week": "week", "hour": "hour"},
    "scrape": {"yearly": "year", "annual": "year", "monthly": "month", "hourly": "hour"},
}
CURRENCY_ICONS = {"fa-rupee": "INR", "fa-inr": "INR", "fa-dollar": "USD", "fa-usd": "USD"}
COUNTRY_CURRENCIES = {"in": "INR", "gb": "GBP", "us": "USD", "au": "AUD", "ca": "CAD", "de": "EUR"}
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes"), ("false", "0", "no")


def looked_up(words: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return table[F.lower(F.coalesce(key, F.lit("")))]


def positive_int(value: Column) -> Column:
    """Whole part of a number or a digit string, where it is above zero."""
    v = F.floor(F.when(F.trim(value.cast("string")).rlike(r"^[+-]?[0-9.]+(?:[eE][+-]?\d+)?$"), value.try_cast("double")))
    return F.when((v > 0) & (v < 9.2e18), v.cast("long"))


def clean_float(value: Column) -> Column:
    v = F.trim(value.cast("string")).try_cast("double")
    return F.when(~F.isnan(v), v)


def clean_string(value: Column) -> Column:
    """Trimmed; blank and NaN are null."""
    return F.nullif(F.trim(value), F.lit(""))


def clean_bool(value: Column) -> Column:
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin(*TRUE_WORDS), True).when(v.isin(*FALSE_WORDS), False)


def rates_of(rates: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for c, r in {**rates, "INR": 1.0}.items() for x in (c, float(r))])


def to_month(amount: Column, currency: Column, period: Column, rates: dict[str, float]) -> Column:
    """The amount in INR a month, halves to even; an unknown period is a month, an unknown currency gives null."""
    share = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.rint(amount.cast("double") * rates_of(rates)[F.upper(currency)] * F.coalesce(share[F.lower(period)], F.lit(1.0))).cast("long")


def convert_bounds(low: Column, high: Column, currency: Column, period: Column, rates: dict[str, float]) -> Column:
    """struct(low, high, parsed); bounds pass unchanged where currency or period is missing, or the currency unknown."""
    known = F.coalesce(period.isNotNull() & rates_of(rates)[F.upper(currency)].isNotNull(), F.lit(False))
    a, b = to_month(low, currency, period, rates), to_month(high, currency, period, rates)
    return F.struct(
        F.when(known, a).otherwise(low).alias("low"), F.when(known, b).otherwise(high).alias("high"), (known & F.coalesce(a, b).isNotNull()).alias("parsed")
    )


def representative(low: Column, high: Column) -> Column:
    return F.coalesce(high, low)


def bucket(low: Column, high: Column, parsed: Column, internship: Column, remote: Column, floors: dict[str, int]) -> Column:
    """pass, fail or unknown against the floor for internships, remote or office work."""
    floor = F.when(internship, floors["internship"]).when(remote, floors["remote"]).otherwise(floors["in_office"])
    shown = representative(low, high)
    return F.when(~F.coalesce(parsed, F.lit(False)) | shown.isNull(), "unknown").when(shown >= floor, "pass").otherwise("fail")


def raw_repr(low: Column, high: Column, currency: Column, interval: Column) -> Column:
    """``USD 60000-90000/yearly``; null without a bound."""
    text = lambda v: F.rint(v).cast("long").cast("string")
    amount = F.when(low.isNotNull() & high.isNotNull(), F.concat(text(low), F.lit("-"), text(high))).otherwise(F.coalesce(text(low), text(high)))
    part = lambda c, before, after: F.coalesce(F.concat(F.lit(before), F.nullif(c, F.lit("")), F.lit(after)), F.lit(""))
    return F.concat(part(currency, "", " "), amount, part(interval, "/", ""))


def stipend(text: Column) -> Column:
    """struct(low, high) of ``₹ 15,000 - 30,000 /month``; one amount is both bounds."""
    pattern = r"₹\s*([\d,]+)(?:\s*-\s*([\d,]+))?\s*/month"
    at = lambda k: F.replace(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, k), F.lit(",")).try_cast("long")
    return F.struct(at(1).alias("low"), F.coalesce(at(2), at(1)).alias("high"))


def interval_period(interval: Column) -> Column:
    """The first of year, month, week, day and hour that the text holds."""
    v = F.lower(F.coalesce(interval, F.lit("")))
    return F.coalesce(*[F.when(v.contains(u), u) for u in ("year", "month", "week", "day", "hour")])
