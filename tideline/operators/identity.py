"""From raw postings to postings: identity, cleaned texts, pay in one unit, bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import pay, text, urls
from tideline.operators.gates import detect_internship
from tideline.plans.config import Feed
from tideline.schemas import POSTING


def to_posting(raw: DataFrame) -> DataFrame:
    """Columns of POSTING from raw ones; pay keeps its currency and period, the bucket stays null."""
    types = dict(c.split() for c in POSTING.split(", "))
    have = {c: F.col(c) if c in raw.columns else F.lit(None).cast(t) for c, t in types.items()}
    made = {
        "job_uid": text.content_hash(have["company"], have["title"], have["location"]),
        "title": F.coalesce(text.clean_text(have["title"]), F.trim(have["title"])),
        "company": F.coalesce(text.clean_text(have["company"]), F.trim(have["company"])),
        "url": urls.canonical_url(have["url"]),
        "salary_parsed": have["salary_min"].isNotNull() | have["salary_max"].isNotNull(),
        "salary_bucket": F.lit(None).cast("string"),
    }
    extra = [c for c in raw.columns if c not in types]
    return raw.select(*[made.get(c, have[c]).cast(t).alias(c) for c, t in types.items()], *extra)


def normalise_pay(postings: DataFrame, feed: Feed) -> DataFrame:
    """Pay in the feed's currency a month; the text of what it was goes to salary_raw where that is empty."""
    low, high, currency, period = (F.col(f"salary_{x}") for x in ("min", "max", "currency", "period"))
    there = low.isNotNull() | high.isNotNull()
    done = F.coalesce(F.upper(currency) == feed.pay.currency, F.lit(False)) & F.coalesce(F.lower(period) == "month", F.lit(False))
    rows = postings.withColumn("_pay", pay.convert_bounds(low, high, currency, period, feed.pay.rates))
    parsed = F.col("_pay.parsed")
    raw = F.when(there & ~done, pay.raw_repr(low.cast("double"), high.cast("double"), currency, period))
    return rows.withColumns(
        {
            "salary_raw": F.coalesce("salary_raw", raw),
            "salary_min": F.col("_pay.low"),
            "salary_max": F.col("_pay.high"),
            "salary_parsed": parsed,
            "salary_currency": F.when(parsed, feed.pay.currency).otherwise(currency),
            "salary_period": F.when(parsed, "month").otherwise(period),
        }
    ).drop("_pay")


def enrich(postings: DataFrame, feed: Feed) -> DataFrame:
    """The internship flag first, as the bucket's floor and the gates read it; then pay, then the bucket."""
    rows = normalise_pay(postings.withColumn("is_internship", detect_internship(F.col("title"))), feed)
    remote, intern = F.coalesce("is_remote", F.lit(False)), F.col("is_internship")
    return rows.withColumn("salary_bucket", pay.bucket(F.col("salary_min"), F.col("salary_max"), F.col("salary_parsed"), intern, remote, feed.pay.floors))


def collapse(postings: DataFrame, order: list[str]) -> DataFrame:
    """One row per job_uid: first and last of each column as struct, and how often it came.

    A grouped aggregate with partial sums, so a uid that holds a third of all rows is collapsed before the shuffle.
    """
    key = F.struct(*order)
    row = F.struct(*[c for c in postings.columns if c != "job_uid"])
    return postings.groupBy("job_uid").agg(F.min_by(row, key).alias("first"), F.max_by(row, key).alias("last"), F.count("*").alias("times"))


def first_in(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order; rows whose last key is blank are all kept."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    blank = F.coalesce(F.col(keys[-1]).cast("string"), F.lit("")) == ""
    named = rows.where(~blank).withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return named.unionByName(rows.where(blank))
