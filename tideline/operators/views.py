"""Filtered, sorted and paged views of a snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE, MOST = 50, 200


def _like(q: str) -> Column:
    """% and _ in the words of a search stay wildcards; only ASCII letters fold, as the store of old did."""
    pattern = f"%{q}%".translate({c: c + 32 for c in range(65, 91)})
    fold = lambda c: F.translate(F.coalesce(F.col(c), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return fold("title").like(pattern) | fold("company").like(pattern)


def feed_condition(
    *, q: str | None = None, source: str | None = None, bucket: str | None = None, remote: bool | None = None, null_remote_is_no: bool = True, applied: bool | None = None,
    bookmarked: bool | None = None, intern: bool | None = None, status: Sequence[str] | str | None = None, include_hidden: bool = False, hide_seen: bool = False,
) -> Column:
    """Whether a posting is in a view. No status: all but deleted; 'all': any; an empty list: none."""
    wanted = F.lit(True)
    if q:
        wanted &= _like(q)
    for name, value in (("source", source), ("salary_bucket", bucket), ("applied", applied), ("bookmarked", bookmarked)):
        if value is not None:
            wanted &= F.col(name) == value
    if intern is not None:
        wanted &= F.coalesce("is_internship", F.lit(False)) == intern
    if remote is not None:
        wanted &= F.coalesce("is_remote", F.lit(False)) == remote if null_remote_is_no else F.col("is_remote") == remote
    if status is None:
        wanted &= F.col("status") != "deleted"
    elif status != "all":
        among = [status] if isinstance(status, str) else list(status)
        wanted &= F.col("status").isin(*among) if among else F.lit(False)
    if not include_hidden:
        wanted &= ~F.coalesce("hidden", F.lit(False))
    if hide_seen:
        wanted &= ~F.coalesce("seen", F.lit(False))
    return wanted


def feed(jobs: DataFrame, **view) -> DataFrame:
    """Postings of a view, by the arguments of ``feed_condition``."""
    return jobs.where(feed_condition(**view))


def totals(jobs: DataFrame, kinds: dict[str, dict]) -> DataFrame:
    """(view, total) of each named view, counted in one pass."""
    counts = jobs.agg(*[F.count_if(feed_condition(**view)).alias(name) for name, view in kinds.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(name).alias("view"), F.col(name).alias("total")) for name in kinds])))


def order_of(sort: str) -> list[Column]:
    """score, date, salary, company or title; anything else is score. job_uid breaks ties."""
    score, posted = F.col("match_score").desc_nulls_last(), F.col("posted_at").desc_nulls_last()
    order = {
        "date": [posted, score], "salary": [F.col("salary_min").desc_nulls_last(), score], "company": [F.lower("company"), F.lower("title")], "title": [F.lower("title")],
    }.get(sort, [score, posted])
    return [*order, F.col("job_uid")]


def page(rows: DataFrame, sort: str = "score", limit: int = PAGE, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order_of(sort)).offset(max(0, offset)).limit(min(max(1, limit), MOST))


def total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"))


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def new_in_cycle(jobs: DataFrame, cycle: int) -> DataFrame:
    """New in this cycle; a row that stayed new from an earlier one is not told again."""
    return jobs.where((F.col("status") == "new") & (F.col("last_seen_cycle") == cycle)).orderBy(F.col("match_score").desc_nulls_last(), "job_uid")


def recent_active(jobs: DataFrame, most: int) -> DataFrame:
    rows = jobs.where(F.col("status").isin("new", "active") & ~F.coalesce("hidden", F.lit(False)))
    return rows.orderBy(F.col("posted_at").desc_nulls_last(), F.col("last_seen_at").desc_nulls_last(), "job_uid").limit(most)
