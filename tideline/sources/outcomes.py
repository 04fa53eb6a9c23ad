"""Outcomes of walks, sources and companies, from logs of landed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def walk_completeness(pages: DataFrame, page_size: int, most_pages: int) -> DataFrame:
    """Per (source, walk): how many pages and items count, whether it failed, and whether it came to an end.

    ``pages`` is (source, walk, page, n_items, ok), pages from 1. A walk stops at the first page that failed, is empty
    or short, or at the cap; a failed first page fails it, a later one keeps the pages before. Grouped with partial
    aggregates: no list of pages is gathered.
    """
    within = F.col("page") <= most_pages
    bad = F.min(F.when(within & ~F.col("ok"), F.col("page"))).alias("bad")
    short = F.min(F.when(within & F.col("ok") & (F.col("n_items") < page_size), F.col("page"))).alias("short")
    ends = pages.groupBy("source", "walk").agg(bad, short)
    stop = F.least(F.coalesce(F.col("bad") - 1, F.lit(most_pages)), F.coalesce("short", F.lit(most_pages)))
    used = pages.join(ends.select(F.col("source").alias("_s"), F.col("walk").alias("_w"), "bad", "short", stop.alias("stop")), F.col("source").eqNullSafe(F.col("_s")) & F.col("walk").eqNullSafe(F.col("_w")))
    counted = F.col("page") <= F.col("stop")
    rows = used.groupBy("source", "walk", "bad", "short").agg(F.count_if(counted).alias("n_pages"), F.coalesce(F.sum(F.when(counted, F.col("n_items"))), F.lit(0)).alias("n_items"))
    ended = F.coalesce(F.col("short") < F.coalesce("bad", F.lit(most_pages + 1)), F.lit(False))
    return rows.select("source", "walk", "n_pages", "n_items", F.coalesce(F.col("bad") == 1, F.lit(False)).alias("failed"), ended.alias("exhausted"))


def source_outcomes(sources: DataFrame, raw: DataFrame, mapped: DataFrame) -> DataFrame:
    """(source, succeeded, n_fetched): no raw item at all is a failure, items that the mapper all dropped are not."""
    got = raw.groupBy("source").agg(F.count("*").alias("n_raw"))
    kept = mapped.groupBy("source").agg(F.count("*").alias("n_fetched"))
    rows = sources.select("source").distinct().join(got, "source", "left").join(kept, "source", "left")
    return rows.select("source", (F.coalesce("n_raw", F.lit(0)) > 0).alias("succeeded"), F.coalesce("n_fetched", F.lit(0)).alias("n_fetched"))


def company_outcomes(fetches: DataFrame) -> DataFrame:
    """Outcomes named source_company from (source, company, succeeded, n_fetched, error).

    Where all companies of a source failed, one row under the source's own name takes their place, with their errors.
    """
    per = fetches.groupBy("source", "company").agg(F.min("succeeded").alias("succeeded"), F.sum("n_fetched").alias("n_fetched"), F.max("error").alias("error"))
    failures = F.when(~F.col("succeeded"), F.struct("company", F.coalesce("error", F.lit("unknown error")).alias("error")))
    whole = per.groupBy("source").agg(F.max("succeeded").alias("any_ok"), F.array_sort(F.collect_list(failures)).alias("failed"))
    text = F.array_join(F.transform("failed", lambda f: F.concat(f["company"], F.lit(": "), f["error"])), "; ")
    whole = whole.withColumn("all_errors", F.nullif(text, F.lit("")))
    single = per.join(whole.where("any_ok").select("source", "all_errors"), "source")
    single = single.select(F.concat_ws("_", "source", "company").alias("source"), "succeeded", "n_fetched", F.when(~F.col("succeeded"), F.col("all_errors")).alias("error"))
    return single.unionByName(whole.where("not any_ok").select("source", F.lit(False).alias("succeeded"), F.lit(0).cast("long").alias("n_fetched"), F.col("all_errors").alias("error")))


def site_stats(calls: DataFrame) -> DataFrame:
    """Per site of (site, ord, n_rows, n_jobs, error): calls, errors, rows, jobs, the last error, and success by jobs."""
    return calls.groupBy("site").agg(
        F.count("*").alias("calls"),
        F.count("error").alias("errors"),
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_jobs").alias("n_jobs"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.col("ord"))).alias("last_error"),
        (F.sum("n_jobs") > 0).alias("succeeded"),
    )
