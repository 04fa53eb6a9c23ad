"""Digests, run summaries and feeds as text.

What is gathered into one row is bounded: 20 lines of a chat digest, ``most`` entries of a feed, the postings of one mail, of which
there are as many as it takes. Numbers of lines come from sorted ranges of rows and how many rows stand before each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.shared import stored
from tideline.functions.text import cut_text, escape_html
from tideline.functions.urls import is_private_host
from tideline.operators.views import order_of

MESSAGE_CHARS, DIGEST_ITEMS, FAILED_NAMES, MAIL_ITEMS = 4096, 20, 6, 100
STATUS_ICONS = {"success": "🟢", "partial": "🟠", "failed": "🔴"}


def place(remote: Column, location: Column) -> Column:
    return F.when(F.coalesce(remote, F.lit(False)), "Remote").otherwise(F.coalesce(location, F.lit("")))


def pay_text(low: Column, high: Column, parsed: Column, currency: Column, period: Column) -> Column:
    """``INR 30,000-45,000/month``; '' for unparsed pay or none."""
    text = lambda v: F.format_number(v, 0)
    amount = F.when(low.isNotNull() & high.isNotNull() & (low != high), F.concat(text(low), F.lit("-"), text(high))).otherwise(text(F.coalesce(high, low)))
    filled = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    whole = F.concat(filled(currency, "INR"), F.lit(" "), amount, F.lit("/"), filled(period, "month"))
    return F.when(F.coalesce(parsed, F.lit(False)) & F.coalesce(low, high).isNotNull(), whole).otherwise("")


def meta() -> Column:
    """Place, pay and source, with dots between; empty ones are left out."""
    pay = pay_text(*[F.col(f"salary_{c}") for c in ("min", "max", "parsed", "currency", "period")])
    return F.concat_ws(" · ", *[F.nullif(c, F.lit("")) for c in (place(F.col("is_remote"), F.col("location")), pay, F.col("source"))])


def _headline(n: Column) -> Column:
    return F.concat(n.cast("string"), F.lit(" new job"), F.when(n == 1, "").otherwise("s"))


def numbered(jobs: DataFrame) -> DataFrame:
    """All postings by score, numbered from 1 as ``n``, with how many there are as ``total``.

    Rows are sorted in ranges, which are written once with each row's range and place in it, as ranges come out otherwise when
    they are made again; a row's number is its place and the rows of the ranges before. No task sees all rows.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranges = jobs.repartitionByRange(*order_of("score")).sortWithinPartitions(*order_of("score"))
    rows = stored(ranges.select("*", F.spark_partition_id().alias("_range"), place.alias("_place")), "numbered")
    before, total = {}, 0
    for r in rows.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():  # one row a range
        before[r["_range"]], total = total, total + r.n
    start = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("_range")] if before else F.lit(0)
    return rows.withColumn("n", (start + F.col("_place") + 1).cast("long")).withColumn("total", F.lit(total).cast("long")).drop("_range", "_place")


def _numbered(jobs: DataFrame) -> DataFrame:
    return jobs if {"n", "total"} <= set(jobs.columns) else numbered(jobs)


def _joined(line: Column, sep: str) -> Column:
    items = F.array_sort(F.collect_list(F.struct("n", line.alias("line"))))
    return F.array_join(F.transform(items, lambda x: x["line"]), sep)


def chat_digest(jobs: DataFrame, most: int = DIGEST_ITEMS) -> DataFrame:
    """One row: text, with linked titles, at most ``most`` items and 4096 characters."""
    head = F.concat(F.col("n").cast("string"), F.lit('. <a href="'), escape_html(F.col("url"), True), F.lit('">'), escape_html(F.col("title")), F.lit("</a> — "), escape_html(F.col("company")))
    line = F.concat_ws("\n", head, F.concat(F.lit("   "), F.nullif(escape_html(meta()), F.lit(""))))
    total = F.col("total")
    rows = _numbered(jobs).where(F.col("n") <= most).agg(_joined(line, "\n").alias("lines"), F.coalesce(F.max("total"), F.lit(0)).alias("total"))
    more = F.when(total > most, F.concat(F.lit("\n\n…and "), (total - most).cast("string"), F.lit(" more."))).otherwise("")
    text = F.concat(F.lit("<b>"), _headline(total), F.lit("</b>\n"), F.when(F.col("lines") != "", F.concat(F.lit("\n"), "lines")).otherwise(""), more)
    return rows.select(cut_text(text, MESSAGE_CHARS).alias("text"))


def mail_digest(jobs: DataFrame, prefix: str = "[feed]", per_mail: int = MAIL_ITEMS) -> DataFrame:
    """Mails of ``per_mail`` postings, by score and numbered through: mail, subject, body. Every posting is in one; none, no mail."""
    line = F.concat_ws("\n", F.concat(F.col("n").cast("string"), F.lit(". "), "title", F.lit(" — "), "company"), F.concat(F.lit("   "), F.nullif(meta(), F.lit(""))), F.concat(F.lit("   "), "url"))
    mail = (F.floor((F.col("n") - 1) / per_mail) + 1).cast("long").alias("mail")
    rows = _numbered(jobs).groupBy(mail).agg(_joined(line, "\n\n").alias("lines"), F.max("total").alias("total"))
    of = F.ceil(F.col("total") / per_mail).cast("string")
    which = F.when(F.col("total") > per_mail, F.concat(F.lit(" ("), F.col("mail").cast("string"), F.lit("/"), of, F.lit(")"))).otherwise("")
    return rows.select("mail", F.concat(F.lit(f"{prefix} "), _headline(F.col("total")), which).alias("subject"), F.concat(F.regexp_replace("lines", r"\s+$", ""), F.lit("\n")).alias("body"))


def run_summary(runs: DataFrame, dashboard: Column) -> DataFrame:
    """(run_id, text) from runs with counters and failed (array of names); a local address is plain text."""
    icons = F.create_map(*[F.lit(x) for pair in STATUS_ICONS.items() for x in pair])
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    names = F.array_join(F.transform(F.slice("failed", 1, FAILED_NAMES), lambda n: escape_html(n)), ", ")
    extra = F.when(F.size("failed") > FAILED_NAMES, F.concat(F.lit(" +"), (F.size("failed") - FAILED_NAMES).cast("string"), F.lit(" more"))).otherwise("")
    link = F.when(is_private_host(dashboard), F.concat(F.lit("Dashboard: "), escape_html(dashboard))).otherwise(F.concat(F.lit('<a href="'), escape_html(dashboard, True), F.lit('">Open dashboard →</a>')))
    text = F.concat_ws(
        "\n",
        F.concat(F.coalesce(icons[F.col("status")], F.lit("⚪")), F.lit(" <b>Run #"), F.col("run_id").cast("string"), F.lit("</b> ["), escape_html(F.col("status")), F.lit("] · "), escape_html(F.col("trigger"))),
        F.concat(F.lit("new "), number("n_new"), F.lit(" · updated "), number("n_updated"), F.lit(" · expired "), number("n_expired"), F.lit(" · filtered "), number("n_filtered")),
        F.concat(F.lit("sources ok "), number("n_sources_ok"), F.lit(" / err "), number("n_sources_err")),
        F.when(F.size("failed") > 0, F.concat(F.lit("failed: "), names, extra)),
        link,
    )
    return runs.select("run_id", cut_text(text, MESSAGE_CHARS).alias("text"))


def rfc3339(ts: Column) -> Column:
    """UTC with +00:00, and microseconds only where there are any."""
    part = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(part != "000000", F.concat(F.lit("."), part)).otherwise(""), F.lit("+00:00"))


def feed_entries(jobs: DataFrame, as_of: Column) -> DataFrame:
    """(job_uid, posted_at, entry): one Atom entry per posting."""
    x = lambda c: escape_html(c, True)
    category = lambda c: F.concat(F.lit('    <category term="'), x(c), F.lit('"/>'))
    entry = F.concat_ws(
        "\n",
        F.lit("  <entry>"),
        F.concat(F.lit("    <id>urn:jobuid:"), x(F.col("job_uid")), F.lit("</id>")),
        F.concat(F.lit("    <title>"), x(F.concat("title", F.lit(" — "), "company")), F.lit("</title>")),
        F.concat(F.lit("    <updated>"), rfc3339(F.coalesce("posted_at", as_of)), F.lit("</updated>")),
        F.concat(F.lit("    <published>"), rfc3339(F.col("posted_at")), F.lit("</published>")),
        F.concat(F.lit('    <link rel="alternate" href="'), x(F.col("url")), F.lit('"/>')),
        category(F.col("source")),
        F.when(F.coalesce("is_remote", F.lit(False)), category(F.lit("remote"))),
        category(F.concat(F.lit("salary:"), "salary_bucket")),
        F.concat(F.lit("    <summary>"), x(meta()), F.lit("</summary>")),
        F.lit("  </entry>"),
    )
    return jobs.select("job_uid", "posted_at", entry.alias("entry"))


def atom_feed(jobs: DataFrame, as_of: Column, title: str, feed_id: str, site: str, most: int = 100) -> DataFrame:
    """One row: the feed of the ``most`` latest postings; without any it is a valid, empty feed."""
    latest = jobs.orderBy(F.col("posted_at").desc_nulls_last(), F.col("last_seen_at").desc_nulls_last(), "job_uid").limit(most)
    rows = feed_entries(latest, as_of).withColumn("n", F.row_number().over(W.orderBy(F.col("posted_at").desc_nulls_last(), "job_uid")))
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?>\n<feed xmlns="http://www.w3.org/2005/Atom">\n'), F.lit(f"  <id>{feed_id}</id>\n  <title>{title}</title>\n  <updated>"), rfc3339(as_of),
        F.lit(f'</updated>\n  <author><name>{title}</name></author>\n  <link rel="alternate" href="{site}"/>\n'),
    )
    return rows.agg(_joined(F.col("entry"), "\n").alias("lines")).select(F.concat(head, "lines", F.when(F.col("lines") != "", "\n").otherwise(""), F.lit("</feed>")).alias("xml"))


Text = Callable[[DataFrame], DataFrame]
#: name -> (scope, DataFrame of postings -> DataFrame of text)
SINKS: dict[str, tuple[str, Text]] = {"chat": ("new_only", chat_digest), "mail": ("new_only", mail_digest)}


def register_sink(name: str, scope: str, text: Text) -> None:
    if scope not in ("new_only", "recent_active"):
        raise ValueError(f"scope: {scope}")
    SINKS[name] = (scope, text)


def register_feed(as_of: Column, title: str, feed_id: str, site: str, most: int = 100) -> None:
    """The Atom feed as a sink named ``feed``, over recent and active postings, dated ``as_of``."""
    register_sink("feed", "recent_active", lambda jobs: atom_feed(jobs, as_of, title, feed_id, site, most))


def publish(new: DataFrame, recent: DataFrame, enabled: list[str]) -> dict[str, DataFrame]:
    """Each enabled sink's text, from the postings of its scope. The new ones are numbered once for all sinks of theirs."""
    if any(SINKS[name][0] == "new_only" for name in enabled):
        new = numbered(new)
    return {name: SINKS[name][1](new if SINKS[name][0] == "new_only" else recent) for name in enabled}


def write_text(text: DataFrame, path: str) -> None:
    """Replace the text at ``path``: Spark's committer moves the finished files there."""
    text.coalesce(1).write.mode("overwrite").text(path)
