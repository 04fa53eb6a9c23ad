"""The given tables as postings, runs and events of a feed: the views that the registered queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.shared import scratch, stored
from tideline.plans.config import Feed, Keywords

START = "2024-01-01 00:00:00"
AS_OF = "2024-02-01 00:00:00"
TITLES = ["Backend Engineer Intern", "Senior Backend Engineer", "Data Engineer", "Software Engineer - Trainee", "Product Manager", "Junior Data Engineer / Backend Engineer", "Écrivain Technique", "Software Engineer"]
SUFFIXES = [" Technologies Pvt. Ltd.", " Labs", " Café", " Inc", ""]
CURRENCIES = ["INR", "usd", "EUR", "GBP", "XYZ"]
PERIODS = ["month", "year", "week", "day", "hour", None]
FEED = Feed(
    keywords=Keywords(
        roles=("backend engineer", "data engineer", "software engineer"), bonus=("the", "der", "que", "und", "les", "of"), must_have=("and", "de", "die", "that"),
        level_required=("intern", "junior", "engineer"), exclude=("senior", "manager"), require_level=True, max_experience_years=2,
    ),
    locations=("Bengaluru", "Remote"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CYCLES, CYCLE_DAYS = 5, 6  #: streamed cycles; the last one takes all days that are left


def cycle_days(cycle: int) -> tuple[int, int]:
    low = 1 + CYCLE_DAYS * cycle
    return (low if cycle else -(1 << 30)), (low + CYCLE_DAYS if cycle + 1 < CYCLES else 1 << 30)


def _pick(values: list, index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw postings, one per document: a supplier as company, its nation or a city as location, pay from the length.

    A document whose number is null, or meets no supplier's key, is a posting of the company Independent, of no nation.
    """
    docs, supplier, nation = (table(spark, sf_dir, t) for t in ("documents", "supplier", "nation"))
    d = F.col("doc_id")
    firms = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")
    n = F.greatest(supplier.agg(F.count("*")).scalar(), F.lit(1))
    rows = docs.join(firms, F.pmod(d, n) == F.col("s_suppkey"), "left")
    tenth = F.floor(d / 10).cast("long")
    return rows.select(
        d.alias("pos"),
        "source",
        d.cast("string").alias("source_native_id"),
        _pick(TITLES, tenth).alias("title"),
        F.concat(F.coalesce("s_name", F.lit("Independent")), F.coalesce(_pick(SUFFIXES, d), F.lit(""))).alias("company"),
        F.when(d % 6 == 0, "Bangalore").when(d % 6 == 1, "Remote, WFH").when(d % 6 == 2, F.lit(None)).otherwise(F.col("n_name")).alias("location"),
        F.when(d % 3 == 0, True).when(d % 3 == 1, False).alias("is_remote"),
        F.concat(F.lit("https://Jobs.Example.com/p/"), d.cast("string"), F.lit("/?utm_source=x&ref=1&b=2&a=1#top")).alias("url"),
        F.concat(F.when(d % 9 == 0, "Needs 3+ years of experience. ").when(d % 9 == 1, "2 years experience; ").otherwise(""), F.coalesce("text", F.lit(""))).alias("description"),
        F.when(d % 7 != 0, F.col("n_chars") * 13 + 500).alias("salary_min"),
        F.when(d % 11 != 0, F.col("n_chars") * 17 + 900).alias("salary_max"),
        _pick(CURRENCIES, d).alias("salary_currency"),
        _pick(PERIODS, d).alias("salary_period"),
        F.when(d % 13 != 0, F.lit(START).cast("timestamp") + F.make_dt_interval(F.lit(0), (d % 1000).cast("int"))).alias("posted_at"),
    )


def source_order() -> F.Column:
    """The number in a source's name is its place in the input order."""
    return F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).try_cast("int"), F.lit(1 << 30))


def _at(day: int) -> F.Column:
    return F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp")


def _ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.operators.gates import judge
    from tideline.operators.identity import enrich, to_posting

    return judge(enrich(to_posting(postings(spark, sf_dir)), FEED), FEED).where("keep").withColumn("ord", source_order())


def _first_cycle(ready: DataFrame) -> DataFrame:
    from tideline.operators.snapshot import merge_cycle
    from tideline.schemas import SNAPSHOT

    return merge_cycle(ready.sparkSession.createDataFrame([], SNAPSHOT), ready.where("pos % 4 < 2"), 1, _at(1), ["ord", "pos"])


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot: the postings in two cycles, by documents modulo 4, judged and merged.

    On the given tables the cycles share no uid, as a uid fixes its document's number modulo 4: the second merge adds only.
    """
    from tideline.operators.snapshot import merge_cycle

    ready = _ready(spark, sf_dir)
    return merge_cycle(_first_cycle(ready), ready.where("pos % 4 > 1"), 2, _at(2), ["ord", "pos"])


def relisted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot of ``jobs`` of a feed that lists half of the first cycle's uids in the second one again, before its own postings.

    So the second merge meets rows that it knows, and keeps one of each; only their status and last sight are not as in ``jobs``.
    """
    from tideline.operators.snapshot import merge_cycle

    ready = _ready(spark, sf_dir)
    own, again = F.expr("pos % 4 > 1"), F.expr("pos % 4 < 2 and job_uid < '8'")
    return merge_cycle(_first_cycle(ready), ready.where(own | again).withColumn("own", own), 2, _at(2), ["own", "ord", "pos"])


def stored_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot as a table, for what reads it more than once."""
    return stored(jobs(spark, sf_dir), "jobs")


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their day from 1; the event type stands for a source, a user for a posting, an error for a failure."""
    events = table(spark, sf_dir, "events")
    day = (F.datediff("ts", F.lit("2024-01-01").cast("date")) + 1).cast("long")
    return events.select("event_id", "ts", "user_id", "event_type", "value", "props", day.alias("day"))
