"""The snapshot of postings: merging a cycle into it, user flags, aging, backfills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.dates import iso
from tideline.operators.gates import detect_internship
from tideline.operators.identity import collapse
from tideline.plans.config import Feed
from tideline.schemas import MUTABLE, POSTING, PROVENANCE, SNAPSHOT, SNAPSHOT_COLUMNS, USER_FLAGS, USER_TEXTS

#: What a card's action sets.
ACTIONS = {
    "apply": ("applied", True), "unapply": ("applied", False), "bookmark": ("bookmarked", True), "unbookmark": ("bookmarked", False),
    "hide": ("hidden", True), "unhide": ("hidden", False), "seen": ("seen", True), "unseen": ("seen", False),
}


def merge_cycle(snapshot: DataFrame, batch: DataFrame, cycle: int | Column, as_of: Column, order: list[str], announce_crosslisted: bool = False) -> DataFrame:
    """The snapshot after a cycle's kept postings.

    A uid not seen before is new, or active if the batch holds it more than once (unless ``announce_crosslisted``); any
    other becomes active, also from stale or deleted. The first arrival gives provenance to new uids, the last one the
    mutable columns; a known row keeps its provenance and what users set.
    """
    return _merged(snapshot, collapse(batch, order), "full_outer", cycle, as_of, announce_crosslisted)


def merge_came(snapshot: DataFrame, came: DataFrame, cycle: int | Column, as_of: Column, announce_crosslisted: bool = False) -> DataFrame:
    """As ``merge_cycle`` of a batch that is collapsed already, but only the rows that came."""
    return _merged(snapshot, came, "right_outer", cycle, as_of, announce_crosslisted)


def _merged(snapshot: DataFrame, came: DataFrame, how: str, cycle: int | Column, as_of: Column, announce_crosslisted: bool) -> DataFrame:
    cycle = F.lit(cycle) if isinstance(cycle, int) else cycle
    both = snapshot.join(came.withColumnRenamed("job_uid", "_uid"), F.col("job_uid") == F.col("_uid"), how)
    known, arrived = F.col("job_uid").isNotNull(), F.col("_uid").isNotNull()
    types = dict(c.split() for c in SNAPSHOT.split(", "))
    fresh = F.lit("new") if announce_crosslisted else F.when(F.col("times") > 1, "active").otherwise("new")
    out: dict[str, Column] = {"job_uid": F.coalesce("job_uid", "_uid")}
    for c in PROVENANCE[:3]:
        out[c] = F.when(known, F.col(c)).otherwise(F.col(f"first.{c}"))
    out["first_seen_at"] = F.when(known, F.col("first_seen_at")).otherwise(as_of)
    for c in MUTABLE:
        out[c] = F.when(arrived, F.col(f"last.{c}")).otherwise(F.col(c))
    out["last_seen_at"] = F.when(arrived, as_of).otherwise(F.col("last_seen_at"))
    out["last_seen_cycle"] = F.when(arrived, cycle).otherwise(F.col("last_seen_cycle"))
    out["status"] = F.when(~arrived, F.col("status")).when(known, "active").otherwise(fresh)
    for c in USER_FLAGS:
        out[c] = F.coalesce(F.col(c), F.lit(False))
    for c in USER_TEXTS:
        out[c] = F.col(c)
    return both.select(*[out[c].cast(types[c]).alias(c) for c in SNAPSHOT_COLUMNS])


def age_out(snapshot: DataFrame, outcomes: DataFrame, cycle: int | Column, as_of: Column, feed: Feed) -> DataFrame:
    """Adds went_stale and went_deleted, and sets the status; a row may do both in one pass.

    Only rows of sources that succeeded age. ``outcomes`` is (source, exhaustive), one row per source that did; where
    that is false, the source shows a window only, and a row has to be older than ``retire_days`` as well.
    """
    ok = outcomes.select(F.col("source").alias("_source"), F.coalesce("exhaustive", F.lit(True)).alias("_exhaustive"))
    rows = snapshot.join(ok, F.col("source") == F.col("_source"), "left")
    cycle = F.lit(cycle) if isinstance(cycle, int) else cycle
    seen = F.col("_source").isNotNull()
    old = F.coalesce("posted_at", "first_seen_at") < as_of - F.make_dt_interval(F.lit(feed.retire_days))
    stale = seen & (F.col("last_seen_cycle") < cycle) & F.col("status").isin("new", "active") & (F.col("_exhaustive") | old)
    rows = rows.withColumn("went_stale", F.coalesce(stale, F.lit(False)))
    status = F.when(F.col("went_stale"), "stale").otherwise(F.col("status"))
    gone = seen & (status == "stale") & (F.col("last_seen_at") < as_of - F.make_dt_interval(F.lit(feed.grace_days)))
    rows = rows.withColumn("went_deleted", F.coalesce(gone, F.lit(False)))
    return rows.withColumn("status", F.when(F.col("went_deleted"), "deleted").otherwise(status)).drop("_source", "_exhaustive")


def aged_by(snapshot: DataFrame, passes: DataFrame, feed: Feed) -> DataFrame:
    """The status of rows that are as they were last seen, after all later passes at once; the same as ``age_out`` pass by pass.

    ``passes`` is (source, exhaustive, as_of, cycle), one row per source and cycle in which it succeeded. They are one array
    a source; Spark broadcasts them if their size allows.
    """
    per = passes_of(passes, feed).select(F.col("source").alias("_source"), F.col("passes").alias("_passes"))
    rows = snapshot.join(per, F.col("source") == F.col("_source"), "left")
    rows = rows.withColumn("_aging", aging(F.col("_passes"), F.col("last_seen_cycle"), F.col("last_seen_at"), F.coalesce("posted_at", "first_seen_at")))
    ages = F.col("status").isin("new", "active") & F.col("_aging.stale").isNotNull()
    return rows.withColumn("status", F.when(ages & F.col("_aging.gone").isNotNull(), "deleted").when(ages, "stale").otherwise(F.col("status"))).select(*snapshot.columns)


def passes_of(passes: DataFrame, feed: Feed) -> DataFrame:
    """(source, passes): each source's passes in order, with the times before which a row is old enough to go."""
    before = lambda days: F.col("as_of") - F.make_dt_interval(F.lit(days))
    one = F.struct("cycle", "as_of", F.coalesce("exhaustive", F.lit(True)).alias("exhaustive"), before(feed.retire_days).alias("retired"), before(feed.grace_days).alias("graced"))
    return passes.groupBy("source").agg(F.array_sort(F.collect_list(one)).alias("passes"))


def aging(passes: Column, seen: Column, seen_at: Column, posted: Column) -> Column:
    """struct(stale, gone): the cycles in which a row last seen in cycle ``seen`` goes stale and is deleted by its source's passes, or null."""
    first = lambda which: F.get(F.filter(passes, which), F.lit(0))["cycle"]
    stale = first(lambda p: (p["cycle"] > seen) & (p["exhaustive"] | (posted < p["retired"])))
    gone = lambda s: first(lambda p: (p["cycle"] >= s) & (seen_at < p["graced"]))
    # a lambda's variable holds the first cycle, which else would be looked for again at each pass
    return F.transform(F.array(stale), lambda s: F.struct(s.alias("stale"), gone(s).alias("gone")))[0]


def replay_intervals(sightings: DataFrame, passes: DataFrame, cycles: DataFrame, feed: Feed) -> DataFrame:
    """Per uid the stretches of cycles in which it had one status: uid, source, status, from_cycle, to_cycle.

    ``sightings`` is (uid, source, cycle, posted_at, ord), ``passes`` (source, cycle, exhaustive), one row per cycle in which
    the source succeeded, ``cycles`` (cycle, as_of). Each sighting lasts until the next one or the last cycle: new or
    active first, then stale and deleted as passes without it say; windowed sources ask for its age as well. Equal
    neighbours are one stretch. A uid has a row a change and not one a cycle; its window holds one row a cycle it was seen in.
    """
    from pyspark.sql import Window as W

    per = passes_of(passes.join(cycles, "cycle"), feed)
    last_arrival = F.max_by(F.struct("posted_at"), "ord")["posted_at"].alias("posted_at")
    seen = sightings.groupBy("uid", "cycle").agg(F.min_by("source", "ord").alias("came_by"), last_arrival, F.count("*").alias("times")).join(cycles, "cycle")
    of_uid = W.partitionBy("uid").orderBy("cycle")
    rows = seen.select(
        "uid", "cycle", "as_of", "posted_at", "times", F.first("came_by").over(of_uid).alias("source"), F.first("as_of").over(of_uid).alias("first_seen_at"),
        F.lead("cycle").over(of_uid).alias("next"), (F.row_number().over(of_uid) == 1).alias("is_first"),
    )
    end = (cycles.agg(F.max("cycle")).first()[0] or 0) + 1
    rows = rows.join(per, "source", "left")
    aged = aging(F.col("passes"), F.col("cycle"), F.col("as_of"), F.coalesce("posted_at", "first_seen_at"))
    rows = rows.withColumn("until", F.coalesce("next", F.lit(end))).withColumn("aged", aged).select("*", "aged.stale", "aged.gone").drop("passes", "aged")
    at = lambda c: F.least(F.coalesce(c, F.col("until")), F.col("until"))
    piece = lambda status, low, high: F.struct(status.alias("status"), low.alias("low"), (high - 1).alias("high"))
    new = F.when(F.col("is_first") & (F.lit(feed.announce_crosslisted) | (F.col("times") == 1)), "new").otherwise("active")
    pieces = F.array(
        piece(new, F.col("cycle"), at(F.col("stale"))), piece(F.lit("stale"), at(F.col("stale")), at(F.col("gone"))), piece(F.lit("deleted"), at(F.col("gone")), F.col("until"))
    )
    each = rows.select("uid", "source", F.explode(F.filter(pieces, lambda p: p["low"] <= p["high"])).alias("p")).select("uid", "source", "p.*")
    in_order = W.partitionBy("uid").orderBy("low")
    island = F.count_if(~F.col("status").eqNullSafe(F.col("before"))).over(in_order)
    marked = each.withColumn("before", F.lag("status").over(in_order)).withColumn("island", island)
    merged = marked.groupBy("uid", "island").agg(F.first("source").alias("source"), F.first("status").alias("status"), F.min("low").alias("from_cycle"), F.max("high").alias("to_cycle"))
    return merged.drop("island")


def expired_count(aged: DataFrame) -> DataFrame:
    """Transitions, not rows: one that goes stale and deleted in a pass counts twice."""
    return aged.agg((F.count_if("went_stale") + F.count_if("went_deleted")).alias("n_expired"))


def latest_flags(events: DataFrame) -> DataFrame:
    """(job_uid, field, value) of the last action of (job_uid, action, ts) on each field; unknown actions are left out."""
    table = F.create_map(*[x for a, (f, v) in ACTIONS.items() for x in (F.lit(a), F.struct(F.lit(f).alias("field"), F.lit(v).alias("value")))])
    known = events.withColumn("_set", table[F.col("action")]).where(F.col("_set").isNotNull())
    last = F.max_by(F.col("_set.value"), F.struct("ts", "action")).alias("value")
    return known.groupBy("job_uid", F.col("_set.field").alias("field")).agg(last)


def apply_flags(snapshot: DataFrame, events: DataFrame) -> DataFrame:
    set_to = latest_flags(events).groupBy("job_uid").pivot("field", USER_FLAGS).agg(F.first("value"))
    set_to = set_to.select(F.col("job_uid").alias("_uid"), *[F.col(c).alias(f"_{c}") for c in USER_FLAGS])
    rows = snapshot.join(set_to, F.col("job_uid") == F.col("_uid"), "left")
    return rows.withColumns({c: F.coalesce(f"_{c}", c) for c in USER_FLAGS}).select(*snapshot.columns)


#: What a user may set by name; the texts come trimmed, blank ones as null.
SETTABLE = ("applied", "bookmarked", "hidden", "seen", "notes", "extra_context")


def set_fields(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """The snapshot after (job_uid, field, value, ts): the last value of each settable field, as text; ``refused`` has the rest.

    A flag is set by true, 1, yes and any other text, and cleared by false, 0, no, blank and null.
    """
    last = changes.where(F.col("field").isin(*SETTABLE)).groupBy("job_uid").pivot("field", list(SETTABLE)).agg(F.max_by(F.struct("value"), F.struct("ts", "value")))
    last = last.select(F.col("job_uid").alias("_uid"), *[F.col(c).alias(f"_{c}") for c in SETTABLE])
    rows = snapshot.join(last, F.col("job_uid") == F.col("_uid"), "left")
    off = lambda v: F.lower(F.trim(F.coalesce(v, F.lit("")))).isin("", "false", "0", "no")
    value = {c: ~off(F.col(f"_{c}.value")) if c in USER_FLAGS else F.nullif(F.trim(F.col(f"_{c}.value")), F.lit("")) for c in SETTABLE}
    return rows.withColumns({c: F.when(F.col(f"_{c}").isNotNull(), value[c]).otherwise(F.col(c)) for c in SETTABLE}).select(*snapshot.columns)


def refused(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """The changes that set nothing, with why: an unknown field, or a posting that is not there."""
    known = snapshot.select(F.col("job_uid").alias("_uid"))
    rows = changes.join(known, F.col("job_uid") == F.col("_uid"), "left")
    why = F.when(~F.coalesce(F.col("field").isin(*SETTABLE), F.lit(False)), "unknown field").when(F.col("_uid").isNull(), "no such posting")
    return rows.withColumn("why", why).where("why is not null").drop("_uid")


#: Columns that the stored form keeps as numbers, and as text.
STORED_BOOLEANS = [c for c, t in (x.split() for x in SNAPSHOT.split(", ")) if t == "BOOLEAN"]
STORED_TIMES = [c for c, t in (x.split() for x in SNAPSHOT.split(", ")) if t == "TIMESTAMP"]


def stored(snapshot: DataFrame) -> DataFrame:
    """The form that rows are exchanged in: booleans as 0 and 1, times as ISO 8601 text in UTC."""
    text = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return snapshot.withColumns({c: F.col(c).cast("int") for c in STORED_BOOLEANS} | {c: text(c) for c in STORED_TIMES})


def decoded(rows: DataFrame) -> DataFrame:
    """Postings from stored rows: numbers as booleans, an unknown remote flag kept, text as times; bookkeeping is dropped."""
    there = {c: F.col(c).cast("boolean") if c == "is_remote" else F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in STORED_BOOLEANS}
    bucket = F.when(F.col("salary_bucket").isin("pass", "fail", "unknown"), F.col("salary_bucket"))
    made = there | {c: iso(F.col(c)) for c in STORED_TIMES} | {"salary_bucket": bucket}
    return rows.select(*[made.get(c, F.col(c)).cast(t).alias(c) for c, t in (x.split() for x in POSTING.split(", "))])


def unmatched_flags(snapshot: DataFrame, events: DataFrame) -> DataFrame:
    return events.join(snapshot.select("job_uid"), "job_uid", "left_anti")


def with_details(snapshot: DataFrame, details: DataFrame) -> DataFrame:
    """Adds effective_description and is_preview; details (job_uid, text) fill full_description once and for good."""
    found = details.groupBy("job_uid").agg(F.min("text").alias("_text")).withColumnRenamed("job_uid", "_uid")
    rows = snapshot.join(found, F.col("job_uid") == F.col("_uid"), "left").withColumn("full_description", F.coalesce("full_description", "_text"))
    preview = F.col("source").isin("adzuna", "jooble") & F.col("full_description").isNull()
    return rows.withColumns({"effective_description": F.coalesce("full_description", "description"), "is_preview": preview}).drop("_uid", "_text")


def backfill_internships(snapshot: DataFrame) -> DataFrame:
    """Derive the internship flag where old rows do not have it."""
    have = F.col("is_internship") if "is_internship" in snapshot.columns else F.lit(None).cast("boolean")
    return snapshot.withColumn("is_internship", F.coalesce(have, detect_internship(F.col("title"))))


def orphan_cycles(snapshot: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows whose last_seen_cycle no run has."""
    return snapshot.join(runs.select(F.col("run_id").alias("last_seen_cycle")), "last_seen_cycle", "left_anti")


def replay(sightings: DataFrame, outcomes: DataFrame, grace_cycles: int) -> DataFrame:
    """Status per (uid, cycle) over all cycles at once, for exhaustive sources.

    ``sightings`` is (uid, source, cycle), ``outcomes`` (source, cycle, succeeded) for each cycle. From its first cycle
    on, a uid is new, then active while seen; stale once its source succeeded without it, deleted when that lasts for
    more than ``grace_cycles`` cycles.
    """
    from pyspark.sql import Window as W

    seen = sightings.groupBy("uid", "cycle").agg(F.min("source").alias("source"))
    own = seen.groupBy("uid").agg(F.min_by("source", "cycle").alias("source"), F.min("cycle").alias("first_cycle"))
    grid = own.join(outcomes.select("source", "cycle", "succeeded"), "source").where("cycle >= first_cycle")
    rows = grid.join(seen.select("uid", "cycle", F.lit(True).alias("seen")), ["uid", "cycle"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    so_far = W.partitionBy("uid").orderBy("cycle").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("last_seen_cycle", F.last(F.when(F.col("seen"), F.col("cycle")), ignorenulls=True).over(so_far))
    missed = F.max(F.when(~F.col("seen") & F.col("succeeded"), F.col("cycle"))).over(so_far)
    rows = rows.withColumn("missed", missed)
    gap = F.col("missed") - F.col("last_seen_cycle")
    status = F.when(F.col("cycle") == F.col("first_cycle"), "new").when(F.col("seen"), "active").when(F.coalesce(gap, F.lit(0)) <= 0, F.when(F.col("last_seen_cycle") == F.col("first_cycle"), "new").otherwise("active"))
    return rows.withColumn("status", status.when(gap > grace_cycles, "deleted").otherwise("stale")).select("uid", "cycle", "source", "last_seen_cycle", "status")
