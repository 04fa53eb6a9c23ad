"""Registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import dates, pay, text, urls
from tideline.functions.shared import small_batches
from tideline.operators import gates, identity, match, neardup, pages, publish, runs, snapshot
from tideline.operators import views as views_of
from tideline.plans import views
from tideline.plans.views import FEED, table
from tideline.schemas import SNAPSHOT
from tideline.sources import outcomes, tables
from tideline.sources.boards import MAPPERS, catalogues, jobicy_mapper, map_items, map_scrape, read_boards
from tideline.streaming import walks
from tideline.streaming.late import appended, recent, written_batches
from tideline.streaming.store import Store, ingest_into

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return f


def _at(ts: str) -> F.Column:
    return F.lit(ts).cast("timestamp")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.judge(identity.enrich(identity.to_posting(views.postings(spark, sf_dir)), FEED), FEED)


@_query
def match_score_topk(spark, sf_dir):
    rows = _judged(spark, sf_dir).where("keep")
    return rows.select("pos", "job_uid", "match_score", "posted_at", F.array_join("reasons", "|").alias("reasons")).orderBy(F.col("match_score").desc(), F.col("posted_at").desc_nulls_last(), "pos").limit(50)


@_query
def posting_identity(spark, sf_dir):
    p = views.postings(spark, sf_dir)
    company, title, location = F.col("company"), F.col("title"), F.col("location")
    return p.select(
        "pos", text.norm_company(company).alias("norm_company"), text.norm_title(title).alias("norm_title"), text.norm_location(location).alias("norm_location"), text.content_hash(company, title, location).alias("job_uid"),
        F.coalesce(text.clean_text(title), F.trim(title)).alias("clean_title"),
    )


@_query
def dedup_first_seen(spark, sf_dir):
    p = identity.to_posting(views.postings(spark, sf_dir)).withColumn("ord", views.source_order())
    c = identity.collapse(p, ["ord", "pos"])
    return c.select("job_uid", F.col("first.source").alias("source"), F.col("first.pos").alias("first_pos"), F.col("last.pos").alias("last_pos"), F.col("last.salary_max").alias("salary_max"), "times")


@_query
def canonical_urls(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(u).alias("canonical"), urls.base_domain(urls.host(u)).alias("domain"), urls.is_private_host(u).alias("private"), urls.has_safe_scheme(u).alias("safe"))


@_query
def posting_urls(spark, sf_dir):
    """The pages' own URLs, and URLs of each applicant system, of two at once, of none, and with a system's name in the path only."""
    k = F.col("page_id")
    bases = ["https://boards.greenhouse.io/acme/jobs/", "https://jobs.lever.co/acme/", "https://jobs.ashbyhq.com/acme/", "https://careers.smartrecruiters.com/acme/", "https://jobs.lever.co.greenhouse.io/x/", "https://WWW.example.com/jobs/", "https://example.org/to/greenhouse.io/"]
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(views._pick(bases, k), k.cast("string"), F.lit("/?utm_source=x#top")).alias("url"))
    p = p.select("page_id", F.lit("made").alias("kind"), "url").unionByName(table(spark, sf_dir, "pages").select("page_id", F.lit("own").alias("kind"), "url"))
    return p.select("page_id", "kind", urls.canonical_url(F.col("url")).alias("canonical"), urls.applicant_system(F.col("url")).alias("system"), urls.is_page_of(F.col("url"), "example.com").alias("own"))


@_query
def pages_by_site(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", urls.base_domain(urls.host(F.col("url"))).alias("site"))
    return p.groupBy("site").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


@_query
def keyword_gates(spark, sf_dir):
    return _judged(spark, sf_dir).select("pos", "is_internship", "salary_bucket", "keep", F.coalesce("drop_reason", F.lit("")).alias("drop_reason"))


@_query
def scores(spark, sf_dir):
    return _judged(spark, sf_dir).select("pos", "match_score", F.array_join("reasons", "|").alias("reasons"))


@_query
def required_years(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), "text")
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), "text")
    p = views.postings(spark, sf_dir).select(F.concat(F.lit("p"), F.col("pos").cast("string")).alias("key"), F.col("description").alias("text"))
    rows = d.unionByName(c).unionByName(p)
    return rows.select("key", gates.required_years(F.lower("text")).alias("years")).where("years is not null")


@_query
def pay_normalise(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, amount = F.col("o_orderkey"), F.rint("o_totalprice").cast("long")
    low, high = F.when(k % 7 != 0, amount), F.when(k % 5 != 0, amount * 2)
    currency, period = views._pick(views.CURRENCIES, k), views._pick(views.PERIODS, k)
    got = pay.convert_bounds(low, high, currency, period, FEED.pay.rates)
    rows = o.select("o_orderkey", got.alias("p"), pay.raw_repr(low.cast("double"), high.cast("double"), currency, period).alias("raw"))
    return rows.select("o_orderkey", F.col("p.low").alias("low"), F.col("p.high").alias("high"), F.col("p.parsed").alias("parsed"), pay.representative(F.col("p.low"), F.col("p.high")).alias("shown"), "raw")


@_query
def salary_buckets(spark, sf_dir):
    e = identity.enrich(identity.to_posting(views.postings(spark, sf_dir)), FEED)
    return e.groupBy("is_internship", F.coalesce("is_remote", F.lit(False)).alias("remote"), "salary_bucket").agg(F.count("*").alias("n"), F.sum("salary_max").alias("sum_max"))


@_query
def drop_funnel(spark, sf_dir):
    f = gates.drop_funnel(_judged(spark, sf_dir))
    return f.select(F.coalesce("source", F.lit("(all)")).alias("source"), F.coalesce("reason", F.lit("(all)")).alias("reason"), "n", F.round("share", 9).alias("share"))


@_query
def feed_page(spark, sf_dir):
    rows = views_of.feed(views.jobs(spark, sf_dir), q="engineer", remote=False, status=["new", "active"])
    return views_of.page(rows, "date", 40, 5).select("job_uid", "title", "company", "match_score", "posted_at", "status")


@_query
def feed_count(spark, sf_dir):
    """The totals do not tell a posting that both cycles listed from one that the second one only added: each counts once."""
    j = views.relisted_jobs(spark, sf_dir)
    kinds = {"all": {"status": "all"}, "remote": {"remote": True}, "not_remote": {"remote": False}, "not_remote_strict": {"remote": False, "null_remote_is_no": False}, "intern": {"intern": True}, "none": {"status": []}, "wild": {"q": "b_ck%eng"}, "pass": {"bucket": "pass"}}
    return views_of.totals(j, kinds)


@_query
def status_counts(spark, sf_dir):
    return views_of.status_counts(views.jobs(spark, sf_dir))


@_query
def distinct_sources(spark, sf_dir):
    from tideline.sources.tables import distinct_sources as distinct

    return distinct(views.jobs(spark, sf_dir))


@_query
def new_in_run(spark, sf_dir):
    return views_of.new_in_cycle(views.jobs(spark, sf_dir), 2).select("job_uid", "match_score", "source")


@_query
def recent_active(spark, sf_dir):
    return views_of.recent_active(views.jobs(spark, sf_dir), 100).select("job_uid", "posted_at", "last_seen_at", "status")


def _outcomes(spark, sf_dir):
    e = views.days(spark, sf_dir)
    failed = (F.col("user_id") % 23 == 0) & (F.col("event_type") == "error")
    per = e.groupBy(F.col("day").alias("run_id"), F.col("event_type").alias("source")).agg(
        (F.count_if(failed) == 0).alias("succeeded"), (F.min("value") < 5).alias("exhaustive"), F.count("*").cast("int").alias("n_fetched"), F.max(F.when(failed, F.concat(F.lit("status "), F.col("user_id").cast("string")))).alias("error")
    )
    return per


@_query
def run_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir)


@_query
def run_status(spark, sf_dir):
    return runs.run_metrics(_outcomes(spark, sf_dir)).select("run_id", "n_sources_ok", "n_sources_err", "n_fetched", "status", F.coalesce("error", F.lit("")).alias("error"))


@_query
def last_outcomes(spark, sf_dir):
    e = views.days(spark, sf_dir).select(F.col("day").alias("run_id"), F.col("event_type").alias("source"), "ts", "event_id", "value")
    return runs.last_outcomes(e, ["ts", "event_id"]).select("run_id", "source", "event_id", "value")


def _events_as_postings(e):
    """The user is the posting."""
    return e.select(F.col("user_id").cast("string").alias("job_uid"), F.col("event_type").alias("source"), F.col("props").alias("source_native_id"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("title"), F.col("ts").alias("posted_at"), F.round(F.col("value") * 100).cast("long").alias("salary_max"), F.col("event_id").alias("pos"))


def _full(batch):
    have = set(batch.columns)
    from tideline.schemas import POSTING

    return batch.select(*[(F.col(n) if n in have else F.lit(None).cast(t)).alias(n) for n, t in (c.split() for c in POSTING.split(", "))], "pos")


def _halves(spark, sf_dir):
    """All events in two cycles: a quarter of the users come in the first only, one in the second, all others by the half of the month."""
    e = views.days(spark, sf_dir)
    kind = F.col("user_id") % 4
    early = (kind == 0) | ((kind > 1) & (F.col("day") < 16))
    return _events_as_postings(e.where(early)), _events_as_postings(e.where(~early))


def _first_cycle(spark, sf_dir):
    return snapshot.merge_cycle(spark.createDataFrame([], SNAPSHOT), _full(_halves(spark, sf_dir)[0]), 1, _at("2024-01-16 00:00:00"), ["pos"])


def _two_cycles(spark, sf_dir):
    return snapshot.merge_cycle(_first_cycle(spark, sf_dir), _full(_halves(spark, sf_dir)[1]), 2, _at("2024-01-31 00:00:00"), ["pos"])


@_query
def upsert_merge(spark, sf_dir):
    return _two_cycles(spark, sf_dir).select("job_uid", "source", "title", "salary_max", "first_seen_at", "last_seen_at", "last_seen_cycle", "status", "applied")


@_query
def upsert_metrics(spark, sf_dir):
    judged = _halves(spark, sf_dir)[1].withColumn("keep", F.col("pos") % 5 != 0)
    return runs.upsert_metrics(judged, _first_cycle(spark, sf_dir))


def _aged(spark, sf_dir):
    ok = spark.range(3).select(F.element_at(F.array(F.lit("view"), F.lit("click"), F.lit("signup")), (F.col("id") + 1).cast("int")).alias("source"), (F.col("id") != 1).alias("exhaustive"))
    return snapshot.age_out(_two_cycles(spark, sf_dir), ok, 3, _at("2024-02-06 12:00:00"), FEED)


@_query
def age_out(spark, sf_dir):
    return _aged(spark, sf_dir).select("job_uid", "source", "status", "went_stale", "went_deleted")


@_query
def expired_count(spark, sf_dir):
    return snapshot.expired_count(_aged(spark, sf_dir))


@_query
def lifecycle_replay(spark, sf_dir):
    e = views.days(spark, sf_dir)
    sightings = e.select(F.col("user_id").alias("uid"), F.col("event_type").alias("source"), F.col("day").alias("cycle"))
    ok = _outcomes(spark, sf_dir).select("source", F.col("run_id").alias("cycle"), "succeeded")
    return snapshot.replay(sightings, ok, 3)


def _runs(spark, sf_dir):
    m = runs.run_metrics(_outcomes(spark, sf_dir))
    start = _at(views.START) + F.make_dt_interval((F.col("run_id") - 1).cast("int"))
    state = F.when(F.col("run_id") % 10 == 0, "running").otherwise(F.col("status"))
    return m.select("run_id", start.alias("started_at"), F.when(state != "running", start + F.make_dt_interval(F.lit(0), (F.col("n_fetched") % 30).cast("int"))).alias("finished_at"), state.alias("status"), F.lit("scheduled").alias("trigger"), F.col("n_sources_ok"), F.col("n_sources_err"), F.col("error"))


@_query
def orphan_runs(spark, sf_dir):
    return runs.reconcile_orphans(_runs(spark, sf_dir), _at(views.AS_OF)).select("run_id", "status", "finished_at", F.coalesce("error", F.lit("")).alias("error"))


@_query
def latest_runs(spark, sf_dir):
    return runs.latest_runs(_runs(spark, sf_dir))


@_query
def overdue_cycles(spark, sf_dir):
    return runs.overdue_cycles(_runs(spark, sf_dir), _at(views.AS_OF))


@_query
def run_history(spark, sf_dir):
    return runs.run_history(_runs(spark, sf_dir)).select("run_id", "status")


@_query
def run_summaries(spark, sf_dir):
    m = runs.run_metrics(_outcomes(spark, sf_dir)).withColumns({"failed": F.transform("failed", lambda x: x["source"]), "n_new": F.lit(1), "n_updated": F.col("n_fetched"), "n_expired": F.lit(0), "n_filtered": F.lit(2), "trigger": F.lit("scheduled")})
    return publish.run_summary(m, F.when(F.col("run_id") % 2 == 0, "http://192.168.1.5:8770/").otherwise("https://feed.example.com/?a=1&b=2"))


@_query
def orphan_cycles(spark, sf_dir):
    """Rows last seen in a cycle that no successful run has."""
    return snapshot.orphan_cycles(_two_cycles(spark, sf_dir), _runs(spark, sf_dir).where("status = 'success'")).select("job_uid", "last_seen_cycle")


def _flag_events(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for x in ("view", "seen", "click", "bookmark", "signup", "hide", "purchase", "apply", "error", "unbookmark")])
    return views.days(spark, sf_dir).select(F.col("user_id").cast("string").alias("job_uid"), F.when(F.col("event_id") % 4 == 0, "unseen").otherwise(names[F.col("event_type")]).alias("action"), "ts")


@_query
def flag_latest(spark, sf_dir):
    return snapshot.latest_flags(_flag_events(spark, sf_dir))


@_query
def flags_applied(spark, sf_dir):
    done = snapshot.apply_flags(_two_cycles(spark, sf_dir), _flag_events(spark, sf_dir))
    return done.groupBy("applied", "bookmarked", "hidden", "seen").agg(F.count("*").alias("n"))


@_query
def flags_unmatched(spark, sf_dir):
    return snapshot.unmatched_flags(_two_cycles(spark, sf_dir).where("last_seen_cycle = 2"), _flag_events(spark, sf_dir)).groupBy("job_uid").agg(F.count("*").alias("n"))


@_query
def row_decode(spark, sf_dir):
    return snapshot.decoded(snapshot.stored(views.jobs(spark, sf_dir))).select("job_uid", "source", "title", "is_remote", "salary_min", "salary_parsed", "salary_bucket", "is_internship", "posted_at")


def _changes(spark, sf_dir):
    """Events as settings of users: mostly known fields, one that is not, on users that may not be there."""
    kind = F.col("event_id") % 5
    field = F.when(kind == 0, "notes").when(kind == 1, "hidden").when(kind == 2, "extra_context").when(kind == 3, "applied").otherwise("status")
    value = F.when(kind.isin(1, 3), F.when(F.col("value") < 20, "false").otherwise("1")).otherwise(F.concat(F.lit("  "), "event_type", F.lit(" ")))
    return views.days(spark, sf_dir).select(F.col("user_id").cast("string").alias("job_uid"), field.alias("field"), value.alias("value"), F.struct("ts", "event_id").alias("ts"))


@_query
def fields_set(spark, sf_dir):
    return snapshot.set_fields(_two_cycles(spark, sf_dir), _changes(spark, sf_dir)).select("job_uid", "applied", "hidden", "notes", "extra_context")


@_query
def fields_refused(spark, sf_dir):
    seen_late = _two_cycles(spark, sf_dir).where("last_seen_cycle = 2")
    return snapshot.refused(seen_late, _changes(spark, sf_dir)).groupBy("field", "why").agg(F.count("*").alias("n"))


@_query
def postings_of_succeeded(spark, sf_dir):
    p = views.postings(spark, sf_dir)
    ok = p.groupBy("source").agg((F.count("*") % 3 != 0).alias("succeeded"))
    return runs.of_succeeded(p, ok).groupBy("source").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


@_query
def succeeded_sources(spark, sf_dir):
    return runs.succeeded_sources(_outcomes(spark, sf_dir))


@_query
def run_view(spark, sf_dir):
    shown = F.transform("outcomes", lambda o: F.concat_ws(":", o["source"], o["succeeded"].cast("string"), o["n_fetched"].cast("string"), o["error"]))
    return runs.with_outcomes(_runs(spark, sf_dir), _outcomes(spark, sf_dir)).select("run_id", "status", F.array_join(shown, ";").alias("outcomes"))


@_query
def run_rows(spark, sf_dir):
    started = runs.start_run(_runs(spark, sf_dir), 1000, _at(views.AS_OF), "manual")
    return runs.finish_run(started, 1000, _at("2024-02-01 01:00:00"), "partial", n_sources_ok=3, n_sources_err=1).select("run_id", "started_at", "finished_at", "status", "trigger", "n_sources_ok", "n_sources_err")


@_query
def details_filled(spark, sf_dir):
    """Full descriptions for every other posting; two sources show previews."""
    j = views.jobs(spark, sf_dir).withColumn("source", F.when(F.col("source").endswith("1"), "adzuna").when(F.col("source").endswith("2"), "jooble").otherwise(F.col("source")))
    full = j.where(F.col("job_uid") < "8").select("job_uid", F.concat(F.lit("All of: "), "title").alias("text"))
    return snapshot.with_details(j, full).select("job_uid", F.md5(F.col("effective_description").cast("binary")).alias("digest"), "is_preview")


@_query
def internships_backfilled(spark, sf_dir):
    return snapshot.backfill_internships(views.jobs(spark, sf_dir).drop("is_internship")).select("job_uid", "is_internship")


@_query
def lists_split(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    typed = F.concat("p_name", F.lit(" , "), "p_type", F.lit("\n"), "p_brand", F.lit(",,\n "))
    return p.select("p_partkey", F.array_join(text.split_list(typed), "|").alias("items"))


@_query
def skill_groups(spark, sf_dir):
    """Each brand's part types, those whose names touch most of the brand's keywords first."""
    p = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.collect_set("p_name").alias("items"))
    groups = F.array_sort(F.collect_list(F.struct(F.col("p_type").alias("category"), F.array_sort("items").alias("items"))))
    wanted = views._pick(["red ring", "blue bolt hot", "old widget"], F.length("p_brand") + F.ascii(F.substring("p_brand", -1, 1)))
    b = p.groupBy("p_brand").agg(groups.alias("groups")).withColumn("keywords", text.keyword_tokens(wanted))
    return b.select("p_brand", F.array_join(F.transform(match.ranked_groups(F.col("groups"), F.col("keywords")), lambda g: g["category"]), ",").alias("ranked"))


@_query
def posting_texts(spark, sf_dir):
    j = views.stored_jobs(spark, sf_dir)
    j = snapshot.set_fields(j, j.select("job_uid", F.lit("extra_context").alias("field"), F.concat(F.lit(" see "), "source").alias("value"), F.lit(1).alias("ts")))
    return j.select("job_uid", match.posting_text(j).alias("text"))


@_query
def source_catalogue(spark, sf_dir):
    """Every supplier is a feed: its key says which boards are on and have keys, its nation's suppliers are the companies."""
    s = table(spark, sf_dir, "supplier")
    names = F.array(*map(F.lit, MAPPERS))
    of = lambda k: F.filter(names, lambda x, i: (F.col("s_suppkey") + i) % k != 0)
    nations = s.groupBy("s_nationkey").agg(F.sum(F.when(F.col("s_suppkey") % 2 == 0, 1).otherwise(0)).alias("n"))
    companies = F.map_from_arrays(F.array(F.lit("lever"), F.lit("ashby")), F.array(F.sequence(F.lit(1), F.lit(2)).cast("array<string>"), F.array_repeat(F.lit("co"), F.col("n").cast("int"))))
    feeds = s.join(nations, "s_nationkey").select(F.col("s_suppkey").cast("string").alias("feed"), of(3).alias("enabled"), of(4).alias("keys"), companies.alias("companies"))
    return catalogues(feeds)


@_query
def profiles_read(spark, sf_dir):
    """A brand as a person, its parts as projects, written as JSON and scanned as profiles: projects with their tools."""
    path = views.scratch(spark, "profiles")
    words = F.split("p_name", " ")
    project = F.struct(F.concat_ws("-", F.lit("P"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_type").alias("tagline"), words.alias("tech"), F.array(F.concat(F.lit("Size "), F.col("p_size").cast("string"))).alias("bullets"))
    part = table(spark, sf_dir, "part")
    people = part.groupBy(F.col("p_brand").alias("person")).agg(F.sort_array(F.collect_list(project)).alias("projects"), F.struct(F.min("p_name").alias("name")).alias("contact"))
    people.write.json(path)
    found = tables.read_profiles(spark, path, multi_line=False)
    each = found.select("person", "contact.name", F.size("projects").cast("long").alias("n_projects"), F.explode("projects").alias("p"), F.size(F.coalesce("skills", F.array())).alias("n_skills"))
    return each.select("person", "name", "n_projects", F.col("p.name").alias("project"), F.col("p.tagline").alias("tagline"), F.array_join("p.tech", "+").alias("tech"), F.array_join("p.bullets", ";").alias("bullets"), "n_skills")


@_query
def rewrites_parsed(spark, sf_dir):
    """Conversations' texts as a rewriter's reply under headers, cut into bullets: how many, of which project, and which first."""
    c = table(spark, sf_dir, "conversations")
    reply = F.concat_ws("\n", F.concat(F.lit("### P"), (F.col("turn") % 3).cast("string")), F.concat(F.lit("- "), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " ")), F.lit("(none)"), F.lit("2. kept "), F.lit("### Q"), F.lit("• last"))
    rows = match.rewritten_bullets(c.select(F.concat_ws("-", "conv_id", "turn").alias("key"), reply.alias("reply")))
    return rows.select("key", "section", "project", F.md5("bullet").alias("bullet"))


@_query
def candidate_pools(spark, sf_dir):
    """Brands and types of parts as projects, so that there are more than a rewriter is shown."""
    j = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("job_uid"), F.concat_ws(" ", F.col("text"), views._pick(["red ring", "blue bolt standard", "green widget large", "economy"], F.col("turn"))).alias("text"))
    p = table(spark, sf_dir, "part").groupBy(F.concat_ws(" ", "p_brand", "p_type").alias("project")).agg(F.min("p_partkey").alias("ord"), F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "p_name", "p_type"))), " ").alias("text"))
    pool = match.candidate_pool(j, p.select("project", "ord", "text"))
    return pool.groupBy("job_uid").agg(F.count("*").alias("n"), F.sum("score").alias("score"), F.max_by("project", F.col("rank")).alias("last"))


@_query
def published(spark, sf_dir):
    """How much each sink has to tell: the digests of new postings and the feed of recent ones."""
    j = views.stored_jobs(spark, sf_dir)
    publish.register_feed(_at(views.AS_OF), "Postings", "urn:feed", "http://localhost/")
    out = publish.publish(views_of.feed(j, status="new"), j.where(F.col("status").isin("new", "active")), ["chat", "mail", "feed"])
    counted = {"chat": F.regexp_count("text", F.lit(r"(?m)^\d+\. <a ")), "mail": F.regexp_count("body", F.lit(r"(?m)^\d+\. ")), "feed": F.regexp_count("xml", F.lit("<entry>"))}
    rows = [out[name].agg(F.coalesce(F.sum(n), F.lit(0)).alias("n_items")).select(F.lit(name).alias("sink"), "n_items") for name, n in counted.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@_query
def values_coerced(spark, sf_dir):
    """Loose numbers, booleans, stipends and period and currency words, made of the events' own numbers."""
    u = F.col("user_id")
    number = F.concat(views._pick(["", " ", "-", "x", "+", "1e"], F.col("event_id")), u.cast("string"), views._pick([".75", "", " ", "!"], F.col("event_id")))
    flag = views._pick(["true", " YES ", "1", "no", "False", "0", "maybe", "", None], F.col("event_id"))
    paid = F.concat(F.lit("₹ "), F.format_number(u * 100, 0), F.when(u % 2 == 0, F.concat(F.lit(" - "), F.format_number(u * 200, 0))).otherwise(""), F.when(u % 5 == 0, "").otherwise(" /month"))
    words, icons = views._pick(["Annual", "monthly", "WEEKLY", "hourly", "daily"], u), views._pick(["fa-rupee", "fa-usd", "FA-INR", "fa-yen"], u)
    got = pay.stipend(paid)
    return table(spark, sf_dir, "events").select(
        "event_id", pay.positive_int(number).alias("whole"), pay.clean_bool(flag).alias("flag"), pay.clean_string(flag).alias("filled"), got["low"].alias("low"), got["high"].alias("high"),
        pay.looked_up(pay.PERIOD_WORDS["board"], words).alias("period"), pay.looked_up(pay.CURRENCY_ICONS, icons).alias("currency"), pay.interval_period(F.concat(F.lit("1 "), words)).alias("unit"),
    )


def _page_log(spark, sf_dir):
    e = views.days(spark, sf_dir)
    return e.groupBy(F.col("event_type").alias("source"), F.col("day").alias("walk"), (F.floor(F.col("event_id") % 300 / 50) + 1).cast("long").alias("page")).agg((F.count("*") * 3).alias("n_items"), (F.min("value") > 0.35).alias("ok"))


@_query
def walk_completeness(spark, sf_dir):
    return outcomes.walk_completeness(_page_log(spark, sf_dir), 24, 5)


@_query
def source_outcomes(spark, sf_dir):
    raw = _judged(spark, sf_dir)
    every = raw.select("source").unionByName(raw.select(F.concat("source", F.lit("-empty")).alias("source")))
    return outcomes.source_outcomes(every, raw, raw.where("keep"))


@_query
def company_outcomes(spark, sf_dir):
    e = views.days(spark, sf_dir)
    f = e.groupBy(F.col("event_type").alias("source"), F.concat(F.lit("co"), (F.col("user_id") % 4).cast("string")).alias("company")).agg(
        ((F.max("value") < 300) & (F.col("event_type") != "error")).alias("succeeded"), F.count("*").alias("n_fetched"), F.lit("not found").alias("error")
    )
    return outcomes.company_outcomes(f)


@_query
def site_stats(spark, sf_dir):
    e = views.days(spark, sf_dir)
    return outcomes.site_stats(e.select(F.col("event_type").alias("site"), F.col("event_id").alias("ord"), F.col("day").alias("n_rows"), (F.col("user_id") % 3).alias("n_jobs"), F.when(F.col("event_id") % 17 == 0, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error")))


@_query
def digest_text(spark, sf_dir):
    return publish.chat_digest(views_of.feed(views.jobs(spark, sf_dir), status="new"))


@_query
def mail_text(spark, sf_dir):
    return publish.mail_digest(views_of.feed(views.jobs(spark, sf_dir), status="new"), "[feed]")


@_query
def feed_entries(spark, sf_dir):
    return publish.feed_entries(views.jobs(spark, sf_dir), _at(views.AS_OF)).select("job_uid", "entry")


@_query
def atom_feed(spark, sf_dir):
    return publish.atom_feed(views.jobs(spark, sf_dir), _at(views.AS_OF), "Postings", "urn:feed", "http://localhost/", 100)


@_query
def near_dup_titles(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(urls.base_domain(urls.host(F.col("url"))).alias("company"), F.regexp_extract(F.coalesce("html", F.lit("")), "(?is)<title>(.*?)</title>", 1).alias("title"))
    return neardup.near_titles(p)


@_query
def keyword_overlap_topk(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("job_uid"), F.concat_ws(" ", F.col("text"), views._pick(["red small ring", "blue bolt promo", "green widget large", "economy standard ring"], F.col("doc_id"))).alias("text"))
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("ord"), F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "p_name", "p_type"))), " ").alias("text"))
    return match.overlap_topk(j, p.select(F.col("p_brand").alias("project"), "ord", "text"), 3)


@_query
def profiles_ranked(spark, sf_dir):
    """Every turn of a conversation is a profile's project: the three that share most with each document."""
    j = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("job_uid"), "text")
    p = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("project"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "text")
    return match.overlap_topk_many(j, p, 3)


def _rewrites(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(" ", F.col("text"), F.concat(F.lit("Cut cost by "), (F.col("conv_id") % 5 + F.col("turn") % 2).cast("string"), F.lit("% over 1,000 runs."))).alias("text"))
    a, b = c.select("conv_id", "turn", F.col("text").alias("source_text")), c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("new_text"))
    return a.join(b, ["conv_id", "turn"])


@_query
def number_guard(spark, sf_dir):
    known, new = text.numbers(F.col("source_text")), text.numbers(F.col("new_text"))
    return _rewrites(spark, sf_dir).select("conv_id", "turn", (F.size(F.array_except(new, known)) == 0).alias("ok"), F.array_join(F.array_sort(new), ",").alias("numbers"))


@_query
def fact_preservation(spark, sf_dir):
    share = match.preservation(F.col("source_text"), F.col("new_text"))
    return _rewrites(spark, sf_dir).select("conv_id", "turn", F.round(share, 9).alias("share"), (share < match.FLOOR).alias("flagged"))


@_query
def tailored(spark, sf_dir):
    jobs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("job_uid"), F.concat_ws(" ", views._pick(["red ring", "blue bolt"], F.col("doc_id")), F.col("text")).alias("text"))
    parts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("ord"), F.array_join(F.array_sort(F.collect_set("p_name")), " ").alias("text"), F.array(F.concat(F.lit("Made "), F.count("*").cast("string"), F.lit(" parts")), F.lit("Shipped")).alias("bullets"))
    projects = parts.select(F.col("p_brand").alias("project"), "ord", "text", "bullets")
    lines = jobs.where("cast(job_uid as long) % 3 = 0").select("job_uid", F.lit("Brand#2").alias("project"), F.lit(0).alias("ord"), F.concat(F.lit("Made "), (F.col("job_uid").cast("long") % 2 * 7).cast("string"), F.lit(" parts")).alias("bullet"))
    t = match.tailor(jobs, projects, lines, 2)
    return t.select("job_uid", F.array_join(F.transform("projects", lambda p: p["project"]), ",").alias("projects"), F.round("preservation", 9).alias("preservation"), F.array_join("flags", ";").alias("flags"), "used_rewrites")


@_query
def page_text(spark, sf_dir):
    return pages.text_of_pages(table(spark, sf_dir, "pages"))


@_query
def page_sanitise(spark, sf_dir):
    return pages.safe_pages(table(spark, sf_dir, "pages"))


@_query
def page_details(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit('<main><div class="x internship_details">'), F.coalesce("html", F.lit("")), F.lit("</div></main>")).alias("html"))
    return pages.details_of_pages(p)


def _listing(spark, sf_dir):
    """Pages that hold a listing card made of their own URL and number."""
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    card = F.concat(
        F.lit('<div class="individual_internship" internshipid="'), k.cast("string"), F.lit('" data-href="/d/'), k.cast("string"), F.lit('"><h3 class="job-internship-name"> Python <b>Development</b></h3><p class="company-name">Acme '),
        (k % 5).cast("string"), F.lit('</p><span class="stipend">₹ '), F.format_number(k * 100 + 1000, 0), F.when(k % 2 == 0, " - 90,000").otherwise(""), F.lit(' /month</span><div class="locations">'), F.when(k % 3 == 0, "Work From Home").otherwise("Pune"),
        F.lit('</div><div class="status-success">'), (k % 9 + 1).cast("string"), F.lit(" days ago</div></div>"),
    )
    return p.select("page_id", F.concat(F.coalesce("html", F.lit("")), card).alias("html"))


@_query
def listing_cards(spark, sf_dir):
    return pages.cards_of_pages(_listing(spark, sf_dir))


@_query
def listing_postings(spark, sf_dir):
    c = pages.cards_of_pages(_listing(spark, sf_dir))
    item = F.struct("id", "href", "title", "company", "stipend", "location", "ago", F.lit("python-dev").alias("slug")).alias("item")
    p = map_items(c.select(item, "pos"), MAPPERS["internshala"], _at(views.AS_OF))
    return p.select("job_uid", "source_native_id", "title", "company", "location", "is_remote", "url", "description", "salary_min", "salary_max", "posted_at")


@_query
def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    reply = F.concat(F.lit("Sure: ```"), F.replace(F.col("props"), F.lit('"k"'), F.concat(F.lit('"'), (F.col("event_id") % 4).cast("string"), F.lit('": " v", "k"'))), F.lit("```"))
    plan = match.plan_of(reply, F.array(F.lit(0), F.lit(1), F.lit(2)))
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.array_join(F.transform(F.map_entries(plan), lambda x: F.concat(x["key"].cast("string"), F.lit("="), x["value"])), ",").alias("plan"))


@_query
def transcript_last_event(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    line = F.when(F.col("turn") % 2 == 1, F.concat(F.lit('{"type":"result","result":"RESULT: {\\"filled\\":[\\"a'), F.col("turn").cast("string"), F.lit('\\"],\\"needs_login\\":true}","is_error":'), F.when(F.col("conv_id") % 2 == 0, "true").otherwise("false"), F.lit("}"))).otherwise(F.coalesce("role", F.lit("")))
    last = match.last_result(c.select(F.col("conv_id").alias("key"), F.col("turn").alias("line_no"), line.alias("line")))
    rep = match.report_of(F.col("result"))
    return last.select("key", "is_error", "found", F.array_join(rep["filled"], ",").alias("filled"), rep["needs_login"].alias("needs_login"), rep["notes"].alias("notes"))


#: The second posting of each payload: that many further on in ids, and so many days older.
SECOND_POS, OLDER_DAYS = 3_603_600_000, 60


def _landed(spark, sf_dir) -> DataFrame:
    """Each board's payload of two postings, made from the postings' view: the posting, and an older one of contract type."""
    p = views.postings(spark, sf_dir)
    second = {"pos": F.col("pos") + SECOND_POS, "source_native_id": (F.col("pos") + SECOND_POS).cast("string"), "title": F.concat("title", F.lit(" II")), "posted_at": F.col("posted_at") - F.make_dt_interval(F.lit(OLDER_DAYS))}
    p = p.select(F.struct(*p.columns).alias("one"), F.struct(*[second.get(c, F.col(c)).alias(c) for c in p.columns]).alias("two"))

    def obj(of, *cols):
        return F.to_json(F.struct(*[of(c).alias(c) if isinstance(c, str) else c for c in cols]))

    a = lambda of, name, c: (of(c) if isinstance(c, str) else c).alias(name)
    named = lambda of, name, c: F.struct(of(c).alias("name")).alias(name)
    bounds = lambda of, lo, hi: (a(of, lo, "salary_min"), a(of, hi, "salary_max"))
    shapes = {
        "remoteok": ('[{"legal":"notice"},', lambda of, iso, seconds, kind: obj(of, a(of, "id", "pos"), a(of, "position", "title"), "company", "url", "location", "description", "salary_min", "salary_max", a(of, "date", F.when(of("pos") % 2 == 0, iso)), a(of, "epoch", seconds)), "]"),
        "himalayas": ('{"jobs":[', lambda of, iso, seconds, kind: obj(of, a(of, "guid", "source_native_id"), "title", a(of, "companyName", "company"), a(of, "applicationLink", "url"), a(of, "locationRestrictions", F.array(of("location"))), *bounds(of, "minSalary", "maxSalary"), a(of, "currency", "salary_currency"), a(of, "salaryPeriod", F.lit("Annual")), a(of, "pubDate", seconds), a(of, "excerpt", "description")), "]}"),
        "jobicy": ('{"jobs":[', lambda of, iso, seconds, kind: obj(of, a(of, "id", "pos"), a(of, "jobTitle", "title"), a(of, "companyName", "company"), "url", a(of, "jobGeo", "location"), a(of, "jobType", F.array(F.lit(kind))), *bounds(of, "salaryMin", "salaryMax"), a(of, "salaryCurrency", "salary_currency"), a(of, "salaryPeriod", F.lit("monthly")), a(of, "pubDate", iso), a(of, "jobDescription", "description")), "]}"),
        "adzuna": ('{"results":[', lambda of, iso, seconds, kind: obj(of, a(of, "id", "source_native_id"), "title", F.struct(of("company").alias("display_name")).alias("company"), F.struct(of("location").alias("display_name")).alias("location"), a(of, "redirect_url", "url"), "description", a(of, "salary_min", of("salary_min") + 0.7), a(of, "salary_max", of("salary_max").cast("double")), a(of, "created", iso)), "]}"),
        "jooble": ('{"jobs":[', lambda of, iso, seconds, kind: obj(of, a(of, "id", "source_native_id"), "title", "company", a(of, "link", "url"), "location", a(of, "snippet", "description"), a(of, "updated", iso)), "]}"),
        "unstop": ('{"data":{"data":[', lambda of, iso, seconds, kind: obj(of, a(of, "id", "pos"), "title", a(of, "updated_at", iso), named(of, "organisation", "company"), a(of, "public_url", F.concat(F.lit("/o/"), of("source_native_id"))), a(of, "region", F.when(of("pos") % 2 == 0, "Online").otherwise(of("location"))), a(of, "details", "description"), F.array(F.struct(F.lit("SQL").alias("name")), F.struct(F.lit(" ").alias("name"))).alias("required_skills"), F.struct(F.when(of("pos") % 5 == 0, "FINISHED").alias("reg_status")).alias("regnRequirements"), F.struct((of("pos") % 2).alias("show_salary"), F.lit(False).alias("not_disclosed"), of("salary_min").alias("min_salary"), of("salary_max").alias("max_salary"), F.lit("fa-rupee").alias("currency"), F.lit("month").alias("pay_in")).alias("jobDetail")), "]}}"),
        "greenhouse": ('{"jobs":[', lambda of, iso, seconds, kind: obj(of, a(of, "id", "pos"), "title", a(of, "company_name", F.when(of("pos") % 2 == 0, of("company"))), named(of, "location", "location"), a(of, "absolute_url", "url"), a(of, "content", F.concat(F.lit("&lt;p&gt;R&amp;D "), of("description"))), a(of, "updated_at", iso)), "]}"),
        "lever": ("[", lambda of, iso, seconds, kind: obj(of, a(of, "id", "source_native_id"), a(of, "text", "title"), a(of, "hostedUrl", "url"), a(of, "workplaceType", views._pick(["Remote", "onsite", "hybrid", None], of("pos"))), F.struct(of("location").alias("location")).alias("categories"), F.struct(of("salary_min").alias("min"), of("salary_max").alias("max"), F.lit("USD").alias("currency"), F.lit("per-year-salary").alias("interval")).alias("salaryRange"), a(of, "createdAt", seconds * 1000), "description"), "]"),
        "ashby": ('{"jobs":[', lambda of, iso, seconds, kind: obj(of, a(of, "id", "source_native_id"), "title", a(of, "jobUrl", F.lit("")), a(of, "applyUrl", "url"), "location", a(of, "isRemote", "is_remote"), a(of, "isListed", F.when(of("pos") % 4 == 0, False)), a(of, "publishedAt", iso), a(of, "descriptionHtml", "description"), F.struct(F.array(F.struct(F.lit("Equity").alias("compensationType"), F.lit(5).cast("long").alias("minValue"), F.lit(6).cast("long").alias("maxValue"), F.lit("USD").alias("currencyCode"), F.lit("1 YEAR").alias("interval")), F.struct(F.lit("Salary").alias("compensationType"), of("salary_min").alias("minValue"), of("salary_max").alias("maxValue"), F.lit("EUR").alias("currencyCode"), F.lit("1 HOUR").alias("interval"))).alias("summaryComponents")).alias("compensation")), "]}"),
        "smartrecruiters": ('{"content":[', lambda of, iso, seconds, kind: obj(of, a(of, "id", "source_native_id"), a(of, "name", "title"), named(of, "company", "company"), a(of, "ref", "url"), F.struct(of("location").alias("city"), F.lit("").alias("region"), F.lit("in").alias("country"), of("is_remote").alias("remote")).alias("location"), a(of, "releasedDate", iso)), "]}"),
    }

    def payload(name):
        before, item, after = shapes[name]
        each = []
        for struct, kind in (("one", "Full-Time"), ("two", "Contract")):
            of = lambda c, struct=struct: F.col(f"{struct}.{c}")
            each.append(item(of, F.date_format(of("posted_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.unix_timestamp(of("posted_at")), kind))
        whole = F.concat(F.lit(before), each[0], F.lit(","), each[1], F.lit(after))
        if name == "lever":
            whole = F.when(F.col("one.pos") % 10 == 0, '{"ok":false,"error":"not found"}').otherwise(whole)
        return F.struct(F.lit(name).alias("board"), whole.alias("payload"))

    every = F.explode(F.array(*map(payload, shapes))).alias("l")
    return p.select(every, F.concat(F.lit("k"), (F.col("one.pos") % 3).cast("string")).alias("company_key")).select("l.*", "company_key")


@_query
def source_mappers(spark, sf_dir):
    """The payloads of all boards read and mapped in one pass: identity, pay and date of each posting.

    One board takes full-time postings only, one drops what is over 35 days old or closed.
    """
    boards = MAPPERS | {"jobicy": replace(MAPPERS["jobicy"], mapper=jobicy_mapper("full"))}
    found, _ = read_boards(_landed(spark, sf_dir), _at(views.AS_OF), boards)
    return found.select("source", "source_native_id", "job_uid", "is_remote", "salary_min", "salary_max", "salary_currency", "salary_period", "posted_at", F.md5("description").alias("description_md5"), "url")


@_query
def board_pages(spark, sf_dir):
    _, log = read_boards(_landed(spark, sf_dir).where(F.col("board").isin("lever", "jobicy", "unstop")), _at(views.AS_OF))
    return log.groupBy("board", "company_key", "ok").agg(F.count("*").alias("n_pages"), F.sum("n_items").alias("n_items"))


@_query
def scraped_frame(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    f = o.select(F.when(k % 2 == 0, "indeed").otherwise("naukri").alias("site"), F.when(k % 11 != 0, F.concat(F.lit(" Engineer "), (k % 9).cast("string"))).alias("title"), F.col("c_name").alias("company"), F.concat(F.lit("https://x.example.com/"), k.cast("string")).alias("job_url"), F.col("o_orderpriority").alias("location"), views._pick(["yes", "0", "maybe", None], k).alias("is_remote"), F.col("o_orderstatus").alias("description"), F.col("o_orderdate").alias("date_posted"), F.when(k % 4 != 0, F.col("o_totalprice")).when(k % 8 == 0, F.lit(float("nan"))).alias("min_amount"), (F.col("o_totalprice") * 2).alias("max_amount"), views._pick(["usd", "INR", "", "JPY"], k).alias("currency"), views._pick(["yearly", "Monthly", "hourly", "daily", None], k).alias("interval"))
    m = map_scrape(f, FEED.pay.rates)
    return m.select("source", "job_uid", "url", "is_remote", "salary_min", "salary_max", "salary_parsed", "salary_raw", "posted_at")


@_query
def source_dedup(spark, sf_dir):
    p = views.postings(spark, sf_dir).select("source", F.when(F.col("pos") % 5 == 0, "").otherwise(F.concat("company", "title")).alias("key"), "pos")
    return identity.first_in(p, ["source", "key"], ["pos"])


@_query
def dates_parsed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = F.unix_timestamp("ts")
    shown = views._pick([0, 1, 2, 3, 4, 5], F.col("event_id"))
    raw = F.when(shown == 0, s.cast("string")).when(shown == 1, (s * 1000).cast("string")).when(shown == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(shown == 3, F.date_format("ts", "yyyy-MM-dd")).when(shown == 4, F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+05:30"))).otherwise("12:30")
    ago = F.concat((F.col("user_id") % 9).cast("string"), views._pick([" days ago", " Weeks ago", " hours ago", " months ago", " eons ago"], F.col("event_id")))
    return e.select("event_id", dates.parse_date(raw).alias("parsed"), dates.posted_ago(ago, _at(views.AS_OF)).alias("posted"))


@_query
def stream_ingest_equals_batch(spark, sf_dir):
    """Six days of events land at a time and are streamed into a bucketed store; each batch writes only what came.

    The SQL is the same life of each posting, worked out over the whole table at once.
    """
    return _streamed(spark, sf_dir).read().select("job_uid", "source", "title", "first_seen_at", "last_seen_at", "last_seen_cycle", "status")


@_query
def stream_writes(spark, sf_dir):
    """What the cycles of the same stream left of the store: per cycle how many uids it was the last to see."""
    store = _streamed(spark, sf_dir)
    return store.read().groupBy("last_seen_cycle").agg(F.count("*").alias("n_rows"), F.count_if(F.col("status") == "active").alias("n_active"))


def _streamed(spark, sf_dir):
    base = views.scratch(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    days = views.days(spark, sf_dir)
    store = Store(spark, f"{base}/store", FEED)

    def prepare(batch, cycle):
        as_of = _at(views.START) + F.make_dt_interval(F.lit(views.CYCLE_DAYS * cycle))
        ok = batch.where("event_type <> 'error'").select(F.col("event_type").alias("source"), (F.col("event_type") != "click").alias("exhaustive")).distinct()
        return _full(_events_as_postings(batch)), ok, as_of

    for cycle in range(views.CYCLES):
        low, high = views.cycle_days(cycle)
        days.where((F.col("day") >= low) & (F.col("day") < high)).select(*schema.names).write.parquet(f"{base}/landed/{cycle}")
        ingest_into(store, spark.readStream.schema(schema).parquet(f"{base}/landed/*"), f"{base}/log", prepare, ["pos"])
    return store


#: Of the events that land late in ``stream_recent``: by how many landings, and the age that passes.
LATE_BY, LATE_AGE = 3, 10


@_query
def stream_recent(spark, sf_dir):
    """Events land by six days; a tenth lands three landings late, a seventh twice, a thirteenth has no date.

    Those over ten days older than the newest of the landings before are dropped. Per event the first landing it passed in.
    """
    base = views.scratch(spark, "recent")
    landing = F.least(F.greatest(F.floor((F.col("day") - 1) / views.CYCLE_DAYS), F.lit(0)), F.lit(views.CYCLES - 1))
    late = F.when(F.col("event_id") % 10 == 3, landing + LATE_BY).otherwise(landing)
    again = F.when(F.col("event_id") % 7 == 0, F.array(late, late + 1)).otherwise(F.array(late))
    rows = views.days(spark, sf_dir).withColumn("landed", F.explode(again)).select(
        F.col("event_id").cast("string").alias("job_uid"), F.when(F.col("event_id") % 13 != 0, F.col("ts")).alias("posted_at"), F.col("landed").cast("long").alias("landed")
    )
    schema = "job_uid STRING, posted_at TIMESTAMP, landed BIGINT"
    for n in range(views.CYCLES + LATE_BY + 1):
        rows.where(F.col("landed") == n).write.parquet(f"{base}/landed/{n}")
        appended(recent(spark.readStream.schema(schema).parquet(f"{base}/landed/*"), LATE_AGE), f"{base}/out", f"{base}/log")
    return written_batches(spark, f"{base}/out", schema).groupBy("job_uid").agg(F.min("landed").alias("landed"))


@_query
def stream_walks(spark, sf_dir):
    """The pages of ``walk_completeness`` land in three parts, dealt by hash, so in no order; the outcomes given last."""
    base = views.scratch(spark, "walks")
    pages = _page_log(spark, sf_dir).withColumn("part", F.pmod(F.xxhash64("source", "walk", "page"), F.lit(3)))
    schema = "source STRING, walk BIGINT, page BIGINT, n_items BIGINT, ok BOOLEAN, landed_at TIMESTAMP"
    landed = _at(views.START) + F.make_dt_interval(F.lit(0), F.col("part").cast("int"))
    for n in range(3):
        pages.where(F.col("part") == n).select("source", "walk", "page", "n_items", "ok", landed.alias("landed_at")).write.parquet(f"{base}/landed/{n}")
        appended(walks.outcomes(spark.readStream.schema(schema).parquet(f"{base}/landed/*"), 24, 5), f"{base}/out", f"{base}/log", "update")
    return walks.last_given(written_batches(spark, f"{base}/out", walks.RESULT)).drop("closed")


@_query
def lifecycle_intervals(spark, sf_dir):
    """The stretches of each posting's life: a user's events of one twentieth are a posting, days are cycles."""
    e = views.days(spark, sf_dir)
    uid = F.concat_ws("-", F.col("user_id").cast("string"), (F.col("event_id") % 20).cast("string"))
    sightings = e.select(uid.alias("uid"), F.col("event_type").alias("source"), F.col("day").alias("cycle"), F.when(F.col("event_id") % 13 != 0, F.col("ts")).alias("posted_at"), F.col("event_id").alias("ord"))
    passes = _outcomes(spark, sf_dir).where("succeeded").select("source", F.col("run_id").alias("cycle"), "exhaustive")
    cycles = e.select(F.col("day").alias("cycle")).distinct().withColumn("as_of", _at(views.START) + F.make_dt_interval(F.col("cycle").cast("int")))
    return snapshot.replay_intervals(sightings, passes, cycles, replace(FEED, retire_days=8))


def queries() -> dict[str, Query]:
    return dict(QUERIES)
