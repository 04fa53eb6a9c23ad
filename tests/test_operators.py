"""Snapshot lifecycle, outcomes, matching, pages, boards, streaming."""

import datetime as dt
import os
import tempfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tideline.functions import text
from tideline.operators import gates, identity, match, neardup, pages, publish, runs, snapshot, views
from tideline.plans.config import Feed, Keywords
from tideline.schemas import SNAPSHOT
from tideline.sources import outcomes
from tideline.sources.boards import MAPPERS, Board, catalogue, jobicy_mapper, map_items, read_boards, read_items, register
from tideline.sources.tables import PROFILE

POSTED = "job_uid string, source string, title string, company string, url string, posted_at timestamp, ord int, pos int"
FULL = Feed(keywords=Keywords(roles=("backend engineer", "backend"), must_have=("go",), require_level=False, exclude=("senior",)), locations=("India",))


def at(day):
    return F.lit(dt.datetime(2026, 1, day).isoformat(" ")).cast("timestamp")


def batch(spark, rows):
    from tideline.schemas import POSTING

    df = spark.createDataFrame(rows, POSTED)
    have = set(df.columns)
    return df.select(*[(F.col(n) if n in have else F.lit(None).cast(t)).alias(n) for n, t in (c.split() for c in POSTING.split(", "))], "ord", "pos")


def test_four_cycles(spark):
    empty = spark.createDataFrame([], SNAPSHOT)
    p = lambda uid, src, o, k, title="t": (uid, src, title, "c", f"u-{src}", None, o, k)
    s = snapshot.merge_cycle(empty, batch(spark, [p("a", "s1", 1, 0, "first"), p("a", "s2", 2, 1, "last"), p("b", "s1", 1, 2), p("c", "s2", 2, 3)]), 1, at(1), ["ord", "pos"])
    rows = {r.job_uid: r for r in s.collect()}
    assert (rows["a"].source, rows["a"].url, rows["a"].title, rows["a"].status) == ("s1", "u-s1", "last", "active")
    assert (rows["b"].status, rows["c"].status, rows["b"].applied) == ("new", "new", False)
    assert [r.job_uid for r in views.new_in_cycle(s, 1).collect()] == ["b", "c"]
    crossed = snapshot.merge_cycle(empty, batch(spark, [p("a", "s1", 1, 0), p("a", "s2", 2, 1)]), 1, at(1), ["ord", "pos"], announce_crosslisted=True)
    assert crossed.first().status == "new"

    ok = spark.createDataFrame([("s1", True)], "source string, exhaustive boolean")
    s2 = snapshot.merge_cycle(s, batch(spark, [p("a", "s2", 2, 0, "again")]), 2, at(2), ["ord", "pos"])
    aged = snapshot.age_out(s2, ok, 2, at(2), Feed())
    status = {r.job_uid: (r.status, r.source) for r in aged.collect()}
    assert status == {"a": ("active", "s1"), "b": ("stale", "s1"), "c": ("new", "s2")}  # s2 did not succeed
    assert snapshot.expired_count(aged).first().n_expired == 1

    s3 = aged.drop("went_stale", "went_deleted")
    gone = snapshot.age_out(s3, ok, 3, at(6), Feed())
    assert {r.job_uid: r.status for r in gone.collect()} == {"a": "deleted", "b": "deleted", "c": "new"}  # a: stale and deleted in one pass
    assert snapshot.expired_count(gone).first().n_expired == 3
    back = snapshot.merge_cycle(gone.drop("went_stale", "went_deleted"), batch(spark, [p("b", "s9", 9, 0)]), 4, at(7), ["ord", "pos"])
    b = {r.job_uid: r for r in back.collect()}["b"]
    assert (b.status, b.source, b.first_seen_at) == ("active", "s1", dt.datetime(2026, 1, 1))
    edge = snapshot.age_out(s3.where("job_uid = 'b'"), ok, 3, at(4), Feed())
    assert edge.first().status == "stale"  # three days are not more than three


def test_window_sources_age_by_date(spark):
    empty = spark.createDataFrame([], SNAPSHOT)
    rows = [("old", "w", "t", "c", "u", dt.datetime(2025, 11, 1), 1, 0), ("young", "w", "t", "c", "u", dt.datetime(2025, 12, 30), 1, 1), ("undated", "w", "t", "c", "u", None, 1, 2)]
    s = snapshot.merge_cycle(empty, batch(spark, rows), 1, at(1), ["ord", "pos"])
    aged = snapshot.age_out(s, spark.createDataFrame([("w", False)], "source string, exhaustive boolean"), 2, at(2), Feed())
    assert {r.job_uid: r.status for r in aged.collect()} == {"old": "stale", "young": "new", "undated": "new"}


def test_counters(spark):
    snap = spark.createDataFrame([("x",)], "job_uid string")
    judged = spark.createDataFrame([("x", True), ("y", True), ("y", True), ("z", False)], "job_uid string, keep boolean")
    assert tuple(runs.upsert_metrics(judged, snap).first()) == (1, 2, 1)
    for ok, err, want in [(0, 0, "success"), (0, 2, "failed"), (1, 1, "partial"), (2, 0, "success")]:
        assert spark.range(1).select(runs.run_status(F.lit(ok), F.lit(err))).first()[0] == want


def test_runs(spark):
    empty = spark.createDataFrame([], "run_id long, started_at timestamp, finished_at timestamp, status string, trigger string, n_new int, error string")
    r = runs.finish_run(runs.start_run(empty, 1, at(1), "manual"), 1, at(2), "partial", n_new=3)
    assert (r.first().status, r.first().n_new) == ("partial", 3)
    r = runs.start_run(r, 2, at(3), "scheduled")
    assert tuple(runs.latest_runs(r).first()) == (2, None, 1)
    fixed = {x.run_id: x for x in runs.reconcile_orphans(r, at(4)).collect()}
    assert (fixed[2].status, fixed[2].error, fixed[1].status) == ("failed", "interrupted", "partial")
    with pytest.raises(ValueError):
        runs.start_run(r, 3, at(1), "whim")
    with pytest.raises(ValueError):
        runs.finish_run(r, 1, at(1), "running")
    due = runs.overdue_cycles(r, at(3)).first()
    assert due.due and not due.late


def test_gates(spark):
    cols = "title string, description string, location string, is_remote boolean, is_internship boolean, salary_bucket string"
    rows = [
        ("Senior Backend Engineer", "go", None, None, False, "pass"), ("Backend Engineer", "rust", None, None, False, "pass"), ("Painter", "go", None, None, False, "pass"), ("Painter Intern", "go", None, None, True, None),
        ("Backend Engineer", "go, 3+ years of experience", None, None, False, "pass"), ("Backend Engineer", "go", "Indiana, USA", False, False, "pass"), ("Backend Engineer", "go", "Pune, India", False, False, "fail"),
        ("Backend Engineer", "go backend", "Indiana", True, False, "unknown"), ("Backend Engineer", "go", None, None, False, "unknown"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {cols}")
    got = {r.i: r for r in gates.judge(df, FULL).collect()}
    assert [got[i].drop_reason for i in range(9)] == ["excluded:senior", "no_relevant_skill", "no_role_match", None, "experience:3y", "location_mismatch", "salary_below_floor", None, None]
    assert got[3].match_score == 20 and got[3].reasons == ["internship", "salary_unknown_flagged"]
    assert got[7].match_score == 25 and got[7].reasons == ["role_title:backend engineer", "role_title:backend"]
    assert got[8].match_score == 15 and got[8].reasons[0] == "salary_unknown_flagged"
    assert got[0].match_score == 0 and got[0].reasons == ["excluded:senior"]


def test_flags(spark):
    empty = spark.createDataFrame([], SNAPSHOT)
    s = snapshot.merge_cycle(empty, batch(spark, [("a", "s", "t", "c", "u", None, 1, 0)]), 1, at(1), ["ord", "pos"])
    e = spark.createDataFrame([("a", "hide", 1), ("a", "unhide", 2), ("a", "apply", 1), ("zz", "apply", 1), ("a", "dance", 9)], "job_uid string, action string, ts int")
    row = snapshot.apply_flags(s, e).first()
    assert (row.hidden, row.applied, row.seen) == (False, True, False)
    assert [r.job_uid for r in snapshot.unmatched_flags(s, e).collect()] == ["zz"]
    d = snapshot.with_details(s, spark.createDataFrame([("a", "long")], "job_uid string, text string")).first()
    assert d.effective_description == "long" and not d.is_preview


def test_views(spark):
    rows = [("a", "Go Dev", "Acme", True, "pass", "new"), ("b", "go ops", "Beta", False, "unknown", "active"), ("c", "Cook", "go_x", None, "pass", "deleted")]
    df = spark.createDataFrame(rows, "job_uid string, title string, company string, is_remote boolean, salary_bucket string, status string").withColumns({c: F.lit(None).cast("boolean") for c in ("hidden", "seen", "applied")} | {"match_score": F.lit(1.0), "posted_at": F.lit(None).cast("timestamp"), "salary_min": F.lit(1)})
    ids = lambda **kw: {r.job_uid for r in views.feed(df, **kw).collect()}
    assert ids() == {"a", "b"} and ids(status="all") == {"a", "b", "c"} and ids(status=[]) == set() and ids(status=["deleted"]) == {"c"}
    assert ids(remote=False, status="all") == {"b", "c"} and ids(remote=False, status="all", null_remote_is_no=False) == {"b"} and ids(q="GO") == {"a", "b"} and ids(q="g_ dev") == {"a"}
    assert [r.job_uid for r in views.page(df, "company", 500, 1).collect()] == ["b", "c"]


def test_outcomes(spark):
    log = [("s", "w1", 1, 50, True), ("s", "w1", 2, 10, True), ("s", "w1", 3, 50, True), ("s", "w2", 1, 0, False), ("s", "w3", 1, 50, True), ("s", "w3", 2, 50, False), ("s", "w4", 1, 50, True), ("s", "w4", 2, 50, True), ("s", "w4", 3, 50, True)]
    got = {r.walk: tuple(r)[2:] for r in outcomes.walk_completeness(spark.createDataFrame(log, "source string, walk string, page int, n_items int, ok boolean"), 50, 3).collect()}
    assert got == {"w1": (2, 60, False, True), "w2": (0, 0, True, False), "w3": (1, 50, False, False), "w4": (3, 150, False, False)}
    f = [("g", "x", True, 3, None), ("g", "y", False, 0, "404"), ("l", "x", False, 0, "a"), ("l", "y", False, 0, None)]
    rows = {r.source: (r.succeeded, r.n_fetched, r.error) for r in outcomes.company_outcomes(spark.createDataFrame(f, "source string, company string, succeeded boolean, n_fetched int, error string")).collect()}
    assert rows == {"g_x": (True, 3, None), "g_y": (False, 0, "y: 404"), "l": (False, 0, "x: a; y: unknown error")}


def test_boards(spark):
    now = at(31)
    one = lambda name, payload: map_items(read_items(spark.createDataFrame([(payload, "acme")], "payload string, company_key string"), MAPPERS[name])[0], MAPPERS[name], now).collect()
    r = one("remoteok", '[{"legal":"x"},{"id":"7","position":" Go  Dev ","company":"Acme Inc","url":"https://A.com/x/?ref=1","date":"2026-01-02T00:00:00+00:00","salary_min":0,"salary_max":90000}]')
    assert len(r) == 1 and (r[0].title, r[0].location, r[0].salary_min, r[0].salary_max, r[0].salary_period, r[0].url, r[0].is_remote) == ("Go Dev", "Remote", None, 90000, None, "https://a.com/x", True)
    r = one("lever", '[{"id":"1","text":"Dev","workplaceType":"hybrid","createdAt":1767225600000,"salaryRange":{"min":1,"max":2,"currency":"USD","interval":"per-month-salary"}}]')
    assert (r[0].source, r[0].is_remote, r[0].posted_at, r[0].salary_period) == ("lever_acme", False, dt.datetime(2026, 1, 1), "month")
    items, log = read_items(spark.createDataFrame([('{"ok":false}', "no"), ("[]", "empty"), ("junk", "bad")], "payload string, company_key string"), MAPPERS["lever"])
    assert items.count() == 0 and {x.company_key: x.ok for x in log.collect()} == {"no": False, "empty": True, "bad": False}
    r = one("ashby", '{"jobs":[{"id":"1","title":"A","isListed":false},{"id":"2","title":"B","isRemote":true,"compensation":{"summaryComponents":[{"compensationType":"Bonus","minValue":1},{"compensationType":"Salary","minValue":5,"maxValue":6,"currencyCode":"USD","interval":"1 YEAR"}]}}]}')
    assert len(r) == 1 and (r[0].salary_min, r[0].salary_period, r[0].company) == (5, "year", "acme")
    r = one("smartrecruiters", '{"content":[{"id":"1","name":"X","location":{"city":"Pune","region":"","country":"in"}}]}')
    assert (r[0].location, r[0].is_remote) == ("Pune, in", False)
    r = one("unstop", '{"data":{"data":[{"id":1,"title":"I","updated_at":"2026-01-30","region":"Online","public_url":"internships/x","required_skills":[{"name":"Go"}],"workfunction":{"name":"Eng"},"jobDetail":{"show_salary":1,"min_salary":10000,"currency":"fa-rupee","pay_in":"month"}},{"id":2,"title":"old","updated_at":"2025-01-01"},{"id":3,"title":"shut","regnRequirements":{"reg_status":"FINISHED"}},{"id":4,"title":"undated"}]}}')
    assert [x.source_native_id for x in r] == ["1", "4"] and (r[0].is_remote, r[0].location, r[0].description, r[0].url, r[0].salary_currency) == (True, None, "Skills: Go\nFunction: Eng", "https://unstop.com/internships/x", "INR")
    r = one("greenhouse", '{"jobs":[{"id":1,"title":"X","location":{"name":"Remote - EU"},"content":"&lt;p&gt;hi","first_published":"2026-01-01"}]}')
    assert (r[0].description, r[0].is_remote, r[0].company) == ("<p>hi", True, "acme")
    assert [x.source for x in catalogue(spark, {"lever", "adzuna", "remoteok"}, companies={"lever": ["a"]}).where("enabled").collect()] == ["remoteok", "lever"]
    register(Board("own", "id:string,t:string", "", lambda i, now: (None, {"source": F.lit("own"), "source_native_id": i("id"), "title": i("t"), "company": F.lit("C")}), 99))
    assert one("own", '[{"id":"1","t":"T"}]')[0].title == "T"
    landed = [("own", '[{"id":"1","t":"T"},null,{"id":"2"}]', "a"), ("jobicy", '{"jobs":[{"id":5,"jobTitle":"J","jobType":["Contract"]},{"id":6,"jobTitle":"K","jobType":["full-time"]}]}', "a"), ("ashby", '{"ok":false}', "b"), ("none", "[]", "a"), ("own", None, "a")]
    postings, log = read_boards(spark.createDataFrame(landed, "board string, payload string, company_key string"), now, MAPPERS | {"jobicy": replace(MAPPERS["jobicy"], mapper=jobicy_mapper("Full"))})
    assert sorted((x.source, x.source_native_id, x.pos, x.company_key) for x in postings.collect()) == [("jobicy", "6", 1, "a"), ("own", "1", 0, "a"), ("own", "2", 2, "a")]
    assert sorted((x.board, x.n_items, x.ok, x.exhaustive) for x in log.collect()) == [("ashby", 0, False, False), ("jobicy", 2, True, True), ("none", 0, False, False), ("own", 0, False, False), ("own", 3, True, False)]
    del MAPPERS["own"]


def test_pages():
    assert pages.page_text("<p>A<b>b</b></p><script>x</script><br>c<li> d </li>e") == "Ab\nc d\ne"
    assert pages.safe_html('<h1 onclick="x">T</h1><a href="javascript:1">j</a><a href="https://x.com/?a=1&b=2">k</a><i>e</i><script>no</script><img src=x>&lt;') == (
        '<h3>T</h3>j<a href="https://x.com/?a=1&amp;b=2" target="_blank" rel="noopener nofollow noreferrer">k</a><em>e</em>&lt;'
    )
    assert pages.safe_html("<p> </p>") == "" and pages.safe_html("abcdef", 3) == "abc" and pages.safe_html(None) == ""
    assert pages.inner_html('<div><section class="a internship_details b"><p>x &amp; <br>y</p></section>z</div>', "internship_details") == "<p>x &amp; <br>y</p>"
    assert pages.inner_html("<p>x</p>", "internship_details") is None
    card = '<div class="individual_internship" internshipid="9" data-href="/i/9"><h3 class="job-internship-name">Go <b>Dev</b></h3><p class="company-name"> Acme </p><span class="status-success">Today</span></div><p class="company-name">out</p>'
    assert pages.listing_cards(card) == [{"id": "9", "href": "/i/9", "title": "Go Dev", "company": "Acme", "stipend": None, "location": None, "ago": "Today"}]


def test_matching(spark):
    jobs = spark.createDataFrame([("j", "Go and Rust services with Kafka"), ("k", "painting")], "job_uid string, text string")
    projects = spark.createDataFrame([("web", 0, "html css", ["Cut 5%"]), ("bus", 1, "kafka go", ["Ran 1,000 jobs", "Saved 7 days"]), ("db", 2, "rust", ["x"])], "project string, ord int, text string, bullets array<string>")
    top = match.overlap_topk(jobs, projects.select("project", "ord", "text"), 2)
    assert [(r.job_uid, r.project, r.score) for r in top.orderBy("job_uid", "rank").collect()] == [("j", "bus", 2), ("j", "db", 1), ("k", "web", 0), ("k", "bus", 0)]
    replies = spark.createDataFrame([("j", "### bus\n- Ran 1000 jobs\n2. Saved 9 days\n(note)\n### ghost\nx")], "key string, reply string")
    lines = match.rewritten_bullets(replies)
    rewrites = lines.select(F.col("key").alias("job_uid"), "project", "ord", "bullet")
    assert [r.bullet for r in lines.orderBy("ord").collect()] == ["Ran 1000 jobs", "Saved 9 days", "x"]
    t = {r.job_uid: r for r in match.tailor(jobs, projects, rewrites, 2).collect()}
    assert t["j"].used_rewrites and [p.project for p in t["j"].projects] == ["bus"] and t["j"].projects[0].bullets == ["Ran 1000 jobs"]
    assert t["j"].preservation == 0.5 and any("rejected" in f for f in t["j"].flags) and any("low" in f for f in t["j"].flags)
    assert not t["k"].used_rewrites and [p.project for p in t["k"].projects] == ["web", "bus"] and t["k"].preservation == 1.0
    known = projects.select(F.lit("j").alias("key"), "project")
    assert [r.project for r in match.unknown_projects(known, lines).collect()] == ["ghost"]
    groups = spark.createDataFrame([([("a", ["x"]), ("b", ["Go lang", "Rust"])], ["go", "rust"])], "g array<struct<category:string,items:array<string>>>, k array<string>")
    assert [g.category for g in groups.select(match.ranked_groups(F.col("g"), F.col("k"))).first()[0]] == ["b", "a"]


def test_plans_and_reports(spark):
    df = spark.createDataFrame([('ok ```{"1": "a", "x": "b", "2": " ", "3": "c"} bye',), ("none",), ('{"1": 5}',), (None,)], "v string")
    got = [r[0] for r in df.select(match.plan_of(F.col("v"), F.array(F.lit(1), F.lit(2)))).collect()]
    assert got[0] == {1: "a"} and got[1] == {} and got[3] == {}
    rep = spark.createDataFrame([('x\nRESULT: {"filled":["a"],"needs_login":true,"notes":"n"}',), ("RESULT: oops",), ("plain",)], "v string").select(match.report_of(F.col("v"))).collect()
    assert rep[0][0].filled == ["a"] and rep[0][0].needs_login and rep[0][0].notes == "n" and "raw tail: plain" in rep[2][0].notes and rep[1][0].filled == []


def test_texts(spark):
    row = spark.createDataFrame([("u<1", "T & Co", "C", "http://x/?a=1&b", True, 1000, 2000, True, "INR", "month", "s", 1.0, None)], "job_uid string, title string, company string, url string, is_remote boolean, salary_min long, salary_max long, salary_parsed boolean, salary_currency string, salary_period string, source string, match_score double, posted_at timestamp").withColumns({"location": F.lit("L"), "salary_bucket": F.lit("pass"), "last_seen_at": F.lit(None).cast("timestamp")})
    text = publish.chat_digest(row).first().text
    assert text == '<b>1 new job</b>\n\n1. <a href="http://x/?a=1&amp;b">T &amp; Co</a> — C\n   Remote · INR 1,000-2,000/month · s'
    assert publish.chat_digest(row.limit(0)).first().text.startswith("<b>0 new jobs</b>")
    many = row.crossJoin(spark.range(25).select("id")).withColumn("job_uid", F.col("id").cast("string"))
    assert publish.chat_digest(many).first().text.endswith("…and 5 more.")
    import xml.dom.minidom

    xml.dom.minidom.parseString(publish.atom_feed(row, at(1), "t", "urn:x", "http://s/").first().xml)
    xml.dom.minidom.parseString(publish.atom_feed(row.limit(0), at(1), "t", "urn:x", "http://s/").first().xml)
    assert publish.mail_digest(row).first().subject == "[feed] 1 new job"
    assert set(publish.publish(row, row, ["chat", "mail"])) == {"chat", "mail"}


def test_mail_lists_every_posting(spark):
    null = lambda c: F.lit(None).cast(c)
    many = spark.range(1005).select(F.col("id").cast("string").alias("job_uid"), F.lit("T").alias("title"), F.lit("C").alias("company"), F.lit("http://x/").alias("url"), null("boolean").alias("is_remote"), F.lit("L").alias("location"), *(null("long").alias(f"salary_{c}") for c in ("min", "max")), null("boolean").alias("salary_parsed"), *(null("string").alias(f"salary_{c}") for c in ("currency", "period", "bucket")), F.lit("s").alias("source"), F.lit(1.0).alias("match_score"), *(null("timestamp").alias(c) for c in ("posted_at", "last_seen_at")))
    mail = publish.mail_digest(many, per_mail=2000).first()
    assert mail.subject == "[feed] 1005 new jobs" and mail.body.count("http://x/") == 1005 and "\n1005. T — C\n" in mail.body
    mails = sorted(publish.mail_digest(many.repartition(3)).collect())
    assert [m.mail for m in mails] == list(range(1, 12)) and mails[10].subject == "[feed] 1005 new jobs (11/11)" and mails[10].body.count("http://x/") == 5
    assert publish.mail_digest(many.limit(0)).count() == 0
    ranks = publish.numbered(many.withColumn("match_score", (F.xxhash64("job_uid") % 7).cast("double")).repartition(5)).collect()
    assert [r.n for r in sorted(ranks, key=lambda r: (-r.match_score, r.job_uid))] == list(range(1, 1006)) and {r.total for r in ranks} == {1005}


def test_text_by_pattern_equals_the_parser(spark, sf):
    import random

    parts = [
        "<p>", "</p>", "<br>", "<br/>", "</br>", "<BR class='x' />", "<p/>", "<pre>", "</PRE >", "<li a=1 b='2' c>", "text", " a b ", "\n", "\xa0", "\u2028", "\x1c", "&amp;", "&amp;lt;", "&nbsp;x", "&lt", "&copy;", "&notit;", "&#39;", "&", "& ", "<", ">", "< b",
        "<script>var t='</p>';</script>", "<script src=x>", "</script>", "<style>p{}</style>", "<noscript>", "</noscript>", "<noscript>no</noscript>", "<!-- c -->", "<!-- <p> -->", "<!doctype html>", "<title>t</title>", "<title>", "<textarea><b>", "<a href='x>y'>", "<a href=x/>", "<x-y>", "<script/>", "</",
    ]
    draw = random.Random(8)
    made = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(4000)] + ["x" * 13_000, "<p>" + "a<b>b</b>\n" * 20_000 + "</p>"]
    given = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(made + given)] + [(-1, None)], "page_id long, html string")
    by_pattern = rows.select("page_id", "html", pages.text_by_pattern(F.col("html")).alias("t")).collect()
    assert [(r.html, r.t) for r in by_pattern if r.t is not None and r.t != pages.page_text(r.html)] == []
    assert all(r.t is not None for r in by_pattern if r.page_id >= len(made)) and sum(r.t is not None for r in by_pattern) > len(given) + 400
    assert {r.page_id: r.page_text for r in pages.text_of_pages(rows).collect()} == {r.page_id: pages.page_text(r.html) for r in rows.collect()}
    assert all(r.t == (None if r.html is None else pages.page_text(r.html)) for r in rows.select("html", pages.text_of_html(F.col("html")).alias("t")).collect())


def test_queries_bound_arrow_batches_by_bytes(spark, sf):
    import __spark_entry__ as entry

    def sizes(batches):
        for batch in batches:
            yield batch.assign(n=len(batch))[["n"]].head(1)

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "256m")
    entry.queries()["page_sanitise"](spark, sf)
    long = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("x"), F.lit(1 << 20)).alias("text"))
    assert max(r.n for r in long.mapInPandas(sizes, "n long").collect()) <= 10


def test_text_of_pages_is_whole(spark):
    from tideline.plans import queries

    lines = [f"line {i} of a long page" for i in range(3000)]
    usual, odd = "".join(f"<p>{x}</p>" for x in lines), "".join(f"<p>{x}" for x in lines) + "<a href='x>y'></a></p>"
    folder = tempfile.mkdtemp(prefix="pages-", dir="/tmp")
    spark.createDataFrame([(1, usual), (2, odd), (3, "<p>" + "x" * 13_000), (4, None)], "page_id long, html string").write.parquet(f"{folder}/pages.parquet")
    got = {r.page_id: r.page_text for r in queries.QUERIES["page_text"](spark, folder).collect()}
    assert got[1] == "\n".join(lines) and got[2] == pages.page_text(odd) and len(got[2]) > 12_000 and got[2].endswith(lines[-1]) and got[3] == "x" * 13_000
    jobs = spark.createDataFrame([("a", "T", usual)], "job_uid string, title string, description string")
    assert jobs.select(match.posting_text(jobs)).first()[0] == "T\n" + "\n".join(lines)[:12_000]


def test_text_of_ampersands_and_open_ends(spark):
    made = {"<title>ver&amp</title>Und": "ver&ampUnd", "long text before and&the": "long text before and&the", "<p>a</p>b & c &": "a\nb & c &", "R&D": "R&D", "&notit; &lt": "&notit; &lt", "a <b": "a <b", "&#39;&eacute;&lt;": "'é<"}
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(made)], "page_id long, html string")
    assert {h: pages.page_text(h) for h in made} == made
    assert [r.page_text for r in pages.text_of_pages(rows).orderBy("page_id").collect()] == list(made.values())
    jobs = rows.select(F.col("page_id").alias("job_uid"), F.lit("T").alias("title"), F.col("html").alias("description"))
    assert [r.t for r in jobs.select("job_uid", match.posting_text(jobs).alias("t")).orderBy("job_uid").collect()] == [f"T\n{t}" for t in made.values()]


@pytest.mark.parametrize("rare", [0, 2, 5, 1000])
def test_many_projects_by_bounds(spark, rare):
    import random

    draw = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    some = lambda n: " ".join(draw.choice(words[: draw.choice([5, 60])]) for _ in range(n))
    jobs = spark.createDataFrame([(str(i), some(draw.randint(0, 30))) for i in range(60)] + [("none", None), ("other", "zz yy")], "job_uid string, text string")
    projects = spark.createDataFrame([(f"p{i:03}", i % 7, some(draw.randint(0, 12))) for i in range(150)], "project string, ord int, text string")
    rows = lambda df: sorted((r.job_uid, r["rank"], r.project, r.ord, r.score) for r in df.collect())
    assert rows(match.overlap_topk_many(jobs, projects, 3, rare)) == rows(match.overlap_topk(jobs, projects, 3))


def test_postings_are_shuffled_once_however_many_blocks_they_meet(spark, monkeypatch):
    files = lambda: {f.getPath(): f.length() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())}
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(80)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(5000)).cast("string"))), " ")
    jobs = spark.range(400).select(F.col("id").cast("string").alias("job_uid"), text.alias("text"))
    projects = spark.range(1000, 1060).select(F.col("id").cast("string").alias("project"), F.col("id").alias("ord"), text.alias("text"))
    best, shuffled = [], []
    for block, met in ((60, 32), (1, 32), (1, 60)):
        monkeypatch.setattr(match, "MET", met, raising=False)
        before = files()
        best.append(sorted(match.overlap_topk_many(jobs, projects, 3, block).collect()))
        shuffled.append(sum(n for f, n in files().items() if f not in before))
    assert best[0] == best[1] == best[2] and len(best[0]) == 1200
    assert max(shuffled[1:]) < 3 * shuffled[0]


def test_rows_of_one_key_are_one_however_they_are_batched(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = [(None if i % 5 == 0 else str(i % 5), [f"w{i % 7}", f"v{i}"] if i % 3 else []) for i in range(40)] + [(f"k{i}", ["a", f"b{i}"]) for i in range(20)]
        packs = match._packed(spark.createDataFrame(rows, "key string, words array<string>"), ["key"], 2, 4, 30).collect()
        found = {}
        for pack in packs:
            ends = [sum(pack.sizes[: i + 1]) for i in range(len(pack.sizes))]
            assert len(pack.key) <= 4 and len(set(pack.words)) == len(pack.words) and ends[-1] == len(pack.codes) and (len(pack.key) == 1 or ends[-1] <= 30)
            for key, size, end in zip(pack.key, pack.sizes, ends, strict=True):
                assert key not in found
                found[key] = sorted(pack.words[c] for c in pack.codes[end - size : end])
        assert found == {key: sorted({w for k, ws in rows if k == key for w in ws}) for key, _ in rows}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_block_of_many_projects_gives_only_its_first(spark):
    import pyarrow as pa

    jobs = pa.table({"job_uid": ["a", "b", "c"], "ids": pa.array([[1, 2, 9], [], [7, 3]], pa.list_(pa.int64()))})
    projects = pa.table({"project": ["z", "y", "x", "w"], "ord": pa.array([5, 5, 2, None], pa.int64()), "ids": pa.array([[1, 2], [2, 1], [3], []], pa.list_(pa.int64()))})
    best = match._best_of_block(jobs, projects, 2).to_pylist()
    assert [(r["job_uid"], r["project"], r["score"]) for r in best] == [("a", "y", 2), ("a", "z", 2), ("b", "w", 0), ("b", "x", 0), ("c", "x", 1), ("c", "w", 0)]
    assert len(match._best_of_block(jobs, projects, 9)) == 12 and len(match._best_of_block(jobs.slice(0, 0), projects, 2)) == 0


def test_first_stale_pass_is_looked_for_once(spark):
    from tideline.plans.views import FEED

    day = lambda n: f"2024-01-{n:02d}"
    cycles = spark.createDataFrame([(n, day(n)) for n in range(1, 9)], "cycle long, as_of string").withColumn("as_of", F.col("as_of").cast("timestamp"))
    passes = spark.createDataFrame([("s", n, None if n % 2 else True) for n in range(1, 9) if n != 3], "source string, cycle long, exhaustive boolean")
    seen = spark.createDataFrame([("u", "s", 2, None, 1)], "uid string, source string, cycle long, posted_at timestamp, ord long")
    lives = snapshot.replay_intervals(seen, passes, cycles, replace(FEED, grace_days=4))
    assert sorted((r.from_cycle, r.to_cycle, r.status) for r in lives.collect()) == [(2, 3, "new"), (4, 6, "stale"), (7, 8, "deleted")]
    assert lives._jdf.queryExecution().optimizedPlan().toString().count("filter(passes") == 2


def test_payloads_are_read_once(spark):
    from tideline.sources.boards import MAPPERS, map_items, read_boards, read_items

    rows = [("lever", '[{"id":"1","text":"Cook"}]', "k"), ("lever", "[]", "k"), ("lever", '{"ok":false}', "k"), ("lever", None, "k"), ("none", "[]", "k")]
    landed = spark.createDataFrame(rows, "board string, payload string, company_key string")
    as_of = F.lit("2024-02-01").cast("timestamp")
    found, log = read_boards(landed, as_of, {"lever": MAPPERS["lever"]})
    items, _ = read_items(landed.drop("board"), MAPPERS["lever"])
    for got in (found, map_items(items, MAPPERS["lever"], as_of)):
        assert [(r.title, r.source) for r in got.collect()] == [("Cook", "lever_k")]
        assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert sorted(r.n_items for r in log.collect()) == [0, 0, 0, 0, 1]


@pytest.mark.parametrize("few", [0, 64])
def test_overlap_reads_a_posting_once(spark, monkeypatch, few):
    monkeypatch.setattr(match, "FEW_PROJECTS", few)
    jobs = spark.createDataFrame([("a", "red blue red ring"), ("a", "blue"), ("b", None), ("c", "green")], "job_uid string, text string")
    projects = spark.createDataFrame([("z", 1, "red"), ("y", 2, "blue red"), ("x", 2, None), ("w", 3, "green")], "project string, ord int, text string")
    best = match.overlap_topk(jobs, projects, 2)
    want = [("a", "y", 2, 3, 1), ("a", "z", 1, 1, 2), ("b", "z", 1, 0, 1), ("b", "x", 2, 0, 2), ("c", "w", 3, 1, 1), ("c", "z", 1, 0, 2)]
    assert [tuple(r) for r in best.orderBy("job_uid", "rank").collect()] == want
    assert dict(best.dtypes) == {"job_uid": "string", "project": "string", "ord": "int", "score": "bigint", "rank": "bigint"}
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == (1 if few else 2)  # of a posting once, and of the projects if they are joined
    assert not match.overlap_topk(jobs, projects.limit(0), 2).collect()


def test_near_titles(spark):
    rows = [("Acme Inc", "Senior Backend Engineer"), ("acme", "Backend Engineer, Senior"), ("Acme", "Backend Engineers Senior"), ("Acme", "Cook"), ("Beta", "Backend Engineers Senior")]
    got = neardup.near_titles(spark.createDataFrame(rows, "company string, title string")).collect()
    assert {(r.a, r.b) for r in got} == {("backend engineer senior", "senior backend engineer"), ("backend engineer senior", "backend engineers senior"), ("backend engineers senior", "senior backend engineer")}
    words = ["go", "rust", "dev", "ops", "lead", "data", "ml", "qa"]
    import itertools

    titles = [" ".join(c) for c in itertools.combinations(words, 4)]
    got = {(r.a, r.b) for r in neardup.near_titles(spark.createDataFrame([("x", t) for t in titles], "company string, title string"), 80.0).collect()}
    key = lambda t: " ".join(sorted(t.split()))
    assert got == {(a, b) for a in titles for b in titles if a < b and neardup.indel_ratio(key(a), key(b)) >= 80.0}


@pytest.mark.parametrize("few", [0, 20, 1000])
def test_near_titles_of_small_and_large_companies(spark, few):
    import random

    draw = random.Random(6)
    words = ["engineer", "backend", "senior", "data", "platform", "öko", "ml", "x"]
    rows = [(c, " ".join(draw.choice(words) + draw.choice(["", "", "s", "1"]) for _ in range(draw.randint(1, 7)))) for c, n in (("A", 12), ("B", 90), (None, 10)) for _ in range(n)]
    got = {(r.company, r.a, r.b, round(r.ratio, 9)) for r in neardup.near_titles(spark.createDataFrame(rows, "company string, title string"), few=few).collect()}
    named = spark.createDataFrame(rows, "company string, title string").select(text.norm_company(F.col("company")), text.norm_title(F.col("title"))).distinct().collect()
    key = lambda t: " ".join(sorted(t.split()))
    want = {(c, a, b, round(neardup.indel_ratio(key(a), key(b)), 9)) for c, a in named for d, b in named if c == d and a < b and neardup.indel_ratio(key(a), key(b)) >= 88}
    assert got == want and want


def test_near_pairs_equal_the_plain_ratio():
    import random

    draw = random.Random(3)
    texts = ["", "a", "é" * 20 + "x", "e" * 40, "e" * 36 + "b"]
    for n in (5, 30, 63, 64, 65, 128, 200, 511, 600):
        text = "".join(draw.choice("abc de") for _ in range(n))
        texts += [text, text[1:] + "z", text[: n // 2] + "qq" + text[n // 2 :], text.replace("a", "b", 3), text[::-1]]
    want = {(i, j): r for i in range(len(texts)) for j in range(i + 1, len(texts)) if (r := neardup.indel_ratio(texts[i], texts[j])) >= 88}
    i, j, ratio = neardup.near_pairs(texts, None, 88.0)
    assert dict(zip(zip(i.tolist(), j.tolist(), strict=True), ratio.tolist(), strict=True)) == want and len(want) > 20
    i, j, ratio = neardup.near_pairs(texts[:20], texts[20:], 88.0)
    assert dict(zip(zip(i.tolist(), (j + 20).tolist(), strict=True), ratio.tolist(), strict=True)) == {k: r for k, r in want.items() if k[0] < 20 <= k[1]}


def test_near_titles_of_many_blocks(spark, monkeypatch):
    import random

    monkeypatch.setattr(neardup, "BLOCK", 20)
    draw = random.Random(7)
    words = ["engineer", "backend", "senior", "data", "platform", "ml", "x"]
    titles = sorted({" ".join(draw.choice(words) + draw.choice(["", "s", "1"]) for _ in range(draw.randint(1, 6))) for _ in range(150)})
    got = sorted((r.a, r.b, r.ratio) for r in neardup.near_titles(spark.createDataFrame([("c", t) for t in titles], "company string, title string"), few=0).collect())
    key = lambda t: " ".join(sorted(t.split()))
    assert got == sorted((a, b, r) for a in titles for b in titles if a < b and (r := neardup.indel_ratio(key(a), key(b))) >= 88) and got


def test_dedup_keeps_blank_keys(spark):
    df = spark.createDataFrame([("s", "k", 2), ("s", "k", 1), ("s", "", 3), ("s", None, 4)], "source string, key string, pos int")
    assert sorted(r.pos for r in identity.first_in(df, ["source", "key"], ["pos"]).collect()) == [1, 3, 4]


def test_stream_is_idempotent(spark, tmp_path):
    from tideline.streaming.ingest import ingest

    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1)], "k string, v int").write.parquet(src)

    def merge(old, new, cycle):
        rows = new if old is None else old.unionByName(new)
        return rows.groupBy("k").agg(F.sum("v").cast("int").alias("v"))

    run = lambda: ingest(spark.readStream.schema("k string, v int").parquet(src), str(tmp_path / "out"), str(tmp_path / "log"), merge)
    assert run().collect() == [("a", 1)]
    spark.createDataFrame([("a", 2), ("b", 5)], "k string, v int").write.mode("append").parquet(src)
    assert sorted(map(tuple, run().collect())) == [("a", 3), ("b", 5)]
    assert sorted(map(tuple, run().collect())) == [("a", 3), ("b", 5)]
    spark.createDataFrame([("c", 1)], "k string, v int").write.mode("append").parquet(src)
    assert sorted(map(tuple, run().collect())) == [("a", 3), ("b", 5), ("c", 1)]
    assert sorted(os.listdir(str(tmp_path / "out"))) == ["cycle=1", "cycle=2"]


def test_profiles(spark, tmp_path):
    from tideline.sources.tables import read_profiles

    (tmp_path / "p.json").write_text('{"person":"x","projects":[{"name":"n","tech":["go"]}]}')
    assert read_profiles(spark, str(tmp_path / "p.json")).first().projects[0].tech == ["go"] and "skills" in PROFILE


def test_feed_count_counts_once_what_both_cycles_list(spark, sf, monkeypatch):
    from tideline.plans import queries, views
    from tideline.schemas import SNAPSHOT_COLUMNS

    counted, totals = [], queries.views_of.totals
    monkeypatch.setattr(queries.views_of, "totals", lambda jobs, kinds: counted.append(jobs) or totals(jobs, kinds))
    total = {r["view"]: r["total"] for r in queries.QUERIES["feed_count"](spark, sf).collect()}["all"]
    rows, once = counted[0].collect(), views.jobs(spark, sf).collect()
    known = [r for r in rows if r.first_seen_at < r.last_seen_at]
    assert 0 < len(known) < sum(r.first_seen_at < known[0].last_seen_at for r in rows) < len(rows) == len(once) == total
    assert {(r.status, r.last_seen_cycle) for r in known} == {("active", 2)}
    same = [c for c in SNAPSHOT_COLUMNS if c not in ("status", "last_seen_at", "last_seen_cycle")]
    assert {tuple(r[c] for c in same) for r in rows} == {tuple(r[c] for c in same) for r in once}


def test_relisted_postings_keep_the_rows_of_jobs_where_cycles_share_a_uid(spark, sf, monkeypatch):
    from tideline.plans import views

    few = views.postings(spark, sf).withColumn("company", F.lit("Acme")).withColumn("location", F.lit(None).cast("string"))
    monkeypatch.setattr(views, "postings", lambda *_: few.withColumn("title", views._pick(views.TITLES, F.floor(F.col("pos") / 3).cast("long"))))
    same = ["job_uid", "source", "source_native_id", "url", "title", "is_remote", "salary_min", "salary_bucket", "is_internship", "posted_at", "first_seen_at"]
    rows, once = (sorted(f(spark, sf).select(same).collect(), key=str) for f in (views.relisted_jobs, views.jobs))
    assert rows == once and 0 < len(rows) < 9
