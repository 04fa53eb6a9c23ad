"""Vectors: (input, expected) as rows through the expressions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline.functions import dates, pay, text, urls
from tideline.operators import gates
from tideline.operators.neardup import indel_ratio

UTC = dt.timezone.utc
NOW = "2026-07-15 12:00:00"


def check(spark, make, vectors):
    rows = [(i, v, w) for i, (v, w) in enumerate(vectors)]
    df = spark.createDataFrame([(i, v) for i, v, _ in rows], "i int, v string")
    got = {r.i: r.x for r in df.select("i", make(F.col("v")).alias("x")).collect()}
    for i, v, w in rows:
        assert got[i] == w, (v, got[i], w)


def test_company(spark):
    check(spark, text.norm_company, [("Acme Technologies Pvt. Ltd.", "acme"), ("Systems Ltd", "systems ltd"), ("Café Labs", "cafe"), ("Group One Inc", "group one"), (None, ""), ("incinc", "incinc")])


def test_title_and_location(spark):
    check(spark, text.norm_title, [("  Sr. Backend-Engineer (Go/Rust) ", "sr backend engineer go rust"), ("Back–end", "backend"), ("Écrivain", "ecrivain"), ("", "")])
    check(spark, text.norm_location, [("Bangalore, India", "bengaluru india"), ("Anywhere", "remote"), (None, ""), ("WFH / BLR", "remote bengaluru")])


def test_clean_text(spark):
    check(spark, text.clean_text, [("  a   b\n", "a b"), ("​﻿ ", None), ("ﬁne １", "fine 1"), (None, None), ("x​y", "xy")])


def test_hash(spark):
    import hashlib

    df = spark.createDataFrame([("Acme Labs", "SDE Intern", "Bangalore")], "c string, t string, l string")
    assert df.select(text.content_hash(F.col("c"), F.col("t"), F.col("l"))).first()[0] == hashlib.sha256(b"acme|sde intern|bengaluru").hexdigest()


def test_canonical_url(spark):
    check(
        spark,
        urls.canonical_url,
        [
            ("HTTPS://Jobs.Example.com/A/b/?utm_source=x&b=2&a=1&ref=q#frag", "https://jobs.example.com/A/b?a=1&b=2"),
            ("https://x.com/", "https://x.com/"), ("https://x.com", "https://x.com"), ("javascript:alert(1)", ""), ("data:text/html,x", ""), ("/relative/path", "/relative/path"), ("", ""), (None, ""),
            ("//host.com/a/", "https://host.com/a"), ("https://x.com/a?b=&c=1", "https://x.com/a?c=1"), ("https://x.com/a?q=a%20b", "https://x.com/a?q=a+b"), ("http://x.com/a//", "http://x.com/a"),
            ("https://x.com/a?UTM_Medium=1&GCLID=2&z=%zz", "https://x.com/a?z=%25zz"),
        ],
    )


def test_hosts(spark):
    check(spark, lambda c: urls.base_domain(urls.host(c)), [("https://www.linkedin.com/x", "linkedin.com"), ("https://a.b.foo.co.in:80/", "foo.co.in"), ("http://localhost:1", "localhost"), ("http://u:p@foo.com", "foo.com")])
    check(spark, urls.is_private_host, [("http://localhost:8770", True), ("http://10.1.2.3", True), ("http://172.20.0.1/", True), ("http://172.40.0.1/", False), ("https://a.example.com", False), ("http://x.local/", True), ("", True)])
    check(spark, urls.applicant_system, [("https://boards.greenhouse.io/x", "greenhouse"), ("https://jobs.lever.co/x", "lever"), ("https://example.com/greenhouse.io", None)])
    check(spark, lambda c: urls.is_page_of(c, "internshala.com"), [("https://internshala.com/x", True), ("https://evil.com/internshala.com", False), ("https://internshala.com.evil.com/", False)])


def test_dates(spark):
    at = lambda *a: dt.datetime(*a)
    check(
        spark,
        dates.parse_date,
        [("1767225600", at(2026, 1, 1)), ("1767225600000", at(2026, 1, 1)), ("2026-01-01T00:00:00Z", at(2026, 1, 1)), ("2026-01-01T05:30:00+05:30", at(2026, 1, 1)), ("2026-01-01", at(2026, 1, 1)), ("12:30", None), ("", None), ("soon", None), (None, None), ("99999999999999999", None)],
    )
    now = at(2026, 7, 15, 12)
    ago = lambda c: dates.posted_ago(c, F.lit(NOW).cast("timestamp"))
    check(spark, ago, [("Today", now), ("Few hours ago", now), ("3 days ago", at(2026, 7, 12, 12)), ("2 weeks ago", at(2026, 7, 1, 12)), ("1 Month ago", at(2026, 6, 15, 12)), ("5 hours ago", now), ("later", None), (None, None)])


def test_pay(spark):
    amount = lambda cur, per: lambda c: pay.to_month(c.cast("double"), F.lit(cur), F.lit(per), {"USD": 83.0})
    check(spark, amount("USD", "year"), [("60000", 415000), ("0", 0)])
    check(spark, amount("INR", "hour"), [("100", 17333)])
    check(spark, amount("INR", "month"), [("0.5", 0), ("1.5", 2), ("2.5", 2)])
    check(spark, pay.positive_int, [("12", 12), ("0", None), ("-3", None), ("12.9", 12), ("x", None), (None, None), (" 7 ", 7)])
    low_high = lambda c: F.concat_ws(",", pay.stipend(c)["low"].cast("string"), pay.stipend(c)["high"].cast("string"))
    check(spark, low_high, [("₹ 15,000 - 30,000 /month", "15000,30000"), ("₹ 20,000 /month", "20000,20000"), ("Unpaid", ""), (None, "")])
    check(spark, pay.clean_bool, [("Yes", True), ("0", False), ("maybe", None), (None, None)])
    check(spark, pay.interval_period, [("1 YEAR", "year"), ("1 HOUR", "hour"), ("none", None), (None, None)])


@pytest.mark.parametrize("remote,intern,want", [(True, False, "pass"), (False, False, "fail"), (None, False, "fail"), (False, True, "pass")])
def test_bucket(spark, remote, intern, want):
    row = spark.range(1).select(pay.bucket(F.lit(10), F.lit(40000), F.lit(True), F.lit(intern), F.coalesce(F.lit(remote).cast("boolean"), F.lit(False)), {"internship": 0, "remote": 30000, "in_office": 80000}))
    assert row.first()[0] == want


def test_keywords(spark):
    check(spark, lambda c: gates.matches(c, "C++"), [("knows c++ well", True), ("c", False), ("abc++", False)])
    check(spark, lambda c: gates.matches(c, "sde-2"), [("sde-2 role", True), ("sde-25", False)])
    check(spark, lambda c: gates.matches(c, " "), [("anything", False)])
    check(spark, gates.detect_internship, [("SDE Intern", True), ("International Sales", False), ("Apprentice", True), ("internal", False)])


def test_required_years(spark):
    check(
        spark,
        gates.required_years,
        [
            ("3+ years of experience", 3), ("3-5 years experience", 3), ("2 to 4 yrs exp", 2), ("experience of 3 years", 3), ("2 year contract", None), ("2+ years with python and 6+ years of software experience", 6),
            ("10 – 12 years’ relevant experience", 10), ("5 years. experience", None), ("exports for 3 years", None), (None, None), ("minimum 4 yrs. of experience", None),
        ],
    )


def test_years_by_clause_equal_a_search_with_looking_ahead(spark):
    """Every order and distance of mentions, against one search for a mention and what is near it."""
    import itertools
    import random
    import re

    token = re.compile(r"(\d{1,2})\s*(?:\+\s*)?(?:(?:-|–|to)\s*\d{1,2}\s*)?\+?\s*(?:years?|yrs?)")
    near = re.compile(r"[^.\n]{0,40}?(?:experience|exp(?![a-z]))")
    after = re.compile(r"(?:experience|exp(?![a-z]))[^.\n]{0,40}?(\d{1,2})\s*\+?\s*(?:years?|yrs?)")

    def slow(text):
        hits = [int(m[1]) for m in token.finditer(text) if near.match(text, m.end())] + [int(m[1]) for m in after.finditer(text)]
        return max(hits, default=None)

    parts = ["3 years", "12345 yrs", "7+ years", "1 - 9 year", "2 to 3 to 4 years", "experience", "exp", "exports", " of ", ". ", "\n", "x" * 38, "y" * 40, " ", "8y", "yearsexp"]
    draw = random.Random(3)
    texts = ["".join(p) for p in itertools.product(parts, repeat=2)] + ["".join(draw.choice(parts) for _ in range(draw.randint(3, 30))) for _ in range(3000)] + ["1yr" * 5000 + " exp", "exp" + "1yr" * 5000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", gates.required_years(F.col("t")).alias("y")).collect()
    assert [(r.t, r.y) for r in rows if r.y != slow(r.t)] == []


def test_indel_ratio():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return 200.0 * t[-1][-1] / (len(a) + len(b))

    for a, b in [("backend engineer", "engineer backend dev"), ("a", "b"), ("", "x"), ("kitten", "sitting"), ("é😀x", "x😀")]:
        assert indel_ratio(a, b) == slow(a, b)
    assert indel_ratio("", "") == 100.0
