"""The bucketed store, lives as intervals, late postings and walks on streams, against plain versions."""

import datetime as dt
import glob
import json
import os
import random
from dataclasses import replace

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tideline.operators import snapshot
from tideline.plans.config import Feed
from tideline.schemas import POSTING, SNAPSHOT
from tideline.sources.outcomes import walk_completeness
from tideline.streaming import walks
from tideline.streaming.late import appended, recent, written_batches
from tideline.streaming.store import Store, folded, ingest_into

FEED = Feed(grace_days=2, retire_days=4)
START = dt.datetime(2024, 1, 1)


def day(n):
    return F.lit(str(START + dt.timedelta(days=n))).cast("timestamp")


def postings(spark, rows):
    """(uid, source, title, posted day or None, pos) as postings."""
    df = spark.createDataFrame([(u, s, t, None if p is None else START + dt.timedelta(days=p), i) for u, s, t, p, i in rows], "job_uid string, source string, title string, posted_at timestamp, pos long")
    have = set(df.columns)
    return df.select(*[(F.col(n) if n in have else F.lit(None).cast(t)).alias(n) for n, t in (c.split() for c in POSTING.split(", "))], "pos")


def passes(spark, ok):
    return spark.createDataFrame(ok, "source string, exhaustive boolean")


def cycles_of(seed, uids, cycles, per):
    """Per cycle: postings, with repeats, and the sources that succeeded; source c shows a window only."""
    draw = random.Random(seed)
    out = []
    for n in range(1, cycles + 1):
        rows = [(f"u{draw.randrange(uids)}", draw.choice("abc"), f"t{n}", draw.choice([None, n - 1, n - 9]), i) for i in range(per)]
        out.append((rows, [(s, s != "c") for s in "abc" if draw.random() < 0.7]))
    return out


def rows_of(df):
    return sorted(tuple(r) for r in df.select("job_uid", "source", "title", "posted_at", "first_seen_at", "last_seen_at", "last_seen_cycle", "status").collect())


def test_store_equals_the_whole_snapshot_and_writes_what_came(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), FEED, buckets=8)
    assert store.last() is None and store.read().count() == 0
    whole = spark.createDataFrame([], SNAPSHOT)
    first = [(f"u{i}", "abc"[i % 3], "t1", None, i) for i in range(2000)]
    life = [(first, [("a", True)]), *cycles_of(1, 60, 6, 30)]
    for n, (batch, ok) in enumerate(life, 1):
        store.merge(postings(spark, batch), passes(spark, ok), n, day(n), ["pos"])
        merged = snapshot.merge_cycle(whole, postings(spark, batch), n, day(n), ["pos"])
        aged = snapshot.age_out(merged, passes(spark, ok), n, day(n), FEED).drop("went_stale", "went_deleted")
        aged.write.parquet(str(tmp_path / f"whole{n}"))
        whole = spark.read.parquet(str(tmp_path / f"whole{n}"))
        assert rows_of(store.read()) == rows_of(whole), n
    wrote = {int(p.split("cycle=")[1].split("/")[0]): 0 for p in glob.glob(f"{store.path}/rows/cycle=*/")}
    for p in glob.glob(f"{store.path}/rows/cycle=*/bucket=*/*.parquet"):
        wrote[int(p.split("cycle=")[1].split("/")[0])] += pq.ParquetFile(p).metadata.num_rows
    assert wrote[1] == 2000 and all(n <= 60 for c, n in wrote.items() if c > 1)  # a cycle's 30, and what of the cycles before is folded with it
    assert sorted(os.listdir(f"{store.path}/manifest")) == ["cycle=6", "cycle=7"]
    named = {(b, c) for n in (6, 7) for b, parts in store.manifest(n).items() for c, _ in parts}
    there = {(int(p.split("bucket=")[1]), int(p.split("cycle=")[1].split("/")[0])) for p in glob.glob(f"{store.path}/rows/cycle=*/bucket=*")}
    assert there == named
    assert rows_of(store.read(6)) == rows_of(spark.read.parquet(str(tmp_path / "whole6")))


def test_store_takes_up_a_cycle_that_broke_off(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), FEED, buckets=4)
    life = cycles_of(2, 40, 3, 25)
    for n, (batch, ok) in enumerate(life, 1):
        store.merge(postings(spark, batch), passes(spark, ok), n, day(n), ["pos"])
    want = rows_of(store.read())
    store.merge(postings(spark, [("other", "a", "x", None, 0)]), passes(spark, []), 3, day(3), ["pos"])
    assert rows_of(store.read()) == want  # done is done
    store._remove(f"{store.path}/manifest/cycle=3")
    store.merge(postings(spark, life[2][0]), passes(spark, life[2][1]), 3, day(3), ["pos"])
    assert rows_of(store.read()) == want
    store.merge(postings(spark, []), passes(spark, [("a", None)]), 4, day(4), ["pos"])  # nothing came; a null flag is exhaustive
    assert {r.status for r in store.read().where("source = 'a' and last_seen_cycle < 4").collect()} <= {"stale", "deleted"}


def test_folding_keeps_few_pieces():
    parts, wrote = [(0, 1_000_000)], 0
    for n in range(1, 400):
        stays, fold = folded(parts, n, 100)
        size = 100 + sum(x for _, x in fold)
        parts, wrote = [*stays, (n, size)], wrote + size
        assert len(parts) < 12
    assert wrote < 400 * 100 * 12 and parts[0] == (0, 1_000_000)


def test_ingest_is_idempotent(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), FEED, buckets=4)
    schema = postings(spark, []).schema
    run = lambda: ingest_into(store, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), lambda b, n: (b, passes(spark, [("a", True)]), day(n)), ["pos"])
    postings(spark, [("x", "a", "1", None, 0), ("y", "a", "1", None, 1)]).write.parquet(str(tmp_path / "in"))
    assert {(r.job_uid, r.status) for r in run().collect()} == {("x", "new"), ("y", "new")}
    postings(spark, [("x", "b", "2", None, 2)]).write.mode("append").parquet(str(tmp_path / "in"))
    want = {("x", "active", "a", "2"), ("y", "stale", "a", "1")}
    for _ in range(2):
        assert {(r.job_uid, r.status, r.source, r.title) for r in run().collect()} == want


def test_intervals_equal_cycle_by_cycle(spark):
    feed = replace(FEED, grace_days=3)
    life = cycles_of(7, 25, 20, 8)
    state, seen, out = {}, [], {}
    for n, (batch, ok) in enumerate(life, 1):
        known = set(state)
        for u, s, _, p, i in batch:
            seen.append((u, s, n, None if p is None else START + dt.timedelta(days=p), n * 1000 + i))
            if u not in state:
                state[u] = {"source": s, "first": n}
            state[u] |= {"last": n, "posted": p, "times": state[u].get("times", 0) + 1 if u not in known else 0}
            state[u]["status"] = "active" if u in known or state[u]["times"] > 1 else "new"
        for u, x in state.items():
            mode = dict(ok).get(x["source"])
            if mode is not None:
                old = (x["first"] if x["posted"] is None else x["posted"]) < n - feed.retire_days
                if x["status"] in ("new", "active") and x["last"] < n and (mode or old):
                    x["status"] = "stale"
                if x["status"] == "stale" and x["last"] < n - feed.grace_days:
                    x["status"] = "deleted"
            out[u, n] = x["status"]
    sightings = spark.createDataFrame(seen, "uid string, source string, cycle long, posted_at timestamp, ord long")
    ok = spark.createDataFrame([(s, n, e) for n, (_, x) in enumerate(life, 1) for s, e in x], "source string, cycle long, exhaustive boolean")
    times = spark.createDataFrame([(n, START + dt.timedelta(days=n)) for n in range(1, 21)], "cycle long, as_of timestamp")
    got = snapshot.replay_intervals(sightings, ok, times, feed).collect()
    assert {(r.uid, n): r.status for r in got for n in range(r.from_cycle, r.to_cycle + 1)} == out
    assert len(got) == sum(out.get((u, n - 1)) != s for (u, n), s in out.items())  # as few rows as can be
    assert {"new", "active", "stale", "deleted"} == set(out.values())


def test_late_postings_drop_and_state_goes(spark, tmp_path):
    schema = "job_uid string, posted_at timestamp"
    keep = []
    for n, rows in enumerate([[("a", 0), ("b", 1), ("n", None)], [("c", 30), ("a", 0), ("n", None)], [("late", 5), ("edge", 26), ("c", 30), (None, 29)], [("far", 60)], [("z", 61)]]):
        made = [(u, None if p is None else START + dt.timedelta(days=p)) for u, p in rows]
        spark.createDataFrame(made, schema).write.parquet(str(tmp_path / "in" / str(n)))
        query = appended(recent(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*")), 5), str(tmp_path / "out"), str(tmp_path / "log"))
        keep.append(sum(s["numRowsTotal"] for s in json.loads(query.lastProgress.json)["stateOperators"]))
    got = sorted((str(r.job_uid) for r in written_batches(spark, str(tmp_path / "out"), schema).collect()))
    assert got == sorted(["a", "b", "n", "c", "n", "edge", "None", "far", "z"])
    assert keep[-1] <= 2 < max(keep)


@pytest.mark.parametrize("seed", [0, 1])
def test_walks_in_any_order(spark, tmp_path, seed):
    draw = random.Random(seed)
    pages = [(s, w, p, draw.choice([0, 3, 10, 10, 10, None]), draw.random() < 0.9, START) for s in ("a", "b") for w in range(12) for p in range(1, draw.randint(2, 8)) for _ in range(draw.choice([1, 1, 2]))]
    draw.shuffle(pages)
    schema = "source string, walk long, page long, n_items long, ok boolean, landed_at timestamp"
    for n in range(3):
        spark.createDataFrame(pages[n::3], schema).write.parquet(str(tmp_path / "in" / str(n)))
        appended(walks.outcomes(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*")), 10, 5), str(tmp_path / "out"), str(tmp_path / "log"), "update")
    got = walks.last_given(written_batches(spark, str(tmp_path / "out"), walks.RESULT))
    want = walk_completeness(spark.createDataFrame(pages, schema).drop("landed_at"), 10, 5)
    key = lambda r: tuple(r[c] for c in ("source", "walk", "n_pages", "n_items", "failed", "exhausted"))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert not got.where("closed").count()
    # time passes with another walk's pages: the timer closes the first ones, and what lands behind the watermark is dropped
    for n, rows in enumerate([[("z", 1, 1, 0, True, START + dt.timedelta(days=9))], [("z", 2, 1, 0, True, START + dt.timedelta(days=10)), ("a", 0, 1, 99, True, START)]], 3):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in" / str(n)))
        appended(walks.outcomes(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*")), 10, 5), str(tmp_path / "out"), str(tmp_path / "log"), "update")
    after = walks.last_given(written_batches(spark, str(tmp_path / "out"), walks.RESULT)).where("source <> 'z'")
    assert sorted(map(key, after.collect())) == sorted(map(key, want.collect())) and after.where("not closed").count() == 0
