"""Micro-batches in any order, replayed or empty, against the batch operators over all rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from webjourney.operators import location, sessions
from webjourney.operators.ordered import keep_spaced
from webjourney.sources.weblog import FAMILIES
from webjourney.streaming import corrected

T0 = dt.datetime(2024, 1, 1)
SCHEMA = ("id long, timestamp timestamp, session_id string, page_url string, client_id string, ip_address string, user_agent string, "
          "event_type string, referrer_domain string, source string, medium string, campaign string, visit_id long")


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(9)
    data = []
    for i in range(400):
        # Several days, so that parts of the results are not read again; NULL and '' are keys apart.
        at = T0 + dt.timedelta(days=rnd.randrange(4), seconds=rnd.randrange(4000))
        data.append((i, at, rnd.choice(["s", "t", None]), rnd.choice(["/a", "/b", "", None]), rnd.choice(["p", "q", None]),
                     rnd.choice(["1", "2"]), "x", rnd.choice(["page_view", "heartbeat", "navigation"]),
                     rnd.choice([None, "www.google.com", "www.siteone.example"]), None, None, None, rnd.choice([None, 5])))
    return spark.createDataFrame(data, SCHEMA).cache()


def batches(rows, n=3):
    """Parts in no order of time, the second one twice, and an empty one."""
    part = lambda k: rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k)
    return [(part(0), 0), (part(1), 1), (part(1), 1), (rows.where("false"), 2), *[(part(k), k + 1) for k in range(2, n)]]


def test_spaced_rows(spark, rows, tmp_path):
    keys, root = ["session_id", "page_url"], str(tmp_path / "out")
    handle = corrected.spaced_batch(keys, 300, root)
    for part, number in batches(rows):
        handle(part, number)
    got = {r.id: (r.kept_id, r.kept_at) for r in corrected.spaced_view(spark, root, rows, keys).collect()}
    want = {r.id: (r.kept_id, r.kept_at) for r in keep_spaced(rows, keys, "timestamp", "id", 300).collect()}
    assert got == want and len(got) == 400


def test_a_batch_on_time_redoes_nothing(spark, rows, tmp_path):
    keys, root = ["session_id", "page_url"], str(tmp_path / "out")
    handle = corrected.spaced_batch(keys, 300, root)
    days = [rows.where(F.dayofmonth("timestamp") == d) for d in (1, 2, 3, 4)]
    for number, part in enumerate(days):
        handle(part, number)
    written = corrected.read_batches(spark, root, corrected.spaced_schema(rows, keys))
    assert {r.batch: r["count"] for r in written.groupBy("batch").count().collect()} == {n: d.count() for n, d in enumerate(days)}


def test_live_sessions(spark, rows, tmp_path):
    root = str(tmp_path / "out")
    handle = corrected.live_sessions_batch(root, FAMILIES, 600)
    for part, number in batches(rows):
        handle(part, number)
    cols = ["id", "user_key", "journey_seq", "is_new", "live_session_id"]
    want = sessions.assign_live(rows, FAMILIES, 600).select(*cols).collect()
    assert sorted(map(tuple, corrected.live_sessions_view(spark, root).select(*cols).collect())) == sorted(map(tuple, want))


def test_recent_merge(spark, rows, tmp_path):
    visits = rows.where("id % 3 = 0").withColumn("session_id", F.concat(F.lit("v"), F.col("id") % 5))
    events = rows.where("id % 3 <> 0").withColumn("session_id", F.concat(F.lit("v"), F.col("id") % 4))
    hits, root = corrected.hits_of(visits, events), str(tmp_path / "out")
    handle = corrected.merge_batch(root, 120)
    for part, number in batches(hits):
        handle(part, number)
    want = location.merge_recent_visits(events, visits, 120)
    got = corrected.merge_view(spark, root)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_partial_counts(spark, rows, tmp_path):
    root = str(tmp_path / "out")
    handle = corrected.partial_batch(corrected.count_parts(["event_type"], "1 day"), root)
    for part, number in batches(rows):
        handle(part, number)
    parts = corrected.read_batches(spark, root, "timestamp timestamp, event_type string, count long")
    got = {(r.window_start, r.event_type): r["count"] for r in corrected.windowed_counts(parts, ["event_type"]).collect()}
    want = rows.groupBy(F.date_trunc("day", "timestamp").alias("d"), "event_type").count().collect()
    assert got == {(r.d, r.event_type): r["count"] for r in want}


def test_nothing_arrived(spark, rows, tmp_path):
    keys = ["session_id", "page_url"]
    assert corrected.spaced_view(spark, str(tmp_path / "none"), rows, keys).count() == 0
    assert corrected.live_sessions_view(spark, str(tmp_path / "none")).count() == 0
