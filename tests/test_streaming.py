"""Streams over several micro-batches give what the batch operators give on the whole log."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from webjourney.operators import location, sessions, summaries
from webjourney.plans import streams
from webjourney.sources import weblog
from webjourney.streaming import live

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """The log cut by time into three files, read one file per batch."""
    root = str(tmp_path_factory.mktemp("log"))
    raw = weblog.log(spark, SF)
    for day, until in ((1, 11), (11, 21), (21, 32)):
        raw.where(F.dayofmonth("ts").between(day, until - 1)).coalesce(1).write.mode("append").parquet(root)
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(root)
    return raw, stream


def folders(tmp_path):
    return str(tmp_path / "out"), str(tmp_path / "checkpoint")


def test_live_sessions(source, tmp_path):
    raw, stream = source
    out = live.run_available(live.live_sessions(weblog.visit_events(stream), weblog.FAMILIES, 43_200), *folders(tmp_path))
    cols = ["id", "journey_seq", "is_new", "live_session_id"]
    want = sessions.assign_live(weblog.visit_events(raw), weblog.FAMILIES, 43_200).select(*cols)
    assert sorted(map(tuple, out.select(*cols).collect())) == sorted(map(tuple, want.collect()))


def test_visit_dedup(source, tmp_path):
    raw, stream = source
    out = live.run_available(live.dedup_visits(weblog.visits(stream), 864_000, "1 minute"), *folders(tmp_path))
    from webjourney.operators.ordered import keep_spaced

    want = keep_spaced(weblog.visits(raw), ["session_id", "page_url"], "timestamp", "id", 864_000)
    assert {(r.id, r.kept_id) for r in out.collect()} == {(r.id, r.kept_id) for r in want.collect()}


def test_event_link_reads_stored_visits(source, tmp_path):
    raw, stream = source
    out, checkpoint = folders(tmp_path)
    stored = lambda: weblog.visits(raw)
    live.each_batch(weblog.visit_events(stream), live.link_batch(stored, out, 432_000, 864_000), checkpoint).awaitTermination()
    got = {(r.id, r.linked_visit_id, r.link_rule) for r in raw.sparkSession.read.parquet(out).collect()}
    want = location.link_events_to_visits(weblog.visit_events(raw), stored(), 432_000, 864_000)
    assert got == {(r.id, r.linked_visit_id, r.link_rule) for r in want.collect()}


def test_latest_and_summaries(source, tmp_path):
    raw, stream = source
    spark = raw.sparkSession
    events, visits = weblog.visit_events(raw), weblog.visits(raw)
    root = str(tmp_path / "latest")
    live.each_batch(weblog.visit_events(stream), live.latest_batch(root, 20), str(tmp_path / "c1")).awaitTermination()
    got = [r.id for r in spark.read.parquet(f"{root}/v2").orderBy(F.desc("timestamp")).collect()]
    want = events.where("event_type <> 'heartbeat'").orderBy(F.desc("timestamp")).limit(20)
    assert got == [r.id for r in want.collect()]

    root = str(tmp_path / "summaries")
    handle = live.summary_batch(lambda: visits, lambda: events, root)
    live.each_batch(weblog.visit_events(stream), handle, str(tmp_path / "c2")).awaitTermination()
    full = summaries.client_summaries(visits, events)
    for name, want in (("journeys", summaries.journeys(full)), ("leads", summaries.leads(full)), ("form_fills", summaries.form_fills(events))):
        got = spark.read.parquet(f"{root}/{name}/v2")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_queries_read_the_newest_version(source, tmp_path, monkeypatch):
    raw, stream = source
    for name in ("log_stream", "shuffled_stream"):
        monkeypatch.setattr(streams.weblog, name, lambda spark, folder: stream)
    spark, events, visits = raw.sparkSession, weblog.visit_events(raw), weblog.visits(raw)
    t = SimpleNamespace(spark=spark, dir="", visits=visits, events=events)
    want = events.where("event_type <> 'heartbeat'").orderBy(F.desc("timestamp"), F.desc("id")).limit(100)
    assert {r.id for r in streams.stream_latest_events(t).collect()} == {r.id for r in want.collect()}
    full = summaries.journeys(summaries.client_summaries(visits, events))
    assert sorted(map(str, streams.stream_summaries(t).collect())) == sorted(map(str, full.collect()))


def test_append_by_day_and_windows(source, tmp_path):
    raw, stream = source
    out, checkpoint = folders(tmp_path)
    q = live.append_by_day(weblog.visit_events(stream), out, checkpoint)
    q.processAllAvailable()
    q.stop()
    assert raw.sparkSession.read.parquet(out).count() == raw.count()
    counts = live.run_available(live.windowed_counts(weblog.visit_events(stream), ["event_type"], "1 day"),
                                str(tmp_path / "w"), str(tmp_path / "wc"))
    want = weblog.visit_events(raw).groupBy(F.date_trunc("day", "timestamp").alias("d"), "event_type").count()
    got = {(r.window_start, r.event_type): r["count"] for r in counts.collect()}
    closed = {(r.d, r.event_type): r["count"] for r in want.collect()}
    assert got and all(closed[k] == n for k, n in got.items())


def test_page_views_once(source, tmp_path):
    raw, stream = source
    out = live.run_available(live.first_page_views(weblog.visit_events(stream), "40 days"), *folders(tmp_path))
    want = sessions.first_page_views(weblog.visit_events(raw))
    assert out.select("session_id", "page_url").distinct().count() == out.count() == want.count()
