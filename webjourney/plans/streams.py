"""Streaming twins, run over the log as a file stream and compared like their batch versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from webjourney.operators import linking, summaries
from webjourney.operators import reports as flat_reports
from webjourney.operators.ordered import work_dir
from webjourney.operators.summary_store import SummaryStore
from webjourney.plans import reports, sessions
from webjourney.plans.registry import query
from webjourney.plans.sessions import _LIVE, SPACING, _spaced
from webjourney.plans.summaries import _W
from webjourney.sources import io, weblog
from webjourney.sources.weblog import FAMILIES
from webjourney.streaming import corrected, live


def _events(t):
    return weblog.visit_events(weblog.log_stream(t.spark, t.dir))


def _visits(t):
    return weblog.visits(weblog.log_stream(t.spark, t.dir))


def _shuffled(t):
    """The log as micro-batches in no order of time."""
    return weblog.shuffled_stream(t.spark, t.dir)


def _run(t, stream):
    root = work_dir(t.spark)
    return live.run_available(stream, f"{root}/out", f"{root}/checkpoint")


def _drain(t, stream, handler):
    """Run ``handler(root)`` over all micro-batches; returns the root."""
    root = work_dir(t.spark)
    live.each_batch(stream, handler(f"{root}/out"), f"{root}/checkpoint").awaitTermination()
    return f"{root}/out"


@query("stream_live_sessions", """
SELECT id, user_key, is_new, seq AS journey_seq, left(sha256(user_key || ':journey:' || seq), 32) AS live_session_id
FROM (SELECT f.id, f.user_key, o.id IS NOT NULL AS is_new,
        sum((o.id IS NOT NULL)::INT) OVER (PARTITION BY f.user_key ORDER BY f.ts, f.id ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS seq
      FROM lf f LEFT JOIN (SELECT id FROM dd WHERE kept_id = id) o ON o.id = f.id)""",
       _LIVE, _spaced("dd", "le", "user_key", 43_200))
def stream_live_sessions(t):
    root = _drain(t, weblog.visit_events(_shuffled(t)), lambda r: corrected.live_sessions_batch(r, FAMILIES, 43_200))
    return corrected.live_sessions_view(t.spark, root).select(
        "id", "user_key", "is_new", "journey_seq", "live_session_id")


def _spaced_stream(t, stream, rows, keys, inclusive):
    root = _drain(t, stream, lambda r: corrected.spaced_batch(keys, SPACING, r, inclusive))
    return corrected.spaced_view(t.spark, root, rows, keys)


@query("stream_visit_dedup", "SELECT id, ts AS timestamp, kept_id FROM dd",
       _spaced("dd", "visits", "session_id, page_url", SPACING))
def stream_visit_dedup(t):
    return _spaced_stream(t, weblog.visits(_shuffled(t)), t.visits, ["session_id", "page_url"], True).select(
        "id", "timestamp", "kept_id")


@query("stream_submit_debounce", "SELECT id, ts AS timestamp FROM dd WHERE kept_id = id",
       "subs AS (SELECT * FROM ve WHERE event_type = 'form_submit')",
       _spaced("dd", "subs", "client_id, session_id, page_url", SPACING, False))
def stream_submit_debounce(t):
    submits = weblog.visit_events(_shuffled(t)).where("event_type = 'form_submit'")
    return _spaced_stream(t, submits, t.events, ["client_id", "session_id", "page_url"], False).where(
        "kept_id = id").select("id", "timestamp")


@query("stream_live_feed", """
SELECT id, ts AS timestamp, event_type, page_url, path, referrer, client_id, session_id, source, medium, campaign,
  data AS event_data, domain AS page_domain, nullif(ref_host, '') AS referrer_domain FROM ve WHERE event_type <> 'heartbeat'""")
def stream_live_feed(t):
    return _run(t, live.live_stream(_events(t)))


@query("stream_day_append", """
SELECT id, event_type, session_id, ts AS timestamp FROM ve WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13'""")
def stream_day_append(t):
    root = work_dir(t.spark)
    rows = weblog.visit_events(_shuffled(t)).select("id", "event_type", "session_id", "timestamp")
    running = live.append_by_day(rows, f"{root}/out", f"{root}/checkpoint")
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return io.read_days(t.spark, f"{root}/out", start="2024-01-10", end="2024-01-12")


@query("stream_event_visit_link", sessions.ORACLE_LINK)
def stream_event_visit_link(t):
    root = _drain(t, _events(t), lambda r: live.link_batch(lambda: t.visits, r, 432_000, SPACING))
    return t.spark.read.parquet(root).drop("batch")


@query("stream_event_visits", "SELECT * FROM linked WHERE link_rule <> 'explicit'", sessions.LINKED)
def stream_event_visits(t):
    log = weblog.log_stream(t.spark, t.dir)
    rows = linking.rows_to_fold(weblog.visit_events(log).where("visit_id IS NULL"), weblog.visits(log))
    return _run(t, live.link_or_create(rows, sessions.LINK_IP, sessions.LINK_USER)).drop("timestamp")


@query("stream_recent_visit_merge", sessions.ORACLE_MERGE)
def stream_recent_visit_merge(t):
    log = _shuffled(t)
    hits = corrected.hits_of(weblog.visits(log), sessions.other_sessions(weblog.visit_events(log)))
    return corrected.merge_view(t.spark, _drain(t, hits, lambda r: corrected.merge_batch(r, 3600)))


def _partials(t, stream, aggregate, schema):
    root = _drain(t, stream, lambda r: corrected.partial_batch(aggregate, r))
    return corrected.read_batches(t.spark, root, f"timestamp timestamp, {schema}")


@query("stream_hourly_events", """
SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS count FROM ve GROUP BY 1, 2""")
def stream_hourly_events(t):
    parts = _partials(t, weblog.visit_events(_shuffled(t)), corrected.count_parts(["event_type"]),
                      "event_type string, count long")
    return corrected.windowed_counts(parts, ["event_type"])


@query("stream_threshold_alerts", """
SELECT date_trunc('hour', ts) AS window_start, count(*) AS count FROM visits GROUP BY 1 HAVING count(*) > 5""")
def stream_threshold_alerts(t):
    return corrected.threshold_alerts(
        _partials(t, weblog.visits(_shuffled(t)), corrected.count_parts([]), "count long"), 5)


@query("stream_hourly_rollup", reports.HOURLY)
def stream_hourly_rollup(t):
    parts = _partials(
        t, weblog.visits(_shuffled(t)), flat_reports.rollup_parts,
        "date date, hour long, crawler_type string, country string, domain string, session_id string, ip_address string, "
        "path string, n long, t double, tn long, e long, b long")
    return flat_reports.rollup_of_parts(parts)


@query("stream_engagement", """
SELECT date_trunc('day', ts)::TIMESTAMP AS day, session_id, page_url, count(*) AS beats,
  max(id % 90000) AS time_on_page_ms, max(id % 45000) AS max_idle_ms,
  count(*) FILTER (WHERE id % 45000 < 30000) AS engaged_beats FROM ve WHERE event_type = 'heartbeat' GROUP BY 1, 2, 3""")
def stream_engagement(t):
    beats = sessions.measured_beats(weblog.visit_events(_shuffled(t)))
    return corrected.engagement(_partials(
        t, beats, corrected.engagement_parts, "session_id string, page_url string, beats long, time_on_page_ms long, "
        "max_idle_ms long, engaged_beats long"))


@query("stream_intake", """
SELECT id, ts AS timestamp, client_id, event_type, path, domain AS page_domain, source, medium, campaign
FROM ve WHERE NOT (event_type = 'form_submit' AND coalesce(data, '') LIKE '%timingsV2%')""")
def stream_intake(t):
    raw = _events(t).selectExpr(
        "id", "timestamp AS received_at", "event_type", "page_url", "referrer", "event_data AS data", "visit_id",
        "client_id AS cid", "tracking_id", "user_agent", "map('timezone', client_side_timezone) AS client_side_data",
        "string(NULL) AS x_forwarded_for", "ip_address AS x_real_ip", "string(NULL) AS forwarded", "'192.0.2.1' AS peer")
    return _run(t, live.enrich_intake(raw)).select(
        "id", "timestamp", "client_id", "event_type", "path", "page_domain", "source", "medium", "campaign")


@query("stream_intake_places", f"""
SELECT id, json_extract_string(d, '$.country') AS country, json_extract_string(d, '$.city') AS city,
  json_extract_string(d, '$.tracking_id') AS tracking_id FROM (
  SELECT p.id, json_object('country', p.country, 'city', p.city, 'tracking_id', e.tracking_id) AS d
  FROM ({sessions.ORACLE_INTAKE}) p JOIN ve e ON e.id = p.id
  WHERE NOT (event_type = 'form_submit' AND coalesce(data, '') LIKE '%timingsV2%'))""", sessions.PLACED_SESSIONS)
def stream_intake_places(t):
    raw = weblog.visit_events(_shuffled(t)).selectExpr(
        "id", "timestamp AS received_at", "event_type", "page_url", "referrer", "event_data AS data", "visit_id", "session_id",
        "client_id AS cid", "tracking_id", "user_agent", "map('timezone', client_side_timezone) AS client_side_data",
        "string(NULL) AS x_forwarded_for", "ip_address AS x_real_ip", "string(NULL) AS forwarded", "'192.0.2.1' AS peer")
    ranges = weblog.networks(t.spark)
    root = _drain(t, raw, lambda r: live.intake_batch(lambda: t.visits, lambda: sessions.placed_sessions(t), ranges, r, 72))
    rows = t.spark.read.parquet(root)
    return rows.select("id", *[F.get_json_object("event_data", f"$.{c}").alias(c) for c in ("country", "city", "tracking_id")])


@query("stream_first_page_views", """
SELECT id, session_id, page_url FROM ve WHERE event_type = 'page_view'
QUALIFY row_number() OVER (PARTITION BY session_id, page_url ORDER BY ts, id) = 1""")
def stream_first_page_views(t):
    parts = _partials(t, weblog.visit_events(_shuffled(t)), corrected.first_view_parts,
                      "session_id string, page_url string, id long")
    return corrected.first_page_views(parts).select("id", "session_id", "page_url")


@query("stream_summaries", "SELECT * FROM w_j", *_W)
def stream_summaries(t):
    root = work_dir(t.spark)
    store = SummaryStore(t.spark, f"{root}/summaries", buckets=8)
    handle = store.batch(lambda: t.visits, lambda: t.events)
    live.each_batch(weblog.visit_events(_shuffled(t)), handle, f"{root}/checkpoint").awaitTermination()
    return store.read("journeys", summaries.journeys(summaries.client_summaries(t.visits, t.events)))


@query("stream_latest_events", """
SELECT id, ts AS timestamp, event_type, page_url, path, referrer, client_id, session_id, source, medium, campaign,
  data AS event_data, domain AS page_domain, nullif(ref_host, '') AS referrer_domain
FROM ve WHERE event_type <> 'heartbeat' ORDER BY ts DESC, id DESC LIMIT 100""")
def stream_latest_events(t):
    root = work_dir(t.spark)
    live.each_batch(_events(t), live.latest_batch(root), f"{root}/checkpoint").awaitTermination()
    return live.newest_version(t.spark, root, live.live_stream(t.events).schema)


@query("stream_geo_inherit", sessions.ORACLE_GEO)
def stream_geo_inherit(t):
    root = _drain(t, _visits(t), lambda r: live.locate_batch(lambda: t.visits, lambda: t.sessions, r, 72))
    return t.spark.read.parquet(root).drop("batch")
