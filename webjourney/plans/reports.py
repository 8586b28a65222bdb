"""Registered dashboard reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from webjourney.operators import reports as r
from webjourney.operators.paging import Listing
from webjourney.plans.registry import query
from webjourney.sources.weblog import AS_OF


@query("visitor_summary", """
SELECT count(*) AS total_visits, count(DISTINCT uid) AS unique_visitors,
  count(*) FILTER (WHERE is_bot) AS ai_crawlers,
  count(*) FILTER (WHERE NOT is_bot AND ua ILIKE '%mobile%') AS mobile_humans,
  count(*) FILTER (WHERE NOT is_bot AND ua NOT ILIKE '%mobile%') AS desktop_humans
FROM visits""")
def visitor_summary(t):
    return r.visitor_summary(t.visits)


@query("conversion_rate", """
SELECT unique_visitors, conversions, round(100.0 * conversions / unique_visitors, 2)::DOUBLE AS conversion_rate
FROM (SELECT count(DISTINCT uid) AS unique_visitors FROM visits),
     (SELECT count(DISTINCT uid) AS conversions FROM ve WHERE event_type = 'form_submit')""")
def conversion_rate(t):
    return r.conversion_rate(t.visits, t.events)


@query("top_user_agents", """
SELECT ua AS user_agent, count(*) AS count FROM visits GROUP BY ua
ORDER BY count(*) DESC, ua LIMIT 10""")
def top_user_agents(t):
    return r.top_user_agents(t.visits)


@query("top_sources", """
SELECT coalesce(nullif(source, ''), 'direct') AS source, c AS count
FROM (SELECT source, count(*) AS c FROM visits GROUP BY source ORDER BY c DESC, source NULLS FIRST LIMIT 5)""")
def top_sources(t):
    return r.top_sources(t.visits)


@query("top_campaigns", """
SELECT coalesce(nullif(campaign, ''), 'none') AS campaign, c AS count
FROM (SELECT campaign, count(*) AS c FROM visits GROUP BY campaign ORDER BY c DESC, campaign NULLS FIRST LIMIT 5)""")
def top_campaigns(t):
    return r.top_campaigns(t.visits)


@query("page_domains", """
SELECT domain, count(*) AS total_visits, count(DISTINCT uid) AS unique_visitors FROM visits
WHERE domain IS NOT NULL GROUP BY domain ORDER BY 2 DESC, 1 LIMIT 20""")
def page_domains(t):
    return r.page_domains(t.visits)


@query("crawler_by_domain", """
SELECT domain, crawler_type AS crawler, count(*) AS count FROM visits
WHERE is_bot AND domain IS NOT NULL GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 NULLS FIRST LIMIT 20""")
def crawler_by_domain(t):
    return r.crawler_by_domain(t.visits)


@query("visitor_categories", """
SELECT coalesce(nullif(crawler_type, ''), 'Human') AS name, count(*) AS count FROM visits GROUP BY crawler_type""")
def visitor_categories(t):
    return r.visitor_categories(t.visits)


@query("bot_summary", """
SELECT crawler_type, count(*) AS visit_count, min(ts) AS first_seen, max(ts) AS last_seen
FROM visits WHERE crawler_type IS NOT NULL GROUP BY 1""")
def bot_summary(t):
    return r.bot_summary(t.visits)


@query("traffic_sources", """
SELECT source, medium, campaign, count(*) AS visits FROM visits WHERE source IS NOT NULL GROUP BY ALL""")
def traffic_sources(t):
    return r.traffic_sources(t.visits)


@query("admin_stats", f"""
SELECT 'total_visits' AS metric, NULL AS name, count(*) AS value FROM visits
UNION ALL SELECT 'recent_visits_24h', NULL, count(*) FROM visits WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY
UNION ALL SELECT 'recent_visits_1h', NULL, count(*) FROM visits WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR
UNION ALL SELECT 'total_sessions', NULL, count(*) FROM sess
UNION ALL SELECT * FROM (SELECT 'crawler', crawler_type, count(*) FROM visits WHERE is_bot
  GROUP BY crawler_type ORDER BY count(*) DESC, crawler_type LIMIT 10)""")
def admin_stats(t):
    return r.admin_stats(t.visits, t.sessions, AS_OF)


@query("event_type_counts", "SELECT event_type, count(*) AS count FROM ve GROUP BY 1")
def event_type_counts(t):
    return r.event_type_counts(t.events)


@query("time_ranges", """
SELECT 'visits' AS table_name, min(ts) AS first_seen, max(ts) AS last_seen FROM visits
UNION ALL SELECT 'visit_events', min(ts), max(ts) FROM ve""")
def time_ranges(t):
    return r.time_ranges(t.visits, t.events)


@query("path_event_counts", """
SELECT path, event_type, count(*) AS count, max(ts) AS latest_event FROM ve GROUP BY 1, 2""")
def path_event_counts(t):
    return r.path_event_counts(t.events)


@query("page_funnel", """
SELECT path, event_type, count(*) AS count, max(ts) AS latest_event FROM ve
WHERE path LIKE '/demo%' OR path LIKE '/sign-up%' GROUP BY 1, 2""")
def page_funnel(t):
    return r.path_event_counts(t.events, ("/demo", "/sign-up"))


@query("page_views", """
SELECT path, count(DISTINCT client_id) AS unique_visitors, count(*) AS total_views, max(ts) AS latest_view
FROM ve WHERE event_type = 'page_view' GROUP BY 1""")
def page_views(t):
    return r.page_views(t.events)


@query("latest_submissions", """
SELECT id, path, event_type, data AS event_data, ts AS timestamp FROM ve WHERE event_type = 'form_submit'
ORDER BY ts DESC, id DESC LIMIT 5""")
def latest_submissions(t):
    return r.latest_submissions(t.events)


@query("top_form_paths", f"""
SELECT path, count(*) AS count FROM ve WHERE event_type = 'form_submit'
  AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 31 DAY GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def top_form_paths(t):
    return r.top_form_paths(t.events, AS_OF, days=31)


@query("similar_paths", f"""
SELECT DISTINCT path FROM ve WHERE (path ILIKE '%sign%up%' OR path ILIKE '%demo%')
  AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 31 DAY ORDER BY 1 LIMIT 20""")
def similar_paths(t):
    return r.similar_paths(t.events, ("%sign%up%", "%demo%"), AS_OF, days=31)


@query("hourly_events", f"""
SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS count FROM ve
WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 744 HOUR GROUP BY 1, 2""")
def hourly_events(t):
    return r.hourly_events(t.events, AS_OF, hours=744)


@query("daily_uniques", f"""
SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(DISTINCT client_id) AS unique_visitors, count(*) AS total_visits
FROM visits WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 31 DAY GROUP BY 1""")
def daily_uniques(t):
    return r.daily_uniques(t.visits, AS_OF, days=31)


@query("top_pages", f"""
SELECT path, domain AS page_domain, count(*) AS visits, count(DISTINCT client_id) AS unique_visitors
FROM visits WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 31 DAY GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20""")
def top_pages(t):
    return r.top_pages(t.visits, AS_OF, days=31)


@query("scroll_depth", f"""
SELECT path, round(avg(json_extract_string(data, '$.percent')::INT), 4) AS avg_scroll_percent,
  max(json_extract_string(data, '$.percent')::BIGINT) AS max_scroll_percent, count(*) AS scroll_events
FROM ve WHERE event_type = 'scroll' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 31 DAY GROUP BY 1""")
def scroll_depth(t):
    return r.scroll_depth(t.events, AS_OF, days=31)


@query("form_conversion", f"""
SELECT path, count(*) FILTER (WHERE event_type = 'page_view') AS page_visitors,
  count(*) FILTER (WHERE event_type = 'form_submit') AS form_submitters,
  round(100.0 * count(*) FILTER (WHERE event_type = 'form_submit')
    / nullif(count(*) FILTER (WHERE event_type = 'page_view'), 0), 2)::DOUBLE AS conversion_rate
FROM (SELECT DISTINCT path, event_type, client_id FROM ve WHERE event_type IN ('page_view', 'form_submit')
      AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 31 DAY) GROUP BY 1""")
def form_conversion(t):
    return r.form_conversion(t.events, AS_OF, days=31)


HOURLY = """
SELECT ts::DATE AS date, hour(ts) AS hour, crawler_type, country, domain,
  count(*) AS visit_count, count(DISTINCT session_id) AS unique_sessions, count(DISTINCT ip) AS unique_ips,
  count(DISTINCT path) AS unique_pages, round(avg(value), 3) AS avg_response_time,
  count(*) FILTER (WHERE kind = 'error') AS error_count, sum(id % 5000)::BIGINT AS bandwidth_bytes,
  round(100.0 * count(*) FILTER (WHERE n = 1) / count(DISTINCT session_id), 2)::DOUBLE AS bounce_rate
FROM (SELECT *, count(*) OVER (PARTITION BY ts::DATE, hour(ts), crawler_type, country, domain, session_id) AS n
      FROM visits) GROUP BY 1, 2, 3, 4, 5"""


@query("hourly_rollup", HOURLY)
def hourly_rollup(t):
    return r.hourly_rollup(t.visits)


@query("visitor_profile", """
SELECT s.uid, min(a) AS first_seen, max(b) AS last_seen, count(*) AS total_visits, sum(n)::BIGINT AS total_pageviews,
  any_value(coalesce(e.n_events, 0)) AS total_events, count(*) > 1 AS is_returning,
  any_value(f.ip) AS primary_ip, any_value(f.ua) AS primary_user_agent,
  any_value(f.country) AS primary_country, any_value(f.city) AS primary_city,
  round(sum(secs), 3) AS total_session_duration, round(avg(secs), 3) AS avg_session_duration,
  round(avg(n), 4) AS avg_pages_per_session,
  round(100.0 * count(*) FILTER (WHERE n = 1) / count(*), 2)::DOUBLE AS bounce_rate
FROM (SELECT uid, session_id, count(*) AS n, min(ts) AS a, max(ts) AS b,
        (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS secs FROM visits GROUP BY 1, 2) s
JOIN (SELECT * FROM visits QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ts, id) = 1) f USING (uid)
LEFT JOIN (SELECT uid, count(*) AS n_events FROM ve GROUP BY 1) e USING (uid)
GROUP BY s.uid""")
def visitor_profile(t):
    return r.visitor_profile(t.visits, t.events)


@query("threshold_alerts", """
SELECT date_trunc('hour', ts) AS window_start, count(*) AS visit_count, 60::BIGINT AS time_window_minutes,
  round(count(*) / 5.0, 4)::DOUBLE AS threshold_exceeded FROM visits GROUP BY 1 HAVING count(*) > 5""")
def threshold_alerts(t):
    return r.threshold_alerts(t.visits, 60, 5)


@query("recent_activity", f"""
SELECT v.id, v.ts AS timestamp, v.is_bot, v.session_id, ua AS user_agent, page_url, coalesce(crawler_type, '') AS crawler_type,
  coalesce(CASE WHEN v.country IS NULL THEN s.country ELSE v.country END, '') AS country,
  coalesce(CASE WHEN v.country IS NULL THEN s.city ELSE v.city END, '') AS city,
  coalesce(tracking_id, '') AS tracking_id, coalesce(source, '') AS source, coalesce(medium, '') AS medium,
  coalesce(campaign, '') AS campaign, coalesce(v.tz, '') AS client_side_timezone,
  coalesce(v.lang, '') AS client_side_language
FROM (SELECT * FROM visits WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY ORDER BY ts DESC, id DESC LIMIT 50) v
LEFT JOIN (SELECT id AS session_id, country, city FROM sess) s ON v.session_id = s.session_id""")
def recent_activity(t):
    return r.recent_activity(t.visits, t.sessions, AS_OF)


@query("recent_visits", f"""
SELECT id, ts AS timestamp, session_id, page_url, crawler_type FROM visits
WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR AND crawler_type = 'GPTBot' ORDER BY ts DESC, id DESC LIMIT 100""")
def recent_visits(t):
    return r.recent_visits(t.visits, AS_OF, 48, "GPTBot").select(
        "id", "timestamp", "session_id", "page_url", "crawler_type")


@query("admin_recent", """
SELECT id, ts AS timestamp, ip AS ip_address, ua AS user_agent, page_url, crawler_type, is_bot, country, city
FROM visits ORDER BY ts DESC, id DESC LIMIT 50""")
def admin_recent(t):
    return r.admin_recent(t.visits)


@query("live_feed", """
SELECT id, ts AS timestamp, event_type, page_url, path, referrer, client_id, session_id, source, medium, campaign,
  data AS event_data, domain AS page_domain, ref_host AS referrer_domain
FROM ve WHERE event_type <> 'heartbeat' ORDER BY ts DESC, id DESC LIMIT 100""")
def live_feed(t):
    return r.live_feed(t.events)


@query("live_feed_since", """
SELECT id, ts AS timestamp, event_type, page_url, path, referrer, client_id, session_id, source, medium, campaign,
  data AS event_data, domain AS page_domain, ref_host AS referrer_domain
FROM ve WHERE event_type <> 'heartbeat' AND id > 500 ORDER BY ts DESC, id DESC LIMIT 50""")
def live_feed_since(t):
    return r.live_feed(t.events, 50, since_id=500)


@query("client_visits", """
SELECT id, client_id, ts AS timestamp, page_url, source FROM visits WHERE client_id IS NOT NULL""")
def client_visits(t):
    return r.client_visits(t.visits).select("id", "client_id", "timestamp", "page_url", "source")


@query("session_page_info", """
SELECT count(*) AS total_count, 20 + 10 < count(*) AS has_next, true AS has_prev, 3::BIGINT AS current_page,
  ceil(count(*) / 10.0)::BIGINT AS total_pages FROM sess""")
def session_page_info(t):
    return r.page_info(t.sessions, 10, 20)


@query("session_list", """
SELECT s.id AS session_id, s.client_id, first_visit, last_visit, coalesce(n, 0) AS visit_count, s.ip AS ip_address,
  coalesce(s.country, '') AS country, coalesce(s.city, '') AS city,
  CASE WHEN n IS NULL THEN 'Unknown' WHEN bots > n - bots THEN 'AI Crawler' ELSE 'Human' END AS classification,
  coalesce(s.tz, '') AS client_side_timezone, coalesce(s.lang, '') AS client_side_language
FROM sess s LEFT JOIN (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE is_bot) AS bots FROM visits GROUP BY 1) v
  ON v.session_id = s.id""")
def session_list(t):
    return r.session_list(t.visits, t.sessions)


@query("session_page", """
SELECT id AS session_id, client_id, first_visit, last_visit, visit_count FROM sess
ORDER BY last_visit DESC, id LIMIT 10 OFFSET 3""")
def session_page(t):
    listing = Listing(t.sessions.select(F.col("id").alias("session_id"), "client_id", "first_visit", "last_visit",
                                        "visit_count"), [F.desc("last_visit"), "session_id"])
    return listing.page(10, 3)


@query("visits_after", """
SELECT id, session_id, ts AS timestamp, path FROM visits WHERE id > 500 ORDER BY id LIMIT 40""")
def visits_after(t):
    return r.after_id(t.visits.select("id", "session_id", "timestamp", "path"), 500, 40)


@query("session_stats", """
SELECT s.id AS session_id, count(v.id) AS total_visits, any_value(first_visit) AS first_visit,
  any_value(last_visit) AS last_visit, NULL::VARCHAR AS country, any_value(s.city) AS city,
  count(DISTINCT v.domain) AS unique_domains, count(DISTINCT v.path) AS unique_paths
FROM sess s LEFT JOIN visits v ON v.session_id = s.id GROUP BY s.id""")
def session_stats(t):
    return r.session_stats(t.visits, t.sessions)


_FIRST = """first_v AS (SELECT * FROM visits WHERE client_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY ts, id) = 1)"""


@query("unified_users", """
SELECT v.client_id, count(DISTINCT v.session_id) AS session_count, count(*) AS visit_count,
  any_value(coalesce(e.n, 0)) AS event_count, any_value(coalesce(e.c, 0)) AS conversion_count,
  min(v.ts) AS first_seen, max(v.ts) AS last_seen, any_value(l.country) AS last_country, any_value(l.city) AS last_city,
  any_value(coalesce(f.source, 'direct')) AS source, any_value(coalesce(f.medium, 'none')) AS medium,
  any_value(coalesce(f.campaign, 'none')) AS campaign, any_value(f.page_url) AS landing_page
FROM visits v JOIN first_v f USING (client_id)
LEFT JOIN (SELECT client_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'form_submit') AS c FROM ve GROUP BY 1) e
  USING (client_id)
LEFT JOIN (SELECT * FROM sess WHERE client_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY last_visit DESC, id) = 1) l ON l.client_id = v.client_id
WHERE v.client_id IS NOT NULL GROUP BY v.client_id""", _FIRST)
def unified_users(t):
    return r.unified_users(t.visits, t.events, t.sessions)


@query("user_activity", """
SELECT client_id, coalesce(s.n, 0) AS unique_sessions, coalesce(v.n, 0) AS total_visits, coalesce(e.n, 0) AS total_events,
  coalesce(v.d, 0) AS unique_domains, coalesce(e.c, 0) AS conversions, s.first_seen, s.last_seen,
  CASE WHEN v.n IS NULL THEN 'unknown' ELSE coalesce(f.source, 'direct') END AS source,
  coalesce(f.medium, 'none') AS medium, coalesce(f.campaign, 'none') AS campaign, f.page_url AS landing_page
FROM (SELECT client_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'form_submit') AS c
      FROM ve WHERE client_id IS NOT NULL GROUP BY 1) e
FULL JOIN (SELECT client_id, count(*) AS n, count(DISTINCT domain) AS d FROM visits WHERE client_id IS NOT NULL GROUP BY 1) v
  USING (client_id)
FULL JOIN (SELECT client_id, count(*) AS n, min(first_visit) AS first_seen,
  arg_max(last_visit, struct_pack(f := first_visit, i := id)) AS last_seen FROM sess WHERE client_id IS NOT NULL GROUP BY 1) s
  USING (client_id)
LEFT JOIN first_v f USING (client_id)""", _FIRST)
def user_activity(t):
    return r.user_activity(t.visits, t.events, t.sessions)


@query("first_touch", """
SELECT f.client_id, f.ts AS first_touch_at, coalesce(f.source, 'direct') AS source, coalesce(f.medium, 'none') AS medium,
  coalesce(f.campaign, 'none') AS campaign, f.page_url AS landing_page, f.referrer, coalesce(n, 0) AS conversion_count
FROM first_v f LEFT JOIN (SELECT client_id, count(*) AS n FROM ve WHERE event_type = 'form_submit' GROUP BY 1) c
  USING (client_id)""", _FIRST)
def first_touch(t):
    return r.first_touch(t.visits, t.events)


@query("conversions", """
SELECT client_id, id, ts AS timestamp, page_url AS page, json_extract(data, '$.form_values')::VARCHAR AS form_values
FROM ve WHERE event_type = 'form_submit' AND client_id IN (SELECT client_id FROM visits WHERE client_id IS NOT NULL)""")
def conversions(t):
    return r.conversions(t.visits, t.events)


@query("event_details", """
SELECT e.id, e.client_id, e.event_type, v.id AS visit_id, v.source AS visit_source, v.medium AS visit_medium
FROM ve e LEFT JOIN visits v ON e.visit_id = v.id""")
def event_details(t):
    return r.event_details(t.events, t.visits).select(
        "id", "client_id", "event_type", "visit_id", "visit_source", "visit_medium")


@query("client_timeline", """
SELECT 'visit' AS item_type, id, ts AS timestamp, client_id, session_id, page_url, referrer, path, domain AS page_domain,
  source, medium, campaign, tracking_id, is_bot, crawler_type, NULL AS referrer_domain, NULL AS event_type, NULL AS event_data
FROM visits WHERE client_id IS NOT NULL
UNION ALL
SELECT 'event', id, ts, client_id, session_id, page_url, referrer, path, domain, source, medium, campaign, tracking_id,
  NULL, NULL, ref_host, event_type, data FROM ve WHERE client_id IS NOT NULL""")
def client_timeline(t):
    return r.client_timeline(t.visits, t.events)
