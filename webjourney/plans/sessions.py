"""Registered session, linking and location queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from webjourney.operators import linking
from webjourney.operators import location as loc
from webjourney.operators import sessions as s
from webjourney.operators.ordered import work_table
from webjourney.plans.registry import query
from webjourney.sources import weblog
from webjourney.sources.weblog import FAMILIES

INACTIVITY = 480 * 60
SPACING = 864_000

_INTERNAL = "regexp_matches(lower({0}), '(^|\\.)(siteone|sitetwo)\\.example(:[0-9]+)?$')"

_RECORDS = """rec AS (
  SELECT 0 AS rank, id, session_id AS old_sid, client_id, ip, ua, ts, NULL AS event_type, referrer, ref_host, source,
    medium, campaign FROM visits
  UNION ALL
  SELECT 1, id, session_id, client_id, NULL, NULL, ts, event_type, referrer, ref_host, source, medium, campaign FROM ve
  WHERE event_type IN ('page_view', 'navigation', 'navigate') AND client_id IS NOT NULL),
keyed AS (
  SELECT *, CASE WHEN client_id IS NOT NULL THEN 'cid:' || client_id ELSE 'ipua:' || ip || ':' || ua END AS user_key FROM rec),
gaps AS (
  SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_key ORDER BY ts, rank, id) AS gap FROM keyed)"""

_ASSIGNED = f"""flags AS (
  SELECT *, CASE WHEN gap IS NULL THEN 1
      WHEN nullif(ref_host, '') IS NOT NULL THEN (NOT {_INTERNAL.format('ref_host')})::INT
      WHEN nullif(source, '') IS NOT NULL THEN (NOT {_INTERNAL.format('source')})::INT
      WHEN medium IS NOT NULL OR campaign IS NOT NULL THEN 1
      ELSE (gap > {INACTIVITY * 1000000})::INT END AS is_new FROM gaps),
seqs AS (
  SELECT *, sum(is_new) OVER (PARTITION BY user_key ORDER BY ts, rank, id ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS seq FROM flags),
assigned AS (
  SELECT *, left(sha256(user_key || ':journey:' || seq), 32) AS new_sid FROM seqs)"""


def _assigned(t):
    return s.sessionize(s.rebuild_records(t.visits, t.events), FAMILIES, INACTIVITY)


@query("sessionize", """
SELECT rank::BIGINT AS rank, id, ts AS timestamp, user_key, seq AS journey_seq, old_sid AS old_session_id,
  new_sid AS new_session_id FROM assigned""", _RECORDS, _ASSIGNED)
def sessionize(t):
    return _assigned(t).select(
        "rank", "id", "timestamp", "user_key", "journey_seq", "old_session_id", "new_session_id")


@query("rebuilt_sessions", """
SELECT new_sid AS id, coalesce(any_value(ip), 'unknown') AS ip_address, coalesce(any_value(ua), 'unknown') AS user_agent,
  any_value(client_id) AS client_id, min(ts) AS first_visit, max(ts) AS last_visit, count(*) AS visit_count,
  arg_min(struct_pack(r := referrer), struct_pack(t := ts, k := rank, i := id)).r AS entry_referrer,
  arg_min(struct_pack(r := nullif(ref_host, '')), struct_pack(t := ts, k := rank, i := id)).r AS entry_referrer_domain,
  true AS is_external_entry
FROM assigned GROUP BY 1""", _RECORDS, _ASSIGNED)
def rebuilt_sessions(t):
    return s.rebuilt_sessions(_assigned(t))


@query("session_remap_audit", """
SELECT old_sid AS old_session_id, new_sid AS new_session_id,
  arg_max(struct_pack(c := client_id), struct_pack(t := ts, k := rank, i := id)).c AS client_id,
  count(*) FILTER (WHERE rank = 0) AS visit_count_moved, count(*) FILTER (WHERE rank = 1) AS event_count_moved
FROM assigned WHERE old_sid <> new_sid GROUP BY 1, 2""", _RECORDS, _ASSIGNED)
def session_remap_audit(t):
    return s.remap_audit(_assigned(t))


@query("session_rebuild_stats", """
SELECT count(*) AS records, count(DISTINCT old_sid) AS sessions_in_use, count(DISTINCT new_sid) AS sessions_after,
  count(*) FILTER (WHERE old_sid <> new_sid AND rank = 0) AS visits_moved,
  count(*) FILTER (WHERE old_sid <> new_sid AND rank = 1) AS events_moved,
  any_value((SELECT count(*) FROM sess)) AS sessions_before FROM assigned""", _RECORDS, _ASSIGNED)
def session_rebuild_stats(t):
    return s.rebuild_stats(t.visits, t.events, t.sessions, FAMILIES, INACTIVITY)


@query("remap_events", """
SELECT e.id, coalesce(a.new_sid, va.new_sid, e.session_id) AS session_id FROM ve e
LEFT JOIN assigned a ON a.id = e.id AND a.rank = 1 LEFT JOIN assigned va ON va.id = e.visit_id AND va.rank = 0""",
       _RECORDS, _ASSIGNED)
def remap_events(t):
    a = _assigned(t)
    return s.remap_events(t.events, a, s.remap_visits(t.visits, a)).select("id", "session_id")


@query("orphan_sessions", """
SELECT id, client_id, visit_count FROM every WHERE id NOT IN (SELECT session_id FROM moved_v)
  AND id NOT IN (SELECT session_id FROM moved_e)""", _RECORDS, _ASSIGNED,
       "moved_v AS (SELECT new_sid AS session_id FROM assigned WHERE rank = 0)",
       """moved_e AS (SELECT coalesce(a.new_sid, va.new_sid, e.session_id) AS session_id FROM ve e
LEFT JOIN assigned a ON a.id = e.id AND a.rank = 1 LEFT JOIN assigned va ON va.id = e.visit_id AND va.rank = 0)""",
       """every AS (SELECT id, client_id, visit_count FROM sess
UNION ALL SELECT DISTINCT md5('idle' || user_id), 'c' || user_id, 0 FROM events)""")
def orphan_sessions(t):
    # Sessions of the log are all in use; those that users opened before it began are not.
    idle = t.log.selectExpr("md5('idle' || user_id) AS id", "'c' || user_id AS client_id", "0 AS visit_count").distinct()
    a = work_table(_assigned(t))
    v = s.remap_visits(t.visits, a)
    every = t.sessions.select("id", "client_id", "visit_count").unionByName(idle)
    return s.orphan_sessions(every, v, s.remap_events(t.events, a, v))


_SPACED = """{name}_n AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts, id) AS rn FROM {src}),
{name} AS (
  SELECT {keys}, id, ts, rn, id AS kept_id, ts AS kept_ts FROM {name}_n WHERE rn = 1
  UNION ALL
  SELECT n.{nkeys}, n.id, n.ts, n.rn,
    CASE WHEN epoch_us(n.ts) - epoch_us(p.kept_ts) <= {us} THEN p.kept_id ELSE n.id END,
    CASE WHEN epoch_us(n.ts) - epoch_us(p.kept_ts) <= {us} THEN p.kept_ts ELSE n.ts END
  FROM {name} p JOIN {name}_n n ON {on} AND n.rn = p.rn + 1)"""


def _spaced(name, src, keys, seconds, inclusive=True):
    ks = [k.strip() for k in keys.split(",")]
    return _SPACED.format(
        name=name, src=src, keys=keys, nkeys=", n.".join(ks), us=int(seconds * 1e6) - (0 if inclusive else 1),
        on=" AND ".join(f"n.{k} IS NOT DISTINCT FROM p.{k}" for k in ks))


@query("visit_dedup", """
SELECT k.id, any_value(v0.session_id) AS session_id, any_value(v0.page_url) AS page_url, any_value(v0.ts) AS timestamp,
  arg_min(v.tracking_id, struct_pack(t := v.ts, i := v.id)) FILTER (WHERE v.tracking_id IS NOT NULL) AS tracking_id,
  count(*) - 1 AS folded
FROM (SELECT id AS vid, kept_id AS id FROM dd) k JOIN visits v ON v.id = k.vid JOIN visits v0 ON v0.id = k.id GROUP BY k.id""",
       _spaced("dd", "visits", "session_id, page_url", SPACING))
def visit_dedup(t):
    return s.dedup_visits(t.visits, SPACING).select(
        "id", "session_id", "page_url", "timestamp", "tracking_id", "folded")


_MAPS = """hm AS (
  SELECT kept_id, 'h' || unnest([0, v.id % 3]) AS k, unnest(['a' || v.id, 'b' || v.id]) AS val, v.ts, v.id
  FROM dd JOIN visits v ON v.id = dd.id WHERE v.id % 4 <> 0),
cm AS (SELECT kept_id, 'c' || v.id % 2 AS k, 'd' || v.id AS val, v.ts, v.id FROM dd JOIN visits v ON v.id = dd.id)"""


@query("visit_merge", """
SELECT k.kept_id AS id, count(*) - 1 AS folded, any_value(h.t) AS request_headers, any_value(c.t) AS custom_data
FROM dd k LEFT JOIN (SELECT kept_id, string_agg(k || '=' || val, ';' ORDER BY k) AS t FROM (
    SELECT kept_id, k, arg_min(val, struct_pack(t := ts, i := id)) AS val FROM hm WHERE k <> 'h0' OR val LIKE 'a%' GROUP BY 1, 2) GROUP BY 1) h
  ON h.kept_id = k.kept_id
LEFT JOIN (SELECT kept_id, string_agg(k || '=' || val, ';' ORDER BY k) AS t FROM (
    SELECT kept_id, k, arg_max(val, struct_pack(t := ts, i := id)) AS val FROM cm GROUP BY 1, 2) GROUP BY 1) c
  ON c.kept_id = k.kept_id GROUP BY 1""", _spaced("dd", "visits", "session_id, page_url", SPACING), _MAPS)
def visit_merge(t):
    shown = lambda c: F.array_join(F.transform(
        F.sort_array(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias(c)
    return s.merge_visits(_with_maps(t.visits), SPACING).select(
        "id", "folded", shown("request_headers"), shown("custom_data"))


def _with_maps(visits):
    """The log has no headers and no custom data, so some are made from the row number."""
    return visits.withColumn("request_headers", F.expr(
        "IF(id % 4 = 0, NULL, IF(id % 3 = 0, map('h0', 'a' || id), map('h0', 'a' || id, 'h' || id % 3, 'b' || id)))")
    ).withColumn("custom_data", F.expr("map('c' || id % 2, 'd' || id)"))


@query("session_counters", """
SELECT session_id, max(ts) AS last_visit, any_value(n) AS visit_count FROM visits JOIN (
  SELECT session_id, count(*) AS n FROM dd WHERE kept_id = id GROUP BY 1) USING (session_id) GROUP BY 1""",
       _spaced("dd", "visits", "session_id, page_url", SPACING))
def session_counters(t):
    return s.session_counters(t.visits, s.dedup_visits(t.visits, SPACING))


@query("submit_debounce", "SELECT id, client_id, session_id, page_url, ts AS timestamp FROM dd WHERE kept_id = id",
       "subs AS (SELECT * FROM ve WHERE event_type = 'form_submit')",
       _spaced("dd", "subs", "client_id, session_id, page_url", SPACING, False))
def submit_debounce(t):
    return s.debounce_submits(t.events, SPACING).select("id", "client_id", "session_id", "page_url", "timestamp")


_LIVE = f"""lk AS (
  SELECT id, ts, session_id, event_type, CASE WHEN client_id IS NOT NULL THEN 'cid:' || client_id ELSE 'ipua:' || ip || ':' || ua END AS user_key,
    ref_host, source, medium, campaign FROM ve),
lf AS (
  SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY ts, id) = 1 OR CASE
      WHEN event_type IN ('heartbeat', 'visibility', 'scroll') THEN false
      WHEN nullif(ref_host, '') IS NOT NULL THEN NOT {_INTERNAL.format('ref_host')}
      WHEN nullif(source, '') IS NOT NULL THEN NOT {_INTERNAL.format('source')} ELSE true END AS entry FROM lk),
le AS (SELECT user_key, id, ts FROM lf WHERE entry)"""


@query("live_sessions", """
SELECT id, user_key, is_new, seq AS journey_seq, left(sha256(user_key || ':journey:' || seq), 32) AS live_session_id
FROM (SELECT f.id, f.user_key, o.id IS NOT NULL AS is_new,
        sum((o.id IS NOT NULL)::INT) OVER (PARTITION BY f.user_key ORDER BY f.ts, f.id ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS seq
      FROM lf f LEFT JOIN (SELECT id FROM dd WHERE kept_id = id) o ON o.id = f.id)""",
       _LIVE, _spaced("dd", "le", "user_key", 43_200))
def live_sessions(t):
    return s.assign_live(t.events, FAMILIES, 43_200).select(
        "id", "user_key", "is_new", "journey_seq", "live_session_id")


@query("first_page_views", """
SELECT id, session_id, page_url, ts AS timestamp FROM ve WHERE event_type = 'page_view'
QUALIFY row_number() OVER (PARTITION BY session_id, page_url ORDER BY ts, id) = 1""")
def first_page_views(t):
    return s.first_page_views(t.events).select("id", "session_id", "page_url", "timestamp")


@query("engagement", """
SELECT session_id, page_url, count(*) AS beats, max((json_extract(data, '$.time_on_page_ms'))::BIGINT) AS time_on_page_ms,
  max((json_extract(data, '$.idle_time_ms'))::BIGINT) AS max_idle_ms,
  count(*) FILTER (WHERE (json_extract(data, '$.idle_time_ms'))::BIGINT < 30000) AS engaged_beats
FROM (SELECT session_id, page_url, '{"time_on_page_ms":' || id % 90000 || ',"idle_time_ms":' || id % 45000 || '}' AS data
      FROM ve WHERE event_type = 'heartbeat') GROUP BY 1, 2""")
def engagement(t):
    return s.engagement(measured_beats(t.events))


def measured_beats(events):
    """The log has no engagement payload on heartbeats, so one is derived from the row number."""
    return events.where("event_type = 'heartbeat'").withColumn("event_data", F.expr(
        """'{"time_on_page_ms":' || id % 90000 || ',"idle_time_ms":' || id % 45000 || '}'"""))


@query("visit_backfill", """
SELECT v.id, coalesce(v.tracking_id, e.tracking_id) AS tracking_id, coalesce(v.tz, e.tz) AS client_side_timezone,
  coalesce(v.lang, e.lang) AS client_side_language
FROM visits v LEFT JOIN (SELECT visit_id,
    arg_min(tracking_id, ts) FILTER (WHERE tracking_id IS NOT NULL) AS tracking_id,
    arg_min(tz, ts) FILTER (WHERE tz IS NOT NULL) AS tz, arg_min(lang, ts) FILTER (WHERE lang IS NOT NULL) AS lang
  FROM (SELECT coalesce(visit_id, a.vid) AS visit_id, ts, tracking_id, tz, lang FROM ve
        LEFT JOIN (SELECT e.id AS eid, v.id AS vid, v.ts AS vts FROM ve e ASOF JOIN visits v
                   ON e.ip = v.ip AND e.page_url = v.page_url AND e.ts >= v.ts) a
          ON a.eid = ve.id AND epoch_us(ts) - epoch_us(a.vts) <= 864000000000)
  GROUP BY 1) e ON e.visit_id = v.id""")
def visit_backfill(t):
    links = loc.link_events_to_visits(t.events, t.visits, SPACING, 0).select("id", "linked_visit_id")
    linked = t.events.join(links, "id").withColumn("visit_id", F.col("linked_visit_id"))
    return s.fill_from_events(t.visits, linked).select(
        "id", "tracking_id", "client_side_timezone", "client_side_language")


@query("session_attributes", """
SELECT session_id, arg_min(country, ts) FILTER (WHERE country IS NOT NULL) AS country,
  arg_min(city, ts) FILTER (WHERE city IS NOT NULL) AS city, arg_min(tz, ts) FILTER (WHERE tz IS NOT NULL) AS client_side_timezone,
  arg_min(lang, ts) FILTER (WHERE lang IS NOT NULL) AS client_side_language FROM visits GROUP BY 1""")
def session_attributes(t):
    return s.session_attributes(t.visits)


_USER_MATCH = """
FROM ve e ASOF LEFT JOIN {src} v ON {on} AND e.page_url = v.page_url AND e.ts >= v.ts"""


ORACLE_LINK = f"""
SELECT e.id, e.visit_id, coalesce(e.visit_id, i.vid, u.vid) AS linked_visit_id,
  CASE WHEN e.visit_id IS NOT NULL THEN 'explicit' WHEN i.vid IS NOT NULL THEN 'same_ip'
    WHEN u.vid IS NOT NULL THEN 'same_user' END AS link_rule
FROM ve e
LEFT JOIN (SELECT e.id, v.id AS vid, epoch_us(e.ts) - epoch_us(v.ts) AS age FROM ve e ASOF JOIN visits v
  ON e.ip = v.ip AND e.page_url = v.page_url AND e.ts >= v.ts) i ON i.id = e.id AND i.age <= 432000000000
LEFT JOIN (
  SELECT e.id, v.id AS vid, epoch_us(e.ts) - epoch_us(v.ts) AS age FROM ve e ASOF JOIN visits v
    ON e.client_id = v.client_id AND e.page_url = v.page_url AND e.ts >= v.ts
  UNION ALL
  SELECT e.id, v.id, epoch_us(e.ts) - epoch_us(v.ts) FROM (SELECT * FROM ve WHERE client_id IS NULL) e ASOF JOIN visits v
    ON e.ip = v.ip AND e.ua = v.ua AND e.page_url = v.page_url AND e.ts >= v.ts) u
  ON u.id = e.id AND u.age <= {SPACING * 1000000}"""


@query("event_visit_link", ORACLE_LINK)
def event_visit_link(t):
    return loc.link_events_to_visits(t.events, t.visits, 432_000, SPACING)


LINK_IP, LINK_USER = 43_200, 172_800

#: The fold row by row: ``seen`` holds the visits of a page that are young enough.
LINKED = f"""sought AS (
  SELECT 0 AS rank, id, ts, page_url, ip, ua, client_id FROM visits
  UNION ALL SELECT 1, id, ts, page_url, ip, ua, client_id FROM ve WHERE visit_id IS NULL),
numbered AS (
  SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY page_url ORDER BY ts, rank, id) AS rn FROM sought),
folded(page_url, rn, id, rank, vid, rule, seen) AS (
  SELECT page_url, 0::BIGINT, NULL::BIGINT, 0, NULL::BIGINT, NULL::VARCHAR,
    []::STRUCT(v BIGINT, us BIGINT, ip VARCHAR, ua VARCHAR, c VARCHAR)[] FROM (SELECT DISTINCT page_url FROM sought)
  UNION ALL
  SELECT page_url, rn, id, rank, coalesce(i, u, -id - 1),
    CASE WHEN i IS NOT NULL THEN 'same_ip' WHEN u IS NOT NULL THEN 'same_user' ELSE 'created' END,
    CASE WHEN rank = 0 OR i IS NULL AND u IS NULL THEN list_append(recent, struct_pack(
      v := CASE rank WHEN 0 THEN id ELSE -id - 1 END, us := us, ip := ip, ua := ua, c := client_id)) ELSE recent END
  FROM (
    SELECT *, CASE rank WHEN 1 THEN list_filter(recent, lambda x: x.ip = ip AND us - x.us <= {LINK_IP * 1000000})[-1].v END AS i,
      CASE rank WHEN 1 THEN list_filter(recent, lambda x: CASE WHEN client_id IS NOT NULL THEN x.c = client_id
        ELSE x.ip = ip AND x.ua = ua END AND us - x.us <= {LINK_USER * 1000000})[-1].v END AS u
    FROM (SELECT n.*, list_filter(f.seen, lambda x: n.us - x.us <= {LINK_USER * 1000000}) AS recent
          FROM folded f JOIN numbered n ON n.page_url = f.page_url AND n.rn = f.rn + 1))),
linked AS (
  SELECT id, vid AS linked_visit_id, rule AS link_rule FROM folded WHERE rank = 1
  UNION ALL SELECT id, visit_id, 'explicit' FROM ve WHERE visit_id IS NOT NULL)"""

#: Events under the session they get on arrival, and the visits made from them.
ARRIVED = """arrived AS (
  SELECT ve.* REPLACE (left(sha256(user_key || ':journey:' || seq), 32) AS session_id) FROM ve JOIN (
    SELECT f.id AS fid, f.user_key, sum((o.id IS NOT NULL)::INT) OVER (PARTITION BY f.user_key ORDER BY f.ts, f.id
      ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS seq
    FROM lf f LEFT JOIN (SELECT id FROM dd WHERE kept_id = id) o ON o.id = f.id) ON fid = ve.id),
made AS (SELECT -a.id - 1 AS vid, a.* FROM arrived a JOIN linked l ON l.id = a.id AND l.link_rule = 'created')"""


def _arrived(t):
    return s.assign_live(t.events, FAMILIES, 43_200).withColumn("session_id", F.col("live_session_id"))


@query("event_visits", "SELECT * FROM linked", LINKED)
def event_visits(t):
    return linking.link_or_create(t.events, t.visits, LINK_IP, LINK_USER)


@query("created_visits", """
SELECT m.vid AS id, m.session_id, m.ts AS timestamp, m.client_id, m.ip AS ip_address, m.page_url, m.source,
  coalesce(pv.country, ps.country) AS country, CASE WHEN pv.country IS NOT NULL THEN pv.city ELSE ps.city END AS city,
  CASE WHEN pv.country IS NOT NULL THEN 'visit' WHEN ps.country IS NOT NULL THEN 'session' ELSE 'none' END AS location_source
FROM made m
LEFT JOIN (SELECT a.vid, b.country, b.city, epoch_us(a.ts) - epoch_us(b.ts) AS age FROM made a
  ASOF JOIN (SELECT * FROM visits WHERE country <> 'XX') b ON a.ip = b.ip AND a.ts >= b.ts) pv
  ON pv.vid = m.vid AND pv.age <= 259200000000
LEFT JOIN (SELECT a.vid, b.country, b.city, epoch_us(a.ts) - epoch_us(b.ts) AS age FROM made a
  ASOF JOIN (SELECT ip, last_visit AS ts, country, city FROM sess WHERE country <> 'XX') b ON a.ip = b.ip AND a.ts >= b.ts) ps
  ON ps.vid = m.vid AND ps.age <= 259200000000""", LINKED, _LIVE, _spaced("dd", "le", "user_key", 43_200), ARRIVED)
def created_visits(t):
    events = _arrived(t)
    links = linking.link_or_create(events, t.visits, LINK_IP, LINK_USER)
    return linking.located_visits(linking.created_visits(events, links), t.visits, t.sessions, 72).select(
        "id", "session_id", "timestamp", "client_id", "ip_address", "page_url", "source", "country", "city",
        "location_source")


MOVES = """steps AS (
  SELECT id AS vid, 0 AS rank, id, ts, session_id FROM visits
  UNION ALL SELECT vid, 0, vid, ts, session_id FROM made
  UNION ALL SELECT l.linked_visit_id, 1, a.id, a.ts, a.session_id FROM arrived a JOIN linked l ON l.id = a.id
    WHERE a.client_id IS NOT NULL),
moves AS (
  SELECT * FROM (SELECT *, lag(session_id) OVER (PARTITION BY vid ORDER BY rank, ts, id) AS old FROM steps)
  WHERE rank = 1 AND session_id <> old)"""


@query("visit_moves", """
SELECT vid AS visit_id, id AS event_id, ts AS timestamp, old AS old_session_id, session_id FROM moves""",
       LINKED, _LIVE, _spaced("dd", "le", "user_key", 43_200), ARRIVED, MOVES)
def visit_moves(t):
    events = work_table(_arrived(t))
    links = work_table(linking.link_or_create(events, t.visits, LINK_IP, LINK_USER))
    return linking.visit_moves(events, t.visits, links)


@query("event_sessions", """
SELECT a.id, CASE WHEN a.client_id IS NOT NULL OR l.linked_visit_id IS NULL THEN a.session_id
  ELSE coalesce(m.session_id, v.session_id, d.session_id) END AS session_id
FROM arrived a LEFT JOIN linked l ON l.id = a.id
LEFT JOIN (SELECT x.id, y.session_id FROM (SELECT a.id, a.ts, linked_visit_id AS vid FROM arrived a JOIN linked USING (id)) x
           ASOF JOIN moves y ON x.vid = y.vid AND x.ts >= y.ts) m ON m.id = a.id
LEFT JOIN visits v ON v.id = l.linked_visit_id LEFT JOIN made d ON d.vid = l.linked_visit_id""",
       LINKED, _LIVE, _spaced("dd", "le", "user_key", 43_200), ARRIVED, MOVES)
def event_sessions(t):
    events = work_table(_arrived(t))
    links = work_table(linking.link_or_create(events, t.visits, LINK_IP, LINK_USER))
    return linking.event_sessions(events, t.visits, links, linking.visit_moves(events, t.visits, links))


ORACLE_MERGE = """
SELECT v.id, v.session_id AS old_session_id, e.session_id FROM visits v ASOF JOIN
  (SELECT * FROM (SELECT id, ts, ip, md5('x' || id % 50) AS session_id, visit_id FROM ve) WHERE visit_id IS NULL) e
  ON v.ip = e.ip AND v.ts <= e.ts
WHERE epoch_us(e.ts) - epoch_us(v.ts) <= 3600000000 AND e.session_id <> v.session_id"""


@query("recent_visit_merge", ORACLE_MERGE)
def recent_visit_merge(t):
    return loc.merge_recent_visits(other_sessions(t.events), t.visits, 3600)


def other_sessions(events):
    """Sessions of the log follow the address; other ones are needed for a move to happen."""
    return events.withColumn("session_id", F.expr("md5('x' || id % 50)"))


ORACLE_GEO = """
SELECT v.id, v.ip AS ip_address,
  CASE WHEN g THEN v.country WHEN pv.country IS NOT NULL THEN pv.country WHEN ps.country IS NOT NULL THEN ps.country
    WHEN o.country IS NOT NULL THEN o.country ELSE v.country END AS country,
  CASE WHEN g THEN v.city WHEN pv.country IS NOT NULL THEN pv.city WHEN ps.country IS NOT NULL THEN ps.city
    WHEN o.country IS NOT NULL THEN o.city ELSE v.city END AS city,
  CASE WHEN g THEN 'own' WHEN pv.country IS NOT NULL THEN 'visit' WHEN ps.country IS NOT NULL THEN 'session'
    WHEN o.country IS NOT NULL THEN 'own_session' ELSE 'none' END AS location_source
FROM (SELECT *, coalesce(country <> 'XX', false) AS g FROM visits) v
LEFT JOIN (SELECT a.id, b.country, b.city, epoch_us(a.ts) - epoch_us(b.ts) AS age FROM visits a
  ASOF JOIN (SELECT * FROM visits WHERE country <> 'XX') b ON a.ip = b.ip AND a.ts >= b.ts) pv
  ON pv.id = v.id AND pv.age <= 259200000000
LEFT JOIN (SELECT a.id, b.country, b.city, epoch_us(a.ts) - epoch_us(b.ts) AS age FROM visits a
  ASOF JOIN (SELECT ip, last_visit AS ts, country, city FROM sess WHERE country <> 'XX') b ON a.ip = b.ip AND a.ts >= b.ts) ps
  ON ps.id = v.id AND ps.age <= 259200000000
LEFT JOIN (SELECT id AS sid, country, city FROM sess) o ON o.sid = v.session_id"""


@query("geo_inherit", ORACLE_GEO)
def geo_inherit(t):
    return loc.inherit_location(t.visits, t.sessions, 72)


def _placed_sql(names: tuple[str, ...]) -> str:
    """Place by the last number of an address of the log, narrowest network first."""
    ie, at, de, fr, gb = (f"'{n}'" for n in names)
    return (f"CASE WHEN n BETWEEN 16 AND 23 THEN {ie} WHEN n = 25 THEN {at} WHEN n BETWEEN 24 AND 31 THEN {de} "
            f"WHEN n BETWEEN 32 AND 63 THEN {fr} ELSE {gb} END")


_COUNTRIES, _CITIES = ("IE", "AT", "DE", "FR", "GB"), ("Dublin", "Wien", "Berlin", "Paris", "London")


ORACLE_INTAKE = f"""
SELECT e.id, CASE r WHEN 'visit' THEN vc WHEN 'session' THEN sc WHEN 'address_session' THEN kc WHEN 'address_visit' THEN lc
    WHEN 'session_placeholder' THEN sc ELSE gc END AS country,
  CASE r WHEN 'visit' THEN vt WHEN 'session' THEN st WHEN 'address_session' THEN kt WHEN 'address_visit' THEN lt
    WHEN 'session_placeholder' THEN st ELSE gt END AS city, r AS place_rule
FROM (
  SELECT e.id, v.country AS vc, v.city AS vt, s.country AS sc, s.city AS st, k.country AS kc, k.city AS kt,
    l.country AS lc, l.city AS lt, g.country AS gc, g.city AS gt,
    CASE WHEN v.country <> 'XX' THEN 'visit' WHEN s.country <> 'XX' THEN 'session'
      WHEN k.country IS NOT NULL THEN 'address_session' WHEN l.country IS NOT NULL THEN 'address_visit'
      WHEN g.country <> 'XX' THEN 'lookup' WHEN s.country IS NOT NULL THEN 'session_placeholder'
      ELSE 'lookup_placeholder' END AS r
  FROM ve e LEFT JOIN visits v ON v.id = e.visit_id LEFT JOIN placed_sessions s ON s.id = e.session_id
  LEFT JOIN (SELECT a.id, b.country, b.city, epoch_us(a.ts) - epoch_us(b.ts) AS age FROM ve a
    ASOF JOIN (SELECT ip, last_visit AS ts, country, city FROM placed_sessions WHERE country <> 'XX') b
    ON a.ip = b.ip AND a.ts >= b.ts) k ON k.id = e.id AND k.age <= 259200000000
  LEFT JOIN (SELECT a.id, b.country, b.city, epoch_us(a.ts) - epoch_us(b.ts) AS age FROM ve a
    ASOF JOIN (SELECT * FROM visits WHERE country <> 'XX') b ON a.ip = b.ip AND a.ts >= b.ts) l
    ON l.id = e.id AND l.age <= 259200000000
  LEFT JOIN (SELECT ip, CASE WHEN n < 2 THEN 'XX' ELSE {_placed_sql(_COUNTRIES)} END AS country,
      CASE WHEN n < 2 THEN 'Unknown' ELSE {_placed_sql(_CITIES)} END AS city
    FROM (SELECT DISTINCT ip, CASE ip WHEN '10.0.0.5' THEN 0 WHEN '127.0.0.1' THEN 1
          ELSE split_part(ip, '.', 4)::INT END AS n FROM ve)) g ON g.ip = e.ip) e"""

#: Some sessions lose their place, some keep a placeholder, and some ended long ago.
PLACED_SESSIONS = """placed_sessions AS (
  SELECT id, ip, CASE WHEN k IN ('0', '1', '2', '3') THEN NULL WHEN k IN ('4', '5', '6', '7') THEN 'XX' ELSE country END AS country,
    CASE WHEN k IN ('0', '1', '2', '3', '4', '5', '6', '7') THEN 'Unknown' ELSE city END AS city,
    last_visit - INTERVAL 20 DAY AS last_visit FROM (SELECT *, left(id, 1) AS k FROM sess))"""


def placed_sessions(t):
    k = F.substring("id", 1, 1)
    return t.sessions.withColumn("country", F.when(k.between("0", "3"), None).when(k.between("4", "7"), "XX").otherwise(
        F.col("country"))).withColumn("city", F.when(k.between("0", "7"), "Unknown").otherwise(F.col("city"))).withColumn(
        "last_visit", F.col("last_visit") - F.expr("INTERVAL 20 DAY"))


@query("intake_places", ORACLE_INTAKE, PLACED_SESSIONS)
def intake_places(t):
    return loc.intake_places(t.events, t.visits, placed_sessions(t), weblog.networks(t.spark), 72)


_PLACED = """placed AS (
  SELECT e.*, v.country AS vc, v.city AS vt, s.country AS sc, s.city AS st, s.sid,
    CASE WHEN json_valid(data) THEN json_extract_string(data, '$.country') END AS pc,
    CASE WHEN json_valid(data) THEN json_extract_string(data, '$.city') END AS pt
  FROM ve e LEFT JOIN (SELECT id AS vid, session_id AS vsid, country, city FROM visits) v
    ON v.vid = e.visit_id AND v.vsid = e.session_id
  LEFT JOIN (SELECT id AS sid, country, city FROM sess) s ON s.sid = e.session_id),
resolved AS (
  SELECT *, CASE WHEN vc <> 'XX' THEN 'visit' WHEN sc <> 'XX' THEN 'session' WHEN pc <> 'XX' THEN 'event_data'
    WHEN pc = 'XX' AND sc IS NOT NULL THEN 'session_xx' WHEN pc = 'XX' AND vc IS NOT NULL THEN 'visit_xx'
    WHEN data IS NOT NULL THEN 'event_data_xx' ELSE 'none' END AS src FROM placed),
located AS (
  SELECT *, CASE WHEN src IN ('visit', 'visit_xx') THEN vc WHEN src IN ('session', 'session_xx') THEN sc
      WHEN src <> 'none' THEN pc END AS country,
    CASE WHEN src IN ('visit', 'visit_xx') THEN vt WHEN src IN ('session', 'session_xx') THEN st
      WHEN src <> 'none' THEN pt END AS city FROM resolved)"""


@query("event_location", "SELECT id, country, city, src AS location_source FROM located", _PLACED)
def event_location(t):
    return loc.resolve_event_location(t.events, t.visits, t.sessions).select(
        "id", F.col("r_country").alias("country"), F.col("r_city").alias("city"), "location_source")


@query("session_timeline", """
SELECT 'visit' AS item_type, session_id, id, ts AS timestamp, page_url, path, source, is_bot, crawler_type,
  NULL AS event_type, NULL AS country, NULL AS city, NULL AS location_source FROM visits
UNION ALL
SELECT 'event', session_id, id, ts, page_url, path, source, NULL, NULL, event_type, country, city, src FROM located""", _PLACED)
def session_timeline(t):
    return loc.session_timeline(t.visits, t.events, t.sessions)


_FIX_S = """bestv AS (SELECT session_id, country, city FROM visits WHERE country <> 'XX'
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) = 1),
fixs AS (
  SELECT s.id, CASE WHEN s.country IS NULL OR s.country = 'XX' THEN coalesce(b.country, s.country) ELSE s.country END AS country,
    CASE WHEN s.city IS NULL OR s.city = 'Unknown' THEN coalesce(b.city, s.city) ELSE s.city END AS city,
    ((s.country IS NULL OR s.country = 'XX') AND b.country IS NOT NULL)
      OR ((s.city IS NULL OR s.city = 'Unknown') AND b.city IS NOT NULL) AS changed
  FROM sess s LEFT JOIN bestv b ON b.session_id = s.id)"""

_FIX_V = """fixv AS (
  SELECT v.id, v.session_id, CASE WHEN v.country IS NULL OR v.country = 'XX' THEN CASE WHEN s.country <> 'XX' THEN s.country ELSE v.country END ELSE v.country END AS country,
    CASE WHEN v.city IS NULL OR v.city = 'Unknown' THEN CASE WHEN s.city <> 'Unknown' THEN s.city ELSE v.city END ELSE v.city END AS city,
    coalesce((v.country IS NULL OR v.country = 'XX') AND s.country <> 'XX', false)
      OR coalesce((v.city IS NULL OR v.city = 'Unknown') AND s.city <> 'Unknown', false) AS changed
  FROM visits v LEFT JOIN {src} s ON s.id = v.session_id)"""

_FIX_E = """fixe AS (
  SELECT e.id, pc, e.data IS NOT NULL AND (pc IS NULL OR pc = 'XX') AS needs, v.country AS vc, v.city AS vt,
    s.country AS sc, s.city AS st
  FROM (SELECT *, json_extract_string(data, '$.country') AS pc FROM ve) e
  LEFT JOIN {v} v ON v.id = e.visit_id LEFT JOIN {s} s ON s.id = e.session_id)"""


@query("geo_repair_sessions", "SELECT * FROM fixs", _FIX_S)
def geo_repair_sessions(t):
    return loc.repair_sessions(t.sessions, t.visits).select("id", "country", "city", "changed")


@query("geo_repair_visits", "SELECT id, country, city, changed FROM fixv", _FIX_V.format(src="sess"))
def geo_repair_visits(t):
    return loc.repair_visits(t.visits, t.sessions).select("id", "country", "city", "changed")


@query("geo_repair_events", """
SELECT id, CASE WHEN needs AND vc <> 'XX' THEN vc WHEN needs AND sc <> 'XX' THEN sc END AS country,
  CASE WHEN needs AND vc <> 'XX' THEN coalesce(vt, 'Unknown') WHEN needs AND sc <> 'XX' THEN coalesce(st, 'Unknown') END AS city,
  needs AND (coalesce(vc <> 'XX', false) OR coalesce(sc <> 'XX', false)) AS changed FROM fixe""",
       _FIX_E.format(v="visits", s="sess"))
def geo_repair_events(t):
    return loc.repair_events(t.events, t.visits, t.sessions).select("id", "country", "city", "changed")


@query("geo_repair_all", """
SELECT 'sessions' AS table_name, count(*) FILTER (WHERE changed) AS updated FROM fixs
UNION ALL SELECT 'visits', count(*) FILTER (WHERE changed) FROM fixv
UNION ALL SELECT 'events', count(*) FILTER (WHERE needs AND (coalesce(vc <> 'XX', false) OR coalesce(sc <> 'XX', false))) FROM fixe""",
       _FIX_S, _FIX_V.format(src="fixs"), _FIX_E.format(v="fixv", s="fixs"))
def geo_repair_all(t):
    return loc.repair_totals(t.visits, t.events, t.sessions)


@query("ip_locations", f"""
SELECT ip, CASE WHEN n < 2 THEN 'XX' ELSE {_placed_sql(_COUNTRIES)} END AS country,
  CASE WHEN n < 2 THEN 'Unknown' ELSE {_placed_sql(_CITIES)} END AS city
FROM (SELECT DISTINCT ip, CASE ip WHEN '10.0.0.5' THEN 0 WHEN '127.0.0.1' THEN 1 ELSE split_part(ip, '.', 4)::INT END AS n FROM visits)
UNION ALL
SELECT DISTINCT '::FFFF:81.2.69.' || n, {_placed_sql(_COUNTRIES)}, {_placed_sql(_CITIES)} FROM (SELECT u % 60 AS n FROM raw)
UNION ALL
SELECT DISTINCT '2a00:' || u % 8 || '::' || u % 60, CASE u % 8 WHEN 1 THEN 'SE' ELSE 'NO' END,
  CASE u % 8 WHEN 1 THEN 'Lund' ELSE 'Oslo' END FROM raw""")
def ip_locations(t):
    # Addresses of the log, and others made from its visitors: IPv6, and IPv4 inside IPv6.
    users = t.log.select(F.col("user_id").alias("u")).distinct()
    made = users.select(F.explode(F.expr(
        "array('::FFFF:81.2.69.' || u % 60, '2a00:' || u % 8 || '::' || u % 60)")).alias("ip_address"))
    return loc.locate_ips(t.visits.select("ip_address").unionByName(made), weblog.networks(t.spark))
