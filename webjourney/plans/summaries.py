"""Registered summary, lead and path queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from webjourney.operators import paths as p
from webjourney.operators import reports as r
from webjourney.operators import summaries as s
from webjourney.operators.ordered import work_dir, work_table
from webjourney.operators.paging import Listing
from webjourney.operators.summary_store import SummaryStore
from webjourney.plans.registry import query
from webjourney.sources.weblog import AS_OF

SINCE = "2024-01-10 00:00:00"

_RENDER = ("array_to_string(list_transform(list_filter(list_zip(keys, vals), lambda p: coalesce(p[2], '') <> ''), "
           "lambda p: p[1] || ': ' || p[2]), ' | ')")
_PERSONAL = ("'gmail.com','googlemail.com','yahoo.com','hotmail.com','outlook.com','live.com','msn.com','me.com',"
             "'icloud.com','qq.com','protonmail.com','proton.me','yandex.com','gmx.com','aol.com'")


def _wide(name: str, forms: str, visits: str, profile: str = "best") -> str:
    pick = {
        "best": f"""coalesce(arg_max(f_email, o) FILTER (WHERE split_part(f_email, '@', 2) NOT IN ({_PERSONAL})),
      arg_max(f_email, o) FILTER (WHERE f_email IS NOT NULL)) AS email,
    coalesce(arg_max(struct_pack(n := f_name), o) FILTER (WHERE split_part(f_email, '@', 2) NOT IN ({_PERSONAL})).n,
      arg_max(struct_pack(n := f_name), o) FILTER (WHERE f_email IS NOT NULL).n) AS name""",
        "first": "arg_min(struct_pack(e := f_email), o).e AS email, arg_min(struct_pack(n := f_name), o).n AS name",
    }[profile]
    return f"""{name}_f AS (
  SELECT client_id, count(*) AS n, min(ts) AS a, max(ts) AS b,
    arg_min(struct_pack(ts, page_url, path, fv, r := {_RENDER}), o) AS ff, arg_max(page_url, o) AS last_page, {pick}
  FROM (SELECT *, struct_pack(ts, id) AS o FROM {forms}) GROUP BY client_id),
{name}_d AS (
  SELECT *, trim(coalesce(path, '')) AS tp, lag(trim(coalesce(path, ''))) OVER (PARTITION BY client_id ORDER BY ts, id) AS pp
  FROM {visits} WHERE client_id IS NOT NULL),
{name}_v AS (
  SELECT client_id, count(*) AS n, min(ts) AS a, max(ts) AS b,
    arg_min(struct_pack(page_url, source, medium, campaign, referrer, ref_host), struct_pack(ts, id)) AS fv,
    arg_max(page_url, struct_pack(ts, id)) AS last_page,
    string_agg(CASE WHEN tp = '' THEN '(page)' ELSE tp END, ' → ' ORDER BY ts, id) FILTER (WHERE pp IS NULL OR pp <> tp) AS seq
  FROM {name}_d GROUP BY client_id),
{name}_j AS (
  SELECT f.client_id, least(v.a, f.a) AS first_seen, greatest(v.b, f.b) AS last_seen, coalesce(v.n, 0) AS visit_count,
    CASE WHEN v.n IS NOT NULL THEN v.fv.page_url ELSE f.ff.page_url END AS entry_page,
    CASE WHEN v.n IS NOT NULL THEN v.last_page ELSE f.last_page END AS exit_page, v.seq AS path_sequence,
    email, name, 1::BIGINT AS has_captured_data, f.n AS form_fill_count, v.fv.source AS source, v.fv.medium AS medium,
    v.fv.campaign AS campaign
  FROM {name}_f f LEFT JOIN {name}_v v USING (client_id)),
{name}_l AS (
  SELECT f.client_id, email, name, f.ff.ts AS captured_at, f.ff.page_url AS captured_page, f.ff.path AS captured_path,
    nullif(f.ff.r, '') AS form_data_shared, f.ff.fv AS captured_data, v.fv.source AS source,
    v.fv.medium AS medium, v.fv.campaign AS campaign, v.fv.referrer AS first_referrer,
    nullif(v.fv.ref_host, '') AS first_referrer_domain, least(v.a, f.a) AS first_seen, greatest(v.b, f.b) AS last_seen
  FROM {name}_f f LEFT JOIN {name}_v v USING (client_id))"""


_W = ("FORMS", _wide("w", "real_forms", "visits"))
_W_FIRST = ("FORMS", _wide("w", f"(SELECT * FROM real_forms WHERE ts >= TIMESTAMP '{SINCE}')",
                           f"(SELECT * FROM visits WHERE ts >= TIMESTAMP '{SINCE}')", "first"))


def _wide_rows(t):
    return s.client_summaries(t.visits, t.events)


@query("journey_summary", "SELECT * FROM w_j", *_W)
def journey_summary(t):
    return s.journeys(_wide_rows(t))


@query("lead_summary", "SELECT * FROM w_l", *_W)
def lead_summary(t):
    return s.leads(_wide_rows(t))


_FILLS = """SELECT client_id, id AS visit_event_id, ts AS timestamp, page_url, path, fv AS form_values,
  coalesce(json_extract(data, '$.filled_fields')::BIGINT, len(keys)) AS filled_fields,
  json_extract_string(data, '$.id') AS form_id, json_extract_string(data, '$.action') AS form_action FROM real_forms"""


@query("form_fills", _FILLS, "FORMS")
def form_fills(t):
    return s.form_fills(t.events)


@query("form_fills_between", _FILLS + " WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-02-01'", "FORMS")
def form_fills_between(t):
    return r.form_fills_between(s.form_fills(t.events), "2024-01-01", "2024-02-01")


@query("journey_list", """
SELECT client_id, visit_count, form_fill_count, first_seen, last_seen, entry_page, exit_page,
  coalesce(source, 'direct') AS source, coalesce(medium, 'none') AS medium, coalesce(campaign, 'none') AS campaign,
  true AS has_captured_data, email, name, path_sequence
FROM w_j WHERE path_sequence ILIKE '%/demo%' AND path_sequence ILIKE '%/pricing%'""", *_W)
def journey_list(t):
    return s.list_journeys(s.journeys(_wide_rows(t)), "/demo, /pricing", captured_only=True)


@query("journey_page", """
SELECT client_id, visit_count, first_seen, last_seen, entry_page, email, path_sequence FROM w_j
ORDER BY last_seen DESC, client_id LIMIT 5 OFFSET 3""", *_W)
def journey_page(t):
    listing = Listing(s.journeys(_wide_rows(t)).select(
        "client_id", "visit_count", "first_seen", "last_seen", "entry_page", "email", "path_sequence"),
        [F.desc("last_seen"), "client_id"])
    return listing.page(5, 3)


@query("lead_list", """
SELECT client_id, captured_at, captured_page, captured_path, email, name, coalesce(source, 'direct') AS source,
  coalesce(medium, 'none') AS medium, coalesce(campaign, 'none') AS campaign, form_data_shared, captured_data
FROM w_l WHERE captured_path ILIKE '/%' AND lower(source) = 'google'""", *_W)
def lead_list(t):
    return s.list_leads(s.leads(_wide_rows(t)), "/", source="Google")


@query("leads_with_journeys", """
SELECT l.client_id, l.email, l.name, l.captured_at, l.source, l.campaign, j.path_sequence
FROM w_l l LEFT JOIN w_j j USING (client_id) WHERE l.email IS NOT NULL""", *_W)
def leads_with_journeys(t):
    wide = _wide_rows(t)
    return s.leads_with_journeys(s.leads(wide), s.journeys(wide))


@query("top_journeys", f"""
SELECT client_id, entry_page, exit_page, visit_count, path_sequence, source, campaign FROM w_j
WHERE last_seen > TIMESTAMP '{AS_OF}' - INTERVAL 31 DAY ORDER BY visit_count DESC, client_id LIMIT 100""", *_W)
def top_journeys(t):
    return r.top_journeys(s.journeys(_wide_rows(t)), AS_OF, days=31)


@query("reconcile_leads", """
SELECT client_id FROM w_j WHERE client_id NOT IN (SELECT client_id FROM w_l WHERE email IS NOT NULL)""", *_W)
def reconcile_leads(t):
    # Leads without an address stand for the missing ones.
    wide = _wide_rows(t)
    return s.unreconciled(s.journeys(wide), s.leads(wide).where("email IS NOT NULL"))


@query("reconcile_refresh", "SELECT client_id, email, name, captured_at, form_data_shared FROM w_l", *_W)
def reconcile_refresh(t):
    # Kept summaries of which the leads without an address got lost; the check finds and rebuilds them.
    store = SummaryStore(t.spark, work_dir(t.spark), buckets=8)
    store.refresh(t.visits, t.events, s.real_forms(t.events).select("client_id"))
    wide = work_table(_wide_rows(t))
    store.overwrite("leads", s.leads(wide).where("email IS NOT NULL"))
    store.reconcile(t.visits, t.events)
    return store.read("leads", s.leads(wide)).select("client_id", "email", "name", "captured_at", "form_data_shared")


@query("changed_clients", f"SELECT DISTINCT client_id FROM real_forms WHERE ts > TIMESTAMP '{SINCE}'", "FORMS")
def changed_clients(t):
    return s.changed_clients(t.events, SINCE)


@query("summary_backfill", "SELECT * FROM w_j", *_W_FIRST)
def summary_backfill(t):
    return s.journeys(s.client_summaries(t.visits, t.events, profile="first", since=SINCE))


@query("lead_backfill", "SELECT * FROM w_l", *_W_FIRST)
def lead_backfill(t):
    return s.leads(s.client_summaries(t.visits, t.events, profile="first", since=SINCE))


@query("incremental_summaries", "SELECT * FROM w_j", *_W)
def incremental_summaries(t):
    # Summaries as of the watermark, then only the changed clients rebuilt: equals a full rebuild
    # of those, while the others keep what they had.
    from pyspark.sql import functions as F

    early_v = t.visits.where(F.col("timestamp") <= F.lit(SINCE).cast("timestamp"))
    early_e = t.events.where(F.col("timestamp") <= F.lit(SINCE).cast("timestamp"))
    current = s.journeys(s.client_summaries(early_v, early_e))
    changed = s.changed_clients(t.events, SINCE)
    # Clients whose visits (not forms) grew after the watermark are refreshed as well here.
    grown = t.visits.where(F.col("timestamp") > F.lit(SINCE).cast("timestamp")).select("client_id").join(
        current.select("client_id"), "client_id", "left_semi")
    changed = changed.unionByName(grown).distinct()
    rebuilt = s.journeys(s.client_summaries(t.visits, t.events, clients=changed))
    return s.replace_clients(current, rebuilt, changed)


@query("lead_detail", """
SELECT c.client_id, c.n AS captured_events, coalesce(rf.n, 0) AS form_fills, l.ts AS captured_at, l.page_url, l.path,
  CASE WHEN coalesce(CASE WHEN l.fv IS NOT NULL THEN l.fv ELSE json_extract(l.data, '$.values')::VARCHAR END, '') <> ''
    THEN CASE WHEN l.fv IS NOT NULL THEN l.fv ELSE json_extract(l.data, '$.values')::VARCHAR END ELSE rf.fv END AS form_values,
  CASE l.id % 7 WHEN 3 THEN 'utm_source: google | utm_medium: cpc | utm_campaign: spring' WHEN 4 THEN 'ref: partner'
    WHEN 5 THEN 'email: u' || l.u || '@corp.example | name: User ' || l.u END AS url_params
FROM (SELECT client_id, count(*) AS n FROM fx WHERE client_id IS NOT NULL GROUP BY 1) c
JOIN (SELECT * FROM fx QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY ts DESC, id DESC) = 1) l USING (client_id)
LEFT JOIN (SELECT client_id, count(*) AS n, arg_max(fv, struct_pack(ts, id)) AS fv FROM real_forms GROUP BY 1) rf USING (client_id)""",
       "FORMS")
def lead_detail(t):
    return s.lead_detail(t.events)


@query("captured_events", """
SELECT client_id, id, ts AS timestamp, page_url, path,
  CASE WHEN fv IS NOT NULL THEN fv ELSE json_extract(data, '$.values')::VARCHAR END AS form_values
FROM fx WHERE client_id IS NOT NULL""", "FORMS")
def captured_events(t):
    return s.captured_events(t.events)


@query("page_flows", f"""
SELECT prev AS from_path, path AS to_path, count(*) AS count
FROM (SELECT path, lag(path) OVER (PARTITION BY session_id ORDER BY ts, id) AS prev FROM visits
      WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 31 DAY)
WHERE prev IS NOT NULL GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 100""")
def page_flows(t):
    return p.page_flows(t.visits, AS_OF, days=31)


@query("path_analysis", """
SELECT j.uid AS unique_user_key, coalesce(any_value(cp.params), any_value(fc.forms), 'No info shared') AS form_data_shared,
  string_agg(j.path, ' → ' ORDER BY j.ts, j.id) FILTER (WHERE j.prev IS NULL OR j.prev <> j.path) AS journey_to_conversion,
  any_value(ua.referrer) AS original_referrer, any_value(ua.source) AS original_utm_source,
  any_value(ua.medium) AS original_utm_medium, any_value(ua.ts) AS user_acquired_at, any_value(sc.conv) AS conversion_at,
  round(any_value((epoch_us(sc.conv) - epoch_us(ua.ts)) / 1e6), 6) AS time_to_convert_seconds
FROM (SELECT v.uid, v.path, v.ts, v.id, lag(v.path) OVER (PARTITION BY v.uid ORDER BY v.ts, v.id) AS prev
      FROM visits v JOIN sc USING (uid) WHERE v.ts <= sc.conv) j
JOIN sc USING (uid) JOIN ua USING (uid) LEFT JOIN cp USING (uid) LEFT JOIN fc USING (uid) GROUP BY j.uid""",
       "hit AS (SELECT * FROM visits WHERE regexp_matches(path, '^.*/schedule([/?#]|$)', 'i'))",
       "sc AS (SELECT uid, min(ts) AS conv FROM hit GROUP BY 1)",
       """cp AS (SELECT uid, CASE WHEN id % 7 = 5 THEN 'name: User ' || u || ' | email: u' || u || '@corp.example' END AS params
FROM hit QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ts, id) = 1)""",
       "ua AS (SELECT * FROM visits QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ts, id) = 1)",
       """fc AS (SELECT uid, string_agg(DISTINCT x, ' | ' ORDER BY x) AS forms FROM (
  SELECT e.uid, 'Form on ' || e.path || ': ' || e.data AS x FROM ve e JOIN sc USING (uid)
  WHERE e.event_type = 'form_submit' AND e.ts <= sc.conv AND data NOT LIKE '%timingsV2%'
    AND data NOT LIKE '%memory.totalJSHeapSize%' AND data NOT LIKE '%eventType%') GROUP BY uid)""")
def path_analysis(t):
    return p.path_analysis(t.visits, t.events, "/schedule", AS_OF, days=31)


_STITCH = (
    """sv AS (SELECT client_id, min(ts) AS started FROM visits WHERE client_id IS NOT NULL
  AND regexp_matches(path, '^.*/sign-up([/?#]|$)', 'i') GROUP BY 1)""",
    """scm AS (SELECT v.client_id, any_value(started) AS started, min(v.ts) AS done FROM visits v JOIN sv USING (client_id)
  WHERE regexp_matches(v.path, '^.*/company-info([/?#]|$)', 'i') AND v.ts >= started GROUP BY 1)""",
    """rel AS (
  SELECT scm.client_id AS cid, v.* FROM visits v JOIN scm USING (client_id)
  UNION ALL
  SELECT scm.client_id, v.* FROM scm JOIN visits tv ON tv.client_id = scm.client_id
    JOIN visits v ON v.ip = tv.ip AND v.ua = tv.ua AND v.ts BETWEEN tv.ts - INTERVAL 24 HOUR AND tv.ts
      AND v.client_id IS DISTINCT FROM scm.client_id)""",
)


@query("stitched_visits", """
SELECT cid AS unified_client_id, id, count(*) AS times, any_value(ts) AS timestamp, any_value(path) AS path
FROM rel GROUP BY 1, 2""", *_STITCH)
def stitched_visits(t):
    done = p.completers(t.visits, "/sign-up", "/company-info")
    return p.stitch_visits(t.visits, done, carried=("id", "timestamp", "path"))


@query("stitched_funnel", """
SELECT s.client_id AS unique_user_key, j.path AS full_journey_path, coalesce(p1.x, 'No URL params') AS signup_page_params,
  coalesce(e1.x, 'No form data') AS raw_signup_events,
  nullif(regexp_extract(e1.x, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}'), '') AS potentially_extracted_email,
  coalesce(p2.x, 'No URL params') AS company_info_url_params, coalesce(e2.x, 'No form data') AS company_info_form_data,
  f.referrer AS original_referrer, f.source AS original_utm_source, f.medium AS original_utm_medium,
  f.ts AS user_acquired_at, s.started AS signup_visited_at, s.done AS company_info_completed_at,
  round((epoch_us(s.done) - epoch_us(f.ts)) / 1e6, 6) AS total_seconds,
  round((epoch_us(s.done) - epoch_us(s.started)) / 1e6, 6) AS funnel_seconds
FROM scm s
LEFT JOIN (SELECT * FROM rel QUALIFY row_number() OVER (PARTITION BY cid ORDER BY ts, id) = 1) f ON f.cid = s.client_id
LEFT JOIN (SELECT cid, string_agg(rel.path || ' (' || domain || ')', ' → ' ORDER BY rel.ts, rel.id) AS path
           FROM rel JOIN scm ON scm.client_id = cid WHERE rel.ts <= scm.done GROUP BY 1) j ON j.cid = s.client_id
LEFT JOIN (SELECT cid, string_agg(DISTINCT x, ' || ' ORDER BY x) AS x FROM (
    SELECT cid, CASE id % 7 WHEN 5 THEN 'email: u' || u || '@corp.example | name: User ' || u END AS x
    FROM rel WHERE path = '/sign-up') GROUP BY 1) p1 ON p1.cid = s.client_id
LEFT JOIN (SELECT cid, string_agg(DISTINCT x, ' || ' ORDER BY x) AS x FROM (
    SELECT cid, CASE id % 7 WHEN 5 THEN 'email: u' || u || '@corp.example | name: User ' || u
      WHEN 4 THEN 'ref: partner' END AS x FROM rel WHERE path = '/company-info') GROUP BY 1) p2 ON p2.cid = s.client_id
LEFT JOIN (SELECT cid, x FROM sent WHERE place = 'sign-up') e1 ON e1.cid = s.client_id
LEFT JOIN (SELECT cid, x FROM sent WHERE place = 'company-info') e2 ON e2.cid = s.client_id""",
       *_STITCH, """sent AS (
  SELECT rel.cid, place, '[' || string_agg(e.data, ', ' ORDER BY e.ts, e.id) || ']' AS x
  FROM rel JOIN ve e ON rel.id = coalesce(e.visit_id, e.id - 1) JOIN (VALUES ('sign-up'), ('company-info')) w(place)
    ON contains(lower(e.path), '/' || place)
  WHERE e.event_type IN ('form_submit', 'custom', 'click', 'form_start') AND e.data IS NOT NULL GROUP BY 1, 2)""")
def stitched_funnel(t):
    # The log links page hits only: here other events belong to the hit numbered one lower, if there is one.
    events = t.events.withColumn("visit_id", F.coalesce("visit_id", F.col("id") - 1))
    return p.stitched_funnel(t.visits, events)
