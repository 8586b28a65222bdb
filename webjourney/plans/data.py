"""Registered enrichment, quality, URL and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from webjourney.functions import agents, journeys, text, url
from webjourney.operators import ips, quality
from webjourney.operators import reports as r
from webjourney.operators import summaries as s
from webjourney.operators.ordered import work_dir
from webjourney.plans.registry import query
from webjourney.plans.sql_views import BROWSER_HITS, CONFIDENCE, CRAWLER_NAME
from webjourney.plans.summaries import _W
from webjourney.sources import io
from webjourney.sources.weblog import AS_OF, FAMILIES

SINCE = "2024-01-20 00:00:00"


# --- addresses ------------------------------------------------------------------------

_OPEN = f"""
SELECT ip, min(ts) AS first_seen_at, max(ts) AS last_seen_at FROM visits v
WHERE NOT is_bot AND ip NOT IN ('127.0.0.1', '::1', '')
  AND NOT EXISTS (SELECT 1 FROM ipe e WHERE e.ip = v.ip AND e.status = 'success' AND e.ttl > TIMESTAMP '{AS_OF}')
  AND NOT EXISTS (SELECT 1 FROM ipe e WHERE e.ip = v.ip AND e.status = 'error' AND e.attempts >= 3)
GROUP BY ip"""


@query("enrichment_candidates", _OPEN)
def enrichment_candidates(t):
    return ips.candidates(t.visits, t.ips, AS_OF)


@query("enrichment_coverage", """
SELECT total AS candidates_total, ok AS enriched_success_total, err AS enriched_error_total, failed AS enriched_failed_total,
  total - ok - err - failed AS enriched_skipped_total, round(ok / total * 100, 1)::DOUBLE AS coverage_percent
FROM (SELECT count(DISTINCT v.ip) AS total, count(DISTINCT e.ip) FILTER (WHERE e.status = 'success') AS ok,
        count(DISTINCT e.ip) FILTER (WHERE e.status = 'error') AS err,
        count(DISTINCT e.ip) FILTER (WHERE e.status = 'failed') AS failed
      FROM visits v LEFT JOIN ipe e USING (ip) WHERE NOT is_bot AND v.ip NOT IN ('127.0.0.1', '::1', ''))""")
def enrichment_coverage(t):
    return ips.coverage(t.visits, t.ips)


def _responses(t):
    return ips.candidates(t.visits, t.ips, AS_OF).withColumn("raw", F.expr(
        """'{"company":{"domain":" ' || upper(ip) || '.Example ","name":"N/A","type":"Hosting"},'
           || '"location":{"country_code":"GB"},"is_vpn":' || (ip LIKE '%5') || '}'"""))


@query("enrichment_normalize", f"""
SELECT ip, lower(ip) || '.example' AS company_domain, NULL::VARCHAR AS company_name, 'hosting' AS company_type, 'gb' AS country,
  ip LIKE '%5' AS is_vpn, NULL::BOOLEAN AS is_tor, TIMESTAMP '{AS_OF}' + INTERVAL 30 DAY AS ttl_expires_at,
  'success' AS status, 0::BIGINT AS attempt_count, first_seen_at FROM ({_OPEN})""")
def enrichment_normalize(t):
    return ips.normalize(_responses(t), AS_OF).select(
        "ip", "company_domain", "company_name", "company_type", "country", "is_vpn", "is_tor", "ttl_expires_at",
        "status", "attempt_count", "first_seen_at")


@query("upsert_keep_first", f"""
SELECT coalesce(n.ip, e.ip) AS ip, CASE WHEN n.ip IS NULL THEN e.status WHEN coalesce(e.attempts, 0) + 1 < 3 THEN 'error' ELSE 'failed' END AS status,
  CASE WHEN n.ip IS NULL THEN e.attempts ELSE coalesce(e.attempts, 0) + 1 END::BIGINT AS attempt_count,
  CASE WHEN n.ip IS NULL THEN e.company_domain END AS company_domain, least(n.first_seen_at, e.first_seen) AS first_seen_at,
  CASE WHEN n.ip IS NULL THEN e.last_seen ELSE n.last_seen_at END AS last_seen_at
FROM ({_OPEN}) n FULL JOIN ipe e ON n.ip = e.ip""")
def upsert_keep_first(t):
    errors = ips.candidates(t.visits, t.ips, AS_OF).selectExpr(
        "*", "'transient' AS error_code", "'timeout' AS error_message")
    return ips.upsert(t.ips, ips.failures(errors, t.ips, AS_OF)).select(
        "ip", "status", "attempt_count", "company_domain", "first_seen_at", "last_seen_at")


@query("visits_with_company", """
SELECT v.id, v.ip AS ip_address, e.company_domain, e.company_name FROM visits v LEFT JOIN ipe e ON e.ip = v.ip AND e.status = 'success'""")
def visits_with_company(t):
    return ips.enrich_visits(t.visits, t.ips).select("id", "ip_address", "company_domain", "company_name")


# --- URLs and agents ------------------------------------------------------------------

@query("url_parts", r"""
SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) AS scheme,
  regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) AS authority,
  nullif(regexp_extract(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1), ':(\d+)$', 1), '')::BIGINT AS port,
  regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS path,
  regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query,
  coalesce(array_to_string(list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
    lambda p: regexp_matches(p, '=.')), lambda p: replace(p, '=', ': ')), ' | '), '') AS params
FROM pages""", views=False)
def url_parts(t):
    u = F.col("url")
    return t.read("pages").select(
        "page_id", url.scheme(u).alias("scheme"), url.authority(u).alias("authority"), url.port(u).alias("port"),
        url.path(u).alias("path"), url.query(u).alias("query"),
        F.coalesce(url.render_params("url"), F.lit("")).alias("params"))


@query("utm", r"""
SELECT page_id, coalesce(nullif(regexp_extract(url, '[?&]utm_source=([^&#]+)', 1), ''),
    nullif(regexp_extract(url, '[?&]source=([^&#]+)', 1), ''), nullif(regexp_extract(url, '[?&]ref=([^&#]+)', 1), ''),
    regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS source,
  nullif(regexp_extract(url, '[?&]utm_medium=([^&#]+)', 1), '') AS medium,
  coalesce(nullif(regexp_extract(url, '[?&]utm_campaign=([^&#]+)', 1), ''),
    nullif(regexp_extract(url, '[?&]campaign=([^&#]+)', 1), '')) AS campaign FROM pages""", views=False)
def utm(t):
    # Each page stands for a referrer to itself.
    return url.with_attribution(t.read("pages"), "url", "url").select("page_id", "source", "medium", "campaign")


@query("event_attribution", "SELECT id, source, medium, campaign, nullif(ref_host, '') AS referrer_domain FROM ve")
def event_attribution(t):
    bare = t.events.select("id", "page_url", "referrer", url.referrer_domain(F.col("referrer")).alias("referrer_domain"))
    return url.with_attribution(bare).select("id", "source", "medium", "campaign", "referrer_domain")


@query("domain_family", r"""
SELECT page_id, CASE WHEN h = 'example.com' OR h LIKE '%.example.com' THEN 'com' WHEN h = 'example.net' OR h LIKE '%.example.net' THEN 'net' END AS family,
  CASE WHEN len(string_split(h, '.')) <= 2 THEN h ELSE array_to_string(string_split(h, '.')[-2:], '.') END AS root_domain
FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS h FROM pages)""", views=False)
def domain_family(t):
    h = url.host(F.col("url"))
    return t.read("pages").select(
        "page_id", url.domain_family(h, {"com": ("example.com",), "net": ("example.net",)}).alias("family"),
        url.root_domain(h).alias("root_domain"))


@query("request_noise", r"""
SELECT page_id, regexp_matches(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)),
    'posthog|segment|analytics|googletagmanager|amplitude|mixpanel|hotjar|fullstory|heap|intercom|pendo|logrocket|ghost|reo\.dev|twitter\.com|ads\.linkedin|cloudflareinsights|blog\.')
  OR regexp_matches(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)),
    '/analytics/|/tracking/|/telemetry/|/flags/|/decide/|/ghost/event|/adsct') AS is_noise FROM pages""", views=False)
def request_noise(t):
    return t.read("pages").select("page_id", url.is_analytics_noise(F.col("url"), ("blog.",)).alias("is_noise"))


@query("crawler_classify", f"""
SELECT id, user_agent, crawler IS NOT NULL AS is_crawler, crawler AS crawler_name, {CONFIDENCE} AS confidence,
  CASE WHEN crawler IN ('Unknown Bot') THEN 'general_pattern' WHEN crawler = 'Suspicious Bot' THEN 'suspicious_pattern'
    WHEN crawler = 'Empty User Agent' THEN 'empty_user_agent' WHEN crawler IS NOT NULL THEN 'pattern_match'
    WHEN ua <> '' AND {BROWSER_HITS} >= 2 THEN 'browser_pattern' ELSE 'unknown' END AS detection_method,
  CASE crawler WHEN 'GPTBot' THEN 'OpenAI' WHEN 'ClaudeBot' THEN 'Anthropic' WHEN 'GoogleBot' THEN 'Google'
    WHEN 'BingBot' THEN 'Microsoft' WHEN 'CCBot' THEN 'Common Crawl' END AS company
FROM (SELECT id, ua AS user_agent, ua, {CRAWLER_NAME} AS crawler FROM (
  SELECT id, CASE id % 4 WHEN 0 THEN ua || ' bingbot/2.0' WHEN 1 THEN upper(ua) WHEN 2 THEN '' ELSE ua || ' CCBot' END AS ua
  FROM hits WHERE id % 2 >= 0))""")
def crawler_classify(t):
    agents_seen = t.events.selectExpr(
        "id", "CASE id % 4 WHEN 0 THEN user_agent || ' bingbot/2.0' WHEN 1 THEN upper(user_agent) "
        "WHEN 2 THEN '' ELSE user_agent || ' CCBot' END AS user_agent")
    return agents.classify(agents_seen).drop("is_ai_crawler")


@query("visitor_category", """
SELECT category, count(*) AS visits FROM (SELECT CASE WHEN l LIKE '%gpt%' OR l LIKE '%openai%' THEN 'chatgpt'
    WHEN l LIKE '%claude%' OR l LIKE '%anthropic%' THEN 'claude' WHEN l LIKE '%perplexity%' THEN 'perplexity'
    WHEN l LIKE '%google%' AND l LIKE '%ai%' THEN 'google_ai' WHEN l LIKE '%bot%' THEN 'bot'
    WHEN l LIKE '%mobile%' THEN 'mobile_human'
    WHEN l LIKE '%mozilla%' OR l LIKE '%chrome%' OR l LIKE '%safari%' THEN 'desktop_human' ELSE 'other' END AS category
  FROM (SELECT lower(ua) AS l FROM visits)) GROUP BY 1""")
def visitor_category(t):
    return t.visits.groupBy(agents.visitor_category(F.col("user_agent")).alias("category")).agg(
        F.count("*").alias("visits"))


@query("session_entries", """
SELECT id, CASE WHEN event_type IN ('heartbeat', 'visibility', 'scroll') THEN false
  WHEN nullif(ref_host, '') IS NOT NULL THEN NOT regexp_matches(ref_host, '(^|[.])(siteone|sitetwo)[.]example(:[0-9]+)?$')
  WHEN nullif(source, '') IS NOT NULL THEN NOT regexp_matches(source, '(^|[.])(siteone|sitetwo)[.]example(:[0-9]+)?$')
  ELSE true END AS is_external FROM ve""")
def session_entries(t):
    c = F.col
    return t.events.select("id", journeys.live_boundary(
        c("event_type"), c("referrer_domain"), c("source"), c("medium"), c("campaign"), FAMILIES).alias("is_external"))


# --- text and payload quality ---------------------------------------------------------

_SPACE = r"\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_CTRL = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]"
_GOOD = f"[a-zA-Z0-9{_SPACE}" + r"@._\-+(),:;!?''\"<>/\\&%$#]"
_GOOD_NARROW = f"[a-zA-Z0-9{_SPACE}" + r"@._\-+(),:;!?''\"]"


def _garbage(c: str, good: str = _GOOD) -> str:
    clean = f"regexp_replace({c}, '{_CTRL}', '', 'g')"
    return (f"(coalesce({c}, '') <> '' AND (length({clean}) = 0 OR (length({clean}) - length(regexp_replace({clean}, '{good}', '', 'g')))"
            f" / length({clean}) < 0.3 OR NOT regexp_matches({clean}, '[a-zA-Z0-9]')))")


@query("text_quality", f"""
SELECT doc_id, {_garbage('text')} AS is_garbage, length(regexp_replace(text, '{_CTRL}', '', 'g')) AS clean_length
FROM documents""", views=False)
def text_quality(t):
    return quality.text_quality(t.read("documents")).select(
        "doc_id", "is_garbage", F.length("clean_text").alias("clean_length"))


@query("email_extract", r"""
SELECT doc_id, nullif(regexp_extract(text, '([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})', 1), '') AS email FROM documents""",
       views=False)
def email_extract(t):
    return t.read("documents").select("doc_id", text.first_email(F.col("text")).alias("email"))


@query("pii_mask", f"""
SELECT conv_id, turn, CASE WHEN sens THEN 'masked' WHEN bad THEN 'rejected' ELSE 'kept' END AS outcome,
  CASE WHEN NOT sens AND NOT bad THEN c END AS masked_value
FROM (SELECT *, regexp_matches(lower(coalesce(role, '')), 'password|pass|pwd|ssn|social|credit|card|cc|cvc|cvv|otp|token|secret|api_key|apikey|recaptcha|cvn') AS sens,
    (length(t) > 100 AND regexp_matches(t, '^[A-Za-z0-9+/=]+$'))
    OR (t LIKE 'eyJ%' AND len(string_split(t, '.')) = 3) OR {_garbage('t', _GOOD_NARROW)} AS bad
  FROM (SELECT *, regexp_replace(t, '{_CTRL}', '', 'g') AS c
        FROM (SELECT *, regexp_replace(coalesce(text, ''), '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') AS t FROM conversations)))""", views=False)
def pii_mask(t):
    return quality.mask_texts(t.read("conversations"), "text", "role", None).select(
        "conv_id", "turn", "outcome", "masked_value")


_CLEANED = f"""cleaned AS (
  SELECT id, old, CASE WHEN {_garbage('old')} THEN NULL
    ELSE trim(regexp_replace(old, '{_CTRL}', '', 'g')) END AS new
  FROM (SELECT id, CASE WHEN event_type = 'form_input' THEN json_extract_string(data, '$.field_value') END AS old
        FROM ve WHERE event_type IN ('form_submit', 'form_input') AND data IS NOT NULL))"""


@query("form_clean", """
SELECT id, old IS NOT NULL AND new IS DISTINCT FROM old AS changed, CASE WHEN old IS NOT NULL THEN new END AS field_value FROM cleaned""", _CLEANED)
def form_clean(t):
    return quality.clean_form_events(t.events).select(
        "id", "changed", F.get_json_object("event_data", "$.field_value").alias("field_value"))


@query("form_clean_totals", """
SELECT count(*) FILTER (WHERE old IS NOT NULL AND new IS DISTINCT FROM old) AS cleaned,
  count(*) FILTER (WHERE NOT (old IS NOT NULL AND new IS DISTINCT FROM old)) AS unchanged, count(*) AS total FROM cleaned""", _CLEANED)
def form_clean_totals(t):
    return quality.clean_form_totals(t.events)


@query("payload_flatten", """
SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS position, key, value FROM (
  SELECT id, generate_subscripts(ks, 1) AS i, unnest(ks) AS key, unnest(vs) AS value FROM (
    SELECT id, fk.ks, list_transform(fk.ks, lambda k: CASE WHEN contains(k, '.') AND k NOT LIKE 'memory%'
        THEN json_extract_string(data, '$.form_values."' || split_part(k, '.', 2) || '"')
        ELSE json_extract_string(data, '$."' || k || '"') END) AS vs
    FROM (SELECT id, data, list_concat(list_transform(list_filter(list_transform(coalesce(json_keys(data, '$.form_values'), []), lambda k: 'form_values.' || k), lambda k: true), lambda k: k),
        list_filter(json_keys(data), lambda k: k <> 'form_values')) AS ks FROM ve
      WHERE data LIKE '{"form_values"%') fk
    UNION ALL
    SELECT id, ks, list_transform(ks, lambda k: CASE WHEN k LIKE 'values.%' THEN json_extract_string(data, '$.values."' || split_part(k, '.', 2) || '"')
        ELSE trim(regexp_replace(json_extract_string(data, '$."' || k || '"'), '[[:cntrl:]]', '', 'g')) END)
    FROM (SELECT id, data, CASE WHEN data LIKE '{"values"%' THEN list_transform(json_keys(data, '$.values'), lambda k: 'values.' || k)
        ELSE json_keys(data) END AS ks FROM ve WHERE data LIKE '{%' AND data NOT LIKE '{"form_values"%')))
WHERE value = '' OR regexp_matches(value, '[a-zA-Z0-9]')""")
def payload_flatten(t):
    return quality.flatten_events(t.events)


# Hits with faults of every kind, as expressions that both SQL dialects read.
_FAULTY = {
    "page_url": "CASE id % 41 WHEN 1 THEN replace(page_url, 'https:', 'ftp:') WHEN 2 THEN 'https://-bad-.example/x' "
                "WHEN 3 THEN 'http://one' WHEN 4 THEN page_url || '/' || repeat('x', 2000) ELSE page_url END",
    "user_agent": "CASE id % 37 WHEN 1 THEN '' WHEN 2 THEN 'x <SCRIPT>' WHEN 3 THEN NULL WHEN 4 THEN repeat('a', 1001) "
                  "ELSE {ua} END",
    "ip_address": "CASE id % 31 WHEN 1 THEN '256.1.1.1' WHEN 2 THEN '2a00::1' WHEN 3 THEN '1::2::3' WHEN 4 THEN '1:2:3' "
                  "WHEN 5 THEN '1:2:3:4:5:6:7:8' WHEN 6 THEN '10.0.0' ELSE {ip} END",
    "page_domain": "CASE id % 29 WHEN 1 THEN 'no_dots.example' WHEN 2 THEN 'localhost:80' WHEN 3 THEN NULL "
                   "WHEN 4 THEN 'a.b:8080' WHEN 5 THEN 'plain' ELSE {domain} END",
    "event_data": "CASE id % 23 WHEN 1 THEN '{{\"__Proto__\":1}}' WHEN 2 THEN '{{\"a\":\"' || repeat('é', 5000) || '\"}}' "
                  "WHEN 3 THEN '{{\"a\":\"' || repeat('x', 5000) || '\"}}' WHEN 4 THEN '[1]' WHEN 5 THEN 'no json' "
                  "ELSE {data} END",
}
_FAULTY_SQL = ", ".join(
    f"{e.format(ua='ua', ip='ip', domain='domain', data='data')} AS {c}" for c, e in _FAULTY.items())
_LABELS = "len(list_filter(string_split({0}, '.'), lambda x: NOT regexp_full_match(x, '[a-zA-Z0-9]([a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?'))) = 0"
_DOMAIN = f"(bare = 'localhost' OR (contains(bare, '.') AND {_LABELS.format('bare')}))"


@query("hit_quality", f"""
SELECT id, CASE
  WHEN NOT (length(page_url) <= 2000 AND regexp_matches(page_url, '^https?://') AND {_DOMAIN.replace('bare', 'host')}) THEN 'url'
  WHEN tracking_id IS NOT NULL AND NOT regexp_full_match(tracking_id, '[a-zA-Z0-9_.-]{{1,100}}') THEN 'tracking_id'
  WHEN coalesce(user_agent, '') = '' OR length(user_agent) > 1000
    OR regexp_matches(lower(user_agent), '<script|javascript:|data:|vbscript:|onload=|onerror=|eval\\(|expression\\(') THEN 'user_agent'
  WHEN NOT CASE WHEN contains(ip_address, ':') THEN len(list_filter(groups, lambda g: length(g) > 4 OR NOT regexp_full_match(g, '[0-9a-fA-F]*'))) = 0
      AND CASE len(string_split(ip_address, '::')) WHEN 1 THEN len(groups) = 8
        WHEN 2 THEN len(list_filter(groups, lambda g: g <> '')) <= 7 ELSE false END
    ELSE len(octets) = 4 AND len(list_filter(octets, lambda o: coalesce(try_cast(o AS INT), 256) NOT BETWEEN 0 AND 255)) = 0 END THEN 'ip_address'
  WHEN page_domain IS NULL OR NOT {_DOMAIN} THEN 'page_domain'
  WHEN event_data IS NOT NULL AND NOT (json_valid(event_data) AND left(event_data, 1) = '{{' AND strlen(event_data) <= 10000
    AND NOT list_has_any(list_transform(coalesce(CASE WHEN left(event_data, 1) = '{{' THEN json_keys(event_data) END, []), lambda k: lower(k)),
      ['__proto__', 'constructor', 'prototype'])) THEN 'event_data' END AS reject_reason
FROM (SELECT *, regexp_extract(page_url, '^[a-z]+://([^/?#]*)', 1) AS host, split_part(page_domain, ':', 1) AS bare,
        string_split(ip_address, ':') AS groups, string_split(ip_address, '.') AS octets
      FROM (SELECT id, tracking_id, {_FAULTY_SQL} FROM ve))""")
def hit_quality(t):
    spoilt = {c: F.expr(e.format(ua="user_agent", ip="ip_address", domain="page_domain", data="event_data"))
              for c, e in _FAULTY.items()}
    return quality.check_hits(t.events.withColumns(spoilt)).select("id", "reject_reason")


_TAGGED_URL = """page_url || CASE WHEN contains(page_url, '?') THEN '&' ELSE '?' END || CASE id % 5
  WHEN 0 THEN 'a%20key!=%20x%01y%20' WHEN 1 THEN '%21=1&empty=&utm_source=second&ref=other' WHEN 2 THEN 'long=' || repeat('v', 700)
  WHEN 3 THEN repeat('k', 60) || '=1#part?x=2' ELSE 'plain+key=1+2' END"""


@query("clean_params", f"""
SELECT id, array_to_string(list_transform(list_filter(list_transform(
    list_filter(range(1, len(ks) + 1), lambda i: list_position(ks, ks[i]) = i), lambda i: struct_pack(
      k := regexp_replace(ks[i], '[^a-zA-Z0-9_-]', '', 'g'),
      v := trim(regexp_replace(vs[i], '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')))),
  lambda e: e.k <> '' AND e.v <> ''), lambda e: e.k || ': ' || e.v), ' | ') AS params
FROM (SELECT id, list_transform(ps, lambda p: url_decode(replace(split_part(p, '=', 1), '+', ' '))) AS ks,
        list_transform(ps, lambda p: url_decode(replace(substr(p, strpos(p, '=') + 1), '+', ' '))) AS vs
      FROM (SELECT id, list_filter(string_split(regexp_extract({_TAGGED_URL}, '\\?([^#]*)', 1), '&'),
              lambda p: regexp_matches(p, '^[^=]*=.')) AS ps FROM visits))""")
def clean_params(t):
    pairs = quality.clean_params("page_url")
    return t.visits.withColumn("page_url", F.expr(_TAGGED_URL)).select("id", F.array_join(
        F.transform(pairs, lambda e: F.concat(e["k"], F.lit(": "), e["v"])), " | ").alias("params"))


@query("rate_flags", """
SELECT id, ip AS ip_address, event_type, ts AS timestamp, n - 1 AS earlier, n - 1 >= 10 AS limited
FROM (SELECT *, count(*) OVER (PARTITION BY ip, event_type ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS n FROM ve)""")
def rate_flags(t):
    return quality.rate_flags(t.events, "event_type", 86_400, 10)


@query("event_search", """
SELECT id, event_type FROM ve WHERE event_type = 'form_submit' AND (data ILIKE '%corp.example%' OR page_url ILIKE '%corp.example%')""")
def event_search(t):
    from webjourney.functions.predicates import row_contains

    return row_contains(t.events.select("id", "event_type", "page_url", "event_data"), "CORP.example", "form_submit").select(
        "id", "event_type")


@query("ingest_noise", "SELECT id FROM ve WHERE event_type = 'form_submit' AND data LIKE '%timingsV2%'")
def ingest_noise(t):
    from webjourney.functions.forms import is_ingest_noise

    return t.events.where(is_ingest_noise(F.col("event_type"), F.col("event_data"))).select("id")


# --- exports and extracts -------------------------------------------------------------

_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"
_CS = "coalesce({0}tz, '') AS client_side_timezone, coalesce({0}lang, '') AS client_side_language, '' AS client_side_screen_resolution, " \
      "'' AS client_side_viewport_size, '' AS client_side_device_memory, '' AS client_side_connection_type"

_VISITS_CSV = f"""
SELECT v.id, {_ISO.format('ts')} AS timestamp, session_id, coalesce(client_id, '') AS client_id, ua AS user_agent, page_url,
  domain AS page_domain, path, coalesce(crawler_type, '') AS crawler_type,
  coalesce(CASE WHEN v.country IS NULL THEN s.country ELSE v.country END, '') AS country,
  coalesce(CASE WHEN v.country IS NULL THEN s.city ELSE v.city END, '') AS city, coalesce(tracking_id, '') AS tracking_id,
  coalesce(source, '') AS source, coalesce(medium, '') AS medium, coalesce(campaign, '') AS campaign,
  coalesce(referrer, '') AS referrer, '' AS page_title, 'GET' AS request_method, ip AS ip_address,
  CASE WHEN is_bot THEN 'True' ELSE 'False' END AS is_bot, '200' AS response_status, {_CS.format('v.')}
FROM visits v LEFT JOIN (SELECT id AS sid, country, city FROM sess) s ON s.sid = v.session_id"""


@query("visits_export", _VISITS_CSV)
def visits_export(t):
    return io.export_visits(t.visits, t.sessions)


@query("visits_export_day", _VISITS_CSV + " WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16'")
def visits_export_day(t):
    return io.export_visits(io.on_day(t.visits, "2024-01-15"), t.sessions)


@query("events_export", f"""
SELECT e.id, {_ISO.format('ts')} AS timestamp, coalesce(visit_id::VARCHAR, '') AS visit_id, session_id,
  coalesce(client_id, '') AS client_id, event_type, page_url, coalesce(referrer, '') AS referrer, path, domain AS page_domain,
  coalesce(ref_host, '') AS referrer_domain,
  coalesce(CASE WHEN pc IS NULL OR pc = 'XX' THEN s.country ELSE pc END, '') AS country,
  coalesce(CASE WHEN pc IS NULL OR pc = 'XX' THEN s.city ELSE pt END, '') AS city,
  coalesce(source, '') AS source, coalesce(medium, '') AS medium, coalesce(campaign, '') AS campaign,
  coalesce(tracking_id, '') AS tracking_id, '' AS crawler_type, '' AS is_bot, coalesce(data, '') AS event_data_json, {_CS.format('e.')}
FROM (SELECT *, json_extract_string(data, '$.country') AS pc, json_extract_string(data, '$.city') AS pt FROM ve) e
LEFT JOIN (SELECT id AS sid, country, city FROM sess) s ON s.sid = e.session_id""")
def events_export(t):
    return io.export_events(t.events, t.sessions)


@query("leads_export", f"""
SELECT client_id, coalesce(captured_page, '') AS captured_page, coalesce(captured_path, '') AS captured_path,
  coalesce(email, '') AS email, coalesce(name, '') AS name, {_ISO.format('captured_at')} AS captured_at,
  coalesce(source, 'direct') AS source, coalesce(medium, 'none') AS medium, coalesce(campaign, 'none') AS campaign,
  coalesce(captured_data, '') AS form_values FROM w_l""", *_W)
def leads_export(t):
    return io.export_leads(s.leads(s.client_summaries(t.visits, t.events)))


@query("journeys_export", f"""
SELECT client_id, coalesce(entry_page, '') AS entry_page, coalesce(exit_page, '') AS exit_page, coalesce(email, '') AS email,
  coalesce(name, '') AS name, coalesce(path_sequence, '') AS path_sequence, visit_count, form_fill_count,
  {_ISO.format('first_seen')} AS first_seen, {_ISO.format('last_seen')} AS last_seen, coalesce(source, 'direct') AS source,
  coalesce(medium, 'none') AS medium, coalesce(campaign, 'none') AS campaign, 'True' AS has_captured_data FROM w_j""", *_W)
def journeys_export(t):
    return io.export_journeys(s.journeys(s.client_summaries(t.visits, t.events)))


@query("partial_extract", f"""
SELECT 'sessions' AS table_name, count(*) AS rows FROM sess WHERE last_visit >= TIMESTAMP '{SINCE}'
UNION ALL SELECT 'visits', count(*) FROM visits WHERE ts >= TIMESTAMP '{SINCE}'
UNION ALL SELECT 'events', count(*) FROM ve WHERE ts >= TIMESTAMP '{SINCE}'
UNION ALL SELECT 'form_fills', count(*) FROM real_forms WHERE client_id IN
  (SELECT client_id FROM visits WHERE ts >= TIMESTAMP '{SINCE}' AND client_id IS NOT NULL)""", "FORMS")
def partial_extract(t):
    tables = {"sessions": t.sessions, "visits": t.visits, "events": t.events, "form_fills": s.form_fills(t.events)}
    return io.row_counts(io.partial_extract(tables, since=SINCE))


@query("stored_days", """
SELECT id, event_type, ts AS timestamp FROM ve WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08'""")
def stored_days(t):
    path = work_dir(t.spark)
    io.write_by_day(t.events.select("id", "event_type", "timestamp"), path)
    return io.read_days(t.spark, path, start="2024-01-05", end="2024-01-07")


@query("visits_csv", _VISITS_CSV)
def visits_csv(t):
    path, rows = work_dir(t.spark), io.export_visits(t.visits, t.sessions)
    io.write_csv(rows, path)
    return io.read_csv(t.spark, path, rows.schema)


@query("reload_counts", """
SELECT 'events' AS table_name, count(*) AS rows FROM ve UNION ALL SELECT 'sessions', count(*) FROM sess
UNION ALL SELECT 'visits', count(*) FROM visits""")
def reload_counts(t):
    path, tables = work_dir(t.spark), {"visits": t.visits, "sessions": t.sessions, "events": t.events}
    io.reload({n: df.where("id IS NULL") for n, df in tables.items()}, path)
    return io.reload(tables, path)


@query("purge_stored", """
SELECT (SELECT count(*) FROM visits) AS deleted_visits, (SELECT count(*) FROM sess) AS deleted_sessions,
  0::BIGINT AS visits_left, 0::BIGINT AS sessions_left, (SELECT count(*) FROM ve) AS events_left""")
def purge_stored(t):
    path = work_dir(t.spark)
    io.reload({"visits": t.visits, "sessions": t.sessions, "events": t.events.select("id")}, path)
    gone = io.purge(t.spark, f"{path}/visits", f"{path}/sessions")
    left = [t.spark.read.parquet(f"{path}/{n}").agg(F.count("*")).scalar().alias(f"{n}_left")
            for n in ("visits", "sessions", "events")]
    return gone.select("*", *left)


@query("merge_absent", f"""
SELECT id, session_id, ts AS timestamp FROM visits WHERE ts >= TIMESTAMP '{SINCE}'""")
def merge_absent(t):
    stored = t.visits.where(F.col("timestamp") < F.lit(SINCE).cast("timestamp"))
    return io.absent(t.visits, stored).select("id", "session_id", "timestamp")


@query("retention", "SELECT id FROM ve WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 15 DAY")
def retention(t):
    from webjourney.functions.predicates import keep_recent

    return keep_recent(t.events, AS_OF, 15).select("id")


@query("max_event_id", "SELECT max(id) AS last_id FROM ve")
def max_event_id(t):
    return r.max_id(t.events)


@query("latest_sessions", """
SELECT CASE WHEN client_id IS NOT NULL THEN 'cid:' || client_id ELSE 'ipua:' || ip || ':' || ua END AS user_key,
  id AS session_id, last_visit FROM sess
QUALIFY row_number() OVER (PARTITION BY coalesce('cid:' || client_id, 'ipua:' || ip || ':' || ua) ORDER BY last_visit DESC, id) = 1""")
def latest_sessions(t):
    from webjourney.operators.sessions import latest_sessions as latest

    return latest(t.sessions)


@query("crawler_catalogue", """
SELECT c.crawler, company, confidence::DOUBLE AS confidence, coalesce(n, 0) AS visits
FROM (VALUES ('GPTBot', 'OpenAI', 0.95), ('ChatGPT-User', 'OpenAI', 0.9), ('OpenAI', 'OpenAI', 0.85), ('ClaudeBot', 'Anthropic', 0.95),
  ('Claude-Web', 'Anthropic', 0.9), ('Anthropic', 'Anthropic', 0.85), ('Google-Extended', 'Google', 0.95), ('GoogleBot', 'Google', 0.8),
  ('PerplexityBot', 'Perplexity', 0.95), ('Perplexity', 'Perplexity', 0.85), ('BingBot', 'Microsoft', 0.8), ('EdgeGPT', 'Microsoft', 0.85),
  ('CCBot', 'Common Crawl', 0.75), ('Bytespider', 'ByteDance', 0.7)) c(crawler, company, confidence)
LEFT JOIN (SELECT crawler_type AS crawler, count(*) AS n FROM visits GROUP BY 1) v USING (crawler)""")
def crawler_catalogue(t):
    return r.crawler_catalogue(t.visits)


@query("text_profile", r"""
SELECT doc_id, CASE WHEN ok THEN nullif(regexp_extract(text, '["'']?email["'']?\s*[:=]\s*["'']?([^"'',|\s]+@[^"'',|\s]+)["'']?', 1, 'i'), '') END AS email
FROM (SELECT doc_id, text, coalesce(text, '') NOT IN ('', 'No info shared') AS ok FROM documents)""", views=False)
def text_profile(t):
    email, _ = text.profile_from_text(F.col("text"))
    return t.read("documents").select("doc_id", email.alias("email"))


@query("intake", """
SELECT id, ts AS timestamp, client_id, ip AS ip_address, event_type, path, domain AS page_domain,
  nullif(ref_host, '') AS referrer_domain, source, medium, campaign,
  CASE WHEN data IS NULL THEN '{' ELSE left(data, length(data) - 1) || ',' END
    || '"tracking_id":' || coalesce('"' || tracking_id || '"', 'null') || ',"source":' || coalesce('"' || source || '"', 'null')
    || ',"medium":' || coalesce('"' || medium || '"', 'null') || ',"campaign":' || coalesce('"' || campaign || '"', 'null')
    || ',"crawler_type":' || coalesce('"' || crawler || '"', 'null') || ',"is_bot":' || (crawler IS NOT NULL)
    || ',"tracking_method":"javascript"}' AS event_data,
  tz AS client_side_timezone, lang AS client_side_language
FROM ve WHERE id % 50 <> 7 AND NOT (event_type = 'form_submit' AND coalesce(data, '') LIKE '%timingsV2%')""")
def intake(t):
    from webjourney.streaming.live import enrich_intake

    # The log as the collector received it; every fiftieth hit lost its type on the way.
    raw = t.events.selectExpr(
        "id", "timestamp AS received_at", "IF(id % 50 = 7, NULL, event_type) AS event_type", "page_url", "referrer",
        "event_data AS data", "visit_id", "client_id AS cid", "tracking_id", "user_agent",
        "map('timezone', client_side_timezone, 'language', client_side_language) AS client_side_data",
        "IF(id % 3 = 0, ip_address || ', 10.9.9.9', NULL) AS x_forwarded_for",
        "IF(id % 3 = 1, ' ' || ip_address, NULL) AS x_real_ip",
        "IF(id % 3 = 2, 'by=x;for=\"' || ip_address || ':80\"', NULL) AS forwarded", "'192.0.2.1' AS peer")
    return enrich_intake(raw).select(
        "id", "timestamp", "client_id", "ip_address", "event_type", "path", "page_domain", "referrer_domain",
        "source", "medium", "campaign", "event_data", "client_side_timezone", "client_side_language")


@query("refresh_summaries", """
SELECT client_id, email, name, captured_at, form_data_shared FROM w_l""", *_W)
def refresh_summaries(t):
    # All three summaries refreshed from empty for every client with a form; the leads are shown.
    wide = s.client_summaries(t.visits, t.events)
    none = F.lit(False)
    current = {"journeys": s.journeys(wide).where(none), "leads": s.leads(wide).where(none),
               "form_fills": s.form_fills(t.events).where(none)}
    clients = s.real_forms(t.events).select("client_id").distinct()
    return s.refresh(t.visits, t.events, current, clients)["leads"].select(
        "client_id", "email", "name", "captured_at", "form_data_shared")
