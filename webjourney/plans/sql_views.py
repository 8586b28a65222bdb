"""The web-log views as DuckDB common table expressions, for the oracle queries.

Written independently of the DataFrame views; only the literal lists are shared.
"""

from __future__ import annotations

from webjourney.sources import weblog as w


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


CRAWLER_NAME = """CASE
  WHEN ua IS NULL OR ua = '' THEN NULL
  WHEN regexp_matches(ua, 'gptbot', 'i') THEN 'GPTBot'
  WHEN regexp_matches(ua, 'chatgpt-user', 'i') THEN 'ChatGPT-User'
  WHEN regexp_matches(ua, 'openai', 'i') THEN 'OpenAI'
  WHEN regexp_matches(ua, 'claudebot', 'i') THEN 'ClaudeBot'
  WHEN regexp_matches(ua, 'claude-web', 'i') THEN 'Claude-Web'
  WHEN regexp_matches(ua, 'anthropic', 'i') THEN 'Anthropic'
  WHEN regexp_matches(ua, 'google-extended', 'i') THEN 'Google-Extended'
  WHEN regexp_matches(ua, 'googlebot', 'i') THEN 'GoogleBot'
  WHEN regexp_matches(ua, 'perplexitybot', 'i') THEN 'PerplexityBot'
  WHEN regexp_matches(ua, 'perplexity', 'i') THEN 'Perplexity'
  WHEN regexp_matches(ua, 'bingbot', 'i') THEN 'BingBot'
  WHEN regexp_matches(ua, 'edgegpt', 'i') THEN 'EdgeGPT'
  WHEN regexp_matches(ua, 'ccbot', 'i') THEN 'CCBot'
  WHEN regexp_matches(ua, 'bytespider', 'i') THEN 'Bytespider'
  WHEN regexp_matches(ua, 'bot|crawler|spider|scraper|robot|crawling', 'i') THEN 'Unknown Bot'
  WHEN regexp_matches(ua, 'python|curl|wget|scrapy|selenium|headless|phantomjs', 'i') THEN 'Suspicious Bot'
  WHEN length(ua) < 10 THEN 'Empty User Agent'
END"""

BROWSER_HITS = (
    "(regexp_matches(ua,'mozilla','i')::INT + regexp_matches(ua,'chrome','i')::INT"
    " + regexp_matches(ua,'safari','i')::INT + regexp_matches(ua,'firefox','i')::INT"
    " + regexp_matches(ua,'edge','i')::INT + regexp_matches(ua,'opera','i')::INT)")

CONFIDENCE = f"""CASE crawler
  WHEN 'GPTBot' THEN 0.95 WHEN 'ChatGPT-User' THEN 0.9 WHEN 'OpenAI' THEN 0.85
  WHEN 'ClaudeBot' THEN 0.95 WHEN 'Claude-Web' THEN 0.9 WHEN 'Anthropic' THEN 0.85
  WHEN 'Google-Extended' THEN 0.95 WHEN 'GoogleBot' THEN 0.8 WHEN 'PerplexityBot' THEN 0.95
  WHEN 'Perplexity' THEN 0.85 WHEN 'BingBot' THEN 0.8 WHEN 'EdgeGPT' THEN 0.85 WHEN 'CCBot' THEN 0.75
  WHEN 'Bytespider' THEN 0.7 WHEN 'Unknown Bot' THEN 0.6 WHEN 'Suspicious Bot' THEN 0.5
  WHEN 'Empty User Agent' THEN 0.4
  ELSE CASE WHEN ua IS NULL OR ua = '' THEN 0.0 WHEN {BROWSER_HITS} >= 2 THEN 0.8 ELSE 0.3 END END"""

VIEWS = f"""
raw AS (
  SELECT event_id AS id, ts, user_id AS u, event_type AS kind, value, props,
    CASE WHEN user_id % 10 <> 9 THEN 'c' || user_id END AS client_id,
    CASE user_id % 60 WHEN 0 THEN '10.0.0.5' WHEN 1 THEN '127.0.0.1'
      ELSE '81.2.69.' || (user_id % 60) END AS ip,
    {_list(w.USER_AGENTS)}[user_id % 12 + 1] AS ua,
    {_list(w.PATHS)}[(7 * event_id + 3 * user_id) % 12 + 1] AS path,
    {_list(w.DOMAINS)}[(event_id + user_id) % 3 + 1] AS domain,
    {_list(w.REFERRERS)}[(11 * event_id + 5 * user_id) % 8 + 1] AS referrer,
    {_list(w.TRACKING_IDS)}[event_id % 3 + 1] AS tracking_id,
    {_list(w.TIMEZONES)}[event_id % 3 + 1] AS tz,
    {_list(w.LANGUAGES)}[event_id % 2 + 1] AS lang,
    CASE event_id % 7 WHEN 3 THEN '?utm_source=google&utm_medium=cpc&utm_campaign=spring'
      WHEN 4 THEN '?ref=partner'
      WHEN 5 THEN '?email=u' || user_id || '%40corp.example&name=User+' || user_id ELSE '' END AS qs
  FROM events),
hits AS (
  SELECT *, 'https://' || domain || path || qs AS page_url, md5(ip || '|' || ua) AS session_id,
    regexp_extract(referrer, '^[a-z]+://([^/?#]*)', 1) AS ref_host,
    {CRAWLER_NAME} AS crawler
  FROM raw),
tagged AS (
  SELECT *, coalesce(nullif(regexp_extract(qs, '[?&]utm_source=([^&]+)', 1), ''),
                     nullif(regexp_extract(qs, '[?&]ref=([^&]+)', 1), ''), ref_host) AS source,
    nullif(regexp_extract(qs, '[?&]utm_medium=([^&]+)', 1), '') AS medium,
    nullif(regexp_extract(qs, '[?&]utm_campaign=([^&]+)', 1), '') AS campaign
  FROM hits),
visits AS (
  SELECT *, crawler AS crawler_type, crawler IS NOT NULL AS is_bot, {CONFIDENCE} AS confidence,
    {_list([p[0] for p in w.PLACES])}[u % 9 + 1] AS country,
    {_list([p[1] for p in w.PLACES])}[u % 9 + 1] AS city,
    coalesce(client_id, session_id) AS uid
  FROM tagged WHERE kind IN ('view', 'click')),
ve0 AS (
  SELECT *, CASE kind WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'navigation'
      WHEN 'signup' THEN 'form_submit'
      WHEN 'purchase' THEN {_list(w.PURCHASE_EVENTS)}[id % 3 + 1]
      ELSE {_list(w.ERROR_EVENTS)}[id % 3 + 1] END AS event_type,
    CASE WHEN kind IN ('view', 'click') THEN id END AS visit_id,
    coalesce(client_id, session_id) AS uid
  FROM tagged),
ve AS (
  SELECT *, CASE event_type
    WHEN 'form_submit' THEN CASE id % 9
      WHEN 0 THEN '{{"form_values":{{"email":"u' || u || '@corp.example","name":"User ' || u || '"}},"filled_fields":2,"id":"f1","action":"/submit"}}'
      WHEN 1 THEN '{{"values":{{"work_email":"u' || u || '@gmail.com","company":"C' || (u % 5) || '"}}}}'
      WHEN 2 THEN '{{"timingsV2":1,"memory.totalJSHeapSize":2}}'
      WHEN 3 THEN '{{"form_values":{{"query":"pricing","page_size":"10"}}}}'
      WHEN 4 THEN '{{"form_values":{{}},"filled_fields":3}}'
      WHEN 5 THEN '{{"form_values":{{"data":"eyJhbGciOi"}}}}'
      WHEN 6 THEN '{{"form_values":{{"field_a":"1"}},"filled_fields":1}}'
      WHEN 7 THEN NULL
      ELSE '{{"form_values":{{"full_name":"N ' || u || '","message":"hi"}},"filled_fields":2}}' END
    WHEN 'scroll' THEN '{{"y":' || (id % 900) || ',"percent":' || (id % 101) || '}}'
    WHEN 'form_input' THEN '{{"field_name":"q","field_value":"' || {_list(w.FIELD_VALUES)}[id % 4 + 1] || '"}}'
    ELSE '{{"country":' || ['"US"', '"XX"', 'null', '"GB"'][id % 4 + 1] || ',"city":"Unknown"}}' END AS data
  FROM ve0),
sess AS (
  SELECT session_id AS id, min(ip) AS ip, min(ua) AS ua, min(client_id) AS client_id,
    min(ts) AS first_visit, max(ts) AS last_visit,
    count(*) FILTER (WHERE kind IN ('view', 'click')) AS visit_count,
    arg_min(struct_pack(r := referrer), struct_pack(ts := ts, id := id)).r AS entry_referrer,
    min({_list([p[0] for p in w.SESSION_PLACES])}[u % 4 + 1]) AS country,
    min({_list([p[1] for p in w.SESSION_PLACES])}[u % 4 + 1]) AS city,
    arg_min(tz, struct_pack(ts := ts, id := id)) FILTER (WHERE tz IS NOT NULL) AS tz,
    arg_min(lang, struct_pack(ts := ts, id := id)) FILTER (WHERE lang IS NOT NULL) AS lang
  FROM hits GROUP BY session_id),
ipe AS (
  SELECT ip, k, CASE WHEN k IN (1, 2) THEN 'success' WHEN k = 3 THEN 'error' ELSE 'failed' END AS status,
    CASE k WHEN 1 THEN TIMESTAMP '2024-03-01' WHEN 2 THEN TIMESTAMP '2024-01-10' END AS ttl,
    CASE WHEN k = 3 THEN CASE WHEN n % 2 = 1 THEN 3 ELSE 1 END WHEN k = 4 THEN 3 ELSE 0 END AS attempts,
    CASE WHEN k <= 2 THEN 'corp' || n || '.example' END AS company_domain,
    CASE WHEN k <= 2 THEN 'Corp ' || n END AS company_name,
    first_seen, last_seen
  FROM (SELECT ip, split_part(ip, '.', 4)::INT AS n, split_part(ip, '.', 4)::INT % 5 AS k,
          min(ts) AS first_seen, max(ts) AS last_seen
        FROM hits WHERE ip LIKE '81.2.69.%' GROUP BY ip) WHERE k <> 0)
"""

# Real form submissions: the payload rules, over JSON functions.
FORMS = """
fj AS (
  SELECT *, CASE WHEN data LIKE '{%' THEN
      CASE WHEN json_type(data, '$.form_values') = 'OBJECT' AND json_extract(data, '$.form_values')::VARCHAR <> '{}'
        THEN json_extract(data, '$.form_values')::VARCHAR
        WHEN json_type(data, '$.values') = 'OBJECT' AND json_extract(data, '$.values')::VARCHAR <> '{}'
        THEN json_extract(data, '$.values')::VARCHAR END END AS fv
  FROM ve WHERE event_type = 'form_submit'),
fk AS (SELECT *, json_keys(fv) AS keys FROM fj),
fx AS (SELECT *, list_transform(keys, lambda k: json_extract_string(fv, '$."' || k || '"')) AS vals FROM fk),
real_forms AS (
  SELECT *, list_extract(list_filter(list_zip(keys, vals), lambda p: lower(p[1]) LIKE '%mail%' AND p[2] LIKE '%@%'), 1)[2] AS f_email,
    list_extract(list_filter(list_zip(keys, vals), lambda p: regexp_matches(lower(p[1]), 'name|user|full') AND trim(p[2]) <> ''), 1)[2] AS f_name
  FROM fx
  WHERE fv IS NOT NULL AND length(data) <= 5000
    AND data NOT LIKE '%timingsV2%' AND data NOT LIKE '%memory.totalJSHeapSize%' AND data NOT LIKE '%eventType%'
    AND NOT list_has_any(keys, ['query','search','page_size','group_size','search_type','score_threshold',
                                'highlight_options','filters.must_not','extend_results'])
    AND NOT (len(keys) = 1 AND keys[1] = 'data' AND (length(vals[1]) > 200 OR vals[1] LIKE 'eyJ%'))
    AND (len(list_filter(keys, lambda k: lower(k) IN ('email','name','company','message','phone','organization',
            'user_email','full_name','company_name','first_name','last_name','subject','comments','inquiry','body')
            OR regexp_matches(lower(k), 'email|name|company'))) > 0
         OR coalesce(json_extract(data, '$.filled_fields')::INT, 0) >= 1)
    AND client_id IS NOT NULL)
"""


def with_views(body: str, *extra: str) -> str:
    """A query over the views. ``extra`` are further CTEs; ``body`` is the final SELECT."""
    return "WITH RECURSIVE " + ",\n".join([VIEWS.strip(), *[e.strip() for e in extra]]) + "\n" + body.strip()
