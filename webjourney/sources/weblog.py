"""Web-log views over the ``events`` table: visits, visit_events, sessions, ip_enrichment.

The table holds ``(event_id, ts, user_id, event_type, value, props)``. Every column of the
views is an expression over one row of it (literal lists indexed by integer arithmetic), so
the views scan, prune and partition like the table itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webjourney.config import CLIENT_SIDE_FIELDS
from webjourney.operators.ordered import work_dir

AS_OF = "2024-01-31 00:00:00"
FAMILIES = {"siteone": ("siteone.example",), "sitetwo": ("sitetwo.example",)}

_CHROME = "AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0 Safari/537.36"
USER_AGENTS = (
    f"Mozilla/5.0 (Windows NT 10.0; Win64; x64) {_CHROME}",
    "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 14_2) AppleWebKit/605.1.15 Version/17.2 Safari/605.1.15",
    f"Mozilla/5.0 (Windows NT 10.0; Win64; x64) {_CHROME} Edge/120.0",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X) Version/17.2 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 Chrome/120.0 Mobile Safari/537.36",
    "Mozilla/5.0 (compatible; GPTBot/1.2)",
    "Mozilla/5.0 (compatible; ClaudeBot/1.0)",
    "Mozilla/5.0 (compatible; Googlebot/2.1)",
    "python-requests/2.31",
    "ExampleSpider 1.0",
    "short",
)
PATHS = (
    "/", "/pricing", "/demo", "/schedule", "/sign-up", "/company-info", "/book-a-demo",
    "/enterprise", "/demo/thanks", "/docs/guide", "/blog/post-1", "/demo",
)
DOMAINS = ("www.siteone.example", "docs.sitetwo.example", "app.siteone.example")
REFERRERS = (
    None, None, None, "https://www.google.com/search?q=x", "https://www.siteone.example/pricing",
    "https://docs.sitetwo.example:443/", "https://news.example.org/a", "https://www.siteone.example/",
)
# What ingest stored for these agents and referrers (the classification and attribution
# operators compute the same, see the crawler_classify and utm queries).
CRAWLERS = (None,) * 6 + (
    "GPTBot", "ClaudeBot", "GoogleBot", "Suspicious Bot", "Unknown Bot", "Empty User Agent")
CONFIDENCES = (0.8,) * 6 + (0.95, 0.95, 0.8, 0.5, 0.6, 0.4)
REFERRER_HOSTS = (
    None, None, None, "www.google.com", "www.siteone.example", "docs.sitetwo.example:443",
    "news.example.org", "www.siteone.example",
)
PLACES = (
    (None, None), ("XX", "Unknown"), ("US", "Boston"), ("GB", "London"), ("DE", "Berlin"),
    ("FR", None), ("IN", "Pune"), ("XX", "Unknown"), (None, None),
)
SESSION_PLACES = (("US", "Austin"), ("XX", "Unknown"), (None, None), ("DE", "Munich"))
PURCHASE_EVENTS = ("form_input", "form_submit", "click")
ERROR_EVENTS = ("heartbeat", "scroll", "visibility")
FIELD_VALUES = ("hello", "  padded text ", "\\u0001\\u0002\\u0003", "日本語テキスト入力")
TRACKING_IDS = (None, "site-a", "site b!")
TIMEZONES = (None, "Europe/London", "America/New_York")
LANGUAGES = ("en-US", None)


def _pick(values, index: str) -> str:
    """SQL text: the list element at a zero-based index."""
    def show(v) -> str:
        return "NULL" if v is None else "r'" + v + "'"

    return f"element_at(array({', '.join(map(show, values))}), int({index}) + 1)"


# Form payloads by event number modulo 9, as SQL text over the visitor number.
_FORM_PAYLOADS = (
    """'{"form_values":{"email":"u' || _u || '@corp.example","name":"User ' || _u || '"},"filled_fields":2,"id":"f1","action":"/submit"}'""",
    """'{"values":{"work_email":"u' || _u || '@gmail.com","company":"C' || _u % 5 || '"}}'""",
    """'{"timingsV2":1,"memory.totalJSHeapSize":2}'""",
    """'{"form_values":{"query":"pricing","page_size":"10"}}'""",
    """'{"form_values":{},"filled_fields":3}'""",
    """'{"form_values":{"data":"eyJhbGciOi"}}'""",
    """'{"form_values":{"field_a":"1"},"filled_fields":1}'""",
    "NULL",
    """'{"form_values":{"full_name":"N ' || _u || '","message":"hi"},"filled_fields":2}'""",
)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table as a file stream."""
    return spark.readStream.schema(log(spark, sf_dir).schema).parquet(f"{sf_dir}/events*.parquet")


def shuffled_stream(spark: SparkSession, sf_dir: str, batches: int = 3) -> DataFrame:
    """The table as a stream of ``batches`` micro-batches whose rows come in no order of time."""
    raw, path = log(spark, sf_dir), work_dir(spark)
    raw.repartitionByRange(batches, F.xxhash64("event_id")).write.parquet(path)
    return spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(path)


def hits(raw: DataFrame) -> DataFrame:
    """Every row of the events table with the columns shared by all views."""
    return (
        raw.selectExpr(
            "event_id AS id", "timestamp(ts) AS timestamp", "user_id AS _u", "event_type AS _kind",
            "value", "props",
            "CASE WHEN user_id % 10 <> 9 THEN 'c' || user_id END AS client_id",
            "CASE user_id % 60 WHEN 0 THEN '10.0.0.5' WHEN 1 THEN '127.0.0.1' "
            "ELSE '81.2.69.' || user_id % 60 END AS ip_address",
            f"{_pick(USER_AGENTS, 'user_id % 12')} AS user_agent",
            f"{_pick(PATHS, '(7 * event_id + 3 * user_id) % 12')} AS path",
            f"{_pick(DOMAINS, '(event_id + user_id) % 3')} AS page_domain",
            "CASE event_id % 7 WHEN 3 THEN '?utm_source=google&utm_medium=cpc&utm_campaign=spring' "
            "WHEN 4 THEN '?ref=partner' "
            "WHEN 5 THEN '?email=u' || user_id || '%40corp.example&name=User+' || user_id ELSE '' END AS _query",
            f"{_pick(REFERRERS, '(11 * event_id + 5 * user_id) % 8')} AS referrer",
            f"{_pick(REFERRER_HOSTS, '(11 * event_id + 5 * user_id) % 8')} AS referrer_domain",
            f"CASE event_id % 7 WHEN 3 THEN 'google' WHEN 4 THEN 'partner' "
            f"ELSE {_pick(REFERRER_HOSTS, '(11 * event_id + 5 * user_id) % 8')} END AS source",
            "CASE WHEN event_id % 7 = 3 THEN 'cpc' END AS medium",
            "CASE WHEN event_id % 7 = 3 THEN 'spring' END AS campaign",
            f"{_pick(TRACKING_IDS, 'event_id % 3')} AS tracking_id",
            f"{_pick(TIMEZONES, 'event_id % 3')} AS client_side_timezone",
            f"{_pick(LANGUAGES, 'event_id % 2')} AS client_side_language",
            *[f"string(NULL) AS {c}" for c in CLIENT_SIDE_FIELDS[2:]],
        )
        .selectExpr(
            "*", "'https://' || page_domain || path || _query AS page_url",
            "md5(ip_address || '|' || user_agent) AS session_id")
    )


def visits(raw: DataFrame) -> DataFrame:
    """Page hits."""
    df = hits(raw).where("_kind IN ('view', 'click')")
    return df.selectExpr(
        "*",
        f"{_pick(CRAWLERS, '_u % 12')} AS crawler_type",
        f"element_at(array({', '.join(f'double({c})' for c in CONFIDENCES)}), int(_u % 12) + 1) AS crawler_confidence",
        "_u % 12 >= 6 AS is_bot",
        "string(NULL) AS page_title", "'GET' AS request_method", "200 AS response_status",
        "int(id % 5000) AS response_size", "value AS response_time_ms",
        f"{_pick([p[0] for p in PLACES], '_u % 9')} AS country",
        f"{_pick([p[1] for p in PLACES], '_u % 9')} AS city",
        "'https' AS protocol", "int(NULL) AS port",
    ).drop("_u", "_kind", "_query", "value", "props", "referrer_domain")


def visit_events(raw: DataFrame) -> DataFrame:
    """Interactions: every row, linked to its visit when it is a page hit."""
    forms = " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_FORM_PAYLOADS))
    df = hits(raw).selectExpr(
        "*",
        f"""CASE _kind WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'navigation'
            WHEN 'signup' THEN 'form_submit' WHEN 'purchase' THEN {_pick(PURCHASE_EVENTS, 'id % 3')}
            ELSE {_pick(ERROR_EVENTS, 'id % 3')} END AS event_type""")
    countries = ('"US"', '"XX"', "null", '"GB"')
    return df.selectExpr(
        "*",
        f"""CASE event_type WHEN 'form_submit' THEN CASE id % 9 {forms} END
            WHEN 'scroll' THEN '{{"y":' || id % 900 || ',"percent":' || id % 101 || '}}'
            WHEN 'form_input' THEN '{{"field_name":"q","field_value":"' || {_pick(FIELD_VALUES, 'id % 4')} || '"}}'
            ELSE '{{"country":' || {_pick(countries, 'id % 4')} || ',"city":"Unknown"}}' END AS event_data""",
        "CASE WHEN _kind IN ('view', 'click') THEN id END AS visit_id",
        "IF(_kind = 'error', 500, 200) AS response_status",
    ).drop("_u", "_kind", "_query", "value", "props")


def sessions(raw: DataFrame) -> DataFrame:
    """Stored sessions: one per address and user agent, as kept before any rebuild."""
    order = "struct(timestamp, id)"
    agg = hits(raw).groupBy(F.col("session_id").alias("_sid")).agg(*[F.expr(e) for e in (
        "min(ip_address) AS ip_address", "min(user_agent) AS user_agent",
        "min(client_id) AS client_id", "min(timestamp) AS first_visit", "max(timestamp) AS last_visit",
        "int(count_if(_kind IN ('view', 'click'))) AS visit_count",
        f"min_by(referrer, {order}) AS entry_referrer",
        f"min_by(referrer_domain, {order}) AS entry_referrer_domain",
        f"min({_pick([p[0] for p in SESSION_PLACES], '_u % 4')}) AS country",
        f"min({_pick([p[1] for p in SESSION_PLACES], '_u % 4')}) AS city",
        *[f"min_by({c}, IF({c} IS NOT NULL, {order}, NULL)) AS {c}" for c in CLIENT_SIDE_FIELDS[:2]],
    )])
    nulls = ("country_name", "timezone", "isp", "organization", "asn", *CLIENT_SIDE_FIELDS[2:])
    return agg.withColumnRenamed("_sid", "id").selectExpr(
        "*", "true AS is_external_entry", *[f"string(NULL) AS {c}" for c in nulls])


def ip_enrichment(raw: DataFrame) -> DataFrame:
    """Enrichment state of the public addresses seen in the log."""
    ips = (
        hits(raw).where("ip_address LIKE '81.2.69.%'").groupBy(F.col("ip_address").alias("ip"))
        .agg(F.min("timestamp").alias("first_seen_at"), F.max("timestamp").alias("last_seen_at"))
        .selectExpr("*", "int(substring_index(ip, '.', -1)) AS n")
        .selectExpr("*", "n % 5 AS k").where("k <> 0")
    )
    return ips.selectExpr(
        "ip",
        "IF(k <= 2, 'corp' || n || '.example', NULL) AS company_domain",
        "IF(k <= 2, 'Corp ' || n, NULL) AS company_name",
        "IF(k <= 2, 'business', NULL) AS company_type", "IF(k <= 2, 'gb', NULL) AS country",
        *[f"IF(k <= 2, false, NULL) AS {c}" for c in ("is_datacenter", "is_vpn", "is_proxy", "is_tor")],
        "'lookup' AS source", "timestamp'2024-01-05' AS enriched_at",
        "CASE k WHEN 1 THEN timestamp'2024-03-01' WHEN 2 THEN timestamp'2024-01-10' END AS ttl_expires_at",
        "CASE WHEN k <= 2 THEN 'success' WHEN k = 3 THEN 'error' ELSE 'failed' END AS status",
        "IF(k >= 3, 'transient', NULL) AS error_code", "IF(k >= 3, 'timeout', NULL) AS error_message",
        "CASE k WHEN 3 THEN IF(n % 2 = 1, 3, 1) WHEN 4 THEN 3 ELSE 0 END AS attempt_count",
        "first_seen_at", "last_seen_at",
    )


def ip_locations(spark: SparkSession) -> DataFrame:
    """IPv4 range dimension: inclusive numeric bounds to country and city."""
    base = (81 << 24) + (2 << 16) + (69 << 8)
    return spark.createDataFrame(
        [(base + 2, base + 19, "GB", "London"), (base + 20, base + 39, "DE", "Berlin"),
         (base + 40, base + 59, "FR", "Paris")],
        "lo long, hi long, country string, city string")


def networks(spark: SparkSession) -> DataFrame:
    """Range dimension by networks that lie inside each other, IPv4 and IPv6."""
    return spark.createDataFrame(
        [("81.2.69.0/24", "GB", "London"), ("81.2.69.16/28", "DE", "Berlin"), ("81.2.69.16/29", "IE", "Dublin"),
         ("81.2.69.25/32", "AT", "Wien"), ("81.2.69.32/27", "FR", "Paris"), ("2a00::/16", "NO", "Oslo"),
         ("2a00:1::/32", "SE", "Lund")],
        "network string, country string, city string")
