"""Domain family, boundary rules, session ids, URLs, agents, addresses: exact cases."""

import hashlib
import ipaddress

import pytest
from pyspark.sql import functions as F

from webjourney.functions import agents, journeys, text, url
from webjourney.operators import location, quality

FAM = {"siteone": ("siteone.example",), "sitetwo": ("sitetwo.example",)}


def column(spark, values, expr, name="x", kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, {name} {kind}")
    return [r[0] for r in df.orderBy("i").select(expr.alias("r")).collect()]


def test_domain_family(spark):
    cases = {
        "siteone.example": "siteone", "www.siteone.example": "siteone", "a.b.sitetwo.example": "sitetwo",
        "notsiteone.example": None, "siteone.example.evil.com": None, None: None, "": None,
        "WWW.SiteOne.Example": "siteone", "www.siteone.example:8443": "siteone", " siteone.example ": "siteone",
        "google.com": None,
    }
    assert column(spark, list(cases), url.domain_family(F.col("x"), FAM)) == list(cases.values())


LIVE = [
    # event_type, referrer_domain, source, medium, campaign, external
    ("page_view", "www.siteone.example", None, None, None, False),
    ("page_view", "docs.sitetwo.example:443", None, None, None, False),
    ("page_view", "www.google.com", None, None, None, True),
    ("heartbeat", "www.google.com", None, None, None, False),
    ("scroll", None, "google", None, None, False),
    ("visibility", None, None, None, None, False),
    ("page_view", None, "google", None, None, True),
    ("page_view", None, "LinkedIn", None, None, True),
    ("page_view", None, "whatever", None, None, True),
    ("page_view", None, "siteone.example", None, None, False),
    ("page_view", None, None, "cpc", None, True),
    ("page_view", None, None, None, "spring", True),
    ("page_view", None, None, None, None, True),
    ("click", None, None, None, None, True),
    ("page_view", "", "", "", "", True),
]


def test_live_boundary(spark):
    schema = "i int, e string, r string, s string, m string, c string"
    df = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(LIVE)], schema)
    got = df.orderBy("i").select(journeys.live_boundary(
        *[F.col(x) for x in "ersmc"], FAM).alias("x")).collect()
    assert [r.x for r in got] == [r[5] for r in LIVE]


REBUILD = [
    # event_type (None = visit), referrer_domain, source, medium, campaign, gap, new
    (None, None, None, None, None, None, True),
    (None, "www.siteone.example", None, None, None, 99999.0, False),
    (None, "www.google.com", None, None, None, 1.0, True),
    (None, "docs.sitetwo.example", None, None, None, 1.0, False),
    ("heartbeat", "www.google.com", None, None, None, 99999.0, False),
    (None, None, None, None, None, 0.0, False),
    (None, None, None, None, None, 1800.0, False),
    (None, None, None, None, None, 1800.000001, True),
    ("page_view", None, None, None, "spring", 1.0, True),
    ("navigate", None, "www.siteone.example", None, None, 99999.0, False),
]


def test_rebuild_boundary(spark):
    schema = "i int, e string, r string, s string, m string, c string, g double"
    df = spark.createDataFrame([(i, *r[:6]) for i, r in enumerate(REBUILD)], schema)
    got = df.orderBy("i").select(journeys.rebuild_boundary(
        *[F.col(x) for x in "ersmcg"], FAM).alias("x")).collect()
    assert [r.x for r in got] == [r[6] for r in REBUILD]


def test_session_id_and_user_key(spark):
    df = spark.createDataFrame(
        [("xyz", "1.2.3.4", "Mozilla/5.0"), (None, "1.2.3.4", "Mozilla/5.0"), ("", "1.2.3.4", "M" * 600)],
        "client_id string, ip_address string, user_agent string")
    keys = [r[0] for r in df.select(journeys.user_key()).collect()]
    assert keys == ["cid:xyz", "ipua:1.2.3.4:Mozilla/5.0", "ipua:1.2.3.4:" + "M" * 600]
    got = df.limit(1).select(journeys.session_id(F.lit("cid:xyz"), F.lit(3))).first()[0]
    assert got == hashlib.sha256(b"cid:xyz:journey:3").hexdigest()[:32] and len(got) == 32


def test_url_parts(spark):
    from urllib.parse import parse_qs, urlparse

    urls = [
        "https://www.siteone.example:8443/a/b;p=1?x=1&y=&x=2&z=a%20b+c#frag", "HTTP://Host/", "/only/path?q=1",
        "https://h.example/a b|c?u=%zz", "mailto:x@y", "", "https://u:p@h.example/p", "https://h.example?utm_source=g",
    ]
    u = F.col("x")
    df = spark.createDataFrame([(i, x) for i, x in enumerate(urls)], "i int, x string")
    got = df.orderBy("i").select(url.scheme(u).alias("s"), url.authority(u).alias("a"), url.path(u).alias("p"),
                                 url.query(u).alias("q"), url.query_map("x").alias("m")).collect()
    for raw, r in zip(urls, got):
        want = urlparse(raw)
        assert (r.s, r.a, r.p, r.q) == (want.scheme, want.netloc, want.path, want.query), raw
        if "%zz" not in raw:
            assert r.m == parse_qs(want.query), raw


def test_utm(spark):
    df = spark.createDataFrame([
        (0, "https://h/?utm_source=a&source=b", None), (1, "https://h/?source=b&ref=c", None), (2, "https://h/?ref=c%20d", None),
        (3, "https://h/", "https://www.google.com/s"), (4, "https://h/?utm_source=", "https://r.example/"),
        (5, "https://h/?utm_medium=m&campaign=x", None), (6, "https://h/?xutm_source=no&utm_source=+y", None)],
        "i int, page_url string, referrer string")
    got = [tuple(r) for r in url.with_attribution(df).orderBy("i").select("source", "medium", "campaign").collect()]
    assert got == [("a", None, None), ("b", None, None), ("c d", None, None), ("www.google.com", None, None),
                   ("r.example", None, None), (None, "m", "x"), (" y", None, None)]


def test_crawlers(spark):
    cases = [
        ("Mozilla/5.0 GPTBot/1.0", True, "GPTBot", 0.95, "pattern_match"),
        ("x claude-web y", True, "Claude-Web", 0.9, "pattern_match"),
        ("SomeCrawler here", True, "Unknown Bot", 0.6, "general_pattern"),
        ("curl/8.0 agent", True, "Suspicious Bot", 0.5, "suspicious_pattern"),
        ("tiny", True, "Empty User Agent", 0.4, "empty_user_agent"),
        ("Mozilla/5.0 Chrome/1 Safari/1", False, None, 0.8, "browser_pattern"),
        ("Mozilla/5.0 only one", False, None, 0.3, "unknown"), ("", False, None, 0.0, "unknown"), (None, False, None, 0.0, "unknown"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, user_agent string")
    got = agents.classify(df).orderBy("i").collect()
    assert [(r.user_agent, r.is_crawler, r.crawler_name, r.confidence, r.detection_method) for r in got] == cases


def test_client_ip(spark):
    df = spark.createDataFrame([
        (0, " 1.1.1.1 , 2.2.2.2", "3.3.3.3", None), (1, None, " 3.3.3.3 ", "for=4.4.4.4"), (2, "", None, 'by=x; for="4.4.4.4:80";proto=https'),
        (3, None, None, 'For="[2001:db8::1]:443"'), (4, None, None, None)], "i int, a string, b string, c string")
    got = [r[0] for r in df.orderBy("i").select(url.client_ip(F.col("a"), F.col("b"), F.col("c"), F.lit("9.9.9.9"))).collect()]
    assert got == ["1.1.1.1", "3.3.3.3", "4.4.4.4", "2001:db8::1", "9.9.9.9"]


def test_ip_rules(spark):
    ips = ["1.2.3.4", "256.1.1.1", "01.2.3.4", "1.2.3", "::1", "::", "2001:db8::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::",
           "1::3::4", "1:2:3:4:5:6:7:8:9", "::ffff:1.2.3.4", "fe80::1", "g::1", "10.1.1.1", "172.16.0.1", "172.32.0.1",
           "192.168.3.4", "169.254.0.9", "127.0.0.1", "8.8.8.8", "fd00::1"]

    def valid(x):
        try:
            ipaddress.ip_address(x)
            return True
        except ValueError:
            return False

    assert column(spark, ips, quality.is_valid_ip(F.col("x"))) == [valid(x) for x in ips]
    private = {x for x in ips if valid(x) and ipaddress.ip_address(x).is_private}
    assert {"::1", "2001:db8::1", "169.254.0.9"} < private
    got = column(spark, ips, location.is_private_ip(F.col("x")))
    assert {x for x, p in zip(ips, got) if p} == private


def test_hit_checks(spark):
    good = ("https://www.siteone.example/p", "site-1", "Mozilla/5.0", "1.2.3.4", "www.siteone.example", '{"a":1}')
    bad = {
        "url": ("ftp://h.example/",) + good[1:], "tracking_id": (good[0], "a b", *good[2:]),
        "user_agent": (*good[:2], "x <script>", *good[3:]), "ip_address": (*good[:3], "1.2.3", *good[4:]),
        "page_domain": (*good[:4], "-x.example", good[5]), "event_data": (*good[:5], '{"__proto__":1}'),
    }
    rows = [(None, *good), (None, good[0], None, *good[2:5], None)] + [(k, *v) for k, v in bad.items()]
    df = spark.createDataFrame(rows, "want string, page_url string, tracking_id string, user_agent string, "
                                     "ip_address string, page_domain string, event_data string")
    checked = quality.check_hits(df).collect()
    assert all(r.want == r.reject_reason for r in checked)
    ok, rejected = quality.split_hits(df)
    assert ok.count() == 2 and rejected.count() == len(bad)


def test_text_rules(spark):
    cases = ["hello", "日本語テキスト", "\x01\x02", "...!!!", "", None, "ab cd", "日本語 abcd efgh"]
    assert column(spark, cases, text.is_garbage(F.col("x"))) == [False, True, True, True, False, False, False, False]
    masks = [("secret text", "password", None), ("  hi\x01 ", "note", "hi"), ("a" * 101, "note", None), ("eyJa.b.c", "note", None),
             ("", "note", ""), ("x" * 50 + " " + "y" * 1200, "note", "x" * 50 + " " + "y" * 1200), ("1234", "credit_no", None)]
    df = spark.createDataFrame([(i, v, n) for i, (v, n, _) in enumerate(masks)], "i int, v string, n string")
    got = [r[0] for r in df.orderBy("i").select(text.mask_value(F.col("v"), F.col("n"))).collect()]
    assert got == [m[2] for m in masks]
    email, name = text.profile_from_text(F.col("x"))
    flat = column(spark, ['email: a@b.co | name: Jo Do', "No info shared", "name: null"], F.struct(email.alias("e"), name.alias("n")))
    assert [tuple(r) for r in flat] == [("a@b.co", "Jo Do"), (None, None), (None, None)]


def test_root_domain_and_noise(spark):
    hosts = {"a.b.co.uk": "b.co.uk", "www.x.com": "x.com", "x.com": "x.com", "localhost": "localhost"}
    assert column(spark, list(hosts), url.root_domain(F.col("x"))) == list(hosts.values())
    urls = {"https://api.mixpanel.com/t": True, "https://x.com/telemetry/a": True, "https://x.com/a": False}
    assert column(spark, list(urls), url.is_analytics_noise(F.col("x"))) == list(urls.values())


def test_step_type_is_checked():
    from webjourney.config import Step, funnels_from_config

    with pytest.raises(ValueError):
        Step("x", "/x", "other")
    (f,) = funnels_from_config({"funnels": [{"key": "k", "label": "L", "steps": [
        {"label": "a", "type": "page", "path": "/a"}, {"label": "b", "type": "event", "path": "/b"}]}]})
    assert [s.event_type for s in f.steps] == ["form_submit"] * 2 and f.steps[1].type == "event"
