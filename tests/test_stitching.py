"""Stitched visits and funnel against brute force, and what they write on the way."""

import collections
import datetime as dt
import os
import random

import pyarrow.parquet as pq
import pytest

from webjourney.operators import paths, stitching
from webjourney.sources import schemas

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else T0 + dt.timedelta(seconds=seconds)


def table(spark, schema, rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def related(visits, clients, hours):
    """client, visit and how often, a row per visit."""
    out = [(v["client_id"], v, 1) for v in visits if v["client_id"] in clients]
    for c in clients:
        own = [v for v in visits if v["client_id"] == c and v["timestamp"] and v["ip_address"] and v["user_agent"]]
        for v in visits:
            if v["client_id"] != c and v["timestamp"]:
                n = sum((t["ip_address"], t["user_agent"]) == (v["ip_address"], v["user_agent"])
                        and dt.timedelta(0) <= t["timestamp"] - v["timestamp"] <= dt.timedelta(hours=hours) for t in own)
                if n:
                    out.append((c, v, n))
    return out


def some_visits(seed, n=400):
    """Clients with several fingerprints, crowds at one instant, missing parts."""
    rnd = random.Random(seed)
    return [{
        "id": i, "client_id": rnd.choice([None, *(f"c{k}" for k in range(12))]), "page_domain": rnd.choice(["d", "e"]),
        "timestamp": at(rnd.choice([3600 * rnd.randrange(90), rnd.randrange(300_000), None if i % 9 == 0 else 7200])),
        "ip_address": rnd.choice([None, "i", "j", "k"]), "user_agent": rnd.choice(["u", "u", "w", None]),
        "path": rnd.choice(["/sign-up", "/company-info", "/a", "/b", None]), "page_url": f"https://d/?p={rnd.randrange(5)}",
        "referrer": f"r{i}", "source": rnd.choice(["s", None])} for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_stitched_visits_and_funnel(spark, monkeypatch, small):
    if small:  # many groups, and many goes at a cell
        monkeypatch.setattr(stitching, "GROUP_PAIRS", 50)
        monkeypatch.setattr(stitching, "ROWS", 7)
    rows = some_visits(3)
    visits = table(spark, schemas.visits(), rows)
    done = {r.client_id: (r.started_at, r.completed_at) for r in paths.completers(visits, "/sign-up", "/company-info").collect()}
    assert len(done) > 5
    clients = spark.createDataFrame([(c,) for c in done], "client_id string")
    want = related(rows, done, 6)
    got = paths.stitch_visits(visits, clients, 6).collect()
    assert sorted((r.unified_client_id, r.id, r.times, str(r.timestamp), r.referrer) for r in got) == sorted(
        (c, v["id"], n, str(v["timestamp"]), v["referrer"]) for c, v, n in want)

    sent = [{"id": i, "visit_id": v["id"], "timestamp": at(1000 * (i * 7919 % 101)), "event_type": "click", "event_data": f"[{i}]",
             "path": ("/sign-up", "/x/company-info/sign-up", "/a")[i % 3]} for i, v in enumerate(rows[::2])]
    story = {r.unique_user_key: r for r in paths.stitched_funnel(visits, table(spark, schemas.visit_events(), sent), hours=6).collect()}
    assert set(story) == set(done)
    first = dt.datetime.min
    for c, (started, completed) in done.items():
        own = sorted(((v, n) for k, v, n in want if k == c), key=lambda x: (x[0]["timestamp"] or first, x[0]["id"]))
        path = [f"{v['path']} ({v['page_domain']})" for v, n in own for _ in range(n)
                if v["path"] and v["timestamp"] and v["timestamp"] <= completed]
        r, v = story[c], own[0][0]
        assert r.full_journey_path == " → ".join(path)
        assert (r.original_referrer, r.original_utm_source, r.user_acquired_at) == (v["referrer"], v["source"], v["timestamp"])
        assert (r.signup_visited_at, r.company_info_completed_at) == (started, completed)
        for name, target in (("raw_signup_events", "sign-up"), ("company_info_form_data", "company-info")):
            times = collections.Counter({v["id"]: n for v, n in own})
            texts = [e["event_data"] for e in sorted(sent, key=lambda e: (e["timestamp"], e["id"])) if target in e["path"]
                     for _ in range(times[e["visit_id"]])]
            assert getattr(r, name) == (f"[{', '.join(texts)}]" if texts else "No form data")
        params = {f"p: {v['page_url'][-1]}" for v, _ in own if v["path"] == "/sign-up"}
        assert r.signup_page_params == " || ".join(sorted(params))


def test_repeated_ids_count_together(spark):
    base = {"ip_address": "i", "user_agent": "u", "page_domain": "d", "page_url": "https://d/"}
    rows = [{"id": 1, "client_id": "x", "timestamp": at(0), "path": "/a", **base}] * 2 + [
        {"id": None, "client_id": "x", "timestamp": at(1), "path": "/b", **base},
        {"id": 2, "client_id": "c", "timestamp": at(10), "path": "/sign-up", **base},
        {"id": 3, "client_id": "c", "timestamp": at(20), "path": "/company-info", **base}]
    visits = table(spark, schemas.visits(), rows)
    clients = spark.createDataFrame([("c",)], "client_id string")
    assert sorted((r.id, r.times) for r in paths.stitch_visits(visits, clients).collect()) == [(1, 4), (1, 4), (2, 1), (3, 1)]
    r = paths.stitched_funnel(visits, table(spark, schemas.visit_events(), [])).first()
    assert r.full_journey_path == " → ".join(["/a (d)"] * 8 + ["/sign-up (d)", "/company-info (d)"])


def crowd(spark):
    """40 clients of one fingerprint with 50 visits each in an hour: 78,000 pairs."""
    return table(spark, schemas.visits(), [{
        "id": i, "client_id": f"c{i % 40}", "timestamp": at(i), "path": ("/sign-up", "/a", "/company-info")[i // 40 % 3],
        "page_domain": "d", "page_url": "https://d/", "ip_address": "i", "user_agent": "u"} for i in range(2000)])


def rows_written(spark, query):
    root = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(root))
    query().write.format("noop").mode("overwrite").save()
    return sum(pq.read_metadata(os.path.join(root, d, f)).num_rows for d in set(os.listdir(root)) - before
               for f in os.listdir(os.path.join(root, d)) if f.endswith(".parquet"))


def test_funnel_writes_no_pairs(spark):
    visits = crowd(spark)
    assert rows_written(spark, lambda: paths.stitched_funnel(visits, table(spark, schemas.visit_events(), []))) < 10_000


def test_stitched_visits_write_no_pairs(spark):
    visits = crowd(spark)
    clients = visits.select("client_id").distinct()
    assert paths.stitch_visits(visits, clients).count() > 78_000
    assert rows_written(spark, lambda: paths.stitch_visits(visits, clients)) < 10_000
