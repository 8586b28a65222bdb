"""Hand-made journeys: attribution, funnel order, stitching of forms, rebuild, repair, recent merges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from webjourney.config import Funnel, Step
from webjourney.operators import funnels, location, paths, reports, sessions
from webjourney.sources import schemas

T0 = dt.datetime(2024, 1, 1)


def table(spark, schema, rows):
    names = schema.names
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], schema)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_first_touch_and_conversion(spark):
    page = "https://www.siteone.example/?utm_source=google&utm_medium=cpc&utm_campaign=demo"
    visits = table(spark, schemas.visits(), [
        {"id": 1, "client_id": "c", "timestamp": at(0), "page_url": page, "source": "google", "medium": "cpc", "campaign": "demo"},
        {"id": 2, "client_id": "c", "timestamp": at(5), "page_url": "x", "source": ""}])
    events = table(spark, schemas.visit_events(), [
        {"id": 1, "client_id": "c", "timestamp": at(9), "event_type": "form_submit", "referrer": page}])
    r = reports.first_touch(visits, events).first()
    assert (r.source, r.medium, r.campaign, r.landing_page, r.conversion_count) == ("google", "cpc", "demo", page, 1)


def test_funnel_order_matters_only_in_the_summary(spark):
    f = Funnel("k", "l", (Step("a", "/a"), Step("b", "/a", "event"), Step("c", "/c")))
    visits = table(spark, schemas.visits(), [
        {"id": 1, "client_id": "x", "timestamp": at(0), "path": "/a"}, {"id": 2, "client_id": "x", "timestamp": at(20), "path": "/C/d"},
        {"id": 3, "client_id": "y", "timestamp": at(10), "path": "/a"}, {"id": 4, "client_id": "y", "timestamp": at(1), "path": "/c"},
        {"id": 5, "session_id": "s", "timestamp": at(0), "path": "/a"}])
    events = table(spark, schemas.visit_events(), [
        {"id": 1, "client_id": "x", "timestamp": at(10), "path": "/a", "event_type": "form_submit", "event_data": "{}"},
        {"id": 2, "client_id": "y", "timestamp": at(11), "path": "/a", "event_type": "form_submit", "event_data": "{}"},
        {"id": 3, "session_id": "s", "timestamp": at(9), "path": "/a", "event_type": "form_submit"}])
    got = funnels.funnel_summary(visits, events, [f]).orderBy("step").collect()
    # The anonymous form has no payload and drops out; y saw /c before the form.
    assert [r.users for r in got] == [3, 2, 1]
    assert [(r.rate, r.dropoff_count) for r in got[1:]] == [(66.67, 1), (50.0, 1)]
    assert [r.share_of_first for r in got] == [100.0, 66.67, 33.33]
    assert {r.client_id for r in funnels.funnel_stage_users(visits, events, f, 2).collect()} == {"x", "y"}
    t = funnels.funnel_timing(visits, events, f).orderBy("step").collect()
    assert [(r.sample_size, r.median_seconds, r.p90_seconds) for r in t] == [(2, 1.0, 1.0), (1, 10.0, 10.0)]
    with pytest.raises(ValueError):
        funnels.funnel_dropoffs(visits, events, f, 2)


def test_stitched_funnel_collects_linked_forms(spark):
    base = {"ip_address": "i", "user_agent": "u", "page_domain": "d"}
    visits = table(spark, schemas.visits(), [
        {"id": 1, "client_id": "anon", "timestamp": at(0), "path": "/blog", "page_url": "https://d/blog", "referrer": "R", **base},
        {"id": 2, "client_id": "c", "timestamp": at(60), "path": "/sign-up", "page_url": "https://d/sign-up?email=a%40b.co&ref=z", **base},
        {"id": 3, "client_id": "c", "timestamp": at(90), "path": "/company-info", "page_url": "https://d/company-info?ref=z", **base}])
    events = table(spark, schemas.visit_events(), [
        {"id": 1, "visit_id": 2, "timestamp": at(70), "path": "/sign-up", "event_type": "click", "event_data": '{"k":1}'},
        {"id": 2, "visit_id": 2, "timestamp": at(65), "path": "/sign-up/x", "event_type": "form_submit", "event_data": '{"m":"me@corp.co"}'},
        {"id": 3, "visit_id": 3, "timestamp": at(95), "path": "/company-info", "event_type": "scroll", "event_data": "{}"}])
    r = paths.stitched_funnel(visits, events).first()
    # The anonymous visit lies within a day of both visits of the client, so it counts twice.
    assert r.full_journey_path == "/blog (d) → /blog (d) → /sign-up (d) → /company-info (d)"
    assert (r.signup_page_params, r.company_info_url_params) == ("email: a@b.co", "ref: z")
    assert r.raw_signup_events == '[{"m":"me@corp.co"}, {"k":1}]' and r.potentially_extracted_email == "me@corp.co"
    assert r.company_info_form_data == "No form data" and r.original_referrer == "R"
    assert (r.total_seconds, r.funnel_seconds) == (90.0, 30.0)


def test_rebuild_removes_orphans(spark):
    fam = {"siteone": ("siteone.example",)}
    visits = table(spark, schemas.visits(), [
        {"id": 1, "session_id": "old", "client_id": "c", "timestamp": at(0)},
        {"id": 2, "session_id": "old", "client_id": "c", "timestamp": at(60)},
        {"id": 3, "session_id": "old", "client_id": "c", "timestamp": at(60 + 1801)}])
    events = table(spark, schemas.visit_events(), [
        {"id": 9, "session_id": "old", "visit_id": 3, "client_id": "c", "timestamp": at(1900), "event_type": "click"}])
    old = table(spark, schemas.sessions(), [{"id": "old", "client_id": "c"}, {"id": "idle"}])
    done = sessions.rebuild(visits, events, old, fam)
    new = {r.id: r.visit_count for r in done["sessions"].collect()}
    assert sorted(new.values()) == [1, 2] and "old" not in new and "idle" not in new
    by_id = {r.id: r.session_id for r in done["visits"].collect()}
    assert by_id[1] == by_id[2] != by_id[3] == done["events"].first().session_id
    assert {(r.visit_count_moved, r.event_count_moved) for r in done["audit"].collect()} == {(2, 0), (1, 0)}


def test_location_chain_and_repair(spark):
    sess = table(spark, schemas.sessions(), [{"id": "s", "country": "XX", "city": "Unknown"}, {"id": "g", "country": "DE", "city": "Berlin"}])
    visits = table(spark, schemas.visits(), [
        {"id": 1, "session_id": "s", "timestamp": at(0), "country": "US", "city": None},
        {"id": 2, "session_id": "g", "timestamp": at(0), "country": "XX", "city": "Unknown"}])
    events = table(spark, schemas.visit_events(), [
        {"id": 1, "session_id": "s", "visit_id": 1, "event_data": '{"country":"XX"}'},
        {"id": 2, "session_id": "g", "visit_id": 2, "event_data": '{"n":1}'},
        {"id": 3, "session_id": "s", "event_data": '{"country":"GB","city":"London"}'},
        {"id": 4, "session_id": "s", "event_data": '{"country":"XX"}'}, {"id": 5, "session_id": "none"}])
    got = {r.id: (r.r_country, r.location_source) for r in location.resolve_event_location(events, visits, sess).collect()}
    assert got == {1: ("US", "visit"), 2: ("DE", "session"), 3: ("GB", "event_data"), 4: ("XX", "session_xx"), 5: (None, "none")}
    done = location.repair_all(visits, events, sess)
    assert {r.id: (r.country, r.city, r.changed) for r in done["sessions"].collect()} == {
        "s": ("US", "Unknown", True), "g": ("DE", "Berlin", False)}
    assert {r.id: (r.country, r.city, r.changed) for r in done["visits"].collect()} == {
        1: ("US", None, False), 2: ("DE", "Berlin", True)}
    data = {r.id: r.event_data for r in done["events"].collect()}
    assert data[1] == '{"country":"US","city":"Unknown"}' and data[2] == '{"n":1,"country":"DE","city":"Berlin"}'
    assert data[4] == '{"country":"US","city":"Unknown"}' and data[3] == '{"country":"GB","city":"London"}'


def test_event_link_windows(spark):
    visits = table(spark, schemas.visits(), [
        {"id": 1, "timestamp": at(0), "ip_address": "i", "user_agent": "u", "page_url": "p", "client_id": "c"},
        {"id": 2, "timestamp": at(10), "ip_address": "j", "user_agent": "u", "page_url": "p", "client_id": "d"}])
    rows = [(1, 90, "i", "c", 1, "same_ip"), (2, 91, "i", "c", 1, "same_user"), (3, 601, "i", "c", None, None),
            (4, 95, "j", None, 2, "same_ip"), (5, 200, "j", None, 2, "same_user"), (6, 200, "i", "zz", None, None)]
    events = table(spark, schemas.visit_events(), [
        {"id": i, "timestamp": at(t), "client_id": c, "page_url": "p"} for i, t, _, c, _, _ in rows])
    ip = spark.createDataFrame([(r[0], r[2], "u") for r in rows], "id long, ip_address string, user_agent string")
    got = location.link_events_to_visits(events.join(ip, "id"), visits).collect()
    assert {(r.id, r.linked_visit_id, r.link_rule) for r in got} == {(r[0], r[4], r[5]) for r in rows}


def test_recent_visits_follow_the_event(spark):
    visits = table(spark, schemas.visits(), [
        {"id": 1, "timestamp": at(0), "ip_address": "i", "session_id": "a"}, {"id": 2, "timestamp": at(50), "ip_address": "i", "session_id": "b"},
        {"id": 3, "timestamp": at(60), "ip_address": "i", "session_id": "e"}])
    events = table(spark, schemas.visit_events(), [{"id": 1, "timestamp": at(200), "session_id": "e"}]).withColumn("ip_address", F.lit("i"))
    got = location.merge_recent_visits(events, visits).collect()
    assert [(r.id, r.old_session_id, r.session_id) for r in got] == [(2, "b", "e")]
