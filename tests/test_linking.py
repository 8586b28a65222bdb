"""Linking that makes visits, its moves, nested networks, paging, and summaries in buckets."""

import datetime as dt
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from webjourney.operators import linking, location, sessions, summaries
from webjourney.operators.paging import Listing
from webjourney.operators.summary_store import SummaryStore
from webjourney.sources import weblog

T0 = dt.datetime(2024, 1, 1)
SCHEMA = ("id long, visit_id long, timestamp timestamp, page_url string, ip_address string, user_agent string, "
          "client_id string, session_id string")


@pytest.fixture(params=[False, True], ids=["one slice", "many slices"])
def sliced(request, spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    if request.param:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield request.param
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", before)


def log(n=700, seed=1):
    rnd = random.Random(seed)
    visits, events = [], []
    for i in range(n):
        at = T0 + dt.timedelta(seconds=rnd.randrange(20_000))
        who = (rnd.choice(["/a", "/a", "/a", "/b", "", None]), rnd.choice(["1", "2", "3", None]), rnd.choice(["x", "y", None]),
               rnd.choice(["p", "q", "r", None, ""]), f"s{rnd.randrange(6)}")
        if rnd.random() < 0.08:
            visits.append((i, None, at, *who))
        else:
            named = rnd.choice([None] * 8 + [rnd.randrange(n)])
            events.append((i, named, at, *who))
    # A crowd at one time, and an event that names what there is not.
    events += [(n + i, None, T0, "/c", "1", "x", "p", "s1") for i in range(30)] + [(n + 40, 10 ** 9, T0, "/z", "9", "x", "p", "s1")]
    return visits, events


def by_hand(visits, events, near, far):
    """Rows one by one, in time order."""
    ids = {v[0] for v in visits}
    out, seen = {}, [(v[2], 0, v[0], v) for v in visits]
    made = []
    for e in sorted(events, key=lambda e: (e[2], e[0])):
        rid, named, at, page, ip, agent, client, _ = e
        if named in ids:
            out[rid] = (named, "explicit")
            continue
        if not page:
            out[rid] = (None, None)
            continue
        known = sorted([s for s in seen if s[0] <= at] + [m for m in made if m[0] <= at], key=lambda s: s[:3])

        def latest(match, limit):
            found = [s for s in known if s[3][3] == page and match(s[3]) and at - s[0] <= dt.timedelta(seconds=limit)]
            return found[-1] if found else None

        hit, rule = latest(lambda v: ip is not None and v[4] == ip, near), "same_ip"
        if hit is None:
            hit, rule = latest(lambda v: v[6] == client if client else (v[4], v[5]) == (ip, agent), far), "same_user"
        if hit is None:
            made.append((at, 1, rid, (-rid - 1, *e[1:])))
            out[rid] = (-rid - 1, "created")
        else:
            out[rid] = (hit[3][0], rule)
    return out


def frames(spark, visits, events):
    return spark.createDataFrame(visits, SCHEMA).drop("visit_id"), spark.createDataFrame(events, SCHEMA)


@pytest.mark.parametrize("near,far", [(90, 600), (600, 90), (0, 0)])
def test_link_or_create(spark, sliced, near, far):
    visits, events = log()
    v, e = frames(spark, visits, events)
    got = {r.id: (r.linked_visit_id, r.link_rule) for r in linking.link_or_create(e, v, near, far).collect()}
    want = by_hand(visits, events, near, far)
    assert got == want
    if (near, far) == (90, 600):
        assert {rule for _, rule in want.values()} == {None, "explicit", "same_ip", "same_user", "created"}


def test_link_without_rows(spark):
    visits, events = log(60)
    v, e = frames(spark, visits, events)
    assert linking.link_or_create(e.where("false"), v).count() == 0
    assert linking.link_or_create(e, v.where("false")).count() == len(events)


def test_moves_and_event_sessions(spark, sliced):
    visits, events = log(500, 3)
    v, e = frames(spark, visits, events)
    links = linking.link_or_create(e, v)
    extra = e
    for c in ("referrer", "page_domain", "path", "tracking_id", "source", "medium", "campaign"):
        extra = extra.withColumn(c, F.lit(None).cast("string"))
    moves = linking.visit_moves(extra, v, links)
    linked = by_hand(visits, events, 90, 600)
    session = {x[0]: x[7] for x in visits}
    want_moves, want_sessions, first = set(), {}, {x[0]: x[7] for x in events}
    for rid, (to, rule) in linked.items():
        if rule == "created":
            session[to] = first[rid]
    for rid, _, at, _, _, _, client, own in sorted(events, key=lambda x: (x[2], x[0])):
        to = linked[rid][0]
        if to is None or client:
            want_sessions[rid] = own
            if to is not None and session[to] != own:
                want_moves.add((to, rid, session[to], own))
                session[to] = own
        else:
            want_sessions[rid] = session[to]
    assert {(r.visit_id, r.event_id, r.old_session_id, r.session_id) for r in moves.collect()} == want_moves
    got = {r.id: r.session_id for r in linking.event_sessions(extra, v, links, moves).collect()}
    assert got == want_sessions
    final = {r.id: r.session_id for r in linking.moved_visits(v, moves).collect()}
    assert final == {x[0]: session[x[0]] for x in visits}


# --- addresses --------------------------------------------------------------------------

def number(text):
    try:
        a = ipaddress.ip_address(text.split("%")[0])
    except ValueError:
        return None
    return (0xFFFF << 32) + int(a) if a.version == 4 else int(a)


def addresses():
    rnd = random.Random(4)
    out = ["1.2.3.4", "256.1.1.1", "1.2.3", "::", "::1", "::ffff:10.0.0.1", "::FFFF:8.8.8.8", "1:2:3:4:5:6:7:8", "1::8", "x", "",
           "fe80::1%eth0", "1:2", "::1::2", "12345::", "2001:DB8::A", "64:ff9b::1.2.3.4", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8"]
    for text in location.RESERVED + location.GLOBAL_PARTS:
        n = ipaddress.ip_network(text)
        kind = ipaddress.IPv4Address if n.version == 4 else ipaddress.IPv6Address
        for i in (int(n[0]), int(n[-1]), int(n[0]) - 1, int(n[-1]) + 1):
            if 0 <= i < 2 ** n.max_prefixlen:
                out.append(str(kind(i)))
    return out + [str(ipaddress.IPv6Address(rnd.getrandbits(128) & rnd.getrandbits(128))) for _ in range(100)]


def test_address_keys_and_private_ranges(spark):
    df = spark.createDataFrame([(a,) for a in addresses()], "x string")
    for r in df.select("x", location.ip_key(F.col("x")).alias("k"), location.is_private_ip(F.col("x")).alias("p")).collect():
        n = number(r.x)
        assert r.k == (None if n is None else f"{n:032x}"), r.x
        a = None if n is None else ipaddress.ip_address(r.x.split("%")[0])
        assert r.p == bool(a and (a.is_private or a.is_loopback or a.is_link_local)), r.x


def test_narrowest_network(spark, sliced):
    rnd = random.Random(5)
    nets = []
    for _ in range(150):
        v4 = rnd.random() < 0.5
        kind, bits = (ipaddress.IPv4Network, rnd.randrange(4, 33)) if v4 else (ipaddress.IPv6Network, rnd.randrange(8, 129))
        width = 32 if v4 else 128
        base = (20 << 24 if v4 else 0x2A << 120) | rnd.getrandbits(width - 8) & rnd.getrandbits(width - 8) & rnd.getrandbits(width - 8)
        nets.append(kind((base, bits), strict=False))
    probes = [str(n[k]) for n in nets for k in (0, -1, rnd.randrange(min(n.num_addresses, 10 ** 9)))] + addresses()
    table = spark.createDataFrame([(str(n), f"C{i:03d}", f"T{i:03d}") for i, n in enumerate(nets)],
                                  "network string, country string, city string")
    ips = spark.createDataFrame([(p,) for p in [*probes, None]], "ip_address string")
    got = {r.ip: (r.country, r.city) for r in location.locate_ips(ips, table).collect()}
    assert set(got) == set(probes)
    for p in set(probes):
        want = (None, None)
        if number(p) is not None:
            a = ipaddress.ip_address(p.split("%")[0])
            own = getattr(a, "ipv4_mapped", None) or a
            inside = [(-n.prefixlen, f"C{i:03d}", f"T{i:03d}") for i, n in enumerate(nets) if n.version == own.version and own in n]
            want = min(inside)[1:] if inside else want
            want = ("XX", "Unknown") if a.is_private or a.is_link_local or a.is_loopback else want
        assert got[p] == want, p


# --- paging and kept summaries ----------------------------------------------------------

def test_pages_at_any_offset(spark, sliced):
    rnd = random.Random(6)
    rows = [(i, rnd.choice([None, *range(9)])) for i in range(333)]
    listing = Listing(spark.createDataFrame(rows, "id long, n long"), [F.desc("n"), "id"])
    ordered = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for limit, offset in ((10, 0), (10, 7), (50, 140), (1000, 5), (10, 330), (10, 400), (0, 3)):
        assert [tuple(r) for r in listing.page(limit, offset).collect()] == ordered[offset:offset + limit]
    assert listing.page_info(10, 20) == {"total_count": 333, "has_next": True, "has_prev": True, "current_page": 3, "total_pages": 34}
    if sliced:
        assert len(listing.ranges(10, 100)[0]) < len(listing.slices)
    with pytest.raises(ValueError):
        listing.page(-1)
    assert Listing(spark.createDataFrame([], "id long"), ["id"]).page(5).count() == 0


def test_summaries_in_buckets(spark, tmp_path):
    raw = weblog.log(spark, "/root/testdata/sf0.001")
    visits, events = weblog.visits(raw), weblog.visit_events(raw)
    store = SummaryStore(spark, str(tmp_path / "kept"), buckets=16)
    wide = summaries.client_summaries(visits, events)
    full = {"journeys": summaries.journeys(wide), "leads": summaries.leads(wide), "form_fills": summaries.form_fills(events)}

    def same():
        for name, df in full.items():
            assert sorted(map(str, store.read(name, df).collect())) == sorted(map(str, df.collect())), name

    clients = summaries.real_forms(events).select("client_id")
    store.refresh(visits, events, clients)
    same()
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "kept").rglob("*.parquet")}
    some = sorted({r.client_id for r in clients.collect()})[:1]
    written = store.refresh(visits, events, spark.createDataFrame([(c,) for c in some], "client_id string"))
    same()
    # Only the bucket of the changed client is written.
    assert len(written) == 1
    changed = {p.parent.name for p in (tmp_path / "kept").rglob("*.parquet") if p not in files}
    assert changed == {f"bucket={written[0]}"}
    assert store.refresh(visits, events, clients.where("false")) == []
    # A client whose forms are gone loses its rows, also where it was alone in its bucket.
    store.refresh(visits, events.where(F.col("client_id").isNull() | ~F.col("client_id").isin(some)),
                  spark.createDataFrame([(c,) for c in some], "client_id string"))
    left = {r.client_id for r in store.read("journeys", full["journeys"]).collect()}
    assert left == {r.client_id for r in full["journeys"].collect()} - set(some)
    # Lost leads are found and rebuilt.
    store.refresh(visits, events, clients)
    everyone = sorted(r.client_id for r in full["leads"].collect())
    lost = everyone[::2]
    store.overwrite("leads", full["leads"].where(~F.col("client_id").isin(lost)))
    assert sorted(r.client_id for r in store.reconcile(visits, events).collect()) == lost != []
    same()


def test_merged_visits(spark, sliced):
    rows = [(1, "s", "u", 0, {"a": "1"}, {"k": "1"}), (2, "s", "u", 20, {"a": "2", "b": "2"}, {"k": "2", "l": "2"}),
            (3, "s", "u", 60, None, {}), (4, "s", None, 61, {"z": "4"}, None), (5, "t", "u", 0, {}, None)]
    visits = spark.createDataFrame(
        [(i, s, u, T0 + dt.timedelta(seconds=t), None, h, c) for i, s, u, t, h, c in rows],
        "id long, session_id string, page_url string, timestamp timestamp, tracking_id string, "
        "request_headers map<string,string>, custom_data map<string,string>")
    kept = sessions.merge_visits(visits, 30)
    got = {r.id: (r.folded, r.request_headers, r.custom_data) for r in kept.collect()}
    assert got == {1: (1, {"a": "1", "b": "2"}, {"k": "2", "l": "2"}), 3: (0, None, {}), 4: (0, {"z": "4"}, None), 5: (0, {}, None)}
    counters = {r.session_id: (r.last_visit, r.visit_count) for r in sessions.session_counters(visits, kept).collect()}
    assert counters == {"s": (T0 + dt.timedelta(seconds=61), 3), "t": (T0, 1)}
