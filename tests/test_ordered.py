"""Order-dependent operators against plain loops, in one slice and in many."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from webjourney.operators import ordered, paths, quality, sessions

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    out = []
    for i in range(1500):
        key = "hot" if rnd.random() < 0.5 else f"k{rnd.randrange(25)}"
        out.append((key, T0 + dt.timedelta(seconds=round(rnd.random() * 4000, 3)), i))
    # Bursts, ties and gaps.
    out += [("hot", T0 + dt.timedelta(seconds=5000 + i // 5), 2000 + i) for i in range(400)]
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, ts timestamp, id long").cache()


@pytest.fixture(params=[False, True], ids=["one slice", "many slices"])
def sliced(request, spark):
    """Adaptive execution merges small slices into one; without it every range is a slice."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    if request.param:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "12")
    yield request.param
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", before)


def by_key(rows):
    out = {}
    for k, t, i in rows:
        out.setdefault(k, []).append((t, i))
    return {k: sorted(v) for k, v in out.items()}


def test_rows_lie_in_slices(frame, sliced):
    t = ordered.Timeline(frame, ["k"], ["ts", "id"])
    slices = {}
    for r in t.df.collect():
        slices.setdefault(r.k, set()).add(r["_slice"])
    assert (max(map(len, slices.values())) > 3) == sliced
    spanning = [r.k for r in t.spanning.collect()]
    assert sorted(spanning) == sorted(k for k, s in slices.items() if len(s) > 1)
    assert len(spanning) <= len(set().union(*slices.values()))


def test_timeline(frame, rows, sliced):
    t = ordered.Timeline(frame, ["k"], ["ts", "id"])
    t.previous("p", F.struct("id")).running_sum("n", F.col("id") % 3)
    t.last_known("l", F.when(F.col("id") % 7 == 0, F.col("id")))
    got = {r.id: (r.p.id if r.p else None, r.n, r.l) for r in t.done().collect()}
    want = {}
    for v in by_key(rows).values():
        total, prev, last = 0, None, None
        for _, i in v:
            total += i % 3
            last = i if i % 7 == 0 else last
            want[i] = (prev, total, last)
            prev = i
    assert got == want


@pytest.mark.parametrize("gap,inclusive", [(0.5, True), (3, True), (3, False), (60, True), (1e5, True)])
def test_keep_spaced(frame, rows, sliced, gap, inclusive):
    got = {r.id: r.kept_id for r in ordered.keep_spaced(frame, ["k"], "ts", "id", gap, inclusive).collect()}
    want = {}
    for v in by_key(rows).values():
        kept = None
        for t, i in v:
            age = (t - kept[0]).total_seconds() if kept else None
            if age is None or age > gap or (not inclusive and age == gap):
                kept = (t, i)
            want[i] = kept[1]
    assert got == want


def test_ordered_texts(frame, rows, sliced):
    even = F.when(F.col("id") % 2 == 0, F.col("id").cast("string"))
    out = ordered.Timeline(frame, ["k"], ["ts", "id"]).texts(even, ">", "o")
    want = {k: ">".join(str(i) for _, i in v if i % 2 == 0) for k, v in by_key(rows).items()}
    assert {r.k: r.o for r in out.collect()} == {k: v for k, v in want.items() if v}


def test_running_counts(frame, rows, sliced):
    base = frame.select("k", F.col("ts").alias("at"))
    probes = frame.select("k", F.col("ts").alias("at"), (F.col("id") % 2 == 0).alias("inclusive"), "id")
    got = {r.id: r.n for r in ordered.running_counts(base, probes, ["k"]).collect()}
    want = {}
    for v in by_key(rows).values():
        for t, i in v:
            want[i] = sum(1 for u, _ in v if u < t or (u == t and i % 2 == 0))
    assert got == want


def test_rate_flags(frame, rows, sliced):
    hits = frame.select("id", F.col("k").alias("ip_address"), F.lit("a").alias("event_type"), F.col("ts").alias("timestamp"))
    got = {r.id: r.earlier for r in quality.rate_flags(hits, window_seconds=60, limit=10).collect()}
    want = {}
    for v in by_key(rows).values():
        for n, (t, i) in enumerate(v):
            want[i] = sum(1 for u, _ in v[:n] if (t - u).total_seconds() <= 60)
    assert got == want


def test_dedup_keeps_first_tracking_id(spark):
    data = [(1, "s", "u", 0, None), (2, "s", "u", 30, "t2"), (3, "s", "u", 31, "t3"), (4, "s", None, 31, "x"), (5, "s", "v", 1, "")]
    df = spark.createDataFrame([(i, s, u, T0 + dt.timedelta(seconds=t), tid) for i, s, u, t, tid in data],
                               "id long, session_id string, page_url string, timestamp timestamp, tracking_id string")
    got = {r.id: (r.tracking_id, r.folded) for r in sessions.dedup_visits(df, 30).collect()}
    assert got == {1: ("t2", 1), 3: ("t3", 0), 4: ("x", 0), 5: (None, 0)}


def test_stitch_visits_counts_pairs(spark, sliced):
    rnd = random.Random(3)
    visits = []
    for i in range(300):
        fp, c = rnd.randrange(3), rnd.choice([None, "a", "b", "c"])
        visits.append((i, c, f"ip{fp}", "ua", T0 + dt.timedelta(minutes=rnd.randrange(5000))))
    df = spark.createDataFrame(visits, "id long, client_id string, ip_address string, user_agent string, timestamp timestamp").selectExpr(
        "*", "'/p' AS path", "'d' AS page_domain", "'u' AS page_url", "'r' AS referrer", "'s' AS source", "'m' AS medium")
    clients = spark.createDataFrame([("a",), ("b",)], "client_id string")
    got = {(r.unified_client_id, r.id): r.times for r in paths.stitch_visits(df, clients).collect()}
    want = {}
    for c in ("a", "b"):
        for i, cid, ip, _, t in visits:
            if cid == c:
                want[c, i] = 1
                continue
            n = sum(1 for _, tc, tip, _, tt in visits if tc == c and tip == ip and dt.timedelta() <= tt - t <= dt.timedelta(hours=24))
            if n:
                want[c, i] = n
    assert got == want


def test_null_key_is_a_key(spark, frame, rows, sliced):
    nulls = frame.withColumn("k", F.when(F.col("k") != "hot", F.col("k")))
    line = ordered.Timeline(nulls, ["k"], ["ts", "id"]).running_sum("s", F.lit(1)).previous("p", F.struct("id"))
    want = set()
    for k, items in by_key(rows).items():
        before = None
        for n, (_, i) in enumerate(items, 1):
            want.add((None if k == "hot" else k, i, n, before))
            before = i
    assert {(r.k, r.id, r.s, r.p.id if r.p else None) for r in line.df.collect()} == want


def test_one_instant_is_cut(spark, sliced):
    """All rows of one key at one time: the order's last column cuts them."""
    df = spark.range(4000).select(F.lit("k").alias("k"), F.lit(T0).cast("timestamp").alias("ts"), F.col("id"))
    t = ordered.Timeline(df, ["k"], ["ts", "id"]).running_sum("n", F.lit(1)).previous("p", F.struct("id"))
    rows = t.df.collect()
    assert (len({r["_slice"] for r in rows}) > 3) == sliced
    assert {(r.id, r.n, r.p.id if r.p else None) for r in rows} == {(i, i + 1, i - 1 if i else None) for i in range(4000)}
    kept = ordered.keep_spaced(df, ["k"], "ts", "id", 0).select("kept_id").distinct().collect()
    assert [r.kept_id for r in kept] == [0]
    assert {r.kept_id for r in ordered.keep_spaced(df, ["k"], "ts", "id", 0, False).collect()} == set(range(4000))


def test_no_rows(frame, sliced):
    none = frame.where("false")
    t = ordered.Timeline(none, ["k"], ["ts", "id"]).running_sum("n", F.lit(1)).last_known("l", F.col("id"))
    assert t.done().count() == 0 and t.texts(F.col("k"), ",", "t").count() == 0
    assert ordered.keep_spaced(none, ["k"], "ts", "id", 1).count() == 0
