"""Journey sessionization, session rebuild, live assignment and visit de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webjourney.config import ENTRY_EVENT_TYPES
from webjourney.functions import url
from webjourney.functions.journeys import (
    Families, live_boundary, rebuild_boundary, session_id, user_key,
)
from webjourney.functions.predicates import Moment, seconds_between
from webjourney.functions.text import blank_to_null
from webjourney.operators.ordered import Timeline, keep_spaced, left_join_spread, work_table

_ORDER = ["timestamp", "rank", "id"]


def rebuild_records(visits: DataFrame, events: DataFrame, start: Moment | None = None) -> DataFrame:
    """All visits, and the page-entry events of known clients, in one record shape."""
    v = visits.select(
        F.lit(0).alias("rank"), "id", F.col("session_id").alias("old_session_id"), "client_id",
        "ip_address", "user_agent", "timestamp", F.lit(None).cast("string").alias("event_type"),
        "referrer", url.referrer_domain(F.col("referrer")).alias("referrer_domain"),
        "source", "medium", "campaign")
    e = events.where(F.col("event_type").isin(*ENTRY_EVENT_TYPES) & (F.col("client_id") != "")).select(
        F.lit(1).alias("rank"), "id", F.col("session_id").alias("old_session_id"), "client_id",
        F.lit(None).cast("string").alias("ip_address"), F.lit(None).cast("string").alias("user_agent"),
        "timestamp", "event_type", "referrer", "referrer_domain", "source", "medium", "campaign")
    out = v.unionByName(e)
    return out if start is None else out.where(F.col("timestamp") >= F.lit(start).cast("timestamp"))


def sessionize(records: DataFrame, families: Families, inactivity_seconds: int = 1800) -> DataFrame:
    """Give every record its journey: ``user_key``, ``journey_seq``, ``new_session_id``.

    The boundary needs the time of the previous record only, so journeys are a running count
    of boundaries.
    """
    t = Timeline(records.withColumn("user_key", user_key()), ["user_key"], _ORDER)
    t.previous("_prev", F.struct("timestamp"))
    gap = seconds_between(F.col("timestamp"), F.col("_prev.timestamp"))
    is_new = rebuild_boundary(
        F.col("event_type"), F.col("referrer_domain"), F.col("source"), F.col("medium"),
        F.col("campaign"), gap, families, inactivity_seconds)
    t.running_sum("journey_seq", is_new.cast("long"))
    return (
        t.done().withColumn("journey_seq", F.col("journey_seq") - 1)
        .withColumn("new_session_id", session_id(F.col("user_key"), F.col("journey_seq")))
        .drop("_prev")
    )


def rebuilt_sessions(assigned: DataFrame) -> DataFrame:
    """Session rows of an assignment; ``visit_count`` counts records."""
    order = F.struct(*_ORDER)

    def first_known(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c) != "", order))

    return assigned.groupBy(F.col("new_session_id").alias("id")).agg(
        F.coalesce(first_known("ip_address"), F.lit("unknown")).alias("ip_address"),
        F.coalesce(first_known("user_agent"), F.lit("unknown")).alias("user_agent"),
        first_known("client_id").alias("client_id"),
        F.min("timestamp").alias("first_visit"), F.max("timestamp").alias("last_visit"),
        F.count("*").alias("visit_count"),
        blank_to_null(F.min_by("referrer", order)).alias("entry_referrer"),
        F.min_by("referrer_domain", order).alias("entry_referrer_domain"),
        F.lit(True).alias("is_external_entry"))


def remap_audit(assigned: DataFrame) -> DataFrame:
    """Visits and events moved per (old, new) session pair."""
    moved = assigned.where(~F.col("old_session_id").eqNullSafe(F.col("new_session_id")))
    return moved.groupBy("old_session_id", "new_session_id").agg(
        F.max_by("client_id", F.struct(*_ORDER)).alias("client_id"),
        F.count(F.when(F.col("rank") == 0, 1)).alias("visit_count_moved"),
        F.count(F.when(F.col("rank") == 1, 1)).alias("event_count_moved"))


def remap_visits(visits: DataFrame, assigned: DataFrame) -> DataFrame:
    new = assigned.where(F.col("rank") == 0).select("id", "new_session_id")
    return visits.join(new, "id", "left").withColumn(
        "session_id", F.coalesce("new_session_id", "session_id")).drop("new_session_id")


def follow_visit_session(events: DataFrame, visits: DataFrame) -> DataFrame:
    """Linked events take the session of their visit."""
    v = visits.select(F.col("id").alias("visit_id"), F.col("session_id").alias("_vs"))
    return left_join_spread(events, v, "visit_id").withColumn(
        "session_id", F.coalesce("_vs", "session_id")).drop("_vs")


def remap_events(events: DataFrame, assigned: DataFrame, remapped_visits: DataFrame) -> DataFrame:
    """Entry events by their own assignment, the others through their visit."""
    new = assigned.where(F.col("rank") == 1).select("id", "new_session_id")
    followed = follow_visit_session(events, remapped_visits)
    return followed.join(new, "id", "left").withColumn(
        "session_id", F.coalesce("new_session_id", "session_id")).drop("new_session_id")


def orphan_sessions(sessions: DataFrame, visits: DataFrame, events: DataFrame) -> DataFrame:
    """Sessions that neither a visit nor an event refers to."""
    used = lambda df: df.select(F.col("session_id").alias("id"))
    return sessions.join(used(visits), "id", "left_anti").join(used(events), "id", "left_anti")


def rebuild(
    visits: DataFrame, events: DataFrame, sessions: DataFrame, families: Families,
    inactivity_seconds: int = 1800, start: Moment | None = None,
) -> dict[str, DataFrame]:
    """Whole session rebuild: new sessions, remapped visits and events, audit and removals."""
    # Five results rest on it.
    assigned = work_table(sessionize(rebuild_records(visits, events, start), families, inactivity_seconds))
    fresh = rebuilt_sessions(assigned)
    v = remap_visits(visits, assigned)
    e = remap_events(events, assigned, v)
    kept = sessions.join(fresh.select("id"), "id", "left_anti")
    orphans = orphan_sessions(kept, v, e)
    return {
        "sessions": kept.join(orphans.select("id"), "id", "left_anti").unionByName(
            fresh, allowMissingColumns=True),
        "visits": v, "events": e, "audit": remap_audit(assigned), "orphans": orphans,
    }


def rebuild_stats(visits: DataFrame, events: DataFrame, sessions: DataFrame, families: Families,
                  inactivity_seconds: int = 1800) -> DataFrame:
    """Dry run: totals before and after, without writing anything."""
    assigned = sessionize(rebuild_records(visits, events), families, inactivity_seconds)
    moved = ~F.col("old_session_id").eqNullSafe(F.col("new_session_id"))
    plan = assigned.agg(
        F.count("*").alias("records"), F.countDistinct("old_session_id").alias("sessions_in_use"),
        F.countDistinct("new_session_id").alias("sessions_after"),
        F.count(F.when(moved & (F.col("rank") == 0), 1)).alias("visits_moved"),
        F.count(F.when(moved & (F.col("rank") == 1), 1)).alias("events_moved"))
    return plan.select("*", sessions.agg(F.count("*")).scalar().alias("sessions_before"))


def assign_live(hits: DataFrame, families: Families, race_seconds: float = 30) -> DataFrame:
    """Sessions as they are assigned on arrival, for hits in time order.

    A hit opens a session when it is the first of its user or an external entry, unless the
    user opened one at most ``race_seconds`` ago; otherwise it continues the latest session.
    """
    entry = live_boundary(
        F.col("event_type"), F.col("referrer_domain"), F.col("source"), F.col("medium"), F.col("campaign"), families)
    # The steps write their rows, so only what they need goes through them.
    narrow = hits.select("id", "timestamp", user_key().alias("user_key"), entry.alias("entry"))
    assigned = assign_entries(narrow, race_seconds).select("id", "user_key", "journey_seq", "is_new")
    return hits.join(assigned, "id").withColumn(
        "live_session_id", session_id(F.col("user_key"), F.col("journey_seq")))


def assign_entries(rows: DataFrame, race_seconds: float = 30, opened: bool = False) -> DataFrame:
    """``journey_seq, is_new`` of rows with ``user_key`` and ``entry``; with ``opened`` also ``opened_at, opened_id``, the
    row that opened the session."""
    t = Timeline(rows, ["user_key"], ["timestamp", "id"]).previous("_prev", F.struct("id"))
    t.df = t.df.withColumn("_opens", F.col("_prev").isNull() | F.col("entry"))
    spaced = keep_spaced(t.df.where("_opens"), ["user_key"], "timestamp", "id", race_seconds)
    # Written, as every step below would scan the rows again.
    opens = work_table(spaced.where(F.col("kept_id") == F.col("id")).select("id", F.lit(True).alias("is_new")))
    # Still in the slices of the first step.
    t.df = t.df.join(opens, "id", "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))
    t.running_sum("journey_seq", F.col("is_new").cast("long"))
    if opened:
        t.last_known("_open", F.when(F.col("is_new"), F.struct("timestamp", "id")))
        t.df = t.df.withColumn("opened_at", F.col("_open.timestamp")).withColumn("opened_id", F.col("_open.id"))
    return t.done().withColumn("journey_seq", F.col("journey_seq") - 1).drop("_prev", "_opens", "_open")


def dedup_visits(visits: DataFrame, seconds: float = 30) -> DataFrame:
    """Fold repeated visits of a session to a URL into the last kept one.

    The kept row keeps its time and takes the first non-empty tracking id; visits without a
    URL are never duplicates.
    """
    with_url = visits.where(F.col("page_url") != "")
    mapping = keep_spaced(with_url, ["session_id", "page_url"], "timestamp", "id", seconds).select(
        "id", "kept_id")
    return fold_visits(visits, mapping)


def fold_visits(visits: DataFrame, mapping: DataFrame) -> DataFrame:
    """Kept visits by a mapping of id to kept_id, with ``folded``, the number of others."""
    with_url = visits.where(F.col("page_url") != "")
    order = F.struct("timestamp", "id")
    folded = with_url.join(mapping, "id").groupBy(F.col("kept_id").alias("id")).agg(
        F.min_by("tracking_id", F.when(F.col("tracking_id") != "", order)).alias("_tid"),
        (F.count("*") - 1).alias("folded"))
    kept = with_url.join(folded, "id").withColumn("tracking_id", F.col("_tid")).drop("_tid")
    bare = visits.where(F.col("page_url").isNull() | (F.col("page_url") == "")).withColumn(
        "folded", F.lit(0).cast("long"))
    return kept.unionByName(bare)


def folded_maps(visits: DataFrame, folds: DataFrame, first: tuple[str, ...], latest: tuple[str, ...]) -> DataFrame:
    """Maps of the visits that fold into one, merged: per key the first value for the columns ``first``, the latest for
    those of ``latest``. ``folds``: id, kept_id. Returns ``id`` of the kept visits that have any entry, and the maps."""
    order = F.struct("timestamp", "id")
    rows = visits.select("id", "timestamp", *first, *latest).join(folds, "id")
    entries = rows.select("kept_id", "timestamp", "id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).alias("m")) for c in (*first, *latest)])).alias("e")).select(
        "kept_id", "timestamp", "id", "e.c", F.explode("e.m").alias("key", "value"))
    merged = entries.groupBy("kept_id", "c", "key").agg(
        F.min_by("value", order).alias("a"), F.max_by("value", order).alias("z"))
    value = F.when(F.col("c").isin(*latest), F.col("z")).otherwise(F.col("a"))

    def whole(c: str) -> Column:
        found = F.sort_array(F.collect_list(F.when(F.col("c") == c, F.struct("key", value.alias("value")))))
        return F.when(F.size(found) > 0, F.map_from_entries(found)).alias(c)

    return merged.groupBy(F.col("kept_id").alias("id")).agg(*[whole(c) for c in (*first, *latest)])


def merge_visits(visits: DataFrame, seconds: float = 30) -> DataFrame:
    """``dedup_visits`` with the maps ``request_headers`` (first value of each key) and ``custom_data`` (latest) of the
    folded visits merged into the kept one."""
    with_url = visits.where(F.col("page_url") != "")
    folds = work_table(keep_spaced(with_url, ["session_id", "page_url"], "timestamp", "id", seconds).select("id", "kept_id"))
    maps = folded_maps(with_url, folds, ("request_headers",), ("custom_data",))
    kept = fold_visits(visits, folds)
    own = lambda c: F.coalesce(f"_{c}", c).alias(c)
    renamed = maps.withColumnsRenamed({c: f"_{c}" for c in ("request_headers", "custom_data")})
    return kept.join(renamed, "id", "left").select(
        *[own(c) if c in ("request_headers", "custom_data") else c for c in kept.columns])


def session_counters(visits: DataFrame, kept: DataFrame) -> DataFrame:
    """``session_id, last_visit, visit_count``: every hit moves the time, only kept ones count."""
    counts = kept.groupBy("session_id").agg(F.count("*").alias("visit_count"))
    return visits.groupBy("session_id").agg(F.max("timestamp").alias("last_visit")).join(counts, "session_id", "left")


def debounce_submits(events: DataFrame, seconds: float = 1) -> DataFrame:
    """Form submits of a client and page no closer than ``seconds`` to the last one kept."""
    submits = events.where(F.col("event_type") == "form_submit")
    keys = ["client_id", "session_id", "page_url"]
    spaced = keep_spaced(submits, keys, "timestamp", "id", seconds, inclusive=False)
    return submits.join(spaced.where(F.col("kept_id") == F.col("id")).select("id"), "id", "left_semi")


def first_page_views(events: DataFrame) -> DataFrame:
    """One page view per session and URL: the earliest."""
    views = events.where(F.col("event_type") == "page_view")
    firsts = views.groupBy("session_id", "page_url").agg(F.min(F.struct("timestamp", "id")).alias("k"))
    return views.join(firsts.select(F.col("k.id").alias("id")), "id", "left_semi")


def engagement(events: DataFrame, idle_limit_ms: int = 30_000, by: tuple[str, ...] = ()) -> DataFrame:
    """Time on page and idle time per session and page (and ``by``) from heartbeat and navigate payloads."""
    on_page = F.get_json_object("event_data", "$.time_on_page_ms").try_cast("bigint")
    idle = F.get_json_object("event_data", "$.idle_time_ms").try_cast("bigint")
    beats = events.where(F.col("event_type").isin("heartbeat", "navigate"))
    return beats.groupBy(*by, "session_id", "page_url").agg(
        F.count("*").alias("beats"), F.max(on_page).alias("time_on_page_ms"), F.max(idle).alias("max_idle_ms"),
        F.count(F.when(idle < idle_limit_ms, 1)).alias("engaged_beats"))


def fill_from_events(visits: DataFrame, events: DataFrame) -> DataFrame:
    """Missing visit fields taken from the first linked event that has them."""
    order = F.struct("timestamp", "id")
    fields = ["tracking_id", "client_side_timezone", "client_side_language"]
    linked = events.where(F.col("visit_id").isNotNull()).groupBy("visit_id").agg(*[
        F.min_by(c, F.when(F.col(c) != "", order)).alias(f"_{c}") for c in fields])
    out = visits.join(linked, visits["id"] == linked["visit_id"], "left").drop("visit_id")
    for c in fields:
        out = out.withColumn(c, F.coalesce(blank_to_null(F.col(c)), F.col(f"_{c}"))).drop(f"_{c}")
    return out


def session_attributes(hits: DataFrame) -> DataFrame:
    """First known value of each descriptive field per session."""
    order = F.struct("timestamp", "id")
    fields = ["country", "city", "client_side_timezone", "client_side_language"]
    return hits.groupBy("session_id").agg(*[
        F.min_by(c, F.when(F.col(c) != "", order)).alias(c) for c in fields])


def latest_sessions(sessions: DataFrame) -> DataFrame:
    """Session each user would continue: the latest by client, or by address and agent."""
    by = F.when(F.col("client_id") != "", F.concat(F.lit("cid:"), "client_id")).otherwise(
        F.concat(F.lit("ipua:"), "ip_address", F.lit(":"), "user_agent"))
    # Latest; of several at the same time the lowest id.
    return sessions.groupBy(by.alias("user_key")).agg(
        F.min_by(F.struct("id", "last_visit"), F.struct(-F.unix_micros("last_visit"), "id")).alias("s")).select(
        "user_key", F.col("s.id").alias("session_id"), F.col("s.last_visit").alias("last_visit"))
