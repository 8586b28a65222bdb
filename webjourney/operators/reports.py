"""Flat dashboard reports: one scan and one aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webjourney.functions.journeys import uid
from webjourney.functions.predicates import Moment, days_before, in_range, moment
from webjourney.functions.text import blank_to_null, or_else
from webjourney.operators.ordered import left_join_spread


def order() -> Column:
    """Total order of visits and of events."""
    return F.struct("timestamp", "id")


def _n() -> Column:
    return F.count("*").alias("count")


def _top(df: DataFrame, k: int | None, *by) -> DataFrame:
    return df if k is None else df.orderBy(*by).limit(k)


def _rate(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.when(whole > 0, F.round(F.lit(100.0) * part / whole, digits)).otherwise(F.lit(0.0))


# --- visitors and traffic -------------------------------------------------------------

def visitor_summary(visits: DataFrame, start: Moment | None = None, end: Moment | None = None) -> DataFrame:
    """Totals, distinct visitors and the three visitor classes; an unknown bot flag is in no class."""
    mobile = F.col("user_agent").ilike("%mobile%")
    human = ~F.col("is_bot")

    def total(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    return in_range(visits, start, end).agg(
        F.count("*").alias("total_visits"),
        F.countDistinct(uid()).alias("unique_visitors"),
        total(F.col("is_bot")).alias("ai_crawlers"),
        total(human & mobile).alias("mobile_humans"),
        total(human & ~mobile).alias("desktop_humans"),
    )


def conversion_rate(
    visits: DataFrame, events: DataFrame, start: Moment | None = None, end: Moment | None = None
) -> DataFrame:
    """Distinct visitors, distinct visitors with a form submit, and their ratio in percent."""
    who = uid().alias("uid")
    seen = in_range(visits, start, end).select(who, F.lit(0).alias("converted"))
    submits = in_range(events, start, end).where(F.col("event_type") == "form_submit").select(
        who, F.lit(1).alias("converted"))
    # One row per visitor first, so both distinct counts come from a single shuffle.
    per_user = seen.unionByName(submits).where(F.col("uid").isNotNull()).groupBy("uid").agg(
        (F.min("converted") == 0).alias("seen"), (F.max("converted") == 1).alias("converted"))
    return per_user.agg(
        F.count(F.when(F.col("seen"), 1)).alias("unique_visitors"),
        F.count(F.when(F.col("converted"), 1)).alias("conversions")).withColumn(
        "conversion_rate", _rate(F.col("conversions"), F.col("unique_visitors")))


def top_user_agents(visits: DataFrame, k: int = 10, start=None, end=None) -> DataFrame:
    return _top(in_range(visits, start, end).groupBy("user_agent").agg(_n()), k,
                F.desc("count"), F.asc_nulls_first("user_agent"))


def _top_labelled(visits: DataFrame, column: str, label: str, k: int, start, end) -> DataFrame:
    # NULL is a group of its own; the label comes after the cut.
    top = _top(in_range(visits, start, end).groupBy(column).agg(_n()), k,
               F.desc("count"), F.asc_nulls_first(column))
    return top.withColumn(column, or_else(F.col(column), label))


def top_sources(visits: DataFrame, k: int = 5, start=None, end=None) -> DataFrame:
    return _top_labelled(visits, "source", "direct", k, start, end)


def top_campaigns(visits: DataFrame, k: int = 5, start=None, end=None) -> DataFrame:
    return _top_labelled(visits, "campaign", "none", k, start, end)


def page_domains(visits: DataFrame, k: int = 20, start=None, end=None) -> DataFrame:
    df = in_range(visits, start, end).where(F.col("page_domain").isNotNull())
    return _top(
        df.groupBy(F.col("page_domain").alias("domain")).agg(
            F.count("*").alias("total_visits"), F.countDistinct(uid()).alias("unique_visitors")),
        k, F.desc("total_visits"), "domain")


def crawler_by_domain(visits: DataFrame, k: int = 20, start=None, end=None) -> DataFrame:
    df = in_range(visits, start, end).where(F.col("is_bot") & F.col("page_domain").isNotNull())
    return _top(
        df.groupBy(F.col("page_domain").alias("domain"), F.col("crawler_type").alias("crawler")).agg(_n()),
        k, F.desc("count"), "domain", F.asc_nulls_first("crawler"))


def visitor_categories(visits: DataFrame, start=None, end=None) -> DataFrame:
    # Unlike a display default, '' and NULL stay separate groups until they are labelled.
    return (
        in_range(visits, start, end).groupBy("crawler_type").agg(_n())
        .select(or_else(F.col("crawler_type"), "Human").alias("name"), "count"))


def bot_summary(visits: DataFrame) -> DataFrame:
    return visits.where(F.col("crawler_type").isNotNull()).groupBy("crawler_type").agg(
        F.count("*").alias("visit_count"), F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"))


def traffic_sources(visits: DataFrame) -> DataFrame:
    return visits.where(F.col("source").isNotNull()).groupBy("source", "medium", "campaign").agg(
        F.count("*").alias("visits"))


def admin_stats(visits: DataFrame, sessions: DataFrame, as_of: Moment, k: int = 10) -> DataFrame:
    """(metric, name, value) rows: totals, last day, last hour and the top crawlers."""
    ts = F.col("timestamp")
    totals = visits.agg(
        F.count("*").alias("total_visits"),
        F.count(F.when(ts >= days_before(as_of, 1), 1)).alias("recent_visits_24h"),
        F.count(F.when(ts >= days_before(as_of, 1 / 24), 1)).alias("recent_visits_1h"))
    session_total = sessions.agg(F.count("*").alias("total_sessions"))

    def rows(df: DataFrame) -> DataFrame:
        return df.unpivot([], df.columns, "metric", "value").select(
            "metric", F.lit(None).cast("string").alias("name"), "value")

    crawlers = _top(
        visits.where(F.col("is_bot")).groupBy("crawler_type").agg(_n()), k,
        F.desc("count"), F.asc_nulls_first("crawler_type"))
    return rows(totals).unionByName(rows(session_total)).unionByName(crawlers.select(
        F.lit("crawler").alias("metric"), F.col("crawler_type").alias("name"),
        F.col("count").alias("value")))


# --- pages and events -----------------------------------------------------------------

def event_type_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(_n())


def time_ranges(visits: DataFrame, events: DataFrame) -> DataFrame:
    def span(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")).select(
            F.lit(name).alias("table_name"), "first_seen", "last_seen")

    return span(visits, "visits").unionByName(span(events, "visit_events"))


def path_event_counts(events: DataFrame, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Path × event type: count and latest. ``prefixes`` limits the paths (page funnel)."""
    df = events
    if prefixes:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.col("path").startswith(p)
        df = df.where(hit)
    return df.groupBy("path", "event_type").agg(_n(), F.max("timestamp").alias("latest_event"))


def page_views(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == "page_view").groupBy("path").agg(
        F.countDistinct("client_id").alias("unique_visitors"), F.count("*").alias("total_views"),
        F.max("timestamp").alias("latest_view"))


def latest_submissions(events: DataFrame, k: int = 5) -> DataFrame:
    return _top(
        events.where(F.col("event_type") == "form_submit").select(
            "id", "path", "event_type", "event_data", "timestamp"),
        k, F.desc("timestamp"), F.desc("id"))


def top_form_paths(events: DataFrame, as_of: Moment, days: int = 7, k: int = 10) -> DataFrame:
    df = events.where((F.col("event_type") == "form_submit") & (F.col("timestamp") > days_before(as_of, days)))
    return _top(df.groupBy("path").agg(_n()), k, F.desc("count"), "path")


def similar_paths(events: DataFrame, patterns: tuple[str, ...], as_of: Moment, days: int = 30,
                  k: int = 20) -> DataFrame:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col("path").ilike(p)
    df = events.where(hit & (F.col("timestamp") > days_before(as_of, days)))
    return _top(df.select("path").distinct(), k, "path")


def hourly_events(events: DataFrame, as_of: Moment, hours: int = 24) -> DataFrame:
    df = events.where(F.col("timestamp") > days_before(as_of, hours / 24))
    return df.groupBy("event_type", F.date_trunc("hour", "timestamp").alias("hour")).agg(_n())


def daily_uniques(visits: DataFrame, as_of: Moment, days: int = 30, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    df = visits.where(F.col("timestamp") > days_before(as_of, days))
    return df.groupBy(F.date_trunc("day", "timestamp").alias("day")).agg(
        distinct("client_id").alias("unique_visitors"), F.count("*").alias("total_visits"))


def top_pages(visits: DataFrame, as_of: Moment, days: int = 7, k: int = 20) -> DataFrame:
    df = visits.where(F.col("timestamp") > days_before(as_of, days))
    return _top(
        df.groupBy("path", "page_domain").agg(
            F.count("*").alias("visits"), F.countDistinct("client_id").alias("unique_visitors")),
        k, F.desc("visits"), "path", "page_domain")


def scroll_depth(events: DataFrame, as_of: Moment, days: int = 7) -> DataFrame:
    percent = F.get_json_object("event_data", "$.percent").try_cast("int")
    df = events.where((F.col("event_type") == "scroll") & (F.col("timestamp") > days_before(as_of, days)))
    return df.groupBy("path").agg(
        F.round(F.avg(percent), 4).alias("avg_scroll_percent"),
        F.max(percent).cast("bigint").alias("max_scroll_percent"), F.count("*").alias("scroll_events"))


def form_conversion(events: DataFrame, as_of: Moment, days: int = 30, path: str | None = None) -> DataFrame:
    """Per path (or one path): distinct page viewers, distinct submitters and their ratio."""
    df = events.where(F.col("event_type").isin("page_view", "form_submit")
                      & (F.col("timestamp") > days_before(as_of, days)))
    if path is not None:
        df = df.where(F.col("path") == path)

    # The visitor sets count NULL once, as DISTINCT over rows does.
    kinds = df.select("path", "event_type", "client_id").distinct()
    views = F.count(F.when(F.col("event_type") == "page_view", 1))
    forms = F.count(F.when(F.col("event_type") == "form_submit", 1))
    return kinds.groupBy("path").agg(
        views.alias("page_visitors"), forms.alias("form_submitters")).withColumn(
        "conversion_rate",
        F.when(F.col("page_visitors") > 0,
               F.round(F.lit(100.0) * F.col("form_submitters") / F.col("page_visitors"), 2)))


# --- rollups and alerts ---------------------------------------------------------------

def hourly_rollup(visits: DataFrame) -> DataFrame:
    """Hourly summary per crawler, country and domain.

    Bounce rate: share of the sessions of the cell with a single visit in it. The first
    aggregation is per session within the cell, so the distinct counts need no second scan.
    """
    cell = ["date", "hour", "crawler_type", "country", "domain"]
    df = visits.select(
        F.to_date("timestamp").alias("date"), F.hour("timestamp").alias("hour"), "crawler_type",
        "country", F.col("page_domain").alias("domain"), "session_id", "ip_address", "path",
        "response_time_ms", "response_status", "response_size")
    per_session = df.groupBy(*cell, "session_id").agg(
        F.count("*").alias("n"), F.sum("response_time_ms").alias("t"),
        F.count("response_time_ms").alias("tn"),
        F.count(F.when(F.col("response_status") >= 400, 1)).alias("e"),
        F.sum("response_size").alias("b"))
    totals = per_session.groupBy(*cell).agg(
        F.sum("n").alias("visit_count"), F.count("session_id").alias("unique_sessions"),
        F.round(F.sum("t") / F.sum("tn"), 3).alias("avg_response_time"),
        F.sum("e").alias("error_count"), F.sum("b").alias("bandwidth_bytes"),
        F.round(F.lit(100.0) * F.count(F.when(F.col("n") == 1, 1)) / F.count("*"), 2).alias("bounce_rate"))
    uniques = df.groupBy(*cell).agg(
        F.countDistinct("ip_address").alias("unique_ips"), F.countDistinct("path").alias("unique_pages"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cell]
    return totals.alias("a").join(uniques.alias("b"), same).select(
        "a.*", "b.unique_ips", "b.unique_pages").withColumn("hour", F.col("hour").cast("bigint"))


_CELL = ("date", "hour", "crawler_type", "country", "domain")


def rollup_parts(visits: DataFrame) -> DataFrame:
    """What hourly rollups can be merged from: sums per cell, session, address and path; ``timestamp`` is the hour."""
    return visits.groupBy(
        F.date_trunc("hour", "timestamp").alias("timestamp"), F.to_date("timestamp").alias("date"),
        F.hour("timestamp").cast("bigint").alias("hour"), "crawler_type", "country",
        F.col("page_domain").alias("domain"), "session_id", "ip_address", "path").agg(
        F.count("*").alias("n"), F.sum("response_time_ms").alias("t"), F.count("response_time_ms").alias("tn"),
        F.count(F.when(F.col("response_status") >= 400, 1)).alias("e"), F.sum("response_size").alias("b"))


def rollup_of_parts(parts: DataFrame) -> DataFrame:
    """``hourly_rollup`` of any number of ``rollup_parts``; distinct counts are exact, whatever the parts share."""
    sums = ("n", "t", "tn", "e", "b")
    per_session = parts.groupBy(*_CELL, "session_id").agg(*[F.sum(c).alias(c) for c in sums])
    totals = per_session.groupBy(*_CELL).agg(
        F.sum("n").alias("visit_count"), F.count("session_id").alias("unique_sessions"),
        F.round(F.sum("t") / F.sum("tn"), 3).alias("avg_response_time"),
        F.sum("e").alias("error_count"), F.sum("b").alias("bandwidth_bytes"),
        F.round(F.lit(100.0) * F.count(F.when(F.col("n") == 1, 1)) / F.count("*"), 2).alias("bounce_rate"))
    uniques = parts.groupBy(*_CELL).agg(
        F.countDistinct("ip_address").alias("unique_ips"), F.countDistinct("path").alias("unique_pages"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in _CELL]
    return totals.alias("a").join(uniques.alias("b"), same).select("a.*", "b.unique_ips", "b.unique_pages")


def visitor_profile(visits: DataFrame, events: DataFrame) -> DataFrame:
    """Long-term profile per visitor over the sessions of its visits."""
    per_session = visits.withColumn("uid", uid()).groupBy("uid", "session_id").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b"),
        F.min_by(F.struct("ip_address", "user_agent", "country", "city"), order()).alias("o"),
        F.min(order()).alias("k"))
    seconds = (F.unix_micros("b") - F.unix_micros("a")) / F.lit(1e6)
    profile = per_session.groupBy("uid").agg(
        F.min("a").alias("first_seen"), F.max("b").alias("last_seen"),
        F.count("*").alias("total_visits"), F.sum("n").alias("total_pageviews"),
        (F.count("*") > 1).alias("is_returning"),
        F.min_by("o", "k").alias("o"),
        F.round(F.sum(seconds), 3).alias("total_session_duration"),
        F.round(F.avg(seconds), 3).alias("avg_session_duration"),
        F.round(F.avg("n"), 4).alias("avg_pages_per_session"),
        F.round(F.lit(100.0) * F.count(F.when(F.col("n") == 1, 1)) / F.count("*"), 2).alias("bounce_rate"))
    counts = events.groupBy(uid().alias("uid")).agg(F.count("*").alias("total_events"))
    return profile.join(counts, "uid", "left").select(
        "uid", "first_seen", "last_seen", "total_visits", "total_pageviews",
        F.coalesce("total_events", F.lit(0)).alias("total_events"), "is_returning",
        F.col("o.ip_address").alias("primary_ip"), F.col("o.user_agent").alias("primary_user_agent"),
        F.col("o.country").alias("primary_country"), F.col("o.city").alias("primary_city"),
        "total_session_duration", "avg_session_duration", "avg_pages_per_session", "bounce_rate")


def threshold_alerts(visits: DataFrame, window_minutes: int = 60, threshold: int = 100) -> DataFrame:
    """Time windows with more visits than the threshold."""
    w = F.window("timestamp", f"{window_minutes} minutes")
    return visits.groupBy(w.alias("w")).agg(F.count("*").alias("visit_count")).where(
        F.col("visit_count") > threshold).select(
        F.col("w.start").alias("window_start"), "visit_count",
        F.lit(window_minutes).cast("bigint").alias("time_window_minutes"),
        F.round(F.col("visit_count") / F.lit(float(threshold)), 4).alias("threshold_exceeded"))


# --- listings -------------------------------------------------------------------------

def page(df: DataFrame, by, limit: int | None = None, offset: int = 0) -> DataFrame:
    """One page in a total order; without a limit the whole listing."""
    out = df.orderBy(*by)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def page_info(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Exact count and page position of a listing."""
    total = F.col("total_count")
    return df.agg(F.count("*").alias("total_count")).select(
        total, (F.lit(offset + limit) < total).alias("has_next"), F.lit(offset > 0).alias("has_prev"),
        F.lit(offset // limit + 1).cast("bigint").alias("current_page"),
        F.ceil(total / F.lit(limit)).alias("total_pages"))


def after_id(df: DataFrame, last_id: int, limit: int) -> DataFrame:
    """Keyset page."""
    return df.where(F.col("id") > last_id).orderBy("id").limit(limit)


def with_session_place(visits: DataFrame, sessions: DataFrame) -> DataFrame:
    """Country and city of the visit, both from its session when the visit has no country."""
    s = sessions.select(F.col("id").alias("session_id"), F.col("country").alias("s_country"),
                        F.col("city").alias("s_city"))
    missing = F.col("country").isNull() | (F.col("country") == "")
    joined = visits.join(s, "session_id", "left")
    return joined.withColumn("city", F.when(missing, F.col("s_city")).otherwise(F.col("city"))).withColumn(
        "country", F.when(missing, F.col("s_country")).otherwise(F.col("country"))).drop("s_country", "s_city")


def recent_activity(
    visits: DataFrame, sessions: DataFrame, as_of: Moment, days: int = 7, limit: int | None = 50,
    offset: int = 0,
) -> DataFrame:
    """Latest visits of the period; only the page that is shown meets the sessions."""
    cols = ["id", "timestamp", "session_id", "user_agent", "page_url", "is_bot", "crawler_type",
            "country", "city", "tracking_id", "source", "medium", "campaign",
            "client_side_timezone", "client_side_language"]
    latest = page(visits.where(F.col("timestamp") >= days_before(as_of, days)).select(*cols),
                  [F.desc("timestamp"), F.desc("id")], limit, offset)
    out = with_session_place(latest, sessions)
    texts = [c for c in cols if c not in ("id", "timestamp", "is_bot")]
    return out.select("id", "timestamp", F.coalesce("is_bot", F.lit(False)).alias("is_bot"),
                      *[F.coalesce(c, F.lit("")).alias(c) for c in texts])


def recent_visits(visits: DataFrame, as_of: Moment, hours: int = 24, crawler_type: str | None = None,
                  limit: int = 100) -> DataFrame:
    df = visits.where(F.col("timestamp") >= days_before(as_of, hours / 24))
    if crawler_type is not None:
        df = df.where(F.col("crawler_type") == crawler_type)
    return page(df, [F.desc("timestamp"), F.desc("id")], limit)


def admin_recent(visits: DataFrame, limit: int = 50) -> DataFrame:
    return page(visits.select(
        "id", "timestamp", "ip_address", "user_agent", "page_url", "crawler_type", "is_bot", "country", "city"),
        [F.desc("timestamp"), F.desc("id")], limit)


def live_feed(events: DataFrame, limit: int | None = 100, since_id: int | None = None) -> DataFrame:
    """Newest events without heartbeats, optionally only those after an id."""
    df = events.where(F.col("event_type") != "heartbeat")
    if since_id is not None:
        df = df.where(F.col("id") > since_id)
    return page(df.select(
        "id", "timestamp", "event_type", "page_url", "path", "referrer", "client_id", "session_id",
        "source", "medium", "campaign", "event_data", "page_domain", "referrer_domain"),
        [F.desc("timestamp"), F.desc("id")], limit)


def client_visits(visits: DataFrame, client_id: str | None = None) -> DataFrame:
    """Visits of one client newest first, or of all known clients."""
    if client_id is None:
        return visits.where(F.col("client_id").isNotNull())
    df = visits.where(F.col("client_id") == client_id)
    return df.orderBy(F.desc("timestamp"), F.desc("id"))


# --- sessions and users ---------------------------------------------------------------

def session_list(visits: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions with visit count and the class most of their visits fall in.

    Equal counts: human before crawler before unknown.
    """
    per_flag = visits.groupBy("session_id", "is_bot").agg(F.count("*").alias("n"))
    rank = F.when(F.col("is_bot").isNull(), 2).when(F.col("is_bot"), 1).otherwise(0)
    label = F.when(F.col("is_bot"), "AI Crawler").when(~F.col("is_bot"), "Human").otherwise("Unknown")
    per_session = per_flag.groupBy(F.col("session_id").alias("id")).agg(
        F.sum("n").alias("visits"), F.max_by(label, F.struct("n", -rank)).alias("classification"))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return sessions.drop("visit_count").join(per_session, "id", "left").select(
        F.col("id").alias("session_id"), "client_id", "first_visit", "last_visit",
        F.coalesce("visits", F.lit(0)).alias("visit_count"), text("ip_address"), text("country"),
        text("city"), F.coalesce("classification", F.lit("Unknown")).alias("classification"),
        text("client_side_timezone"), text("client_side_language"))


def session_stats(visits: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per session: visits, distinct domains, distinct paths (empty text does not count)."""
    stats = visits.groupBy(F.col("session_id").alias("id")).agg(
        F.count("*").alias("n"), F.countDistinct(blank_to_null(F.col("page_domain"))).alias("d"),
        F.countDistinct(blank_to_null(F.col("path"))).alias("p"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return sessions.join(stats, "id", "left").select(
        F.col("id").alias("session_id"), zero("n", "total_visits"), "first_visit", "last_visit",
        F.col("country_name").alias("country"), "city", zero("d", "unique_domains"),
        zero("p", "unique_paths"))


def _first_touch(df: DataFrame, key: str) -> DataFrame:
    """Earliest visit per key as a struct, found in the aggregation itself."""
    return df.groupBy(key).agg(
        F.min_by(F.struct("source", "medium", "campaign", "page_url", "referrer", "timestamp"), order()).alias("ft"))


def unified_users(visits: DataFrame, events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Known clients: activity counts, first touch and location of the latest session."""
    stats = visits.where(F.col("client_id").isNotNull()).groupBy("client_id").agg(
        F.countDistinct("session_id").alias("session_count"), F.count("*").alias("visit_count"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.min_by(F.struct("source", "medium", "campaign", "page_url"), order()).alias("ft"))
    acts = events.where(F.col("client_id").isNotNull()).groupBy("client_id").agg(
        F.count("*").alias("e"), F.count(F.when(F.col("event_type") == "form_submit", 1)).alias("c"))
    # Latest session; of several at the same time the lowest id.
    latest = sessions.where(F.col("client_id").isNotNull()).groupBy("client_id").agg(
        F.min_by(F.struct("country", "city"), F.struct(-F.unix_micros("last_visit"), "id")).alias("loc"))
    return stats.join(acts, "client_id", "left").join(latest, "client_id", "left").select(
        "client_id", "session_count", "visit_count", F.coalesce("e", F.lit(0)).alias("event_count"),
        F.coalesce("c", F.lit(0)).alias("conversion_count"), "first_seen", "last_seen",
        F.col("loc.country").alias("last_country"), F.col("loc.city").alias("last_city"),
        or_else(F.col("ft.source"), "direct").alias("source"),
        or_else(F.col("ft.medium"), "none").alias("medium"),
        or_else(F.col("ft.campaign"), "none").alias("campaign"),
        F.col("ft.page_url").alias("landing_page"))


def user_activity(visits: DataFrame, events: DataFrame, sessions: DataFrame,
                  client_id: str | None = None) -> DataFrame:
    """Activity summary and first touch per client (all clients, or one).

    ``last_seen`` is the last visit of the session that started last.
    """
    def known(df: DataFrame) -> DataFrame:
        return df.where(F.col("client_id").isNotNull() if client_id is None
                        else F.col("client_id") == client_id)

    v = known(visits).groupBy("client_id").agg(
        F.count("*").alias("v"), F.countDistinct(blank_to_null(F.col("page_domain"))).alias("d"),
        F.min_by(F.struct("source", "medium", "campaign", "page_url"), order()).alias("ft"))
    e = known(events).groupBy("client_id").agg(
        F.count("*").alias("e"), F.count(F.when(F.col("event_type") == "form_submit", 1)).alias("c"))
    s = known(sessions).groupBy("client_id").agg(
        F.count("*").alias("s"), F.min("first_visit").alias("first_seen"),
        F.max_by("last_visit", F.struct("first_visit", "id")).alias("last_seen"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    has_visit = F.col("ft").isNotNull()
    return v.join(e, "client_id", "full").join(s, "client_id", "full").select(
        "client_id", zero("s", "unique_sessions"), zero("v", "total_visits"), zero("e", "total_events"),
        zero("d", "unique_domains"), zero("c", "conversions"), "first_seen", "last_seen",
        F.when(has_visit, or_else(F.col("ft.source"), "direct")).otherwise("unknown").alias("source"),
        F.when(has_visit, or_else(F.col("ft.medium"), "none")).otherwise("none").alias("medium"),
        F.when(has_visit, or_else(F.col("ft.campaign"), "none")).otherwise("none").alias("campaign"),
        F.col("ft.page_url").alias("landing_page"))


def first_touch(visits: DataFrame, events: DataFrame) -> DataFrame:
    """First-touch attribution of clients with their number of conversions."""
    ft = _first_touch(visits.where(F.col("client_id").isNotNull()), "client_id")
    conv = events.where((F.col("event_type") == "form_submit") & F.col("client_id").isNotNull()).groupBy(
        "client_id").agg(F.count("*").alias("n"))
    return ft.join(conv, "client_id", "left").select(
        "client_id", F.col("ft.timestamp").alias("first_touch_at"),
        or_else(F.col("ft.source"), "direct").alias("source"),
        or_else(F.col("ft.medium"), "none").alias("medium"),
        or_else(F.col("ft.campaign"), "none").alias("campaign"),
        F.col("ft.page_url").alias("landing_page"), F.col("ft.referrer").alias("referrer"),
        F.coalesce("n", F.lit(0)).alias("conversion_count"))


def conversions(visits: DataFrame, events: DataFrame) -> DataFrame:
    """Every conversion of a client that has visits, with the form values given."""
    from webjourney.functions.forms import field

    known = visits.where(F.col("client_id").isNotNull()).select("client_id")
    return events.where((F.col("event_type") == "form_submit") & F.col("client_id").isNotNull()).join(
        known, "client_id", "left_semi").select(
        "client_id", "id", "timestamp", F.col("page_url").alias("page"),
        field(F.col("event_data"), "form_values").alias("form_values"))


def event_details(events: DataFrame, visits: DataFrame) -> DataFrame:
    """Events with title, source and medium of their visit."""
    v = visits.select(F.col("id").alias("visit_id"), F.col("page_title").alias("visit_title"),
                      F.col("source").alias("visit_source"), F.col("medium").alias("visit_medium"))
    return left_join_spread(events, v, "visit_id")


def timeline(visits: DataFrame, events: DataFrame) -> DataFrame:
    """Visits and events in one typed listing."""
    common = ["id", "timestamp", "client_id", "session_id", "page_url", "referrer", "path",
              "page_domain", "source", "medium", "campaign", "tracking_id"]
    v = visits.select(F.lit("visit").alias("item_type"), *common, "is_bot", "crawler_type")
    e = events.select(F.lit("event").alias("item_type"), *common, "referrer_domain", "event_type", "event_data")
    return v.unionByName(e, allowMissingColumns=True)


def client_timeline(visits: DataFrame, events: DataFrame, client_id: str | None = None,
                    limit: int | None = None, offset: int = 0) -> DataFrame:
    def known(df: DataFrame) -> DataFrame:
        return df.where(F.col("client_id").isNotNull() if client_id is None
                        else F.col("client_id") == client_id)

    rows = timeline(known(visits), known(events))
    if client_id is None and limit is None:
        # All clients: a total order of the whole log would only cost a sort.
        return rows
    return page(rows, ["timestamp", F.desc("item_type"), "id"], limit, offset)


def top_journeys(journeys: DataFrame, as_of: Moment, days: int = 7, k: int = 100) -> DataFrame:
    return _top(journeys.where(F.col("last_seen") > days_before(as_of, days)).select(
        "client_id", "entry_page", "exit_page", "visit_count", "path_sequence", "source", "campaign"),
        k, F.desc("visit_count"), "client_id")


def form_fills_between(fills: DataFrame, start: Moment, end: Moment) -> DataFrame:
    ts = F.col("timestamp")
    return fills.where((ts >= moment(start)) & (ts <= moment(end))).orderBy(F.desc("timestamp"), "visit_event_id")


def max_id(df: DataFrame) -> DataFrame:
    """Cursor for the next poll of the live feed."""
    return df.agg(F.max("id").alias("last_id"))


def crawler_catalogue(visits: DataFrame) -> DataFrame:
    """Named crawlers with their company and confidence, and how often each one came."""
    from webjourney.config import CRAWLERS

    known = visits.sparkSession.createDataFrame(
        [(c.name, c.company, c.confidence) for c in CRAWLERS], "crawler string, company string, confidence double")
    seen = visits.groupBy(F.col("crawler_type").alias("crawler")).agg(F.count("*").alias("n"))
    return known.join(seen, "crawler", "left").select(
        "crawler", "company", "confidence", F.coalesce("n", F.lit(0)).alias("visits"))
