"""Page flows, conversion paths and the cross-domain stitched funnel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webjourney.functions import forms, url
from webjourney.functions.journeys import uid
from webjourney.functions.predicates import Moment, days_before, hits_target, micros, seconds_between
from webjourney.functions.text import first_email
from webjourney.operators import stitching
from webjourney.operators.ordered import Timeline, work_table

ARROW = " → "


def page_flows(visits: DataFrame, as_of: Moment, days: int = 7, k: int | None = 100) -> DataFrame:
    """Counts of page-to-page moves inside a session."""
    rows = visits.where((F.col("timestamp") >= days_before(as_of, days)) & F.col("path").isNotNull()).select(
        "session_id", "timestamp", "id", "path")
    t = Timeline(rows, ["session_id"], ["timestamp", "id"]).previous("_prev", F.struct("path"))
    flows = t.done().where(F.col("_prev").isNotNull()).groupBy(
        F.col("_prev.path").alias("from_path"), F.col("path").alias("to_path")).agg(F.count("*").alias("count"))
    return flows if k is None else flows.orderBy(F.desc("count"), "from_path", "to_path").limit(k)


def path_analysis(visits: DataFrame, events: DataFrame, target: str, as_of: Moment, days: int = 30) -> DataFrame:
    """How visitors came to a target path: first touch, path, what they shared, time to convert."""
    order = F.struct("timestamp", "id")
    recent = F.col("timestamp") >= days_before(as_of, days)
    v = visits.where(recent).withColumn("uid", uid()).select(
        "uid", "id", "timestamp", "path", "page_url", "referrer", "source", "medium")
    hits = v.where(hits_target(F.col("path"), target)).withColumn("_params", url.render_params(
        "page_url", keep=("email", "name", "company", "organization", "user_email")))
    converters = hits.groupBy("uid").agg(
        F.min("timestamp").alias("conversion_at"),
        F.min_by(F.struct("_params"), order).alias("_p"))
    # Every conversion is a visit, so the first touch lies among the visits up to it.
    journey = v.join(converters.select("uid", "conversion_at"), "uid").where(
        F.col("timestamp") <= F.col("conversion_at"))
    t = Timeline(journey, ["uid"], ["timestamp", "id"]).previous("_prev", F.struct("path"))
    repeated = F.coalesce(F.col("_prev.path") == F.col("path"), F.lit(False))
    walked = t.summary(
        F.when(~repeated, F.col("path")), ARROW, "journey_to_conversion",
        [F.min_by(F.struct("referrer", "source", "medium", "timestamp"), order).alias("ft")])

    sent = events.where(recent & (F.col("event_type") == "form_submit")
                        & forms.passes_noise_filter(F.col("event_data")))
    text = F.concat(F.lit("Form on "), F.col("path"), F.lit(": "), F.col("event_data"))
    shared = sent.select(uid().alias("uid"), "timestamp", text.alias("_t")).join(
        converters.select("uid", "conversion_at"), "uid").where(
        F.col("timestamp") <= F.col("conversion_at")).groupBy("uid").agg(
        F.sort_array(F.collect_set("_t")).alias("_f"))
    form_text = F.when(F.size("_f") > 0, F.array_join("_f", " | "))
    return (
        converters.join(walked, "uid").join(shared, "uid", "left").select(
            F.col("uid").alias("unique_user_key"),
            F.coalesce("_p._params", form_text, F.lit("No info shared")).alias("form_data_shared"),
            "journey_to_conversion", F.col("ft.referrer").alias("original_referrer"),
            F.col("ft.source").alias("original_utm_source"), F.col("ft.medium").alias("original_utm_medium"),
            F.col("ft.timestamp").alias("user_acquired_at"), "conversion_at",
            F.round(seconds_between(F.col("conversion_at"), F.col("ft.timestamp")), 6)
            .alias("time_to_convert_seconds"))
        .orderBy(F.desc("conversion_at"), "unique_user_key"))


# --- cross-domain stitching -----------------------------------------------------------

def completers(visits: DataFrame, first_target: str, last_target: str) -> DataFrame:
    """Clients with a visit to the first target and a later one to the last target."""
    v = visits.where(F.col("client_id").isNotNull()).select("client_id", "timestamp", "path")
    started = v.where(hits_target(F.col("path"), first_target)).groupBy("client_id").agg(
        F.min("timestamp").alias("started_at"))
    reached = v.where(hits_target(F.col("path"), last_target)).join(started, "client_id").where(
        F.col("timestamp") >= F.col("started_at"))
    return reached.groupBy("client_id").agg(
        F.min("started_at").alias("started_at"), F.min("timestamp").alias("completed_at"))


_CARRIED = ("id", "timestamp", "path", "page_domain", "page_url", "referrer", "source", "medium")


def _client_visits(visits: DataFrame, clients: DataFrame) -> DataFrame:
    """``client, fp, us`` of the visits that others are matched with."""
    return stitching.fingerprinted(visits).withColumnRenamed("owner", "client").join(
        clients.select(F.col("client_id").alias("client")), "client", "left_semi")


def _repeated_ids(visits: DataFrame) -> DataFrame | None:
    """Ids that several visits have, if there are any."""
    ids = work_table(visits.where(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    return None if ids.isEmpty() else ids


def _matched_by_id(seen: DataFrame, ids: DataFrame, own: DataFrame, window: int) -> DataFrame:
    """``unified_client_id, id, times`` where the rows of an id count together."""
    some = stitching.Meeting(seen.join(ids, "id", "left_semi"), own, window)
    return some.related(f"unified_client_id string, times long, id {seen.schema['id'].dataType.simpleString()}", ["id"]).groupBy(
        "unified_client_id", "id").agg(F.sum("times").alias("times"))


def stitch_visits(
    visits: DataFrame, clients: DataFrame, hours: float = 24, carried: Sequence[str] = _CARRIED,
) -> DataFrame:
    """Visits of each client plus those of other clients with the same address and agent in the
    ``hours`` up to one of the client's visits, with the columns ``carried``.

    A foreign visit counts once per matching visit of the client (``times``); rows of one id count together. Visits
    are matched in blocks with the clients of their fingerprint, so pairs are made once, by the task that returns them.
    """
    window = int(hours * 3_600_000_000)
    own_times = _client_visits(visits, clients)
    own = visits.join(clients.select("client_id"), "client_id", "left_semi").select(
        F.col("client_id").alias("unified_client_id"), F.lit(1).cast("bigint").alias("times"), *carried)
    extra = [c for c in dict.fromkeys(("id", *carried))]
    columns = visits.select(*[F.col(c).alias(f"_{c}") for c in extra], "ip_address", "user_agent", "client_id", "timestamp")
    seen = stitching.fingerprinted(columns.where("_id is not null"), *[f"_{c}" for c in extra])
    ids = _repeated_ids(visits)
    if ids is not None:
        counted = _matched_by_id(seen.withColumnRenamed("_id", "id"), ids, own_times, window)
        own = own.unionByName(counted.join(visits.select(*extra), "id").select("unified_client_id", "times", *carried))
        seen = seen.join(ids.withColumnRenamed("id", "_id"), "_id", "left_anti")
    types = ", ".join(f"`_{c}` {visits.schema[c].dataType.simpleString()}" for c in carried)
    payload = [f"_{c}" for c in carried]
    foreign = stitching.Meeting(seen.select("fp", "owner", "us", *payload), own_times, window).related(
        f"unified_client_id string, times long, {types}", payload)
    return own.unionByName(foreign.withColumnsRenamed(dict(zip(payload, carried))))


def stitched_funnel(
    visits: DataFrame, events: DataFrame, first_target: str = "/sign-up", last_target: str = "/company-info",
    hours: float = 24,
) -> DataFrame:
    """Sign-up to completion with the history recovered by identity stitching.

    Visits and their events are matched as in ``stitch_visits``; texts are put together by the task that matches them,
    so a pair of client and visit is no row.
    """
    window = int(hours * 3_600_000_000)
    done = completers(visits, first_target, last_target)
    tags = ("utm_source", "utm_medium", "utm_campaign", "d", "tid")
    at_first, at_last = (hits_target(F.col("path"), p) for p in (first_target, last_target))
    look = F.concat(F.lit("v"), F.to_json(F.struct(
        F.concat(F.col("path"), F.lit(" ("), F.col("page_domain"), F.lit(")")).alias("item"), "referrer", "source", "medium",
        F.when(at_first, url.render_params("page_url", drop=(*tags, "ref"))).alias("p1"),
        F.when(at_last, url.render_params("page_url", drop=tags)).alias("p2"))))
    shown = visits.withColumns({"place": F.lit(0), "at": micros(F.col("timestamp")), "oid": F.col("id"), "look": look})
    item = ("place", "at", "oid", "look")
    # An event belongs to the pages its path names, to both if it names both.
    near = lambda target, place: F.when(F.col("path").rlike(f"(?i)^.*{target}.*"), F.lit(place))
    sent = events.where(F.col("event_type").isin("form_submit", "custom", "click", "form_start")
                        & F.col("event_data").isNotNull() & F.col("visit_id").isNotNull()).select(
        F.col("visit_id").alias("id"), F.explode(F.array_compact(F.array(near(first_target, 1), near(last_target, 2)))).alias("place"),
        micros(F.col("timestamp")).alias("at"), F.col("id").alias("oid"), F.concat(F.lit("e"), F.col("event_data")).alias("look"))

    own_times = _client_visits(visits, done)
    own = shown.join(done, "client_id", "left_semi").select(F.col("client_id").alias("client"), F.lit(1).alias("n"), "id", *item)
    seen = stitching.fingerprinted(shown.where(F.col("id").isNotNull()), "id", *item)
    ids = _repeated_ids(visits)
    if ids is not None:
        counted = _matched_by_id(seen, ids, own_times, window).withColumnsRenamed({"unified_client_id": "client", "times": "n"})
        own = own.unionByName(counted.join(shown.select("id", *item), "id").select("client", "n", "id", *item))
        seen = seen.join(ids, "id", "left_anti")
    linked = seen.select("fp", "owner", "us", "id").join(sent, "id").drop("id")
    told = stitching.Meeting(seen.drop("id").unionByName(linked), own_times, window).stories(
        done.select(F.col("client_id").alias("client"), micros(F.col("started_at")).alias("at"),
                    micros(F.col("completed_at")).alias("oid")),
        own.drop("id").unionByName(own.select("client", "n", "id").join(sent, "id").drop("id")))
    moment = lambda c: F.timestamp_micros(c)
    out = told.withColumns({
        "_p1": F.sort_array("p1"), "_p2": F.sort_array("p2"), "started_at": moment("started_us"),
        "completed_at": moment("completed_us"), "first_at": moment("first_us"),
        **{f"_{c}": F.concat(F.lit("["), F.col(c), F.lit("]")) for c in ("f1", "f2")}})

    params = lambda c: F.when(F.size(c) > 0, F.array_join(c, " || "))
    return out.select(
        F.col("unified_client_id").alias("unique_user_key"), F.col("path").alias("full_journey_path"),
        F.coalesce(params("_p1"), F.lit("No URL params")).alias("signup_page_params"),
        F.coalesce("_f1", F.lit("No form data")).alias("raw_signup_events"),
        first_email(F.col("_f1")).alias("potentially_extracted_email"),
        F.coalesce(params("_p2"), F.lit("No URL params")).alias("company_info_url_params"),
        F.coalesce("_f2", F.lit("No form data")).alias("company_info_form_data"),
        F.col("referrer").alias("original_referrer"), F.col("source").alias("original_utm_source"),
        F.col("medium").alias("original_utm_medium"), F.col("first_at").alias("user_acquired_at"),
        F.col("started_at").alias("signup_visited_at"), F.col("completed_at").alias("company_info_completed_at"),
        F.round(seconds_between(F.col("completed_at"), F.col("first_at")), 6).alias("total_seconds"),
        F.round(seconds_between(F.col("completed_at"), F.col("started_at")), 6).alias("funnel_seconds"))
