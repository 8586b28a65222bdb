"""Journey and lead summaries of clients with real form submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webjourney.functions import forms, url
from webjourney.functions.predicates import (
    Moment, contains_all, has_prefix, in_range, moment, same_text,
)
from webjourney.functions.text import or_else, strip
from webjourney.operators.ordered import Timeline


def _order() -> Column:
    return F.struct("timestamp", "id")


def real_forms(events: DataFrame, since: Moment | None = None, after: Moment | None = None) -> DataFrame:
    """Real submissions of known clients: from ``since`` on, or later than ``after``."""
    df = events.where((F.col("event_type") == "form_submit") & (F.col("client_id") != ""))
    df = in_range(df, since)
    if after is not None:
        df = df.where(F.col("timestamp") > moment(after))
    return df.where(forms.is_real_form(F.col("event_data")))


def form_fills(events: DataFrame, since: Moment | None = None) -> DataFrame:
    """One row per real submission."""
    data = F.col("event_data")
    return real_forms(events, since).select(
        "client_id", F.col("id").alias("visit_event_id"), "timestamp", "page_url", "path",
        forms.values_json(data).alias("form_values"), forms.filled_fields(data).alias("filled_fields"),
        F.get_json_object(data, "$.id").alias("form_id"), F.get_json_object(data, "$.action").alias("form_action"))


def _form_side(real: DataFrame, profile: str) -> DataFrame:
    """Per client the first form, last page, counts and the contact data."""
    order = _order()
    rows = real.withColumn("_p", forms.profile(F.col("event_data")))
    email = F.col("_p.email")
    latest = lambda cond: F.max_by("_p", F.when(cond, order))
    agg = rows.groupBy("client_id").agg(
        F.count("*").alias("f_count"), F.min("timestamp").alias("f_first"), F.max("timestamp").alias("f_last"),
        F.min_by(F.struct("timestamp", "page_url", "path", "event_data", "_p"), order).alias("first_form"),
        F.max_by("page_url", order).alias("last_form_page"),
        latest(forms.is_work_email(email)).alias("_work"), latest(email.isNotNull()).alias("_any"))
    if profile == "first":
        return agg.withColumn("email", F.col("first_form._p.email")).withColumn(
            "name", F.col("first_form._p.name")).drop("_work", "_any")
    return agg.withColumn("email", F.coalesce("_work.email", "_any.email")).withColumn(
        "name", F.coalesce("_work.name", "_any.name")).drop("_work", "_any")


def _visit_side(visits: DataFrame, clients: DataFrame) -> DataFrame:
    """Per client the first and last visit, their number and the path text."""
    order = _order()
    v = visits.where(F.col("client_id").isNotNull()).join(clients, "client_id", "left_semi")
    rows = v.select("client_id", "timestamp", "id", "page_url", "source", "medium", "campaign", "referrer",
                    strip(F.coalesce("path", F.lit(""))).alias("p"))
    t = Timeline(rows, ["client_id"], ["timestamp", "id"]).previous("_prev", F.struct("p"))
    moved = F.col("_prev").isNull() | (F.col("_prev.p") != F.col("p"))
    return t.summary(
        F.when(moved, or_else(F.col("p"), "(page)")), " → ", "path_sequence", [
            F.count("*").alias("v_count"), F.min("timestamp").alias("v_first"), F.max("timestamp").alias("v_last"),
            F.min_by(F.struct("page_url", "source", "medium", "campaign", "referrer"), order).alias("first_visit"),
            F.max_by("page_url", order).alias("last_visit_page")])


def client_summaries(
    visits: DataFrame, events: DataFrame, profile: str = "best", since: Moment | None = None,
    clients: DataFrame | None = None,
) -> DataFrame:
    """One wide row per client with a real form; journeys and leads are projections of it.

    ``profile``: ``best`` takes the newest work address, else the newest one; ``first`` takes the
    first form's. ``since`` bounds the history; ``clients`` limits the rebuild.
    """
    real = real_forms(events, since)
    if clients is not None:
        real = real.join(clients, "client_id", "left_semi")
    form_side = _form_side(real, profile)
    visit_side = _visit_side(in_range(visits, since), real.select("client_id"))
    return form_side.join(visit_side, "client_id", "left")


def journeys(wide: DataFrame) -> DataFrame:
    first = F.col("first_visit")
    return wide.select(
        "client_id", F.least("v_first", "f_first").alias("first_seen"),
        F.greatest("v_last", "f_last").alias("last_seen"),
        F.coalesce("v_count", F.lit(0)).alias("visit_count"),
        F.when(first.isNotNull(), first["page_url"]).otherwise(F.col("first_form.page_url")).alias("entry_page"),
        F.when(first.isNotNull(), F.col("last_visit_page")).otherwise(F.col("last_form_page")).alias("exit_page"),
        "path_sequence", "email", "name", F.lit(1).alias("has_captured_data"),
        F.col("f_count").alias("form_fill_count"), first["source"].alias("source"),
        first["medium"].alias("medium"), first["campaign"].alias("campaign"))


def leads(wide: DataFrame) -> DataFrame:
    first, form = F.col("first_visit"), F.col("first_form")
    return wide.select(
        "client_id", "email", "name", form["timestamp"].alias("captured_at"),
        form["page_url"].alias("captured_page"), form["path"].alias("captured_path"),
        forms.render_values(form["event_data"]).alias("form_data_shared"),
        forms.values_object(form["event_data"]).alias("captured_data"),
        first["source"].alias("source"), first["medium"].alias("medium"), first["campaign"].alias("campaign"),
        first["referrer"].alias("first_referrer"),
        url.referrer_domain(first["referrer"]).alias("first_referrer_domain"),
        F.least("v_first", "f_first").alias("first_seen"), F.greatest("v_last", "f_last").alias("last_seen"))


# --- keeping summaries up to date -----------------------------------------------------

def changed_clients(events: DataFrame, after: Moment) -> DataFrame:
    """Clients with a real form later than the watermark."""
    return real_forms(events, after=after).select("client_id").distinct()


def replace_clients(current: DataFrame, rebuilt: DataFrame, changed: DataFrame) -> DataFrame:
    """Summary rows of the changed clients replaced; a changed client without forms loses its rows."""
    return current.join(changed, "client_id", "left_anti").unionByName(rebuilt)


def refresh(
    visits: DataFrame, events: DataFrame, current: dict[str, DataFrame], clients: DataFrame,
) -> dict[str, DataFrame]:
    """Rebuild journeys, leads and form fills of the given clients on their whole history."""
    wide = client_summaries(visits, events, clients=clients)
    fills = form_fills(events).join(clients, "client_id", "left_semi")
    return {
        "journeys": replace_clients(current["journeys"], journeys(wide), clients),
        "leads": replace_clients(current["leads"], leads(wide), clients),
        "form_fills": replace_clients(current["form_fills"], fills, clients),
    }


def unreconciled(journey_rows: DataFrame, lead_rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Clients with captured data and no lead: all of them, or the first ``limit`` by id."""
    missing = journey_rows.where(F.col("has_captured_data") == 1).join(
        lead_rows.select("client_id"), "client_id", "left_anti").select("client_id")
    return missing if limit is None else missing.orderBy("client_id").limit(limit)


# --- listings -------------------------------------------------------------------------

def _with_defaults(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("source", or_else(F.col("source"), "direct"))
        .withColumn("medium", or_else(F.col("medium"), "none"))
        .withColumn("campaign", or_else(F.col("campaign"), "none")))


def list_journeys(
    journey_rows: DataFrame, target_path: str | None = None, captured_only: bool = False,
    start: Moment | None = None, end: Moment | None = None,
) -> DataFrame:
    df = in_range(journey_rows, start, end, "last_seen")
    if target_path:
        df = df.where(contains_all(F.col("path_sequence"), target_path))
    if captured_only:
        df = df.where(F.col("has_captured_data") == 1)
    return _with_defaults(df).select(
        "client_id", "visit_count", F.coalesce("form_fill_count", F.lit(0)).alias("form_fill_count"),
        "first_seen", "last_seen", "entry_page", "exit_page", "source", "medium", "campaign",
        (F.coalesce("has_captured_data", F.lit(0)) != 0).alias("has_captured_data"), "email", "name",
        "path_sequence").orderBy(F.desc("last_seen"), "client_id")


def list_leads(
    lead_rows: DataFrame, captured_path: str | None = None, source: str | None = None,
    medium: str | None = None, campaign: str | None = None,
    start: Moment | None = None, end: Moment | None = None,
) -> DataFrame:
    df = in_range(lead_rows, start, end, "last_seen")
    if captured_path:
        df = df.where(has_prefix(F.col("captured_path"), captured_path))
    for c, value in (("source", source), ("medium", medium), ("campaign", campaign)):
        if value:
            df = df.where(same_text(F.col(c), value))
    return _with_defaults(df).select(
        "client_id", "captured_at", "captured_page", "captured_path", "email", "name", "source",
        "medium", "campaign", "form_data_shared", "captured_data", "last_seen",
    ).orderBy(F.desc("last_seen"), "client_id").drop("last_seen")


def leads_with_journeys(lead_rows: DataFrame, journey_rows: DataFrame) -> DataFrame:
    return lead_rows.where(F.col("email").isNotNull()).join(
        journey_rows.select("client_id", "path_sequence"), "client_id", "left").select(
        "client_id", "email", "name", "captured_at", "source", "campaign", "path_sequence")


def lead_detail(events: DataFrame, client_id: str | None = None) -> DataFrame:
    """Latest capture per client (any event type containing 'submit'), its URL parameters, and
    how many captures and real forms there are."""
    who = F.col("client_id").isNotNull() if client_id is None else F.col("client_id") == client_id
    captured = events.where(who & F.col("event_type").ilike("%submit%"))
    real = F.when((F.col("event_type") == "form_submit") & forms.is_real_form(F.col("event_data")), _order())
    agg = captured.groupBy("client_id").agg(
        F.count("*").alias("captured_events"), F.count(real).alias("form_fills"),
        F.max_by(F.struct("timestamp", "page_url", "path", "event_data"), _order()).alias("l"),
        F.max_by("event_data", real).alias("_fill"))
    own = forms.values_json(F.col("l.event_data"))
    empty = own.isNull() | own.isin("", "{}", "[]")
    out = agg.select(
        "client_id", "captured_events", "form_fills", F.col("l.timestamp").alias("captured_at"),
        F.col("l.page_url").alias("page_url"), F.col("l.path").alias("path"),
        F.when(empty, forms.values_json(F.col("_fill"))).otherwise(own).alias("form_values"))
    return out.withColumn("url_params", url.render_params("page_url"))


def captured_events(events: DataFrame, client_id: str | None = None) -> DataFrame:
    who = F.col("client_id").isNotNull() if client_id is None else F.col("client_id") == client_id
    return events.where(who & F.col("event_type").ilike("%submit%")).select(
        "client_id", "id", "timestamp", "page_url", "path",
        forms.values_json(F.col("event_data")).alias("form_values"))
