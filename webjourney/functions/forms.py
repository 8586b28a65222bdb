"""Form payload logic: what a real submission is, and what it says about the visitor."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from webjourney.config import (
    MEANINGFUL_FORM_KEYS, NOISE_TOKENS, PERSONAL_MAIL_DOMAINS, SEARCH_FORM_KEYS,
)
from webjourney.functions.text import blank_to_null, let, strip

_MAP = "map<string,string>"


def field(payload: Column, name: str) -> Column:
    """Top-level payload field as text; missing, null and empty text are NULL."""
    return blank_to_null(F.get_json_object(payload, f"$.{name}"))


def values_json(payload: Column) -> Column:
    """JSON text of ``form_values`` if it is non-empty, else of ``values``."""
    return F.coalesce(
        let(F.get_json_object(payload, "$.form_values"),
            lambda f: F.when(~f.isin("", "{}", "[]", "0", "false"), f)),
        F.get_json_object(payload, "$.values"))


def values_object(payload: Column) -> Column:
    """As :func:`values_json`, NULL unless it is a non-empty object."""
    return let(values_json(payload), lambda js: F.when(js.startswith("{") & (js != "{}"), js))


def values_map(payload: Column) -> Column:
    """Form values as an ordered map; nested values stay JSON text."""
    return F.from_json(values_object(payload), _MAP)


def values_entries(payload: Column) -> Column:
    """``array<struct<key,value>>`` of the form values in payload order."""
    return F.map_entries(values_map(payload))


def has_noise(payload: Column) -> Column:
    return payload.rlike("|".join(re.escape(t) for t in NOISE_TOKENS))


def passes_noise_filter(payload: Column) -> Column:
    """Not monitoring noise. A NULL payload does not pass, as in three-valued SQL."""
    return F.coalesce(~has_noise(payload), F.lit(False))


def is_ingest_noise(event_type: Column, payload: Column) -> Column:
    """``form_submit`` payloads dropped on arrival."""
    foreign = F.exists(
        F.map_entries(F.from_json(payload, _MAP)),
        lambda e: F.lower(e["key"]).startswith("payload.")
        | ((F.lower(e["key"]) == "action") & F.coalesce(e["value"] == "page_hit", F.lit(False))))
    return F.coalesce((event_type == "form_submit") & (has_noise(payload) | foreign), F.lit(False))


def _looks_real(payload: Column, entries: Column) -> Column:
    text = lambda e: F.coalesce(e["value"], F.lit("None"))
    long_token = lambda v: (F.length(v) > 200) & v.rlike("^(eyJ|phc_)")
    meaningful = "^(" + "|".join(MEANINGFUL_FORM_KEYS) + ")$|email|name|company"

    noise = payload.rlike("|".join(re.escape(t) for t in NOISE_TOKENS) + r'|\\"data\\":')
    search = F.exists(entries, lambda e: e["key"].isin(*SEARCH_FORM_KEYS))
    only_events = (F.size(entries) == 2) & F.forall(entries, lambda e: e["key"].isin("events", "timestamp"))
    object_events = (F.size(entries) <= 2) & F.exists(
        entries, lambda e: (e["key"] == "events") & text(e).contains("[object Object]"))
    blob = (F.size(entries) == 1) & F.exists(
        entries, lambda e: (e["key"] == "data") & ((F.length(text(e)) > 200) | text(e).startswith("eyJ")))
    all_tokens = F.forall(entries, lambda e: long_token(text(e)))
    named = F.exists(entries, lambda e: F.lower(e["key"]).rlike(meaningful))
    filled = F.coalesce(F.get_json_object(payload, "$.filled_fields").try_cast("double"), F.lit(0.0)) >= 1
    return (
        payload.startswith("{") & (F.size(entries) > 0) & (F.length(payload) <= 5000) & ~noise & ~search
        & ~only_events & ~object_events & ~blob & ~all_tokens & (named | filled))


def is_real_form(payload: Column) -> Column:
    """True for a submission with user-provided data; never NULL."""
    real = let(payload, lambda p: let(values_entries(p), lambda entries: _looks_real(p, entries)))
    return F.coalesce(real, F.lit(False))


def _first(entries: Column, cond) -> Column:
    return F.get(F.filter(entries, cond), F.lit(0))["value"]


def profile(payload: Column) -> Column:
    """``struct<email,name>`` from the first fitting keys, in payload order."""
    filled = F.filter(values_entries(payload), lambda e: strip(e["value"]) != "")
    return let(filled, lambda entries: F.struct(
        strip(_first(entries, lambda e: F.lower(e["key"]).contains("mail") & e["value"].contains("@"))).alias("email"),
        strip(_first(entries, lambda e: F.lower(e["key"]).rlike("name|user|full"))).alias("name")))


def loose_profile(payload: Column) -> Column:
    """``struct<email,name>``: values of the first non-empty keys containing 'email' / 'name'."""
    filled = F.filter(values_entries(payload), lambda e: e["value"] != "")
    return let(filled, lambda entries: F.struct(
        _first(entries, lambda e: F.lower(e["key"]).contains("email")).alias("email"),
        _first(entries, lambda e: F.lower(e["key"]).contains("name")).alias("name")))


def is_work_email(email: Column) -> Column:
    domain = F.lower(F.substring_index(email, "@", -1))
    return F.coalesce(
        email.contains("@") & ~domain.isin("", *PERSONAL_MAIL_DOMAINS), F.lit(False))


def render_values(payload: Column) -> Column:
    """``key: value`` list of the non-empty values, NULL when there is none."""
    filled = F.filter(values_entries(payload), lambda e: e["value"] != "")
    return blank_to_null(F.array_join(
        F.transform(filled, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " | "))


def filled_fields(payload: Column) -> Column:
    """Declared number of filled fields, else the number of values."""
    return F.coalesce(
        F.get_json_object(payload, "$.filled_fields").try_cast("int"),
        F.coalesce(F.size(values_entries(payload)), F.lit(0)))
