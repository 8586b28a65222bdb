"""Data quality jobs: garbage and masking, payload flattening, hit checks, request rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webjourney.config import DANGEROUS_KEYS, FLATTEN_SKIP_TOKENS, INJECTION_PATTERNS
from webjourney.functions import text, url
from webjourney.functions.text import let
from webjourney.functions.jsontext import object_text, quoted, raw_text, set_fields, typed_entries
from webjourney.functions.predicates import micros
from webjourney.operators.ordered import Timeline


def text_quality(df: DataFrame, column: str = "text") -> DataFrame:
    """Add ``is_garbage`` and the text without control characters."""
    c = F.col(column)
    return df.withColumn("is_garbage", text.is_garbage(c)).withColumn("clean_text", text.drop_control_chars(c))


def clean_form_events(events: DataFrame) -> DataFrame:
    """Form payloads with garbage values removed and control characters dropped.

    Adds ``changed``; ``event_data`` is rewritten only where something changed.
    """
    data = F.col("event_data")
    form_values = F.get_json_object(data, "$.form_values")
    cleaned = lambda c: text.strip(text.drop_control_chars(c))

    def fixed(e: Column) -> Column:
        is_text, kept = e["kind"] == "STRING", text.blank_to_null(cleaned(e["text"]))
        value = let(F.struct(F.when(is_text & ~text.is_garbage(e["text"]), kept).alias("v")), lambda x: F.struct(
            e["key"].alias("key"),
            F.when(~is_text, F.nullif(raw_text(e), F.lit("null"))).when(x["v"].isNotNull(), quoted(x["v"])).alias("raw"),
            F.when(is_text, ~x["v"].eqNullSafe(e["text"])).otherwise(e["kind"] == "VOID").alias("changed")))
        return value

    values = let(typed_entries(form_values), lambda entries: F.transform(entries, fixed))
    has_values = F.coalesce(form_values.startswith("{"), F.lit(False))
    field = F.filter(typed_entries(data), lambda e: (e["key"] == "field_value") & (e["kind"] == "STRING"))
    old = F.get(field, F.lit(0))["text"]
    new = F.when(~text.is_garbage(old), cleaned(old))

    df = events.where(F.col("event_type").isin("form_submit", "form_input") & data.isNotNull())
    df = df.withColumn("_values", F.when(has_values, values)).withColumn(
        "_old", F.when(~has_values, old)).withColumn("_new", F.when(~has_values, new))
    dirty = F.coalesce(F.exists("_values", lambda e: e["changed"]), F.lit(False))
    touched = F.col("_old").isNotNull() & ~F.col("_new").eqNullSafe(F.col("_old"))
    kept = F.filter("_values", lambda e: e["raw"].isNotNull())
    return df.withColumn("changed", dirty | touched).withColumn(
        "event_data",
        F.when(dirty, set_fields(data, {"form_values": object_text(kept)}))
        .when(touched, set_fields(data, {"field_value": quoted(F.col("_new"))}))
        .otherwise(data)).drop("_values", "_old", "_new")


def clean_form_totals(events: DataFrame) -> DataFrame:
    """Dry run of :func:`clean_form_events`."""
    return clean_form_events(events).agg(
        F.count(F.when(F.col("changed"), 1)).alias("cleaned"),
        F.count(F.when(~F.col("changed"), 1)).alias("unchanged"), F.count("*").alias("total"))


def mask_texts(df: DataFrame, value: str, name: str, max_len: int | None = None) -> DataFrame:
    """Add the masked value and which rule applied."""
    v, n = F.col(value), F.col(name)
    return df.withColumn("masked_value", text.mask_value(v, n, max_len=max_len)).withColumn(
        "outcome", text.mask_outcome(v, n))


def flatten_payload(payload: Column, max_parts: int = 4, max_keys: int = 50) -> Column:
    """``array<struct<key,value>>`` of the leaves of a nested payload under dotted keys.

    Depth first in payload order, at most ``max_keys`` leaves and ``max_parts`` key parts;
    internal keys are skipped with everything below them, texts are sanitized.
    """
    skip = "|".join(FLATTEN_SKIP_TOKENS)
    empty = F.array().cast("array<struct<key:string,value:string>>")

    def leaf(key: Column, value: Column) -> Column:
        return F.array(F.struct(key.alias("key"), value.alias("value")))

    def items(body: Column) -> Column:
        """Entries of an object, or of an array under its index numbers."""
        as_array = F.zip_with(
            F.from_json(body, "array<string>"), F.from_json(body, "array<variant>"),
            lambda v, k: F.struct(v.alias("text"), F.coalesce(F.schema_of_variant(k), F.lit("VOID")).alias("kind")))
        numbered = F.transform(as_array, lambda e, i: F.struct(
            i.cast("string").alias("key"), e["text"].alias("text"), e["kind"].alias("kind")))
        return F.when(body.startswith("["), numbered).otherwise(typed_entries(body))

    def level(body: Column, prefix: Column | None, parts: int) -> Column:
        def entry(e: Column) -> Column:
            key = e["key"] if prefix is None else F.concat(prefix, F.lit("."), e["key"])
            nested = e["kind"].rlike("^(OBJECT|ARRAY)")
            out = F.when(F.lower(key).rlike(skip) | (e["kind"] == "VOID"), empty).when(
                e["kind"] == "STRING", F.filter(leaf(key, text.mask_value(e["text"], key)), lambda x: x["value"].isNotNull()))
            if parts < max_parts:
                out = out.when(nested, level(e["text"], key, parts + 1))
            return out.otherwise(F.when(nested, empty).otherwise(leaf(key, e["text"])))

        return F.flatten(F.transform(items(body), entry))

    return F.slice(level(payload, None, 1), 1, max_keys)


def flatten_events(events: DataFrame, column: str = "event_data") -> DataFrame:
    """One row per leaf: ``id, position, key, value``."""
    df = events.where(F.col(column).startswith("{")).select("id", flatten_payload(F.col(column)).alias("_f"))
    return df.select("id", F.posexplode("_f").alias("position", "_e")).select(
        "id", "position", F.col("_e.key").alias("key"), F.col("_e.value").alias("value"))


# --- hit checks -----------------------------------------------------------------------

_LABEL = "[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"({_OCTET}\.){{3}}{_OCTET}"
_H = "[0-9a-fA-F]{1,4}"


def _ipv6_pattern() -> str:
    forms = [f"({_H}:){{7}}{_H}", f"({_H}:){{6}}{_V4}"]
    # A double colon stands for one or more groups.
    for before in range(0, 8):
        head = "" if before == 0 else f"{_H}(:{_H}){{{before - 1}}}"
        after = 7 - before
        tail = "" if after == 0 else f"({_H}(:{_H}){{0,{after - 1}}})?"
        forms.append(f"{head}::{tail}")
        if after >= 2:
            forms.append(f"{head}::({_H}:){{0,{after - 2}}}{_V4}")
    return "|".join(forms)


IP_PATTERN = f"^({_V4}|{_ipv6_pattern()})$"


def is_valid_domain(c: Column, max_length: int | None = 253) -> Column:
    bare = F.substring_index(c, ":", 1)
    ok = bare.rlike(rf"^({_LABEL}\.)+{_LABEL}$") | (bare == "localhost")
    return F.coalesce(ok if max_length is None else ok & (F.length(c) <= max_length), F.lit(False))


def is_valid_url(c: Column, max_length: int = 2000) -> Column:
    ok = (F.length(c) <= max_length) & url.scheme(c).isin("http", "https") & is_valid_domain(
        url.authority(c), None)
    return F.coalesce(ok, F.lit(False))


def is_valid_tracking_id(c: Column, max_length: int = 100) -> Column:
    return F.coalesce((F.length(c) <= max_length) & c.rlike(r"^[a-zA-Z0-9\-_.]+$"), F.lit(False))


def is_valid_user_agent(c: Column, max_length: int = 1000) -> Column:
    ok = (c != "") & (F.length(c) <= max_length) & ~F.lower(c).rlike("|".join(INJECTION_PATTERNS))
    return F.coalesce(ok, F.lit(False))


def is_valid_ip(c: Column) -> Column:
    return F.coalesce(c.rlike(IP_PATTERN), F.lit(False))


def is_valid_payload(c: Column, max_bytes: int = 10_000) -> Column:
    keys = F.json_object_keys(c)
    bad = F.exists(keys, lambda k: F.lower(k).isin(*DANGEROUS_KEYS))
    return F.coalesce(keys.isNotNull() & (F.octet_length(c) <= max_bytes) & ~bad, F.lit(False))


def sanitize(c: Column, max_length: int | None = None, allowed: str | None = None) -> Column:
    """Without control characters (and characters outside ``allowed``), cut, trimmed."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    if allowed:
        out = F.regexp_replace(out, f"[^{allowed}]", "")
    if max_length:
        out = F.substring(out, 1, max_length)
    return text.strip(out)


def clean_params(page_url: str, key_length: int | None = None, value_length: int | None = None) -> Column:
    """Sanitized first query parameters as ``array<struct<k,v>>``; empty keys and values drop out.

    ``page_url`` is a column name or SQL text. Keys and values are whole unless lengths are given.
    """
    firsts = F.transform(F.map_entries(url.query_map(page_url)), lambda e: F.struct(
        sanitize(e["key"], key_length, "a-zA-Z0-9_-").alias("k"),
        sanitize(F.get(e["value"], F.lit(0)), value_length).alias("v")))
    return F.filter(firsts, lambda e: (e["k"] != "") & (e["v"] != ""))


def check_hits(df: DataFrame) -> DataFrame:
    """Add ``reject_reason`` (first failed check, NULL when accepted).

    Tracking id and payload are optional; the others must be present and valid.
    """
    given = lambda c: F.col(c).isNotNull()
    checks: Sequence[tuple[str, Column]] = (
        ("url", is_valid_url(F.col("page_url"))),
        ("tracking_id", ~given("tracking_id") | is_valid_tracking_id(F.col("tracking_id"))),
        ("user_agent", is_valid_user_agent(F.col("user_agent"))),
        ("ip_address", is_valid_ip(F.col("ip_address"))),
        ("page_domain", is_valid_domain(F.col("page_domain"))),
        ("event_data", ~given("event_data") | is_valid_payload(F.col("event_data"))),
    )
    reason = F
    for name, ok in checks:
        reason = reason.when(~ok, F.lit(name))
    return df.withColumn("reject_reason", reason)


def split_hits(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason)."""
    checked = check_hits(df)
    return (
        checked.where(F.col("reject_reason").isNull()).drop("reject_reason"),
        checked.where(F.col("reject_reason").isNotNull()))


# --- request rate ---------------------------------------------------------------------

def rate_flags(
    hits: DataFrame, action: str = "event_type", window_seconds: float = 60, limit: int = 1000,
) -> DataFrame:
    """Earlier requests of the same address and action in the trailing window, flagged at the limit.

    The count is the row's position minus the number of rows before the window, both from one
    running count over rows and window starts; no frame slides, so a dense key costs the same
    per row as a sparse one.
    """
    keys = ["ip_address", action]
    rows = hits.select("id", *keys, F.col("timestamp").alias("at"), F.lit(1).alias("rank"))
    starts = hits.select("id", *keys, F.timestamp_micros(
        micros(F.col("timestamp")) - int(window_seconds * 1_000_000)).alias("at"), F.lit(0).alias("rank"))
    t = Timeline(rows.unionByName(starts), keys, ["at", "rank", "id"])
    t.running_sum("n", F.col("rank").cast("long"))
    is_row = F.col("rank") == 1
    out = t.done().groupBy("id", *keys).agg(
        F.max(F.when(is_row, F.col("at"))).alias("timestamp"),
        (F.max(F.when(is_row, F.col("n"))) - 1 - F.max(F.when(~is_row, F.col("n")))).alias("earlier"))
    return out.withColumn("limited", F.col("earlier") >= limit)
