"""User keys, session ids and the two session boundary rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from webjourney.config import CONTINUITY_EVENT_TYPES, ENTRY_EVENT_TYPES
from webjourney.functions.url import is_internal

Families = Mapping[str, Sequence[str]]


def uid() -> Column:
    """Visitor id of the dashboard queries."""
    return F.coalesce(F.col("client_id"), F.col("session_id"))


def user_key(
    client_id: Column | None = None, ip: Column | None = None, user_agent: Column | None = None
) -> Column:
    """Visitor id of sessionization: the client, else address and user agent."""
    client_id = F.col("client_id") if client_id is None else client_id
    ip = F.col("ip_address") if ip is None else ip
    user_agent = F.col("user_agent") if user_agent is None else user_agent
    return F.when(
        client_id.isNotNull() & (client_id != ""), F.concat(F.lit("cid:"), client_id)
    ).otherwise(F.concat(
        F.lit("ipua:"), F.coalesce(ip, F.lit("")), F.lit(":"),
        F.coalesce(user_agent, F.lit(""))))


def session_id(key: Column, seq: Column) -> Column:
    """Deterministic id of the n-th journey of a user."""
    return F.substring(F.sha2(F.concat(key, F.lit(":journey:"), seq.cast("string")), 256), 1, 32)


def _present(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def _outside_signal(
    referrer_domain: Column, source: Column, medium: Column, campaign: Column,
    families: Families, silent: Column,
) -> Column:
    """New journey by referrer, source, medium or campaign; ``silent`` when there is no signal."""
    return (
        F.when(_present(referrer_domain), ~is_internal(referrer_domain, families))
        .when(_present(source), ~is_internal(source, families))
        .when(_present(medium) | _present(campaign), F.lit(True))
        .otherwise(silent)
    )


def rebuild_boundary(
    event_type: Column, referrer_domain: Column, source: Column, medium: Column, campaign: Column,
    gap_seconds: Column, families: Families, inactivity_seconds: int = 1800,
) -> Column:
    """Boundary of a rebuilt journey; ``gap_seconds`` is NULL on a user's first record.

    ``event_type`` is NULL for visits, which are always page entries.
    """
    silent = gap_seconds > inactivity_seconds
    entry = event_type.isNull() | event_type.isin(*ENTRY_EVENT_TYPES)
    return (
        F.when(gap_seconds.isNull(), F.lit(True))
        .when(~entry, F.lit(False))
        .otherwise(_outside_signal(referrer_domain, source, medium, campaign, families, silent))
    )


def live_boundary(
    event_type: Column, referrer_domain: Column, source: Column, medium: Column, campaign: Column,
    families: Families,
) -> Column:
    """External entry on arrival; without any signal the visitor starts a new journey."""
    return F.when(
        F.coalesce(event_type.isin(*CONTINUITY_EVENT_TYPES), F.lit(False)), F.lit(False)
    ).otherwise(_outside_signal(referrer_domain, source, medium, campaign, families, F.lit(True)))
