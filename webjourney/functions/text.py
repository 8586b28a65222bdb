"""String helpers: cleaning, garbage test, masking, emails (Column expressions)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from webjourney.config import SENSITIVE_FIELD_TOKENS

# Control characters, and the two sets of recognizable characters.
CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
_SPACES = r"\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
RECOGNIZABLE = "[a-zA-Z0-9" + _SPACES + r"""@._\-+(),:;!?'"<>/\\&%$#]+"""
RECOGNIZABLE_NARROW = "[a-zA-Z0-9" + _SPACES + r"""@._\-+(),:;!?'"]+"""
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it.

    Catalyst copies an expression to every place that refers to it when it merges projections
    and pushes filters; a lambda variable stays one evaluation.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def or_else(c: Column, default: str) -> Column:
    """Default for missing values; an empty string counts as missing."""
    return F.when(c.isNull() | (c == ""), F.lit(default)).otherwise(c)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def drop_control_chars(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL_CHARS, "")


def _too_unreadable(clean: Column, recognizable: str) -> Column:
    readable = F.length(clean) - F.length(F.regexp_replace(clean, recognizable, ""))
    return (readable / F.length(clean) < 0.3) | ~clean.rlike("[a-zA-Z0-9]")


def is_garbage(c: Column) -> Column:
    """Under 30 % readable characters, or nothing alphanumeric. NULL and '' are not garbage."""
    bad = let(drop_control_chars(c), lambda clean: (F.length(clean) == 0) | _too_unreadable(clean, RECOGNIZABLE))
    return F.when(c.isNull() | (c == ""), F.lit(False)).otherwise(bad)


def is_sensitive_field(name: Column, field_type: Column | None = None) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    hit = low.rlike("|".join(SENSITIVE_FIELD_TOKENS))
    if field_type is not None:
        hit = hit | (F.lower(F.coalesce(field_type, F.lit(""))) == "password")
    return hit


def mask_value(
    value: Column, name: Column, field_type: Column | None = None, max_len: int | None = None
) -> Column:
    """Value safe to keep from a form field: NULL when masked or rejected, else cleaned; cut where ``max_len`` is given."""
    def safe(trimmed: Column) -> Column:
        blob = (F.length(trimmed) > 100) & trimmed.rlike(r"^[A-Za-z0-9+/=]{100,}$")
        token = trimmed.startswith("eyJ") & (F.size(F.split(trimmed, r"\.")) == 3)

        def readable(clean: Column) -> Column:
            noise = (F.length(clean) > 0) & _too_unreadable(clean, RECOGNIZABLE_NARROW)
            return F.when(~noise, clean if max_len is None else F.substring(clean, 1, max_len))

        return F.when(~(blob | token), let(drop_control_chars(trimmed), readable))

    return F.when(
        ~is_sensitive_field(name, field_type), let(strip(F.coalesce(value, F.lit(""))), safe))


def mask_outcome(value: Column, name: Column, field_type: Column | None = None) -> Column:
    """Which rule applied: ``masked``, ``rejected`` or ``kept``."""
    kept = mask_value(value, name, field_type)
    return (
        F.when(is_sensitive_field(name, field_type), F.lit("masked"))
        .when(kept.isNull(), F.lit("rejected"))
        .otherwise(F.lit("kept"))
    )


def first_email(c: Column) -> Column:
    """First email address in a text, NULL if there is none."""
    return F.when(c.contains("@"), blank_to_null(F.regexp_extract(c, f"({EMAIL})", 1)))


def profile_from_text(c: Column) -> tuple[Column, Column]:
    """(email, name) out of flat ``email: …``/``name: …`` text."""
    email = blank_to_null(F.regexp_extract(
        c, r"""(?i)["']?email["']?\s*[:=]\s*["']?([^"',|\s]+@[^"',|\s]+)["']?""", 1))
    raw = strip(F.regexp_extract(c, r"""(?i)["']?name["']?\s*[:=]\s*["']?([^"'|]+)["']?""", 1))
    placeholder = F.lower(raw).isin("null", "undefined", "unknown", "", "[object object]")
    usable = c.isNotNull() & (c != "") & (c != "No info shared")
    return F.when(usable, email), F.when(usable & ~placeholder, raw)
