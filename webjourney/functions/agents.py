"""Crawler classification and visitor categories from the user agent."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webjourney.config import (
    BROWSER_TOKENS, CRAWLERS, GENERIC_BOT_TOKENS, TOOL_TOKENS, Crawler,
)


def _hit(ua: str, pattern: str) -> str:
    # Plain names need no regex engine; a custom pattern may be a real regex.
    if re.fullmatch(r"[\w\- ]+", pattern):
        return f"contains(lower({ua}), '{pattern.lower()}')"
    return f"{ua} rlike r'(?i){pattern}'"


def _any(ua: str, tokens: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({ua}), '{t}')" for t in tokens) + ")"


def crawler_sql(ua: str = "user_agent", patterns: Sequence[Crawler] = CRAWLERS) -> dict[str, str]:
    """SQL text of the classification fields of a user agent.

    One CASE finds the number of the first rule that matches; the fields are array lookups by
    that number, so everything stays in one generated stage without a shuffle.
    """
    outcomes = [(False, None, 0.0, "unknown", None)]
    cases = [f"WHEN {ua} IS NULL OR {ua} = '' THEN 1"]
    browsers = " + ".join(f"int(contains(lower({ua}), '{t}'))" for t in BROWSER_TOKENS)
    rules = [(_hit(ua, c.pattern), (True, c.name, c.confidence, "pattern_match", c.company)) for c in patterns]
    rules += [
        (_any(ua, GENERIC_BOT_TOKENS), (True, "Unknown Bot", 0.60, "general_pattern", None)),
        (_any(ua, TOOL_TOKENS), (True, "Suspicious Bot", 0.50, "suspicious_pattern", None)),
        (f"length({ua}) < 10", (True, "Empty User Agent", 0.40, "empty_user_agent", None)),
        (f"{browsers} >= 2", (False, None, 0.80, "browser_pattern", None)),
    ]
    for cond, outcome in rules:
        outcomes.append(outcome)
        cases.append(f"WHEN {cond} THEN {len(outcomes)}")
    outcomes.append((False, None, 0.30, "unknown", None))
    rule = f"CASE {' '.join(cases)} ELSE {len(outcomes)} END"

    def text(v) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "\\'") + "'"

    kinds = (
        ("is_crawler", lambda v: str(v).lower()), ("crawler_name", text),
        ("confidence", lambda v: f"double({v})"), ("detection_method", text), ("company", text))
    return {
        name: f"element_at(array({', '.join(show(o[i]) for o in outcomes)}), {rule})"
        for i, (name, show) in enumerate(kinds)
    }


def classify(
    df: DataFrame, ua: str = "user_agent", patterns: Sequence[Crawler] = CRAWLERS
) -> DataFrame:
    """Add is_crawler, crawler_name, confidence, detection_method, company and is_ai_crawler."""
    return df.selectExpr(
        "*", *[f"{e} AS {n}" for n, e in crawler_sql(ua, patterns).items()]
    ).withColumn("is_ai_crawler", F.expr("is_crawler AND confidence > 0.7"))


def visitor_category(ua: Column) -> Column:
    """Plain substring tests in order; 'ai' may sit inside another word."""
    low = F.lower(ua)
    return (
        F.when(low.contains("gpt") | low.contains("openai"), "chatgpt")
        .when(low.contains("claude") | low.contains("anthropic"), "claude")
        .when(low.contains("perplexity"), "perplexity")
        .when(low.contains("google") & low.contains("ai"), "google_ai")
        .when(low.contains("bot"), "bot")
        .when(low.contains("mobile"), "mobile_human")
        .when(low.contains("mozilla") | low.contains("chrome") | low.contains("safari"), "desktop_human")
        .otherwise("other")
    )
