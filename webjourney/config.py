"""Fixed values and parameter objects shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Crawler:
    """One named crawler: a case-insensitive pattern over the user agent."""

    name: str
    pattern: str
    confidence: float
    company: str


# Named crawlers, first match wins.
CRAWLERS: tuple[Crawler, ...] = (
    Crawler("GPTBot", "GPTBot", 0.95, "OpenAI"),
    Crawler("ChatGPT-User", "ChatGPT-User", 0.90, "OpenAI"),
    Crawler("OpenAI", "OpenAI", 0.85, "OpenAI"),
    Crawler("ClaudeBot", "ClaudeBot", 0.95, "Anthropic"),
    Crawler("Claude-Web", "Claude-Web", 0.90, "Anthropic"),
    Crawler("Anthropic", "Anthropic", 0.85, "Anthropic"),
    Crawler("Google-Extended", "Google-Extended", 0.95, "Google"),
    Crawler("GoogleBot", "Googlebot", 0.80, "Google"),
    Crawler("PerplexityBot", "PerplexityBot", 0.95, "Perplexity"),
    Crawler("Perplexity", "Perplexity", 0.85, "Perplexity"),
    Crawler("BingBot", "bingbot", 0.80, "Microsoft"),
    Crawler("EdgeGPT", "EdgeGPT", 0.85, "Microsoft"),
    Crawler("CCBot", "CCBot", 0.75, "Common Crawl"),
    Crawler("Bytespider", "Bytespider", 0.70, "ByteDance"),
)

# Unnamed bots, tools and browser tokens.
GENERIC_BOT_TOKENS = ("bot", "crawler", "spider", "scraper", "robot", "crawling")
TOOL_TOKENS = ("python", "curl", "wget", "scrapy", "selenium", "headless", "phantomjs")
BROWSER_TOKENS = ("mozilla", "chrome", "safari", "firefox", "edge", "opera")

# Personal mail domains (anything else is a work address).
PERSONAL_MAIL_DOMAINS = (
    "gmail.com", "googlemail.com",
    "yahoo.com", "yahoo.co.uk", "yahoo.fr", "yahoo.de", "yahoo.in",
    "hotmail.com", "hotmail.co.uk", "hotmail.fr", "hotmail.de",
    "outlook.com", "live.com", "msn.com", "me.com", "icloud.com",
    "qq.com", "163.com", "126.com", "sina.com", "sohu.com",
    "protonmail.com", "proton.me",
    "yandex.com", "yandex.ru", "mail.ru",
    "gmx.com", "gmx.de", "gmx.net", "web.de",
    "aol.com", "jimel.com",
)

# Form keys that mark user-provided data.
MEANINGFUL_FORM_KEYS = (
    "email", "name", "company", "message", "phone", "organization",
    "user_email", "full_name", "company_name", "first_name", "last_name",
    "subject", "comments", "inquiry", "body",
)
# Form keys of search widgets.
SEARCH_FORM_KEYS = (
    "query", "search", "page_size", "group_size", "search_type", "score_threshold",
    "highlight_options", "filters.must_not", "extend_results",
)
# Payload tokens of performance monitoring noise.
NOISE_TOKENS = ("timingsV2", "memory.totalJSHeapSize", "eventType")

# Field-name fragments whose values are masked.
SENSITIVE_FIELD_TOKENS = (
    "password", "pass", "pwd", "ssn", "social", "credit", "card", "cc", "cvc", "cvv",
    "otp", "token", "secret", "api_key", "apikey", "recaptcha", "cvn", "card_number", "cvv2",
)
# Payload keys skipped when a nested payload is flattened.
FLATTEN_SKIP_TOKENS = (
    "phc_", "distinct_id", "anonymous", "token", "uuid", "session_id",
    "timestamp", "version", "api_key", "device_id",
)
# Host and path fragments of analytics traffic. Site-specific hosts are passed in.
NOISE_HOST_TOKENS = (
    "posthog", "segment", "analytics", "google-analytics", "googletagmanager",
    "amplitude", "mixpanel", "hotjar", "fullstory", "heap", "intercom", "pendo", "logrocket",
    "ghost", "reo.dev", "api.reo.dev", "twitter.com", "ads.linkedin", "cloudflareinsights",
)
NOISE_PATH_TOKENS = (
    "/analytics/", "/tracking/", "/telemetry/", "/flags/", "/decide/", "/ghost/event", "/adsct",
)
# Two-part public suffixes.
TWO_PART_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "co.nz")

# User-agent fragments and payload keys rejected by the hit quality checks.
INJECTION_PATTERNS = (
    "<script", "javascript:", "data:", "vbscript:", "onload=", "onerror=", r"eval\(", r"expression\(",
)
DANGEROUS_KEYS = ("__proto__", "constructor", "prototype")

# Events that can open a journey when sessions are rebuilt, and the ones
# that never do when they are assigned live.
ENTRY_EVENT_TYPES = ("page_view", "navigation", "navigate")
CONTINUITY_EVENT_TYPES = ("heartbeat", "visibility", "scroll")

# Client-side attributes carried by sessions, visits and events.
CLIENT_SIDE_FIELDS = (
    "client_side_timezone", "client_side_language", "client_side_screen_resolution",
    "client_side_viewport_size", "client_side_device_memory", "client_side_connection_type",
)

UNROUTABLE_IPS = ("127.0.0.1", "::1", "")


@dataclass(frozen=True)
class Step:
    """One funnel step: a page prefix, or an event of a type on a page prefix."""

    label: str
    path: str
    type: str = "page"
    event_type: str = "form_submit"

    def __post_init__(self) -> None:
        if self.type not in ("page", "event"):
            raise ValueError(f"funnel step type must be 'page' or 'event', not {self.type!r}")


@dataclass(frozen=True)
class Funnel:
    key: str
    label: str
    steps: Sequence[Step] = field(default_factory=tuple)

    @classmethod
    def from_config(cls, config: dict) -> "Funnel":
        steps = tuple(
            Step(
                label=s.get("label") or s.get("path", ""),
                path=s.get("path", ""),
                type=s.get("type", "page"),
                event_type=s.get("event_type") or "form_submit",
            )
            for s in config.get("steps", [])
        )
        return cls(config["key"], config.get("label", config["key"]), steps)


def funnels_from_config(config: dict) -> list[Funnel]:
    """Funnels of a dashboard configuration ``{"funnels": [...]}``."""
    return [Funnel.from_config(f) for f in config.get("funnels", [])]


def _form_funnel(path: str, key: str) -> Funnel:
    return Funnel(key, f"{path} to form", (
        Step(f"Visited {path}", path),
        Step("Submitted form", path, "event"),
    ))


DEFAULT_FUNNELS: tuple[Funnel, ...] = (
    Funnel("demo_to_schedule", "Demo to schedule", (
        Step("Visited /demo", "/demo"),
        Step("Submitted form", "/demo", "event"),
        Step("Visited /schedule", "/schedule"),
    )),
    _form_funnel("/sign-up", "sign_up_form"),
    _form_funnel("/book-a-demo", "book_a_demo_form"),
    _form_funnel("/enterprise", "enterprise_form"),
)
