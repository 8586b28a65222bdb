"""URL and referrer fields as Column expressions (RFC 3986 split, lenient on odd characters)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webjourney.config import NOISE_HOST_TOKENS, NOISE_PATH_TOKENS, TWO_PART_SUFFIXES
from webjourney.functions.text import blank_to_null

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
AUTHORITY_REGEX = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def authority(url: Column) -> Column:
    """Host with port and user info, '' when the URL names no host."""
    return F.regexp_extract(url, AUTHORITY_REGEX, 1)


def host(url: Column) -> Column:
    """Lower-case host without user info and port."""
    bare = F.regexp_replace(authority(url), r"^.*@", "")
    return F.lower(F.regexp_replace(bare, r":\d*$", ""))


def port(url: Column) -> Column:
    return blank_to_null(F.regexp_extract(authority(url), r":(\d+)$", 1)).try_cast("int")


def path(url: Column) -> Column:
    """Path without the parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, _PATH, 1), r";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(url, _QUERY, 1)


def _decode(text: str) -> str:
    plus = f"replace({text}, '+', ' ')"
    return f"coalesce(try_url_decode({text}), {plus})"


def query_pairs_sql(url: str) -> str:
    """SQL text: ``array<struct<k,v>>`` of the query in URL order, decoded, blank values dropped."""
    query = f"regexp_extract({url}, r'{_QUERY}', 1)"
    return (
        f"transform(filter(split({query}, '&'), p -> p rlike r'(?s)^[^=]*=.'), p -> named_struct("
        f"'k', {_decode("substring_index(p, '=', 1)")}, "
        f"'v', {_decode("substring(p, instr(p, '=') + 1)")}))")


def query_map(url: str) -> Column:
    """``map<string, array<string>>`` of the query; ``url`` is a column name or SQL text."""
    pairs = query_pairs_sql(url)
    return F.expr(
        f"map_from_entries(transform(array_distinct(transform({pairs}, e -> e.k)), n -> named_struct("
        f"'key', n, 'value', transform(filter({pairs}, e -> e.k = n), e -> e.v))))")


def _first_param_sql(url: str, name: str) -> str:
    # Without escapes the query needs no split: first non-blank value of the name.
    plain = f"regexp_extract({url}, r'^[^?#]*[?](?:[^#]*?&)?{name}=([^&#]+)', 1)"
    split = f"get(filter({query_pairs_sql(url)}, e -> e.k = '{name}'), 0).v"
    return f"if(contains({url}, '%'), {split}, nullif(replace({plain}, '+', ' '), ''))"


def first_param_sql(url: str, *names: str) -> str:
    firsts = ", ".join(_first_param_sql(url, n) for n in names)
    return f"CASE WHEN contains({url}, '?') THEN coalesce({firsts}) END"


def first_param(url: str, *names: str) -> Column:
    """First value of the first parameter among ``names`` that is present."""
    return F.expr(first_param_sql(url, *names))


def render_params(
    url: str, keep: Sequence[str] | None = None, drop: Sequence[str] = (), sep: str = " | "
) -> Column:
    """``key: first value`` list of the chosen parameters, NULL when none is left.

    With ``keep`` the keys come by length and then by bytes, as in a binary JSON object;
    otherwise they keep their URL order.
    """
    pairs = query_pairs_sql(url)
    if keep is not None:
        ordered = sorted(keep, key=lambda k: (len(k), k))
        texts = ", ".join(
            f"'{k}: ' || get(filter({pairs}, e -> e.k = '{k}'), 0).v" for k in ordered)
        text = f"concat_ws('{sep}', {texts})"
    else:
        names = ", ".join(f"'{d}'" for d in drop) or "''"
        keys = f"filter(array_distinct(transform({pairs}, e -> e.k)), n -> n NOT IN ({names}))"
        text = (f"array_join(transform({keys}, n -> n || ': ' || "
                f"get(filter({pairs}, e -> e.k = n), 0).v), '{sep}')")
    return F.expr(f"CASE WHEN contains({url}, '?') THEN nullif({text}, '') END")


def utm_sql(url: str, referrer: str) -> dict[str, str]:
    """SQL text of source, medium and campaign; an untagged URL takes the referrer's host."""
    tagged = first_param_sql(url, "utm_source", "source", "ref")
    host = f"CASE WHEN {referrer} <> '' THEN regexp_extract({referrer}, r'{AUTHORITY_REGEX}', 1) END"
    return {
        "source": f"coalesce({tagged}, {host})",
        "medium": first_param_sql(url, "utm_medium"),
        "campaign": first_param_sql(url, "utm_campaign", "campaign"),
    }


def with_attribution(df: DataFrame, url: str = "page_url", referrer: str = "referrer") -> DataFrame:
    """Add source, medium and campaign."""
    return df.selectExpr("*", *[f"{e} AS {n}" for n, e in utm_sql(url, referrer).items()])


def referrer_domain(referrer: Column) -> Column:
    """Authority of the referrer, NULL when absent."""
    return blank_to_null(authority(referrer))


def domain_family(hostname: Column, families: Mapping[str, Sequence[str]]) -> Column:
    """Family whose domain equals the host or is a dot suffix of it, else NULL."""
    h = F.lower(F.trim(hostname))
    h = F.when(h.startswith("["), h).otherwise(F.regexp_replace(h, r":[^:]*$", ""))
    out = F.lit(None).cast("string")
    for family, domains in reversed(list(families.items())):
        hit = F.lit(False)
        for d in domains:
            hit = hit | (h == d) | h.endswith("." + d)
        out = F.when(hit, F.lit(family)).otherwise(out)
    return out


def is_internal(hostname: Column, families: Mapping[str, Sequence[str]]) -> Column:
    return domain_family(hostname, families).isNotNull()


def root_domain(hostname: Column) -> Column:
    """Registrable domain: two labels, or three under a two-part public suffix."""
    parts = F.split(hostname, r"\.")
    n = F.size(parts)
    two = F.substring_index(hostname, ".", -2)
    return F.when(n <= 2, hostname).when(
        two.isin(*TWO_PART_SUFFIXES), F.substring_index(hostname, ".", -3)
    ).otherwise(two)


def is_analytics_noise(url: Column, extra_hosts: Sequence[str] = ()) -> Column:
    """Request to an analytics host or path."""
    h, p = host(url), F.lower(path(url))
    hit = F.lit(False)
    for token in (*NOISE_HOST_TOKENS, *extra_hosts):
        hit = hit | h.contains(token)
    for token in NOISE_PATH_TOKENS:
        hit = hit | p.contains(token)
    return F.coalesce(hit, F.lit(False))


def client_ip(forwarded_for: Column, real_ip: Column, forwarded: Column, peer: Column) -> Column:
    """Client address: first X-Forwarded-For, X-Real-IP, ``for=`` of Forwarded, else the peer."""
    via = F.trim(F.regexp_extract(forwarded, r'''(?i)(?:^|;)\s*for=\s*"?([^";]+)''', 1))
    bare = F.when(via.startswith("["), F.regexp_extract(via, r"^\[([^\]]*)\]", 1)).otherwise(
        F.substring_index(via, ":", 1))
    return F.coalesce(
        blank_to_null(F.trim(F.substring_index(forwarded_for, ",", 1))),
        blank_to_null(F.trim(real_ip)),
        blank_to_null(bare),
        peer,
    )
