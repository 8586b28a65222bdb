"""Event-to-visit linking, location inheritance, resolution and repair."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webjourney.functions.forms import field
from webjourney.functions.jsontext import quoted, set_fields
from webjourney.functions.predicates import good_country, micros
from webjourney.functions.text import let
from webjourney.operators.ordered import Timeline, left_join_spread


def _recent(name: str, seconds: float) -> Column:
    """The last known struct if it is at most ``seconds`` old."""
    age = micros(F.col("timestamp")) - micros(F.col(f"{name}.timestamp"))
    return F.when(age <= int(seconds * 1_000_000), F.col(name))


def link_events_to_visits(
    events: DataFrame, visits: DataFrame, same_ip_seconds: float = 90, same_user_seconds: float = 600,
) -> DataFrame:
    """Latest matching visit of every event that does not name one.

    First the visits to the same URL from the same address, then those by the same client (or
    address and agent when the event has no client). Each rule is one pass over the union of
    both sides in time order instead of a range join.
    Returns ``id, visit_id, linked_visit_id, link_rule``.
    """
    fingerprint = F.concat(F.lit("f:"), F.coalesce("ip_address", F.lit("")), F.lit("|"), F.coalesce(
        "user_agent", F.lit("")))
    client = F.concat(F.lit("c:"), F.col("client_id"))
    has_client = F.coalesce(F.col("client_id") != "", F.lit(False))

    e = events.select(
        "id", "visit_id", "timestamp", "ip_address", "page_url", F.lit(1).alias("rank"),
        F.when(has_client, client).otherwise(fingerprint).alias("who"))
    v = visits.select("id", "timestamp", "ip_address", "page_url", F.lit(0).alias("rank"),
                      fingerprint.alias("f"), F.when(has_client, client).alias("c"))
    hit = F.struct("id", "timestamp")

    first = v.select("id", F.lit(None).cast("bigint").alias("visit_id"), "timestamp", "ip_address",
                     "page_url", "rank", F.lit(None).cast("string").alias("who")).unionByName(e)
    t = Timeline(first, ["ip_address", "page_url"], ["timestamp", "rank", "id"])
    t.last_known("_v", F.when(F.col("rank") == 0, hit))
    by_ip = t.done().where(F.col("rank") == 1).withColumn(
        "_ip", F.when(F.col("page_url").isNotNull() & F.col("ip_address").isNotNull(),
                      _recent("_v", same_ip_seconds)["id"])).drop("_v", "ip_address")

    owners = v.select("id", "timestamp", "page_url", "rank", F.explode(F.array("f", "c")).alias("who")).where(
        F.col("who").isNotNull())
    t = Timeline(owners.unionByName(by_ip, allowMissingColumns=True), ["who", "page_url"],
                 ["timestamp", "rank", "id"])
    t.last_known("_v", F.when(F.col("rank") == 0, hit))
    by_user = _recent("_v", same_user_seconds)["id"]
    out = t.done().where(F.col("rank") == 1).withColumn(
        "_user", F.when(F.col("page_url").isNotNull(), by_user))
    return out.select(
        "id", "visit_id", F.coalesce("visit_id", "_ip", "_user").alias("linked_visit_id"),
        F.when(F.col("visit_id").isNotNull(), "explicit").when(F.col("_ip").isNotNull(), "same_ip")
        .when(F.col("_user").isNotNull(), "same_user").alias("link_rule"))


def merge_recent_visits(events: DataFrame, visits: DataFrame, seconds: float = 180) -> DataFrame:
    """Visits pulled into the session of the first unlinked event from their address that
    follows within ``seconds``: ``id, session_id`` of the visits that change."""
    v = visits.select("id", "ip_address", "session_id", "timestamp", F.lit(1).alias("rank"))
    e = events.where(F.col("visit_id").isNull()).select(
        "id", "ip_address", "session_id", "timestamp", F.lit(0).alias("rank"))
    # Time runs backwards, so the last known event is the next one to come.
    flipped = v.unionByName(e).where(F.col("ip_address").isNotNull()).withColumn(
        "back", F.timestamp_micros(-micros(F.col("timestamp"))))
    t = Timeline(flipped, ["ip_address"], ["back", "rank", "id"])
    t.last_known("_e", F.when(F.col("rank") == 0, F.struct("timestamp", "session_id")))
    wait = micros(F.col("_e.timestamp")) - micros(F.col("timestamp"))
    return t.done().where(
        (F.col("rank") == 1) & (wait <= int(seconds * 1_000_000))
        & (F.col("_e.session_id") != F.col("session_id"))).select(
        "id", F.col("session_id").alias("old_session_id"), F.col("_e.session_id").alias("session_id"))


def inherit_location(visits: DataFrame, sessions: DataFrame, hours: float = 24) -> DataFrame:
    """Location of each visit: its own if good, else the last good one from the same address
    within ``hours``, visits before sessions, else the one of its own session.

    Returns ``id, ip_address, country, city, location_source``.
    """
    good = good_country(F.col("country"))
    place = F.struct("timestamp", "country", "city")
    v = visits.select(F.col("id").cast("string").alias("key"), "id", "ip_address", "timestamp",
                      "country", "city", "session_id", F.lit(1).alias("rank"))
    s = sessions.select(F.col("id").alias("key"), "ip_address", F.col("last_visit").alias("timestamp"),
                        "country", "city", F.lit(0).alias("rank"))
    t = Timeline(v.unionByName(s, allowMissingColumns=True), ["ip_address"], ["timestamp", "rank", "key"])
    t.last_known("_v", F.when(good & (F.col("rank") == 1), place))
    t.last_known("_s", F.when(good & (F.col("rank") == 0), place))
    own = sessions.select(F.col("id").alias("session_id"), F.col("country").alias("o_country"),
                          F.col("city").alias("o_city"))
    rows = t.done().where(F.col("rank") == 1).join(own, "session_id", "left")
    seconds = hours * 3600
    from_v, from_s = _recent("_v", seconds), _recent("_s", seconds)
    known_ip = F.col("ip_address").isNotNull()
    use_v, use_s = known_ip & from_v.isNotNull(), known_ip & from_s.isNotNull()
    use_own = F.col("o_country").isNotNull()

    def chain(kind: str) -> Column:
        return (
            F.when(good, F.col(kind)).when(use_v, from_v[kind]).when(use_s, from_s[kind])
            .when(use_own, F.col(f"o_{kind}")).otherwise(F.col(kind)))

    label = (
        F.when(good, "own").when(use_v, "visit").when(use_s, "session")
        .when(use_own, "own_session").otherwise("none"))
    return rows.select("id", "ip_address", chain("country").alias("country"), chain("city").alias("city"),
                       label.alias("location_source"))


def resolve_event_location(events: DataFrame, visits: DataFrame, sessions: DataFrame) -> DataFrame:
    """Add ``r_country, r_city, location_source``: visit of the same session, then session, then
    payload, then whatever placeholder is most specific."""
    v = visits.select(F.col("id").alias("visit_id"), "session_id", F.col("country").alias("v_country"),
                      F.col("city").alias("v_city"))
    s = sessions.select(F.col("id").alias("session_id"), F.col("country").alias("s_country"),
                        F.col("city").alias("s_city"))
    # A visit counts only in the event's own session.
    own = left_join_spread(events, v.withColumnRenamed("session_id", "_vs"), "visit_id")
    same = F.col("_vs") == F.col("session_id")
    e = own.withColumns({c: F.when(same, F.col(c)) for c in ("v_country", "v_city")}).drop("_vs").join(
        s, "session_id", "left").withColumn("_p", F.from_json("event_data", "country string, city string"))
    p_country = F.nullif(F.col("_p.country"), F.lit(""))
    placeholder = p_country.eqNullSafe(F.lit("XX"))
    has_data = F.coalesce((F.col("event_data") != "") & (F.col("event_data") != "{}"), F.lit(False))
    known = lambda c: F.coalesce(c != "", F.lit(False))

    def place(kind: str, label: str) -> Column:
        country, city = (p_country, F.nullif(F.col("_p.city"), F.lit(""))) if kind == "_p" else (
            F.col(f"{kind}_country"), F.col(f"{kind}_city"))
        return F.struct(country.alias("country"), city.alias("city"), F.lit(label).alias("source"))

    chosen = (
        F.when(good_country(F.col("v_country")), place("v", "visit"))
        .when(good_country(F.col("s_country")), place("s", "session"))
        .when(good_country(p_country), place("_p", "event_data"))
        .when(placeholder & known(F.col("s_country")), place("s", "session_xx"))
        .when(placeholder & known(F.col("v_country")), place("v", "visit_xx"))
        .when(has_data, place("_p", "event_data_xx")))
    return e.withColumn("_r", chosen).select(
        *events.columns, F.col("_r.country").alias("r_country"), F.col("_r.city").alias("r_city"),
        F.coalesce("_r.source", F.lit("none")).alias("location_source"))


def intake_places(
    events: DataFrame, visits: DataFrame, sessions: DataFrame, ranges: DataFrame, hours: float = 24,
) -> DataFrame:
    """Where an event came from as it arrives: ``id, country, city, place_rule``.

    The good place of its visit, else of its session, else the last good one that a session, else that a visit had from
    its address within ``hours``, else that of the address in ``ranges`` (see ``locate_ips``). A placeholder is taken only
    where there is nothing better: the session's, then the lookup's. An event without address has no lookup.
    """
    place = F.struct("country", "city")
    v = visits.select(F.col("id").alias("visit_id"), place.alias("_v"))
    s = sessions.select(F.col("id").alias("session_id"), place.alias("_s"))
    named = left_join_spread(events.select("id", "timestamp", "visit_id", "session_id", "ip_address"), v, "visit_id").join(
        s, "session_id", "left")
    # What addresses were known for, in the order of time; an event sees what is there when it comes.
    known = F.struct("timestamp", "country", "city")
    of_visits = visits.where(good_country(F.col("country"))).select(
        "ip_address", "timestamp", F.lit(0).alias("rank"), F.col("id").cast("string").alias("key"), known.alias("_kv"))
    of_sessions = sessions.where(good_country(F.col("country"))).withColumn("timestamp", F.col("last_visit")).select(
        "ip_address", "timestamp", F.lit(0).alias("rank"), F.concat(F.lit("s"), "id").alias("key"), known.alias("_ks"))
    asking = named.select("ip_address", "timestamp", F.lit(1).alias("rank"), F.col("id").cast("string").alias("key"),
                          "id", "_v", "_s")
    t = Timeline(
        asking.unionByName(of_visits, allowMissingColumns=True).unionByName(of_sessions, allowMissingColumns=True)
        .where((F.col("rank") == 1) | F.col("ip_address").isNotNull()), ["ip_address"], ["timestamp", "rank", "key"])
    t.last_known("_lv", F.col("_kv")).last_known("_ls", F.col("_ks"))
    found = locate_ips(events.where(F.col("ip_address") != ""), ranges).select(
        F.col("ip").alias("ip_address"), place.alias("_g"))
    rows = left_join_spread(t.done().where("rank = 1"), found, "ip_address")
    has_ip = F.coalesce(F.col("ip_address") != "", F.lit(False))
    by_session, by_visit = (F.when(has_ip, _recent(c, hours * 3600)) for c in ("_ls", "_lv"))
    named_session = F.coalesce(F.col("_s.country") != "", F.lit(False))

    def choose(value) -> Column:
        return (
            F.when(good_country(F.col("_v.country")), value("_v", "visit"))
            .when(good_country(F.col("_s.country")), value("_s", "session"))
            .when(by_session.isNotNull(), value("_ls", "address_session"))
            .when(by_visit.isNotNull(), value("_lv", "address_visit"))
            .when(good_country(F.col("_g.country")), value("_g", "lookup"))
            .when(has_ip & named_session, value("_s", "session_placeholder"))
            .when(has_ip, value("_g", "lookup_placeholder")))

    return rows.select("id", choose(lambda c, _: F.col(f"{c}.country")).alias("country"),
                       choose(lambda c, _: F.col(f"{c}.city")).alias("city"),
                       F.coalesce(choose(lambda _, rule: F.lit(rule)), F.lit("none")).alias("place_rule"))


def with_places(events: DataFrame, places: DataFrame) -> DataFrame:
    """Country and city put into the payload."""
    text = lambda c: F.coalesce(quoted(F.col(c)), F.lit("null"))
    rows = events.join(places.select("id", F.col("country").alias("_c"), F.col("city").alias("_t")), "id", "left")
    return rows.withColumn("event_data", set_fields(
        F.coalesce("event_data", F.lit("{}")), {"country": text("_c"), "city": text("_t")})).drop("_c", "_t")


def session_timeline(visits: DataFrame, events: DataFrame, sessions: DataFrame,
                     session_id: str | None = None) -> DataFrame:
    """Visits and located events of every session, or of one in time order."""
    if session_id is not None:
        visits = visits.where(F.col("session_id") == session_id)
        events = events.where(F.col("session_id") == session_id)
        sessions = sessions.where(F.col("id") == session_id)
    v = visits.select(
        F.lit("visit").alias("item_type"), "session_id", "id", "timestamp", "page_url", "path",
        "source", "is_bot", "crawler_type")
    located = resolve_event_location(events, visits, sessions)
    e = located.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi").select(
        F.lit("event").alias("item_type"), "session_id", "id", "timestamp", "page_url", "path",
        F.coalesce(F.when(F.col("source") != "", F.col("source")),
                   field(F.col("event_data"), "source")).alias("source"),
        "event_type", F.col("r_country").alias("country"), F.col("r_city").alias("city"), "location_source")
    own = v.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    rows = own.unionByName(e, allowMissingColumns=True)
    return rows if session_id is None else rows.orderBy("timestamp", F.desc("item_type"), "id")


# --- repair ---------------------------------------------------------------------------

def _bad_country(c: Column) -> Column:
    return ~good_country(c)


def _bad_city(c: Column) -> Column:
    return c.isNull() | c.isin("", "Unknown")


def repair_sessions(sessions: DataFrame, visits: DataFrame) -> DataFrame:
    """Fill session locations from the latest visit with a good country; adds ``changed``."""
    best = visits.where(good_country(F.col("country"))).groupBy(F.col("session_id").alias("id")).agg(
        F.max_by(F.struct("country", "city"), F.struct("timestamp", "id")).alias("b"))
    s = sessions.join(best, "id", "left")
    fix_country = _bad_country(F.col("country")) & F.col("b.country").isNotNull()
    fix_city = _bad_city(F.col("city")) & F.coalesce(F.col("b.city") != "", F.lit(False))
    return s.select(
        *[c for c in sessions.columns if c not in ("country", "city")],
        F.when(fix_country, F.col("b.country")).otherwise(F.col("country")).alias("country"),
        F.when(fix_city, F.col("b.city")).otherwise(F.col("city")).alias("city"),
        (fix_country | fix_city).alias("changed"))


def repair_visits(visits: DataFrame, sessions: DataFrame) -> DataFrame:
    """Fill visit locations from their session; adds ``changed``."""
    s = sessions.select(F.col("id").alias("session_id"), F.col("country").alias("_c"), F.col("city").alias("_t"))
    fix_country = _bad_country(F.col("country")) & good_country(F.col("_c"))
    fix_city = _bad_city(F.col("city")) & ~_bad_city(F.col("_t"))
    # Only these rows are looked at; an empty city with a good country stays as it is.
    country, city = F.col("country"), F.col("city")
    eligible = country.isNull() | (country == "XX") | city.isNull() | (city == "Unknown")
    eligible = F.coalesce(eligible, F.lit(False))
    return visits.join(s, "session_id", "left").select(
        *[c for c in visits.columns if c not in ("country", "city")],
        F.when(eligible & fix_country, F.col("_c")).otherwise(country).alias("country"),
        F.when(eligible & fix_city, F.col("_t")).otherwise(city).alias("city"),
        (eligible & (fix_country | fix_city)).alias("changed"))


def repair_events(events: DataFrame, visits: DataFrame, sessions: DataFrame) -> DataFrame:
    """Put a good location into payloads that have none; adds ``country, city, changed``.

    ``event_data`` is rewritten with both keys set; other keys keep their place.
    """
    v = visits.select(F.col("id").alias("visit_id"), F.col("country").alias("v_c"), F.col("city").alias("v_t"))
    s = sessions.select(F.col("id").alias("session_id"), F.col("country").alias("s_c"), F.col("city").alias("s_t"))
    e = left_join_spread(events, v, "visit_id").join(s, "session_id", "left")
    p = F.get_json_object("event_data", "$.country")
    needs = F.col("event_data").isNotNull() & (p.isNull() | (p == "XX"))
    use_v, use_s = good_country(F.col("v_c")), good_country(F.col("s_c"))
    unknown = lambda c: F.when(c.isNull() | (c == ""), F.lit("Unknown")).otherwise(c)
    country = F.when(needs & use_v, F.col("v_c")).when(needs & use_s, F.col("s_c"))
    city = F.when(needs & use_v, unknown(F.col("v_t"))).when(needs & use_s, unknown(F.col("s_t")))
    changed = needs & (use_v | use_s)
    return e.select(
        *[c for c in events.columns if c != "event_data"],
        F.when(changed, set_fields(F.col("event_data"), {"country": quoted(country), "city": quoted(city)}))
        .otherwise(F.col("event_data")).alias("event_data"),
        country.alias("country"), city.alias("city"), changed.alias("changed"))


def repair_all(visits: DataFrame, events: DataFrame, sessions: DataFrame) -> dict[str, DataFrame]:
    """Sessions, then visits, then events, each using what was repaired before it."""
    s = repair_sessions(sessions, visits)
    v = repair_visits(visits, s.drop("changed"))
    e = repair_events(events, v.drop("changed"), s.drop("changed"))
    return {"sessions": s, "visits": v, "events": e}


def repair_totals(visits: DataFrame, events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows changed per step of :func:`repair_all`."""
    done = repair_all(visits, events, sessions)
    out = None
    for name in ("sessions", "visits", "events"):
        row = done[name].agg(F.count(F.when(F.col("changed"), 1)).alias("updated")).select(
            F.lit(name).alias("table_name"), "updated")
        out = row if out is None else out.unionByName(row)
    return out


# --- address lookups ------------------------------------------------------------------

#: Networks registered as not global, and the parts of them that are.
RESERVED = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
    "::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16",
    "fc00::/7", "fe80::/10")
GLOBAL_PARTS = (
    "192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48",
    "2001:20::/28", "2001:30::/28")
_MAPPED = "00000000000000000000ffff"


def ipv4_number(ip: Column) -> Column:
    """Numeric IPv4 address, NULL for anything else."""
    def number(parts: Column) -> Column:
        return F.when(F.forall(parts, lambda p: p <= 255), F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, p: n * 256 + p))

    digits = F.when(ip.rlike(r"^(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}$"), F.split(ip, r"\."))
    return let(F.transform(digits, lambda p: p.cast("bigint")), number)


def _four(n: Column) -> Column:
    return F.lpad(F.lower(F.hex(n)), 8, "0")


def ip_key(ip: Column) -> Column:
    """128 bits of an address as 32 hex digits, which sort like the numbers; IPv4 as its mapped IPv6 address.

    NULL for what is no address. A zone (``%eth0``) does not count.
    """
    # Every step is bound once: written out, the expression would hold dozens of copies of the address.
    def with_hex_tail(text: Column) -> Column:
        return let(F.regexp_extract(text, r":(\d{1,3}(?:\.\d{1,3}){3})$", 1), lambda tail: F.when(tail == "", text).otherwise(
            let(_four(ipv4_number(tail)), lambda four: F.concat(
                F.substring(text, F.lit(1), F.length(text) - F.length(tail)), F.substring(four, 1, 4), F.lit(":"),
                F.substring(four, 5, 4)))))

    def groups(half: Column) -> Column:
        return F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))

    def filled(halves: Column) -> Column:
        def joined(head: Column, rest: Column) -> Column:
            missing = 8 - F.size(head) - F.size(rest)
            return F.when(F.size(halves) == 1, head).when(
                (F.size(halves) == 2) & (missing >= 1),
                F.concat(head, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), rest))

        return let(groups(halves[0]), lambda head: let(
            groups(F.coalesce(F.get(halves, F.lit(1)), F.lit(""))), lambda rest: joined(head, rest)))

    def v6_key(text: Column) -> Column:
        return let(let(F.split(text, "::"), filled), lambda g: F.when(
            text.contains(":") & (F.size(g) == 8) & F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")),
            F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), "")))

    return let(ipv4_number(ip), lambda n: F.when(n.isNotNull(), F.concat(F.lit(_MAPPED), _four(n))).otherwise(
        let(let(F.lower(F.regexp_replace(ip, "%.*$", "")), with_hex_tail), v6_key)))


def network_keys(network: Column) -> Column:
    """First and last key (struct of low and high) of a network: ``address/bits``, without bits one address."""
    address = F.substring_index(network, "/", 1)
    given = F.regexp_extract(network, r"/(\d+)$", 1).try_cast("int")
    bits = F.coalesce(F.when(ipv4_number(address).isNotNull(), given + 96).otherwise(given), F.lit(128))

    def bounds(key: Column, n: Column) -> Column:
        whole, part = F.floor(n / 4).cast("int"), n % 4
        digit = F.conv(F.substring(key, whole + 1, F.lit(1)), 16, 10).cast("int")
        free = (F.pow(F.lit(2), 4 - part) - 1).cast("int")

        def end(last: Column, fill: str) -> Column:
            known = F.concat(F.substring(key, F.lit(1), whole), F.when(part > 0, F.lower(F.hex(last))).otherwise(F.lit("")))
            return F.rpad(known, 32, fill)

        return F.struct(end(digit.bitwiseAND(15 - free), "0").alias("low"), end(digit.bitwiseOR(free), "f").alias("high"))

    return let(ip_key(address), lambda key: let(bits, lambda n: bounds(key, n)))


def _network_bounds(network: str) -> tuple[str, str]:
    found = ipaddress.ip_network(network)
    base = 0xFFFF << 32 if found.version == 4 else 0
    return f"{base + int(found[0]):032x}", f"{base + int(found[-1]):032x}"


def is_private_ip(ip: Column) -> Column:
    """Loopback, link-local and private addresses and the other reserved blocks; an IPv4 address inside an IPv6 one
    counts as itself."""
    def reserved(key: Column) -> Column:
        inside = lambda networks: reduce(Column.__or__, [
            key.between(*map(F.lit, _network_bounds(n))) for n in networks])
        return F.coalesce(inside(RESERVED) & ~inside(GLOBAL_PARTS), F.lit(False))

    return let(ip_key(ip), reserved)


def _boundaries(ranges: DataFrame) -> DataFrame:
    """Where a range begins (side 0, the wider first) and ends (side 2): ``at, side, wide, place``."""
    if "network" in ranges.columns:
        bounds = network_keys(F.col("network"))
    else:
        bounds = F.struct(*[F.concat(F.lit(_MAPPED), _four(F.col(c))).alias(n) for c, n in (("lo", "low"), ("hi", "high"))])
    # Of two equal ranges the lowest place is taken.
    keyed = ranges.select(bounds.alias("r"), F.struct("country", "city").alias("place")).where(
        F.col("r.low").isNotNull() & F.col("r.high").isNotNull()).groupBy("r.low", "r.high").agg(
        F.min("place").alias("place"))
    inverse = F.translate("high", "0123456789abcdef", "fedcba9876543210")
    return keyed.select(F.explode(F.array(
        F.struct(F.col("low").alias("at"), F.lit(0).alias("side"), inverse.alias("wide"), "place"),
        F.struct(F.col("high").alias("at"), F.lit(2).alias("side"), F.col("low").alias("wide"), "place"))).alias("b")
    ).select("b.*", F.lit(0).alias("all"))


def innermost(ranges: DataFrame) -> DataFrame:
    """The place that holds from each boundary on: ``at, side, wide, place`` (a struct in a struct: NULL outside of all).

    Ranges lie inside or beside each other, as networks do. A running count of open ranges gives the depth; after a
    boundary the range holds that was last opened at this depth, so ranges need neither a stack nor to be cut up.
    """
    order = ["at", "side", "wide"]
    t = Timeline(_boundaries(ranges), ["all"], order)
    t.running_sum("depth", F.when(F.col("side") == 0, 1).otherwise(-1).cast("long"))
    d = Timeline(t.done(), ["depth"], order)
    d.last_known("opened", F.when(F.col("side") == 0, F.struct("place")))
    return d.done().select(*order, F.struct(F.when(F.col("depth") > 0, F.col("opened.place")).alias("place")).alias(
        "holds"))


def locate_ips(df: DataFrame, ranges: DataFrame, ip: str = "ip_address") -> DataFrame:
    """Distinct addresses (IPv4 and IPv6) with the place of the narrowest range they lie in.

    ``ranges``: country, city, and either ``network`` or the IPv4 numbers ``lo`` and ``hi``. One pass over addresses and
    boundaries in order, so neither wide nor nested ranges multiply rows. Private addresses get the placeholder; what is
    no address has no place.
    """
    ips = df.select(F.col(ip).alias("ip")).where(F.col("ip").isNotNull()).distinct()
    probes = ips.select(ip_key(F.col("ip")).alias("at"), F.lit(1).alias("side"), F.col("ip").alias("wide"), "ip")
    found = innermost(ranges).unionByName(probes.where(F.col("at").isNotNull()), allowMissingColumns=True)
    t = Timeline(found.withColumn("all", F.lit(0)), ["all"], ["at", "side", "wide"])
    t.last_known("_h", F.col("holds"))
    placed = t.done().where(F.col("side") == 1).select("ip", F.col("_h.place").alias("p")).unionByName(
        probes.where(F.col("at").isNull()).select("ip", F.lit(None).cast("struct<country:string,city:string>").alias("p")))
    private = is_private_ip(F.col("ip"))
    return placed.select(
        "ip", F.when(private, "XX").otherwise(F.col("p.country")).alias("country"),
        F.when(private, "Unknown").otherwise(F.col("p.city")).alias("city"))
