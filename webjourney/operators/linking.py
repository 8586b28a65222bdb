"""Visits made from events, and visits that move to a client's session.

An event that names no visit takes the latest one of its page from its address, else the latest of its page by the same
client (or address and agent), else it makes a visit of its own, which later events may find. That last rule makes the
step sequential: what an event finds depends on what earlier ones made. Rows are therefore folded in time order, but only
together with rows that can matter to them: those of the same page that follow each other within the longer tolerance by
address or by client. Such groups are found first, as components of time islands, and folded side by side.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webjourney.functions.predicates import micros
from webjourney.operators.location import inherit_location
from webjourney.operators.ordered import Timeline, work_table

#: Rules in the order in which they are tried.
EXPLICIT, SAME_IP, SAME_USER, CREATED = "explicit", "same_ip", "same_user", "created"


def created_id(event_id: Column) -> Column:
    """Ids of made visits: negative, one for each event, apart from those of visits on record."""
    return -event_id - 1


def _given(c: str) -> Column:
    return F.col(c) != ""


def _who() -> tuple[Column, Column]:
    """Keys of a client, and of an address with its agent; a missing address or agent is a value of its own."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    client = F.when(_given("client_id"), F.concat(F.lit("c:"), F.col("client_id")))
    return client, F.concat(F.lit("f:"), part("ip_address"), F.lit("\0"), part("user_agent"))


def _islands(rows: DataFrame, keys: list[str], limit: int, name: str) -> DataFrame:
    """``rows`` with a number for their island: rows of ``keys`` no further than ``limit`` µs from the one before.

    The number is a hash; islands that share one are folded together, which changes nothing but the work.
    """
    t = Timeline(rows, keys, ["timestamp", "rank", "id"]).previous("_p", F.struct("timestamp"))
    apart = F.col("_p").isNull() | (micros(F.col("timestamp")) - micros(F.col("_p.timestamp")) > limit)
    t.running_sum("_n", apart.cast("long"))
    return t.done().withColumn(name, F.xxhash64(F.lit(name), *keys, "_n")).drop("_p", "_n")


def _groups(rows: DataFrame, by_ip: str, by_client: str) -> DataFrame:
    """``rows`` with ``group``: the least address island that its own one reaches over shared client islands.

    Only clients that are seen on several address islands join any; the others do not take part in the search.
    """
    edges = rows.where(F.col(by_client).isNotNull()).select(by_ip, by_client).distinct()
    bridging = edges.groupBy(by_client).agg(F.min(by_ip).alias("_a"), F.max(by_ip).alias("_b")).where("_a < _b")
    edges = work_table(edges.join(bridging.select(by_client), by_client, "left_semi"))
    labels = work_table(edges.select(by_ip, F.col(by_ip).alias("label")).distinct())
    while True:
        over = edges.join(labels, by_ip).groupBy(by_client).agg(F.min("label").alias("label"))
        least = edges.join(over, by_client).groupBy(by_ip).agg(F.min("label").alias("_near"))
        # The label of one's label halves the way to go.
        hop = labels.select(F.col(by_ip).alias("_near"), F.col("label").alias("_far"))
        new = work_table(labels.join(least, by_ip).join(hop, "_near").select(
            by_ip, F.least("label", "_far").alias("label"), (F.least("label", "_far") < F.col("label")).alias("_less")))
        labels = new.drop("_less")
        if not new.where("_less").head(1):
            break
    return rows.join(labels, by_ip, "left").withColumn("group", F.coalesce("label", by_ip)).drop("label")


class Recent:
    """Latest visit by key, forgotten once it is older than the longest look back."""

    def __init__(self, keep: int) -> None:
        self.keep, self.seen = keep, {}

    def put(self, key, us: int, visit: int) -> None:
        # Newest last, so the oldest are met first.
        self.seen.pop(key, None)
        self.seen[key] = (us, visit)

    def get(self, key, us: int, limit: int):
        found = self.seen.get(key)
        return found[1] if found and us - found[0] <= limit else None

    def forget(self, us: int) -> None:
        while self.seen:
            key = next(iter(self.seen))
            if us - self.seen[key][0] <= self.keep:
                break
            del self.seen[key]


class Fold:
    """The rules for one group of rows in time order."""

    def __init__(self, same_ip: int, same_user: int) -> None:
        self.same_ip, self.same_user = same_ip, same_user
        self.by_ip, self.by_who = Recent(same_ip), Recent(same_user)

    def visit(self, us: int, visit: int, page: str, ip, client, device) -> None:
        self.by_ip.put((page, ip), us, visit)
        self.by_who.put((page, device), us, visit)
        if client is not None:
            self.by_who.put((page, client), us, visit)

    def saved(self) -> str:
        return json.dumps([list(r.seen.items()) for r in (self.by_ip, self.by_who)])

    def restore(self, text: str) -> None:
        for recent, items in zip((self.by_ip, self.by_who), json.loads(text)):
            recent.seen = {tuple(key): tuple(value) for key, value in items}

    def event(self, us: int, event: int, page: str, ip, client, device) -> tuple[int, str]:
        self.by_ip.forget(us)
        self.by_who.forget(us)
        found = None if ip is None else self.by_ip.get((page, ip), us, self.same_ip)
        if found is not None:
            return found, SAME_IP
        found = self.by_who.get((page, device if client is None else client), us, self.same_user)
        if found is not None:
            return found, SAME_USER
        self.visit(us, -event - 1, page, ip, client, device)
        return -event - 1, CREATED


def rows_to_fold(events: DataFrame, visits: DataFrame) -> DataFrame:
    """Visits (rank 0) and the events that look for one (rank 1), with a page, in one shape."""
    client, device = _who()

    def shape(df: DataFrame, rank: int) -> DataFrame:
        return df.where(_given("page_url")).select(
            F.lit(rank).alias("rank"), F.col("id").cast("long").alias("id"), "timestamp", "page_url", "ip_address",
            client.alias("client"), device.alias("device"))

    return shape(visits, 0).unionByName(shape(events, 1))


def _explicit(events: DataFrame, visits: DataFrame) -> DataFrame:
    """id and linked_visit_id of the events that name a visit there is."""
    named = events.where(F.col("visit_id").isNotNull()).select("id", "visit_id")
    known = visits.select(F.col("id").alias("visit_id"))
    return named.join(known, "visit_id", "left_semi").select("id", F.col("visit_id").alias("linked_visit_id"))


def link_or_create(
    events: DataFrame, visits: DataFrame, same_ip_seconds: float = 90, same_user_seconds: float = 600,
) -> DataFrame:
    """Every event with the visit it belongs to: ``id, linked_visit_id, link_rule``.

    ``explicit``: the event names a visit there is. Else the latest visit of its page (of several at one time the one
    with the highest id, one made by an event last) from its address within ``same_ip_seconds``, or by its client (address
    and agent without one) within ``same_user_seconds``. Else one is ``created`` with a negative id (``created_id``).
    Events without a page that name none get none. A page that one address hits without a pause is one group.
    """
    same_ip, same_user = int(same_ip_seconds * 1_000_000), int(same_user_seconds * 1_000_000)
    gap = max(same_ip, same_user)
    explicit = work_table(_explicit(events, visits))
    looking = events.join(explicit.select("id"), "id", "left_anti")
    rows = _islands(rows_to_fold(looking, visits), ["page_url", "ip_address"], gap, "by_ip")
    own = _islands(rows.where(F.col("client").isNotNull()), ["page_url", "client"], gap, "by_client")
    rows = work_table(own.unionByName(rows.where(F.col("client").isNull()), allowMissingColumns=True))
    dealt = _groups(rows, "by_ip", "by_client").withColumn("us", micros(F.col("timestamp")))

    def scan(batches: Iterator) -> Iterator:
        import pandas as pd

        now, fold = None, None
        for pdf in batches:
            out = []
            for group, rank, rid, us, page, ip, client, device in zip(*[pdf[c].tolist() for c in columns]):
                if group != now:
                    now, fold = group, Fold(same_ip, same_user)
                if rank:
                    out.append((rid, *fold.event(us, rid, page, ip, client, device)))
                else:
                    fold.visit(us, rid, page, ip, client, device)
            yield pd.DataFrame(out, columns=["id", "linked_visit_id", "link_rule"])

    columns = ["group", "rank", "id", "us", "page_url", "ip_address", "client", "device"]
    folded = (
        dealt.select(*columns).repartition("group").sortWithinPartitions("group", "us", "rank", "id")
        .mapInPandas(scan, "id long, linked_visit_id long, link_rule string"))
    without = looking.where(~F.coalesce(_given("page_url"), F.lit(False))).select(
        F.col("id").cast("long").alias("id"), F.lit(None).cast("long").alias("linked_visit_id"),
        F.lit(None).cast("string").alias("link_rule"))
    return explicit.select(
        F.col("id").cast("long").alias("id"), F.col("linked_visit_id").cast("long").alias("linked_visit_id"),
        F.lit(EXPLICIT).alias("link_rule")).unionByName(folded).unionByName(without)


_TAKEN = ("client_id", "ip_address", "user_agent", "page_url", "referrer", "page_domain", "path", "tracking_id",
          "source", "medium", "campaign")


def created_visits(events: DataFrame, links: DataFrame) -> DataFrame:
    """The visits that events made, with the fields they take from their event."""
    made = links.where(F.col("link_rule") == CREATED).select("id")
    return events.join(made, "id", "left_semi").select(
        created_id(F.col("id").cast("long")).alias("id"), "session_id", "timestamp", *_TAKEN)


def located_visits(created: DataFrame, visits: DataFrame, sessions: DataFrame, hours: float = 24) -> DataFrame:
    """``created_visits`` with the country and city known for their address (see ``inherit_location``)."""
    known = visits.select("id", "session_id", "timestamp", "ip_address", "country", "city")
    none = F.lit(None).cast("string")
    both = created.select("id", "session_id", "timestamp", "ip_address", none.alias("country"), none.alias("city"))
    places = inherit_location(known.unionByName(both), sessions, hours).where("id < 0")
    return created.join(places.select("id", "country", "city", "location_source"), "id")


def visit_moves(events: DataFrame, visits: DataFrame, links: DataFrame) -> DataFrame:
    """Each time an event of a known client takes its visit into another session: ``visit_id, event_id, timestamp,
    old_session_id, session_id``, for visits on record and made ones. The last move is where the visit stays."""
    own = events.join(links.where(F.col("linked_visit_id").isNotNull()), "id").where(_given("client_id")).select(
        F.col("linked_visit_id").alias("visit_id"), F.lit(1).alias("rank"), "id", "timestamp", "session_id")
    stored = visits.select(F.col("id").cast("long").alias("visit_id"), F.lit(0).alias("rank"), F.col("id").cast(
        "long").alias("id"), "timestamp", "session_id")
    made = created_visits(events, links).select(
        F.col("id").alias("visit_id"), F.lit(0).alias("rank"), "id", "timestamp", "session_id")
    # What is on record comes first, also where the event's clock was behind.
    t = Timeline(stored.unionByName(made).unionByName(own), ["visit_id"], ["rank", "timestamp", "id"])
    t.previous("_prev", F.struct("session_id"))
    return t.done().where((F.col("rank") == 1) & ~F.col("session_id").eqNullSafe(F.col("_prev.session_id"))).select(
        "visit_id", F.col("id").alias("event_id"), "timestamp", F.col("_prev.session_id").alias("old_session_id"),
        "session_id")


def moved_visits(visits: DataFrame, moves: DataFrame) -> DataFrame:
    """Visits in the session of their last move."""
    last = moves.groupBy(F.col("visit_id").alias("id")).agg(
        F.max_by("session_id", F.struct("timestamp", "event_id")).alias("_to"))
    return visits.join(last, "id", "left").withColumn("session_id", F.coalesce("_to", "session_id")).drop("_to")


def event_sessions(events: DataFrame, visits: DataFrame, links: DataFrame, moves: DataFrame) -> DataFrame:
    """The session each event is stored under: a known client's own one, else that of its visit at the time.

    ``id, session_id``.
    """
    linked = events.join(links.select("id", "linked_visit_id"), "id")
    plain = linked.where(F.col("linked_visit_id").isNull() | F.coalesce(_given("client_id"), F.lit(False)))
    follow = linked.where(F.col("linked_visit_id").isNotNull() & ~F.coalesce(_given("client_id"), F.lit(False)))
    first = visits.select(F.col("id").cast("long").alias("visit_id"), "session_id").unionByName(
        created_visits(events, links).select(F.col("id").alias("visit_id"), "session_id"))
    states = first.select("visit_id", F.lit(None).cast("timestamp").alias("timestamp"), F.lit(0).alias("rank"),
                          F.lit(0).cast("long").alias("id"), "session_id").unionByName(
        moves.select("visit_id", "timestamp", F.lit(1).alias("rank"), F.col("event_id").alias("id"), "session_id"))
    asked = follow.select(F.col("linked_visit_id").alias("visit_id"), "timestamp", F.lit(1).alias("rank"), "id",
                          F.lit(None).cast("string").alias("session_id"), F.lit(True).alias("asks"))
    t = Timeline(states.withColumn("asks", F.lit(False)).unionByName(asked), ["visit_id"],
                 ["timestamp", "rank", "id", "asks"])
    t.last_known("_s", F.when(~F.col("asks"), F.struct("session_id")))
    return plain.select("id", "session_id").unionByName(
        t.done().where("asks").select("id", F.col("_s.session_id").alias("session_id")))
