"""Conversion funnels. All steps of all funnels come from one aggregation per visitor."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webjourney.config import Funnel, Step
from webjourney.functions import forms
from webjourney.functions.journeys import uid
from webjourney.functions.predicates import Moment, has_prefix, in_range, micros, seconds_between
from webjourney.functions.text import or_else
from webjourney.operators.ordered import Timeline, work_table


def _step_rows(
    visits: DataFrame, events: DataFrame, steps: Sequence[Step], key: Column, start, end,
    drop_noise: bool,
) -> DataFrame:
    """(key, timestamp, kind, path) of the rows that can be a step, projected before any shuffle."""
    event_types = sorted({s.event_type for s in steps if s.type == "event"})
    keyed = [key.alias("key"), "timestamp", "path"]
    parts = []
    if any(s.type == "page" for s in steps):
        parts.append(in_range(visits, start, end).select(*keyed, F.lit("page").alias("kind")))
    if event_types:
        ev = in_range(events, start, end).where(F.col("event_type").isin(*event_types))
        if drop_noise:
            ev = ev.where(forms.passes_noise_filter(F.col("event_data")))
        parts.append(ev.select(*keyed, F.col("event_type").alias("kind")))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.where(reduce(Column.__or__, [_matches(s) for s in dict.fromkeys(steps)]))


def _matches(step: Step) -> Column:
    kind = "page" if step.type == "page" else step.event_type
    return (F.col("kind") == kind) & has_prefix(F.col("path"), step.path)


def step_times(
    visits: DataFrame, events: DataFrame, funnels: Sequence[Funnel], key: Column | None = None,
    start: Moment | None = None, end: Moment | None = None, drop_noise: bool = True,
) -> DataFrame:
    """Per visitor the first time of every step: columns ``f<i>_s<j>``.

    Conditional minima combine map-side, so a visitor with any number of rows sends one row
    per task.
    """
    steps = [s for f in funnels for s in f.steps]
    rows = _step_rows(visits, events, steps, uid() if key is None else key, start, end, drop_noise)
    firsts = [
        F.min(F.when(_matches(s), F.col("timestamp"))).alias(f"f{i}_s{j}")
        for i, f in enumerate(funnels) for j, s in enumerate(f.steps)
    ]
    return rows.groupBy("key").agg(*firsts)


def funnel_summary(
    visits: DataFrame, events: DataFrame, funnels: Sequence[Funnel],
    start: Moment | None = None, end: Moment | None = None,
) -> DataFrame:
    """One row per funnel step: users, rate from the step before, drop-off, share of the first.

    A step counts the users of the step before whose first time is not earlier than their first
    time there; a user who saw the later page first is lost.
    """
    times = step_times(visits, events, funnels, start=start, end=end)
    counts = []
    for i, f in enumerate(funnels):
        reached = F.lit(True)
        for j in range(len(f.steps)):
            t = F.col(f"f{i}_s{j}")
            if j == 0:
                reached = t.isNotNull()
            else:
                # The chain joins on the visitor, which a NULL key cannot satisfy.
                reached = reached & (t >= F.col(f"f{i}_s{j - 1}")) & F.col("key").isNotNull()
            counts.append(F.count(F.when(reached, 1)).alias(f"f{i}_s{j}"))
    one = times.agg(*counts)
    cells = F.array(*[
        F.struct(
            F.lit(f.key).alias("funnel_key"), F.lit(f.label).alias("funnel_label"),
            F.lit(j + 1).cast("bigint").alias("step"), F.lit(s.label).alias("step_label"),
            F.col(f"f{i}_s{j}").alias("users"),
            (F.col(f"f{i}_s{j - 1}") if j else F.lit(None).cast("bigint")).alias("_prev"),
            F.col(f"f{i}_s0").alias("_first"))
        for i, f in enumerate(funnels) for j, s in enumerate(f.steps)
    ])
    rows = one.select(F.explode(cells).alias("c")).select("c.*")

    def pct(whole: Column) -> Column:
        return F.when(whole > 0, F.round(F.lit(100.0) * F.col("users") / whole, 2)).otherwise(F.lit(0.0))

    prev = F.col("_prev")
    return rows.select(
        "funnel_key", "funnel_label", "step", "step_label", "users",
        F.when(prev.isNotNull(), pct(prev)).alias("rate"),
        F.when(prev.isNotNull(), F.greatest(prev - F.col("users"), F.lit(0))).alias("dropoff_count"),
        pct(F.col("_first")).alias("share_of_first"))


def _at_ranks(arrivals: DataFrame, wanted: dict, parts: int = 4096) -> dict:
    """For each name (its first part is the step) the duration at a rank among those between two bounds.

    Every pass cuts what is left of each range into ``parts`` and keeps the one with the rank, so the driver sees
    ``parts`` counts a range at most.
    """
    done = {}
    while wanted:
        done |= {k: low for k, (low, high, _) in wanted.items() if low == high}
        wanted = {k: v for k, v in wanted.items() if k not in done}
        if not wanted:
            break
        ranges = sorted({(k[0], low, high) for k, (low, high, _) in wanted.items()})
        widths = {r: (r[2] - r[1]) // parts + 1 for r in ranges}
        place = F.array_compact(F.array(*[
            F.when((F.col("step") == s) & F.col("us").between(low, high), F.struct(
                F.lit(i).alias("i"), F.floor((F.col("us") - low) / widths[s, low, high]).alias("part")))
            for i, (s, low, high) in enumerate(ranges)]))
        counts = arrivals.select(F.explode(place).alias("p"), "us").groupBy("p.i", "p.part").agg(
            F.count("*").alias("n"), F.min("us").alias("low"), F.max("us").alias("high")).collect()
        for k, (low, high, rank) in wanted.items():
            own = ranges.index((k[0], low, high))
            for r in sorted((r for r in counts if r.i == own), key=lambda r: r.part):
                if rank <= r.n:
                    wanted[k] = (r.low, r.high, rank)
                    break
                rank -= r.n
    return done


def funnel_timing(
    visits: DataFrame, events: DataFrame, funnel: Funnel, start=None, end=None,
) -> DataFrame:
    """Seconds between adjacent steps of known clients: mean, median and 90th percentile over all arrivals.

    Percentiles are nearest rank and exact. Durations are counted in coarse cells first; then only the cells that hold a
    rank are counted in finer ones, until a cell is one duration. No arrivals are sorted and none meet in a task.
    """
    known = F.col("client_id").isNotNull()
    times = step_times(visits.where(known), events.where(known), [funnel], F.col("client_id"),
                       start, end, drop_noise=False)
    last = len(funnel.steps) - 1
    pairs = F.array(*[
        F.struct(F.lit(j + 1).cast("bigint").alias("step"), F.col(f"f0_s{j}").alias("a"),
                 F.col(f"f0_s{j + 1}").alias("b")) for j in range(last)])
    arrivals = work_table(times.select(F.explode(pairs).alias("p")).where("p.b >= p.a").select(
        "p.step", (micros(F.col("p.b")) - micros(F.col("p.a"))).alias("us")))
    # 64 cells for each doubling, so some thousands a step at most.
    counted = arrivals.groupBy("step", F.floor(F.log2(F.col("us") / 1e6 + 1) * 64).alias("cell")).agg(
        F.count("*").alias("n"), F.sum(F.col("us").cast("decimal(38,0)")).alias("total"),
        F.min("us").alias("low"), F.max("us").alias("high")).collect()
    stats, wanted = {}, {}
    for step in {r.step for r in counted}:
        cells = sorted((r for r in counted if r.step == step), key=lambda r: r.cell)
        n = sum(r.n for r in cells)
        stats[step] = {"sample_size": n, "avg_seconds": float(sum(r.total for r in cells)) / 1e6 / n}
        for name, share in (("median_seconds", 0.5), ("p90_seconds", 0.9)):
            rank = max(math.floor(n * share), 1)
            for r in cells:
                if rank <= r.n:
                    wanted[step, name] = (r.low, r.high, rank)
                    break
                rank -= r.n
    for (step, name), us in _at_ranks(arrivals, wanted).items():
        stats[step][name] = us / 1e6
    found = times.sparkSession.createDataFrame(
        [(s, v["sample_size"], *[v[c] for c in ("avg_seconds", "median_seconds", "p90_seconds")]) for s, v in stats.items()],
        "step long, sample_size long, avg_seconds double, median_seconds double, p90_seconds double")
    found = found.select("step", "sample_size", *[F.round(c, 2).alias(c) for c in found.columns[2:]])
    labels = times.sparkSession.createDataFrame(
        [(funnel.key, j + 1, funnel.steps[j].label, funnel.steps[j + 1].label) for j in range(last)],
        "funnel_key string, step long, from_step string, to_step string")
    none = {"sample_size": 0, "avg_seconds": 0.0, "median_seconds": 0.0, "p90_seconds": 0.0}
    return labels.join(found, "step", "left").fillna(none).select(
        "funnel_key", "step", "from_step", "to_step", *none)


_TOUCHED = ("source", "medium", "campaign", "page_url", "referrer")


def funnel_user_totals(visits: DataFrame, events: DataFrame, funnel: Funnel, start=None, end=None) -> DataFrame:
    """Per step how many clients a listing of its users, and of those that stop there, has: ``step, stage_users,
    dropoffs`` (NULL at the last step). All steps come from one aggregation."""
    known = F.col("client_id").isNotNull()
    times = step_times(visits.where(known), events.where(known), [funnel], F.col("client_id"), start, end, drop_noise=False)
    at = [F.col(f"f0_s{j}").isNotNull() for j in range(len(funnel.steps))]
    count = lambda c: F.count(F.when(c, 1))
    rows = [F.struct(
        F.lit(j).cast("bigint").alias("step"), F.col(f"_s{j}").alias("stage_users"),
        (F.col(f"_d{j}") if j + 1 < len(at) else F.lit(None).cast("bigint")).alias("dropoffs")) for j in range(len(at))]
    return times.agg(
        *[count(reduce(Column.__and__, at[:j + 1])).alias(f"_s{j}") for j in range(len(at))],
        *[count(at[j] & ~at[j + 1]).alias(f"_d{j}") for j in range(len(at) - 1)],
    ).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _touch_columns() -> list[Column]:
    """First and last visit (lowest / highest id on equal times)."""
    order = F.struct("timestamp", "id")
    return [F.min_by(F.struct("timestamp", *_TOUCHED), order).alias("a"),
            F.max_by(F.struct("timestamp", "page_url"), order).alias("z")]


def funnel_dropoffs(
    visits: DataFrame, events: DataFrame, funnel: Funnel, step: int, start=None, end=None,
) -> DataFrame:
    """Clients that reached a step and never the next one, with their first and last touch.

    Time order between the steps does not matter here; touches ignore the date range.
    """
    if not 0 <= step < len(funnel.steps) - 1:
        raise ValueError("invalid step")
    known = F.col("client_id").isNotNull()
    times = step_times(visits.where(known), events.where(known), [funnel], F.col("client_id"),
                       start, end, drop_noise=False)
    lost = times.where(F.col(f"f0_s{step}").isNotNull() & F.col(f"f0_s{step + 1}").isNull()).select(
        F.col("key").alias("client_id"))
    # Touches are needed for the lost clients only; the semi join trims before aggregating.
    touched = visits.where(known).join(lost, "client_id", "left_semi").groupBy("client_id").agg(*_touch_columns())
    return touched.select(
        "client_id", F.col("a.timestamp").alias("first_seen"), F.col("z.timestamp").alias("last_seen"),
        or_else(F.col("a.source"), "direct").alias("source"),
        or_else(F.col("a.medium"), "none").alias("medium"),
        or_else(F.col("a.campaign"), "none").alias("campaign"),
        F.col("a.page_url").alias("entry_page"))


def funnel_stage_users(
    visits: DataFrame, events: DataFrame, funnel: Funnel, step: int, start=None, end=None,
) -> DataFrame:
    """Journey detail of the clients that reached every step up to ``step`` in any order."""
    if not 0 <= step < len(funnel.steps):
        raise ValueError("invalid step")
    known = F.col("client_id").isNotNull()
    v, e = visits.where(known), events.where(known)
    times = step_times(v, e, [funnel], F.col("client_id"), start, end, drop_noise=False)
    reached = reduce(Column.__and__, [F.col(f"f0_s{j}").isNotNull() for j in range(step + 1)])
    stage = times.where(reached).select(
        F.col("key").alias("client_id"), F.col(f"f0_s{step}").alias("stage_reached_at"))

    in_stage = in_range(v, start, end).join(stage.select("client_id"), "client_id", "left_semi")
    walked = Timeline(
        in_stage.select("client_id", "timestamp", "id", "path", *_TOUCHED), ["client_id"], ["timestamp", "id"]).summary(
        F.when(F.col("path") != "", F.col("path")), " → ", "path_sequence", _touch_columns())
    # Latest form of the client, whatever it contains and whenever it was sent.
    forms_of = e.where(F.col("event_type") == "form_submit").groupBy("client_id").agg(
        F.max_by(F.struct("event_data", "page_url", "timestamp"), F.struct("timestamp", "id")).alias("f"))
    data = F.col("f.event_data")
    has_data = F.coalesce((data != "") & (data != "{}"), F.lit(False))
    contact = forms.loose_profile(data)
    first, last = F.col("a"), F.col("z")
    return (
        stage.join(walked, "client_id").join(forms_of, "client_id", "left")
        .select(
            "client_id", "stage_reached_at",
            first["timestamp"].alias("first_seen"), last["timestamp"].alias("last_seen"),
            first["page_url"].alias("entry_page"), last["page_url"].alias("exit_page"),
            or_else(first["source"], "direct").alias("source"),
            or_else(first["medium"], "none").alias("medium"),
            or_else(first["campaign"], "none").alias("campaign"),
            first["referrer"].alias("entry_referrer"),
            F.coalesce(forms.values_object(data).isNotNull(), F.lit(False)).alias("has_captured_data"),
            forms.values_json(data).alias("captured_data"),
            F.when(has_data, F.col("f.page_url")).alias("captured_page"),
            F.when(has_data, F.col("f.timestamp")).alias("captured_at"),
            contact["email"].alias("email"), contact["name"].alias("name"),
            F.coalesce("path_sequence", F.lit("")).alias("path_sequence"),
            F.floor(seconds_between(last["timestamp"], first["timestamp"])).alias("duration_seconds"))
    )
