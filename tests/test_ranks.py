"""Durations at a rank without sorting, and the funnel reports built on it, against plain lists."""

import random

import pytest

from webjourney.config import DEFAULT_FUNNELS
from webjourney.operators import funnels
from webjourney.sources import weblog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("parts", [2, 7, 4096])
def test_values_at_ranks(spark, parts):
    rnd = random.Random(8)
    values = {1: [rnd.randrange(10 ** 12) for _ in range(500)], 2: [5] * 300 + [rnd.randrange(50) for _ in range(300)], 3: [7]}
    rows = spark.createDataFrame([(s, v) for s, vs in values.items() for v in vs], "step long, us long").cache()
    wanted = {(s, r): (min(vs), max(vs), r) for s, vs in values.items() for r in (1, len(vs) // 2 + 1, len(vs))}
    got = funnels._at_ranks(rows, wanted, parts)
    assert got == {(s, r): sorted(values[s])[r - 1] for s, r in wanted}


def test_no_arrivals(spark):
    raw = weblog.log(spark, SF).where("false")
    out = funnels.funnel_timing(weblog.visits(raw), weblog.visit_events(raw), DEFAULT_FUNNELS[0]).collect()
    assert [(r.sample_size, r.median_seconds) for r in out] == [(0, 0.0)] * (len(DEFAULT_FUNNELS[0].steps) - 1)


def test_totals_agree_with_the_listings(spark):
    raw = weblog.log(spark, SF)
    visits, events, funnel = weblog.visits(raw), weblog.visit_events(raw), DEFAULT_FUNNELS[0]
    totals = {r.step: r for r in funnels.funnel_user_totals(visits, events, funnel).collect()}
    for step in range(len(funnel.steps)):
        # A listing leaves out clients that have events and no visit.
        assert funnels.funnel_stage_users(visits, events, funnel, step).count() <= totals[step].stage_users
    assert totals[len(funnel.steps) - 1].dropoffs is None
    assert totals[0].dropoffs >= funnels.funnel_dropoffs(visits, events, funnel, 0).count()
