"""Every registered query against its SQL on the smallest data folder."""

import pytest
from compare import check, duck

from webjourney.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    if name not in ORACLES:
        assert QUERIES[name](spark, SF).columns
        return
    problem = check(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert problem is None or "no rows on either side" in problem, problem


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).first().total_visits > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
