"""Every registered query against its SQL on the smallest data."""

import pytest

import check
from ledgerloom.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(small):
    return check.connect(small)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_equals_sql(spark, con, small, name):
    ok, note = check.compare(spark, con, name, small)
    assert ok, note


def test_every_sql_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
