"""All registered queries against their SQL twins on the smallest data set."""

import os

import pytest

import verify

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    return verify.open_duck(FOLDER)


NAMES = sorted(verify.ENTRIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    outcome = verify.check(spark, duck, name, FOLDER)
    assert outcome.problem is None, outcome.problem


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["repo", "branch", "date", "loc"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
