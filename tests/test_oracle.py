"""Every registered query against its oracle statement on the smallest data set."""

import pytest

import __spark_entry__ as entry
from workload import registry
from workload.check import compare, oracle_connection

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES  # the training-data queries have tests of their own


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]).startswith("ok")
    else:
        assert df.count() >= 0


def test_entry(spark):
    assert set(entry.entry(spark).columns) >= {"candidate_id", "similarity"}
