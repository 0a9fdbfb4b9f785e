"""Every registered query against its SQL, value by value."""

import pytest
from compare import connect, difference
from conftest import SMALL

import __spark_entry__ as entry
from shoalsong.plans.oracle import ORACLE
from shoalsong.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SMALL), con, ORACLE[name]) is None


def test_oracle_names_are_registered():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLE)


def test_all_are_in_the_entry():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns == ["analysis_id", "num_segments", "label", "confidence", "valid"]
