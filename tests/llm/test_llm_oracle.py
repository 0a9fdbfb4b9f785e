"""Queries with SQL, value by value, on the given tables."""

import pytest
from compare import connect, difference
from conftest import SMALL

from shoalsong.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SMALL), connect(SMALL), ORACLE[name]) is None


def test_operators_and_the_pipeline():
    import __spark_entry__ as entry

    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
