"""Registered queries against their SQL twins on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import difference, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_twins_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns == ["customer_segment", "sla_rate"] and entry(spark).count() == 3


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_twin(spark, con, name):
    assert difference(queries()[name](spark, SF), con, oracle_sql()[name]) is None
