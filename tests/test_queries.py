"""Every query of the engine beside its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from quern.queries import REGISTRY
from tests.compare import compare


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, "/root/testdata/sf0.001", REGISTRY[name].run, REGISTRY[name].sql) == ""


def test_entry(spark):
    assert entry.entry(spark).columns == ["a", "b"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
