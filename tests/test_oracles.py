"""Every registered query against its oracle in DuckDB, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tablewarden.queries import registry
from tools.compare import normal, oracle

SF = "/root/testdata/sf0.001"


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = oracle(SF, entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 15
