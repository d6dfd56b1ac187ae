"""The subpackage's queries against their SQL on the smallest tables."""

import pytest
from tests.test_oracle import SF, duck, rows  # noqa: F401

import __spark_entry__ as entry
from revstrata.llm import catalog


def test_all_are_compared():
    from revstrata.plans import catalog as plain

    assert set(entry.oracle_sql()) == set(plain.SQL) | set(catalog.SQL)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, duck, name):  # noqa: F811
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)
