"""Every registered query with SQL, against an independent SQL engine."""

import pytest

import __spark_entry__ as entry
from emberlake.plans import catalogue
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, sf_dir, con, name):
    compare(catalogue.queries()[name](spark, sf_dir), con, catalogue.oracle_sql()[name])


def test_registration(spark):
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
