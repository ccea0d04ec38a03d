"""Every registered query that has SQL agrees with it on the smallest tables."""

import os

import oracle
import pytest

from tidemark.plans import registry

SF = os.environ.get("TIDEMARK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, con, name):
    found = oracle.mismatch(registry.queries()[name](spark, SF), registry.oracle_sql()[name], con)
    assert found is None, found


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0
