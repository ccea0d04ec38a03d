"""The driver's entry points."""

import __spark_entry__ as entry

from tidemark.plans import registry


def test_core_queries_are_registered():
    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["eid", "gap_bin", "n", "gap_sum", "n_stories"] and df.count() > 0
