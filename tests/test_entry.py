"""The driver contract: entry runs, every oracle has a query, names are unique."""

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "auroc" in df.columns


def test_registry_consistency():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80
