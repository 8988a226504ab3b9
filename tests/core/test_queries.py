"""Every query runs over the smallest tables; those with SQL give the same rows as DuckDB."""

from __future__ import annotations

import pytest

from textevidence.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES) and len(SQL) > 30


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, compare):
    compare(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, data):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark, monkeypatch, data):
    import __spark_entry__ as entry

    monkeypatch.setenv("TEXTEVIDENCE_ENTRY_DIR", data)
    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())
