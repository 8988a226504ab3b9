"""A small local session for all tests."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)

SMALL = os.environ.get("TEXTEVIDENCE_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data() -> str:
    return SMALL


@pytest.fixture(scope="session")
def compare(spark, data):
    """Compares a query with its SQL twin in DuckDB over the same folder."""
    import duckdb

    connection = duckdb.connect()
    for name in os.listdir(data):
        connection.sql(f"create view {name.removesuffix('.parquet')} as select * from '{data}/{name}'")

    def rows(table: list[tuple], names: list[str]) -> list[str]:
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted(repr([float(x) if isinstance(x := row[i], float) else x for i in order]) for row in table)

    def run(query, sql: str) -> None:
        got = query(spark, data)
        want = connection.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)

    return run
