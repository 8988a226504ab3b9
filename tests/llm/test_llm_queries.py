"""Every query of the corpus operators runs over the smallest tables and has the columns it must have."""

from __future__ import annotations

import pytest

pytest.importorskip("textevidence.llm")
from textevidence.llm import queries as q  # noqa: E402

COLUMNS = {
    "p1_found": ["record_table", "record_id", "line_no", "kind", "item"],
    "p2_found": ["record_table", "id_a", "id_b"],
    "p3_found": ["record_table", "record_id", "start_pos", "end_pos"],
    "p4_found": ["record_table", "record_id", "start_pos", "end_pos", "pii_type"],
    "p5_found": ["record_table", "record_id", "lang"],
    "p6_ids": ["doc_id", "ids"],
    "p8_found": ["doc_id", "start_pos", "end_pos"],
}


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_runs(name, spark, data):
    df = q.queries()[name](spark, data)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.collect()
    assert rows
    if name.endswith("_found"):
        assert len({tuple(r) for r in rows}) == len(rows)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_as_sql(name, compare):
    compare(q.queries()[name], q.oracle_sql()[name])


def test_empty_tables(spark, data, tmp_path):
    import os

    for name in os.listdir(data):
        df = spark.read.parquet(f"{data}/{name}")
        (df if name.startswith(("name_parts", "lang_samples", "mix_targets")) else df.where("false")).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    for name, f in q.queries().items():
        n = f(spark, str(tmp_path)).count()
        assert n == (7 if name == "p7_shares" else 0), name
