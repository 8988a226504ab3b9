"""Shapes of the corpus operators' plans."""

from __future__ import annotations

import pytest

pytest.importorskip("textevidence.llm")
from textevidence.llm import queries as q  # noqa: E402


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["p2_canonical", "p3_found", "p4_found", "p4_redacted", "p5_segments", "p6_ids", "p1_repaired"])
def test_texts_stay_in_place(name, spark, data):
    text = plan(q.queries()[name](spark, data))
    assert "Exchange" not in text and "Join" not in text


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p5_found", "p7_mixture", "p8_found", "p8_parts", "p8_lines"])
def test_growing_tables_are_not_broadcast(name, spark, data):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(q.queries()[name](spark, data))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "BroadcastHashJoin" not in text


def test_spans_shuffle_units_and_stretches_only(spark, data):
    text = plan(q.queries()["p8_found"](spark, data))
    assert text.count("Exchange") == 1 and "_text" not in text  # of stretches; units are shuffled before the checkpoint
