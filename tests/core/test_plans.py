"""Shapes of plans: what must not be shuffled is not, and scans read only what they need."""

from __future__ import annotations

import re

import pytest

from textevidence.operators import documents, evaluation, extract, facts
from textevidence.plans import registry


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["script_ratio", "script_presence", "intake_preview", "facts_of_pages", "fact_rows", "norm_forms", "markup_text", "json_repair", "image_intents_coerced", "consent_filter_hash"])
def test_projections_stay_in_one_stage(name, spark, data):
    text = plan(registry.queries()[name](spark, data))
    assert "Exchange" not in text and "Join" not in text


@pytest.mark.parametrize("name", ["script_ratio", "facts_of_pages", "fact_rows", "markup_text", "json_repair", "consent_filter_hash"])
def test_no_python_where_expressions_do(name, spark, data):
    text = plan(registry.queries()[name](spark, data))
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


def test_columns_and_filters_reach_the_scan(spark, data):
    text = plan(registry.queries()["consent_filter_hash"](spark, data))
    assert re.search(r"PushedFilters: \[.*consent", text)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"event_id", "audio_sha256", "image_sha256", "transcript", "consent"}


def test_extraction_is_one_pass(spark, data):
    pages = spark.read.parquet(f"{data}/pdf_pages.parquet")
    for df in (extract.extract_fields(pages, "page_id", "text").where("field = 'email'"), documents.document_payload(pages, "page_id", "text").where("extractable")):
        text = plan(df)
        assert text.count("ArrowEvalPython") == 1 and "Exchange" not in text and "Join" not in text


def test_rollups_shuffle_once(spark, data):
    pages = spark.read.parquet(f"{data}/pdf_pages.parquet")
    assert plan(documents.ocr_provenance(pages)).count("Exchange hashpartitioning") == 1
    events = spark.read.parquet(f"{data}/image_intents.parquet").selectExpr("provenance.provider as p", "provenance.latency_ms as ms")
    text = plan(evaluation.latency(events, "p", "ms"))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_" in text


def test_facts_table_is_codegen(spark, data):
    assert "*(1) Project" in plan(facts.fact_table(spark.read.parquet(f"{data}/documents.parquet"), "doc_id", "text"))
