"""Cue matching and fusion on known cases."""

from __future__ import annotations

import pytest

from textevidence.catalog.cues import CUES
from textevidence.operators import dialect, resolver

CHIP = CUES[0][0]


@pytest.fixture(scope="module")
def inferred(spark):
    cases = {
        "empty": "", "null": None, "blank": "  ", "word": "Hello", "english": "The road was closed for repairs all week.",
        "place": "খুলনার মানুষ নদীর পাড়ে থাকে", "roman": "ami sylheti bhashay kotha koi", "long": (CHIP + " ") * 400,
        "khulna": "ami khulnar manush rupsa nodir pare thaki", "emoji": "😀" * 1500,
    }
    df = spark.createDataFrame(list(cases.items()), "id string, text string")
    return {r["id"]: r for r in dialect.infer_dialect(df, "text").collect()}


def test_missing(inferred):
    for k in ("empty", "null", "blank"):
        r = inferred[k]
        assert (r["status"], r["match_score"], r["dialect_label"], r["script_mix"]) == ("missing_transcript", None, None, "unknown")


def test_floors(inferred):
    r = inferred["place"]
    assert (r["status"], r["candidate_dialect_label"], round(r["match_score"], 3)) == ("unresolved", "khulna", 0.711)
    assert inferred["word"]["status"] == inferred["english"]["status"] == "unresolved"
    assert inferred["english"]["script_mix"] == "en"


def test_romanised_and_truncated(inferred):
    assert (inferred["roman"]["dialect_label"], inferred["roman"]["script_mix"], inferred["roman"]["match_score"]) == ("sylhet", "banglish", 1.0)
    assert inferred["khulna"]["dialect_label"] == "khulna"
    assert inferred["long"]["input_truncated"] and inferred["long"]["dialect_label"] == "sylhet"
    assert inferred["emoji"]["input_truncated"]


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(CHIP, "x", 1.0)], "text string, status string, match_score double")
    out = dialect.infer_dialect(df, "text")
    assert out.columns.count("status") == 1 and out.first()["status"] == "suggested"
    assert dialect.infer_dialect(df.where("false"), "text").count() == 0


def test_one_python_pass(spark):
    df = dialect.infer_dialect(spark.createDataFrame([(CHIP,)], "text string"), "text").where("match_score > 0.5")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("best_cue") <= 2 and "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize(
    ("raw", "transcript", "want"),
    [
        ('{"dialect":"sylhet","confidence":0.86,"cues":["সিলেটি"]}', CHIP, ("ok", "suggested", "sylhet", 0.94, "agree", "combined")),
        ('{"dialect":"barishal","confidence":0.95,"cues":["ভাষায়"]}', CHIP, ("ok", "suggested", "barishal", 0.77, "disagree", "vertex_classifier")),
        ('{"dialect":"unresolved","confidence":0.81,"cues":[]}', CHIP, ("ok", "unresolved", None, 0.81, "none", "vertex_classifier")),
        ("not json", CHIP, ("parse_error", "suggested", "sylhet", 1.0, "none", "cue_match")),
        (None, CHIP, ("provider_error", "suggested", "sylhet", 1.0, "none", "cue_match")),
        ("[1]", CHIP, ("parse_error", "suggested", "sylhet", 1.0, "none", "cue_match")),
        ("null", CHIP, ("parse_error", "suggested", "sylhet", 1.0, "none", "cue_match")),
        ('{"dialect":"sylhet","confidence":0.9,"cues":["other"]}', CHIP, ("parse_error", "suggested", "sylhet", 1.0, "none", "cue_match")),
        ('{"dialect":"sylhet","confidence":0.9,"cues":[]}', CHIP, ("parse_error", "suggested", "sylhet", 1.0, "none", "cue_match")),
        ('{"dialect":"sylhet","confidence":1.2,"cues":["সিলেটি"]}', CHIP, ("parse_error", "suggested", "sylhet", 1.0, "none", "cue_match")),
        ('{"dialect":"sylhet","confidence":0.9,"cues":["সিলেটি"],"x":1}', CHIP, ("parse_error", "suggested", "sylhet", 1.0, "none", "cue_match")),
        ('{"dialect":"mars","confidence":0.9,"cues":["সিলেটি"]}', CHIP, ("parse_error", "suggested", "sylhet", 1.0, "none", "cue_match")),
        ('{"dialect":"sylhet","confidence":0.9,"cues":["sylheti"]}', "ami sylheti bhashay kotha koi", ("ok", "suggested", "sylhet", 0.98, "agree", "combined")),
        ("{}", "", ("skipped_missing_transcript", "missing_transcript", None, None, "none", "cue_match")),
    ],
)
def test_resolver(spark, raw, transcript, want):
    df = spark.createDataFrame([(transcript, raw)], "text string, raw string")
    r = resolver.resolve_dialect(df, "text", "raw").first()
    assert (r["classifier_status"], r["status"], r["dialect_label"], r["match_score"], r["agreement"], r["method"]) == want


def test_no_provider(spark):
    r = resolver.resolve_dialect(spark.createDataFrame([(CHIP,)], "text string"), "text").first()
    assert (r["classifier_status"], r["resolve_threshold"], r["dialect_label"]) == ("not_configured", 0.58, "sylhet")
