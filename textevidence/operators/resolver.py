"""Fusion of cue evidence with answers of an optional classifier.

The classifier's raw answers are a table; a failed call is a null answer.  A strict parser turns each answer
into a struct with an error, never into an exception.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog.cues import FLOOR, REGIONS, VARIANTS
from ..functions.script import has_bengali_script, presence_tag
from ..functions.text import clamp_score, norm_match, strip
from .dialect import infer_dialect, region_of

#: Floor of a resolved classifier answer, boost of agreement, penalty of disagreement.
RESOLVE_FLOOR, BOOST, PENALTY = 0.72, 0.08, 0.18


def parse_answers(df: DataFrame, raw: Column, transcript: Column) -> DataFrame:
    """Adds answer_dialect, answer_confidence, answer_cues and answer_error of a classifier's raw JSON answer.

    The answer must be an object with exactly confidence, cues and dialect; the dialect known or unresolved; the
    confidence a number in [0, 1]; cues strings that stand in the transcript word for word; and a regional
    dialect needs at least one, each in Bengali script or, in a romanised transcript, with a known romanised
    word.  A null answer is a failed call.  Steps are columns of their own, so that each is worked out once.
    """
    part = lambda name: F.try_variant_get("_value", f"$.{name}", "variant")
    step = df.withColumns({"_body": strip(raw), "_text": transcript})
    step = step.withColumns({"_value": F.try_parse_json("_body"), "_keys": F.concat_ws(",", F.array_sort(F.json_object_keys("_body"))), "_match": norm_match(F.col("_text"))})
    step = step.withColumns({
        "_is_object": F.coalesce(F.schema_of_variant("_value").startswith("OBJECT"), F.lit(False)),
        "_is_text": F.coalesce(F.schema_of_variant(part("dialect")) == "STRING", F.lit(False)),
        "_is_number": F.coalesce(F.schema_of_variant(part("confidence")).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"), F.lit(False)),
        "_are_texts": F.coalesce(F.schema_of_variant(part("cues")).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False)),
        "answer_dialect": F.try_variant_get("_value", "$.dialect", "string"),
        "answer_confidence": F.try_variant_get("_value", "$.confidence", "double"),
        "answer_cues": F.filter(F.transform(F.try_variant_get("_value", "$.cues", "array<string>"), strip), lambda c: c != ""),
        "_romanised": presence_tag(F.col("_text"), F.col("_match")) == "banglish",
    })
    known = lambda c: F.size(F.filter(F.split(F.lower(c), "[^a-z]+"), lambda t: t.isin(*VARIANTS))) > 0
    step = step.withColumns({
        "_regional": ~F.col("answer_dialect").isin("unresolved", "dhaka"),
        "_outside": F.exists("answer_cues", lambda c: ~F.contains(F.col("_text"), c)),
        "_foreign": F.exists("answer_cues", lambda c: ~has_bengali_script(c) & ~(F.col("_romanised") & known(c))),
    })
    error = (
        F.when(F.col("_body").isNull(), "provider_error")
        .when(F.col("_value").isNull() & (F.col("_body") != "null"), "not_json")
        .when(~F.col("_is_object"), "not_object")
        .when(F.col("_keys") != "confidence,cues,dialect", "wrong_keys")
        .when(~F.col("_is_text") | ~F.col("answer_dialect").isin("unresolved", *REGIONS), "unknown_dialect")
        .when(~F.col("_is_number") | (F.col("answer_confidence") < 0) | (F.col("answer_confidence") > 1), "bad_confidence")
        .when(~F.col("_are_texts"), "bad_cues")
        .when(F.col("_outside"), "cue_not_in_transcript")
        .when(F.col("_regional") & (F.size("answer_cues") == 0), "no_cue")
        .when(F.col("_regional") & F.col("_foreign"), "cue_not_bengali")
    )
    return step.withColumn("answer_error", error).drop("_body", "_text", "_value", "_keys", "_match", "_is_object", "_is_text", "_is_number", "_are_texts", "_romanised", "_regional", "_outside", "_foreign")


def fuse(df: DataFrame, classifier: Column, confidence: Column) -> DataFrame:
    """Adds fused_confidence, agreement and resolved to rows of cue evidence (dialect_label,
    candidate_dialect_label, match_score); ``classifier`` is its dialect, null if unresolved.

    A cue counts from the general floor on, even below a curated one.  Agreement adds 0.08, disagreement takes 0.18.
    Without a confidence the fused one is null, and nothing is resolved.
    """
    cue = F.coalesce("dialect_label", "candidate_dialect_label")
    counts = classifier.isNotNull() & cue.isNotNull() & F.coalesce(F.col("match_score") >= FLOOR, F.lit(False))
    agreement = F.when(counts & (cue == classifier), "agree").when(counts, "disagree").otherwise("none")
    step = df.withColumn("agreement", agreement)
    moved = F.when(confidence.isNull(), F.lit(None).cast("double")).when(F.col("agreement") == "agree", F.least(F.lit(1.0), confidence + BOOST)).when(F.col("agreement") == "disagree", F.greatest(F.lit(0.0), confidence - PENALTY)).otherwise(confidence)
    return step.withColumn("fused_confidence", clamp_score(moved, 3)).withColumn("resolved", classifier.isNotNull() & F.coalesce(F.col("fused_confidence") >= RESOLVE_FLOOR, F.lit(False)))


def resolve_dialect(df: DataFrame, text_col: str, raw_col: str | None = None, configured: bool = True) -> DataFrame:
    """Cue evidence of each row, fused with the classifier's raw answer in ``raw_col`` (null: the call failed).

    Adds the columns of ``infer_dialect`` and classifier_status, classifier_dialect, classifier_confidence, cues,
    agreement, resolve_threshold.  Without a provider or an acceptable answer the cue evidence stands.
    """
    base = infer_dialect(df, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = F.col(raw_col) if raw_col else F.lit(None).cast("string")
    step = parse_answers(base, raw, text)
    error = F.col("answer_error")
    status = F.when(F.col("status") == "missing_transcript", "skipped_missing_transcript").when(F.lit(not configured or raw_col is None), "not_configured").when(error == "provider_error", "provider_error").when(error.isNotNull(), "parse_error").otherwise("ok")
    step = step.withColumn("classifier_status", status)
    ok = F.col("classifier_status") == "ok"
    answer = F.when(F.col("answer_dialect") != "unresolved", F.col("answer_dialect"))
    given = clamp_score(F.col("answer_confidence"), 3)
    step = fuse(step.withColumns({"_dialect": F.when(ok, answer), "classifier_confidence": F.when(ok, given)}), F.col("_dialect"), F.col("classifier_confidence"))
    resolved, region = ok & F.col("resolved"), region_of(F.col("_dialect"))
    method = F.when(F.col("agreement") == "agree", "combined").otherwise("vertex_classifier")
    return step.withColumns({
        "method": F.when(ok, method).otherwise(F.col("method")),
        "source": F.when(ok, method).otherwise(F.col("source")),
        "candidate_label": F.when(ok & F.col("_dialect").isNotNull(), F.concat(F.lit("Vertex classifier "), F.coalesce(region, F.col("_dialect")))).otherwise(F.col("candidate_label")),
        "candidate_dialect_label": F.when(ok, F.coalesce("_dialect", "candidate_dialect_label")).otherwise(F.col("candidate_dialect_label")),
        "status": F.when(resolved, "suggested").when(ok, "unresolved").otherwise(F.col("status")),
        "dialect_label": F.when(resolved, F.col("_dialect")).when(~ok, F.col("dialect_label")),
        "speaker_region": F.when(resolved, region).when(~ok, F.col("speaker_region")),
        "match_score": F.when(ok, F.col("fused_confidence")).otherwise(F.col("match_score")),
        "confidence": F.when(ok, F.col("fused_confidence")).otherwise(F.col("match_score")),
        "classifier_dialect": F.when(ok, F.col("answer_dialect")),
        "cues": F.when(ok, F.col("answer_cues")).otherwise(F.array().cast("array<string>")),
        "agreement": F.when(ok, F.col("agreement")).otherwise("none"),
        "resolve_threshold": F.when(ok, RESOLVE_FLOOR).otherwise(FLOOR),
    }).drop("answer_dialect", "answer_confidence", "answer_cues", "answer_error", "_dialect", "fused_confidence", "resolved")

