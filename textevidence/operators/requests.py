"""Batch forms of the request flows: phrases to evidence, and speech answers to transcripts with evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.script import ratio_tag
from ..functions.text import norm_transcript, utf16_length
from .dialect import infer_dialect
from .evaluation import batches
from .governance import MOST_CHARS, MOST_PHRASES
from .providers import first_success
from .resolver import resolve_dialect


def evaluate_phrases(phrases: DataFrame, id_col: str, text_col: str, size: int = MOST_PHRASES) -> DataFrame:
    """(id, batch, phrase, characters, normalized, the columns of ``infer_dialect``, status_code): each phrase with its
    evidence, in batches of at most ``size``.  413 where a batch has more than 8192 characters; its phrases keep
    their evidence for review.  Null phrases count as empty."""
    base = phrases.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("phrase"))
    step = batches(base, id_col, size).withColumns({"characters": utf16_length(F.col("phrase")), "normalized": norm_transcript(F.col("phrase"))})
    sums = step.groupBy("batch").agg(F.sum("characters").alias("_sum"))
    step = step.join(sums.hint("merge"), "batch").withColumn("status_code", F.when(F.col("_sum") > MOST_CHARS, 413).otherwise(200)).drop("_sum")
    return infer_dialect(step, "phrase")


def assemble_transcripts(attempts: DataFrame, key: str, raw_col: str | None = None) -> DataFrame:
    """(key, transcript_raw, transcript_bn, language, stt_provider, fallback, the columns of ``resolve_dialect``) from
    attempts (key, priority, provider, answer, error) of speech engines: the first that succeeds gives the transcript.
    ``raw_col`` names a classifier's raw answer on the attempts (the same on all of a key).  Where none succeeded
    fallback is true and the transcript null."""
    best = first_success(attempts, key).withColumnRenamed("answer", "transcript_raw").withColumnRenamed("provider", "stt_provider").drop("attempts", "errors")
    step = best.withColumn("transcript_bn", norm_transcript(F.col("transcript_raw"))).withColumn("language", ratio_tag(F.col("transcript_bn")))
    if raw_col:
        step = step.join(attempts.groupBy(key).agg(F.min(raw_col).alias("_raw")).hint("merge"), key)
    return resolve_dialect(step, "transcript_bn", "_raw" if raw_col else None).drop("_raw")
