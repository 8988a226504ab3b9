"""Scoring against gold rows, roll-ups and thresholds.  Gate rows can fail a run, probe rows are only reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import token_f1
from ..functions.text import norm_compare, strip

#: Thresholds.
DIALECT_MIN, TEXT_MIN, OCR_F1_MIN, STT_F1_MIN = 1.0, 1.0, 0.9, 0.6


def score_dialect(gold: DataFrame, evidence: DataFrame) -> DataFrame:
    """Gold rows (id, gate, expected_status, expected_dialect_label) with what was observed (id, status,
    dialect_label) and pass.  A row without evidence fails; it is not skipped."""
    seen = evidence.select("id", F.col("status").alias("observed_status"), F.col("dialect_label").alias("observed_label"))
    right = (F.col("observed_status") == F.col("expected_status")) & F.col("observed_label").eqNullSafe(F.col("expected_dialect_label"))
    return gold.join(seen, "id", "left").withColumns({"label": F.coalesce("expected_dialect_label", F.lit("(none)")), "pass": F.coalesce(right, F.lit(False))})


def per_label(scored: DataFrame) -> DataFrame:
    """(label, total, passed, accuracy) of the gate rows."""
    return scored.where("gate").groupBy("label").agg(F.count("*").alias("total"), F.count_if(F.col("pass")).alias("passed")).withColumn("accuracy", F.col("passed") / F.col("total"))


def totals(scored: DataFrame) -> DataFrame:
    """One row: gate_total, gate_passed, gate_accuracy, probe_total, probe_matched; an empty gate has accuracy 0."""
    gate = F.coalesce(F.col("gate"), F.lit(False))
    out = scored.agg(F.count_if(gate).alias("gate_total"), F.count_if(gate & F.col("pass")).alias("gate_passed"), F.count_if(~gate).alias("probe_total"), F.count_if(~gate & F.col("pass")).alias("probe_matched"))
    return out.withColumn("gate_accuracy", F.coalesce(F.try_divide("gate_passed", "gate_total"), F.lit(0.0)))


def score_texts(rows: DataFrame, expected: str, observed: str, exact: Column, f1_min: float = OCR_F1_MIN, problems: Column | None = None) -> DataFrame:
    """Adds metric, score and pass: exact rows must be equal in comparison form, others reach the token F1."""
    a, b = norm_compare(F.col(expected)), norm_compare(F.col(observed))
    clean = F.lit(True) if problems is None else F.size(problems) == 0
    step = rows.withColumns({"_a": a, "_b": b, "_exact": F.coalesce(exact, F.lit(False))})
    score = F.when(F.col("_exact"), (F.col("_a") == F.col("_b")).cast("double")).otherwise(token_f1(F.col("_a"), F.col("_b")))
    step = step.withColumn("metric", F.when(F.col("_exact"), "exact").otherwise("token_f1")).withColumn("score", score)
    return step.withColumn("pass", (F.col("score") >= F.when(F.col("_exact"), 1.0).otherwise(f1_min)) & clean).drop("_a", "_b", "_exact")


def missing_schemas(expected: Column, observed: Column) -> Column:
    """Expected schemas that were not observed."""
    return F.array_except(F.coalesce(expected, F.array().cast("array<string>")), F.coalesce(observed, F.array().cast("array<string>")))


def speech_problems(fallback: Column, bn: Column, raw: Column, status: Column, provider: Column, model: Column) -> Column:
    """What is wrong with a transcription's answer, in fixed order."""
    some = F.array_compact(F.array(
        F.when(fallback.isNull(), "fallback must be false on success"),
        F.when(strip(F.coalesce(bn, F.lit(""))) == "", "transcript_bn missing or empty"),
        F.when(raw.isNull(), "transcript_raw missing"),
        F.when(status.isNull(), "dialect evidence missing (expected DialectInference with status)"),
        F.when((F.coalesce(provider, F.lit("")) == "") | (F.coalesce(model, F.lit("")) == ""), "stt_provenance.provider/model missing"),
    ))
    return F.when(fallback, F.array(F.lit("fallback:true (no STT vendor served the request)"))).otherwise(some)


def page_problems(expected: Column, pages: Column) -> Column:
    """What is wrong with a document's number of pages: nothing where none is expected; a null list counts as null."""
    got = F.when(pages.isNotNull(), F.size(pages))
    text = F.concat(F.lit("pages: expected "), expected.cast("string"), F.lit(", got "), F.coalesce(got.cast("string"), F.lit("null")))
    return F.array_compact(F.array(F.when(expected.isNotNull() & ~got.eqNullSafe(expected), text)))


def score_speech(rows: DataFrame, gold: str, transcript: str, problems: str, fallback: str, f1_min: float = STT_F1_MIN, allow_fallback: bool = False) -> DataFrame:
    """Adds score (null without a gold transcript), all_problems, pass and downgraded to rows with the problems of
    ``speech_problems``.  A fallback fails, unless it is allowed and the only problem: then it is downgraded."""
    fell = F.coalesce(F.col(fallback), F.lit(False))
    score = F.when(F.coalesce(F.col(gold), F.lit("")) != "", token_f1(norm_compare(F.col(gold)), norm_compare(F.coalesce(F.col(transcript), F.lit("")))))
    low = F.when(~fell & (F.col("score") < f1_min), F.concat(F.lit("transcript token-F1 "), F.format_string("%.3f", F.col("score")), F.lit(f" < {f1_min:g}")))
    step = rows.withColumn("score", score).withColumn("all_problems", F.concat(F.col(problems), F.array_compact(F.array(low))))
    only = F.forall("all_problems", lambda p: p.startswith("fallback:true"))
    return step.withColumn("pass", (F.size("all_problems") == 0) | (F.lit(allow_fallback) & fell & only)).withColumn("downgraded", F.lit(allow_fallback) & fell)


def suite_failures(dialect: DataFrame | None = None, labels: DataFrame | None = None, texts: DataFrame | None = None, speech: DataFrame | None = None, negatives: DataFrame | None = None, health: DataFrame | None = None, dialect_min: float = DIALECT_MIN, negatives_min: float = 1.0) -> DataFrame | None:
    """(place, key, failure) of all suites that ran, in the order place, key; no row: the run passes.

    dialect: the row of ``totals``; labels: rows of ``per_label``; texts: (id, kind, metric, score, gate, pass);
    speech: (id, all_problems, pass); negatives: (id, expected, observed, pass) with expected an array of statuses;
    health: (pass, problem).  A suite that did not run is left out (null), which is no pass.
    """
    number = lambda c: F.format_string("%.3f", c)
    parts = []
    if dialect is not None:
        text = F.concat(F.lit("dialect gate accuracy "), number(F.col("gate_accuracy")), F.lit(f" < {dialect_min:g} ("), F.col("gate_passed").cast("string"), F.lit("/"), F.col("gate_total").cast("string"), F.lit(")"))
        parts.append(dialect.where(F.col("gate_accuracy") < dialect_min).select(F.lit(1).alias("place"), F.lit("").alias("key"), text.alias("failure")))
    if labels is not None:
        parts.append(threshold_failures(labels, dialect_min).select(F.lit(2).alias("place"), F.col("label").alias("key"), "failure"))
    if texts is not None:
        text = F.concat(F.lit("ocr "), F.col("id").cast("string"), F.lit(" ("), F.col("kind"), F.lit("/"), F.col("metric"), F.lit(") score "), number(F.col("score")), F.lit(" failed its gate"))
        parts.append(texts.where("gate and not pass").select(F.lit(3).alias("place"), F.col("id").cast("string").alias("key"), text.alias("failure")))
    if speech is not None:
        text = F.concat(F.lit("stt "), F.col("id").cast("string"), F.lit(": "), F.array_join("all_problems", "; "))
        parts.append(speech.where("not pass").select(F.lit(4).alias("place"), F.col("id").cast("string").alias("key"), text.alias("failure")))
    if negatives is not None:
        sums = negatives.agg(F.count("*").alias("total"), F.count_if(F.col("pass")).alias("passed")).where(F.coalesce(F.try_divide("passed", "total"), F.lit(0.0)) < negatives_min)
        text = F.concat(F.lit("negative-path checks "), F.col("passed").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(f" < {negatives_min:g}"))
        parts.append(sums.select(F.lit(5).alias("place"), F.lit("").alias("key"), text.alias("failure")))
        text = F.concat(F.lit("negative "), F.col("id").cast("string"), F.lit(": expected HTTP "), F.array_join(F.col("expected").cast("array<string>"), "|"), F.lit(", got "), F.coalesce(F.col("observed").cast("string"), F.lit("null")))
        parts.append(negatives.where("not pass").select(F.lit(6).alias("place"), F.col("id").cast("string").alias("key"), text.alias("failure")))
    if health is not None:
        parts.append(health.where("not pass").select(F.lit(7).alias("place"), F.lit("").alias("key"), F.concat(F.lit("health: "), F.col("problem")).alias("failure")))
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def latency(samples: DataFrame, route: str, ms: str) -> DataFrame:
    """(route, count, avg_ms, max_ms): rounded half up; null times are left out."""
    out = samples.where(F.col(ms).isNotNull()).groupBy(F.col(route).alias("route"))
    return out.agg(F.count("*").alias("count"), F.floor(F.avg(ms) + 0.5).cast("long").alias("avg_ms"), F.floor(F.max(ms) + 0.5).cast("long").alias("max_ms"))


def threshold_failures(labels: DataFrame, minimum: float = DIALECT_MIN) -> DataFrame:
    """(label, failure) of the labels whose accuracy is below the minimum."""
    text = F.concat(F.lit('dialect label "'), F.col("label"), F.lit('" accuracy '), F.format_string("%.3f", F.col("accuracy")), F.lit(f" < {minimum:g} ("), F.col("passed").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(")"))
    return labels.where(F.col("accuracy") < minimum).select("label", text.alias("failure"))


def batches(rows: DataFrame, id_col: str, size: int = 50, buckets: int | None = None) -> DataFrame:
    """Adds batch: chunks of at most ``size`` rows.  Rows are numbered within buckets of a digest of the id (as many
    as shuffle partitions, unless given), so no task numbers all rows; only the last chunk of a bucket may be smaller."""
    buckets = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64(id_col), F.lit(buckets))
    chunk = F.floor((F.row_number().over(Window.partitionBy("_bucket").orderBy(id_col)) - 1) / size)
    return rows.withColumn("_bucket", bucket).withColumn("batch", F.concat_ws("-", F.col("_bucket").cast("string"), chunk.cast("string"))).drop("_bucket")


def write_report(parts: dict[str, DataFrame], path: str) -> None:
    """Write each part of an evaluation as JSON lines below ``path``."""
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
