"""Provider chains over tables of attempts, and coercion of what models answer.

No network: an attempt is a row; the first that succeeds within the budget wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, strip

#: Budgets of one model and of the chain in ms, and the default models.
MODEL_MS, CHAIN_MS = 18_000, 54_000
DEFAULT_MODELS = ["xiaomi/mimo-v2.5", "qwen/qwen3-vl-8b-instruct", "qwen/qwen3-vl-30b-a3b-instruct"]


def first_success(attempts: DataFrame, key: str, answer: str = "answer") -> DataFrame:
    """(key, provider, answer, attempts, errors, fallback): of (key, priority, provider, answer, error) rows the
    first by priority with an answer and no error; ties by provider.  fallback: none succeeded."""
    ok = F.col(answer).isNotNull() & F.col("error").isNull()
    out = attempts.groupBy(key).agg(
        F.min(F.when(ok, F.struct("priority", "provider", F.col(answer).alias("answer")))).alias("best"),
        F.count("*").alias("attempts"),
        F.count_if(~ok).alias("errors"),
    )
    return out.select(key, F.col("best.provider").alias("provider"), F.col("best.answer").alias("answer"), "attempts", "errors", F.col("best").isNull().alias("fallback"))


def within_budget(attempts: DataFrame, key: str, model_ms: int = MODEL_MS, chain_ms: int = CHAIN_MS) -> DataFrame:
    """Adds started_ms, spent_ms and skipped: each attempt costs at most the model's budget, and none begins once
    the chain's is spent.  Chains are short; their rows meet in one window per key."""
    order = Window.partitionBy(key).orderBy("priority", "provider")
    cost = F.least(F.coalesce(F.col("ms"), F.lit(0)), F.lit(model_ms))
    started = F.coalesce(F.sum(cost).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return attempts.withColumn("started_ms", started).withColumn("skipped", F.col("started_ms") >= chain_ms).withColumn("spent_ms", F.when(F.col("skipped"), 0).otherwise(cost))


def model_list(configured: Column, legacy: Column, models: list[str] | None = None) -> Column:
    """The configured models, trimmed and each once; else the legacy one before the defaults (``models``, or the
    fixed ones); else the defaults."""
    named = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(configured, F.lit("")), ","), strip), lambda m: m != ""))
    defaults = F.array(*[F.lit(m) for m in models or DEFAULT_MODELS])
    old = strip(F.coalesce(legacy, F.lit("")))
    return F.when(F.size(named) > 0, named).when(old != "", F.array_distinct(F.concat(F.array(old), defaults))).otherwise(defaults)


def text_confidence(text: Column, blocked: Column, finish: Column) -> Column:
    """A stand-in for confidence: 0.1 for nothing or a broken answer, else by the share of visible characters."""
    broken = F.coalesce(blocked, F.lit(False)) | (F.coalesce(finish, F.lit("STOP")) != "STOP") | (F.coalesce(text, F.lit("")) == "")
    seen = F.length(F.regexp_replace(text, f"[{WS}]", ""))
    return F.when(broken, 0.1).otherwise(F.floor(F.least(F.lit(1.0), seen / F.length(text) + 0.5) * 100 + 0.5) / 100)


def repair_json(raw: Column) -> Column:
    """A model's answer as a variant: as it is, without a code fence, or its outermost braces; else null."""
    bare = strip(F.regexp_replace(F.regexp_replace(raw, rf"^```[A-Za-z]*[{WS}]*", ""), rf"[{WS}]*```\z", ""))
    block = F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(bare), F.try_parse_json(block))


def coerce_intent(parsed: Column) -> Column:
    """struct of an image's intent with every field of its type: wrong or missing texts by default, lists as
    texts, the confidence held in [0, 1] with 0.5 for none."""

    def text(name: str, default: str = "") -> Column:
        value = F.try_variant_get(parsed, f"$.{name}", "variant")
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(parsed, f"$.{name}", "string")).otherwise(default).alias(name)

    def texts(name: str) -> Column:
        return F.coalesce(F.try_variant_get(parsed, f"$.{name}", "array<string>"), F.array().cast("array<string>")).alias(name)

    kind = F.schema_of_variant(F.try_variant_get(parsed, "$.confidence", "variant"))
    number = F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"), F.try_variant_get(parsed, "$.confidence", "double"))
    confidence = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)), F.lit(0.5)).alias("confidence")
    return F.struct(text("object_label", "unknown"), text("scene"), text("intent_guess"), text("text_in_image"), text("language", "unknown"), texts("category_hints"), texts("condition_hints"), confidence)


def coerce_image_intent(df: DataFrame, id_col: str, raw_col: str) -> DataFrame:
    """(id, the fields of an image's intent, fallback): fallback where no JSON object could be read."""
    step = df.select(id_col, repair_json(F.col(raw_col)).alias("_v"))
    return step.select(id_col, coerce_intent(F.col("_v")).alias("r"), F.coalesce(~F.schema_of_variant("_v").startswith("OBJECT"), F.lit(True)).alias("fallback")).select(id_col, "r.*", "fallback")


def join_parts(parts: Column) -> Column:
    """Texts of an answer's parts (structs with type and text), one line each."""
    return F.array_join(F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"]), "\n")
