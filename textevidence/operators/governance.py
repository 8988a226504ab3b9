"""Consent, redaction, event sinks, limits of requests, and settings as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, utf16_length

#: What consent protects, and limits of requests.
PROTECTED = ["transcript", "audio_sha256", "image_sha256"]
MOST_CHARS, MOST_PHRASES, MOST_FACT_BYTES = 8192, 50, 500_000


def consent(raw: Column) -> Column:
    """True for true, or the texts true, 1 and yes in any case; never for null, numbers or any other type."""
    said = F.lower(strip(raw.cast("string")))
    return F.coalesce(F.when(F.typeof(raw) == "boolean", said == "true").when(F.typeof(raw) == "string", said.isin("true", "1", "yes")), F.lit(False))


def consented_events(events: DataFrame, enabled: bool = True) -> DataFrame:
    """The events that may be kept.  Without the switch there are none; protected columns are nulled besides,
    should a row without consent ever get this far."""
    kept = events.where(F.coalesce(F.col("consent"), F.lit(False)) & F.lit(enabled))
    return kept.withColumns({c: F.when(F.col("consent"), F.col(c)) for c in PROTECTED if c in events.columns})


def corpus_projection(events: DataFrame) -> DataFrame:
    """(event_id, dialect_label, dialect_match_score, method, classifier_status, classifier_confidence): missing columns as null."""
    names = {"dialect_label": "string", "dialect_match_score": "double", "method": "string", "classifier_status": "string", "classifier_confidence": "double"}
    return events.select("event_id", *[(F.col(c) if c in events.columns else F.lit(None)).cast(t).alias(c) for c, t in names.items()])


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def append_events(events: DataFrame, path: str, enabled: bool = True) -> None:
    """Append the consented events as JSON lines."""
    consented_events(events, enabled).withColumn("schema_version", F.lit("corpus_event.v1")).write.mode("append").json(path)


def append_usage(usage: DataFrame, path: str) -> None:
    """Append usage lines (consumer, ok): no token and no content."""
    usage.select(F.lit("usage_event.v1").alias("schema_version"), F.current_timestamp().alias("ts"), "consumer", "ok").write.mode("append").json(path)


def key_map(raw: Column) -> Column:
    """name -> key of a JSON object or of name:key entries between commas or lines; what is malformed is skipped,
    of a name given twice the last stays."""
    text = strip(F.coalesce(raw, F.lit("")))
    parsed = F.from_json(F.when(text.startswith("{") & F.try_parse_json(text).isNotNull(), text), "map<string,string>")
    of_json = F.transform(F.map_entries(parsed), lambda e: F.struct(strip(e["key"]).alias("key"), strip(e["value"]).alias("value")))
    listed = F.transform(F.split(text, "[,\n]"), lambda e: F.struct(strip(F.regexp_extract(e, "(?s)^([^:]*):(.*)", 1)).alias("key"), strip(F.regexp_extract(e, "(?s)^([^:]*):(.*)", 2)).alias("value")))
    entries = F.filter(F.coalesce(of_json, listed), lambda e: (e["key"] != "") & (e["value"] != ""))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def match_consumer(tokens: DataFrame, keys: DataFrame) -> DataFrame:
    """(token_id, consumer): named keys (name, key) by digest, else ``legacy`` for shared keys (null name), else null.
    Several keys of one digest give the least name."""
    known = keys.select(F.sha2("key", 256).alias("digest"), "name").groupBy("digest").agg(F.min("name").alias("name"))
    joined = tokens.select("token_id", F.sha2("token", 256).alias("digest")).join(known.withColumn("_known", F.lit(True)), "digest", "left")
    return joined.select("token_id", F.when(F.col("_known"), F.coalesce("name", F.lit("legacy"))).alias("consumer"))


def auth_decisions(requests: DataFrame, keys: DataFrame, bypass: bool = False) -> DataFrame:
    """(request_id, status, consumer) of requests (request_id, authorization) against keys (name, key): 403 for all
    when no key is set at all (unless ``bypass``, for local work), 401 without a token or for an unknown one, else
    200 with the consumer's name.  A projection of what would be decided; it guards nothing."""
    usable = keys.where(strip(F.coalesce("key", F.lit(""))) != "")
    tokens = requests.select("request_id", bearer(F.col("authorization")).alias("token"))
    matched = match_consumer(tokens.withColumnRenamed("request_id", "token_id"), usable).withColumnRenamed("token_id", "request_id")
    some = usable.agg((F.count("*") > 0).alias("_some"))  # one row
    status = F.when(~F.col("_some"), 200 if bypass else 403).when(F.col("consumer").isNull(), 401).otherwise(200)
    return matched.join(F.broadcast(some)).select("request_id", status.alias("status"), "consumer")


def bearer(header: Column) -> Column:
    """The token of a bearer header; null without one."""
    return F.nullif(strip(F.regexp_extract(header, r"(?is)^\s*bearer\s+(.*)\z", 1)), F.lit(""))


def first_set(df: DataFrame, names: list[str]) -> tuple[Column, Column]:
    """The first non-blank of the columns ``names``, and the name that gave it."""
    values = [(n, F.nullif(strip(F.col(n)), F.lit(""))) for n in names]
    value, source = F.coalesce(*[v for _, v in values]), F.when(values[0][1].isNotNull(), names[0])
    for n, v in values[1:]:
        source = source.when(v.isNotNull(), n)
    return value, source


def dialect_request_status(body_bytes: Column, text: Column) -> Column:
    """413 beyond the bytes of a body or the characters of a text, else 200; a null text is no error."""
    return F.when(body_bytes > 65_536, 413).when(utf16_length(F.coalesce(text, F.lit(""))) > MOST_CHARS, 413).otherwise(200)


def phrase_requests(phrases: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, phrases, characters, status) per request: 400 for more than 50 phrases, 413 for more than 8192 characters."""
    out = phrases.groupBy(key).agg(F.count("*").alias("phrases"), F.sum(F.coalesce(utf16_length(F.col(text_col)), F.lit(0))).alias("characters"))
    return out.withColumn("status", F.when(F.col("phrases") > MOST_PHRASES, 400).when(F.col("characters") > MOST_CHARS, 413).otherwise(200))


def facts_request_status(text: Column) -> Column:
    """400 for a blank text or one of more than 500,000 bytes, else 200."""
    return F.when((strip(F.coalesce(text, F.lit(""))) == "") | (F.octet_length(text) > MOST_FACT_BYTES), 400).otherwise(200)
