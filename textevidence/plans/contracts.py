"""Queries of the small contracts (statuses, kinds, forms, scores) over whole tables, with SQL written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import script, similarity, text
from ..operators import dialect, documents, evaluation, extract, facts, governance, providers, requests
from ..sources import intake
from .registry import _t, query

_ASTRAL = r"[^\x{10000}-\x{10FFFF}]"
_TRIM = "chr(9) || chr(10) || chr(13) || ' '"


def _cycle(key: str, values: list[str | None]):
    """One of ``values`` in turn, by a whole number."""
    out = F.when(F.col(key) % len(values) == 0, F.lit(values[0]).cast("string"))
    for i, v in enumerate(values[1:], 1):
        out = out.when(F.col(key) % len(values) == i, F.lit(v).cast("string"))
    return out


@query(
    """
select event_id, coalesce(consent, false) as from_flag, false as from_number, case event_id % 7 when 0 then true when 1 then true when 2 then true else false end as from_text from corpus_events"""
)
def consent_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "corpus_events").select("event_id", "consent", (F.col("event_id") % 2).alias("number"), _cycle("event_id", [" TRUE ", "1", "Yes", "no", "2", "", None]).alias("said"))
    return rows.select("event_id", *[governance.consent(F.col(c)).alias(n) for c, n in (("consent", "from_flag"), ("number", "from_number"), ("said", "from_text"))])


@query("select true as within, true as filled, count(*) as rows from customer")
def batch_sizes(spark: SparkSession, d: str) -> DataFrame:
    made = evaluation.batches(_t(spark, d, "customer").select("c_custkey"), "c_custkey").groupBy("batch").agg(F.count("*").alias("n"))
    return made.agg((F.max("n") <= 50).alias("within"), (F.min("n") >= 1).alias("filled"), F.sum("n").alias("rows"))


@query(
    f"""
with u as (select event_id, transcript as t, coalesce(length(transcript), 0) + coalesce(length(regexp_replace(transcript, '{_ASTRAL}', '', 'g')), 0) as units, coalesce(strlen(transcript), 0) as bytes from corpus_events)
select event_id, case when bytes > 65536 or units > 8192 then 413 else 200 end as dialect_status, case when trim(coalesce(t, ''), {_TRIM}) = '' or bytes > 500000 then 400 else 200 end as facts_status,
  case when t is null then null else 200 end as body_status from u"""
)
def request_statuses(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("transcript")
    body = F.when(t.isNotNull(), intake.body_status(F.to_json(F.struct(F.substring(t, 1, 100).alias("text")))))
    return _t(spark, d, "corpus_events").select("event_id", governance.dialect_request_status(F.coalesce(F.octet_length(t), F.lit(0)), t).alias("dialect_status"), governance.facts_request_status(t).alias("facts_status"), body.alias("body_status"))


@query(
    """
select c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') as digits, (c_custkey % 900 + 100)::varchar || '1234' || case when c_custkey % 2 = 0 then '.50' else '' end as amount,
  case c_custkey % 5 when 0 then 'key' || c_custkey::varchar when 1 then 'two words' else null end as token,
  case c_custkey % 6 when 0 then 10 when 1 then 10 when 2 then 7 when 3 then 1 when 4 then 50 else 12 end as bounded,
  case c_custkey % 3 when 0 then 'transaction amount BDT' when 1 then 'CET1 ratio' else 'working hours per week' end as label from customer"""
)
def small_forms(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    money = F.concat(F.lit("00"), (k % 900 + 100).cast("string"), F.lit(",1,234"), F.when(k % 2 == 0, ".50").otherwise(""))
    header = F.when(k % 5 == 0, F.concat(F.lit("Bearer key"), k.cast("string"), F.lit("  "))).when(k % 5 == 1, "bearer   two words").when(k % 5 == 2, "Basic abc").when(k % 5 == 3, "Bearer   ")
    label = _cycle("c_custkey", ["transaction_amount_bdt", "cet1_ratio", "working_hours_per_week"])
    raw = _cycle("c_custkey", [None, "abc", "7.9", "0", "999", " 12 "])
    return _t(spark, d, "customer").select("c_custkey", text.digits_only(F.col("c_name")).alias("digits"), text.amount(money).alias("amount"), governance.bearer(header).alias("token"), documents.bounded_int(raw, documents.OCR_PAGES).alias("bounded"), text.fact_label(label).alias("label"))


@query(
    """
select p_partkey, case p_partkey % 5 when 0 then 'audio/wav' when 1 then 'audio/webm' when 2 then 'audio/ogg' when 3 then 'video/mp4' else null end as kind,
  case p_partkey % 5 when 3 then 415 when 4 then 415 else case when p_partkey % 4 = 0 then 400 else 200 end end as status,
  case p_partkey % 4 when 1 then 'image/jpeg' else 'image/png' end as scan, case p_partkey % 4 when 1 then 'image/jpeg' when 2 then 'image/png' when 3 then 'image/webp' else 'image/jpeg' end as photo,
  case p_partkey % 6 when 0 then 'ben+eng' when 1 then 'ben+eng' when 2 then 'eng' when 3 then 'ben' when 4 then 'eng' else 'fra' end as language from part"""
)
def media_kinds(spark: SparkSession, d: str) -> DataFrame:
    mime = _cycle("p_partkey", ["Audio/X-WAV; codecs=1", "audio/webm;codecs=opus", " AUDIO/OGG ", "video/mp4", None])
    content = F.unhex(_cycle("p_partkey", ["", "FFD8FF00", "89504E47", "52494646000000005745425000"]))
    hint = _cycle("p_partkey", [None, "  ", "English", "bn", "eng", "FRA"])
    status = intake.media_status(mime, content, intake.AUDIO_KINDS, intake.MOST_AUDIO)
    return _t(spark, d, "part").select("p_partkey", intake.audio_kind(mime).alias("kind"), status.alias("status"), intake.scan_kind(content).alias("scan"), intake.photo_kind(content).alias("photo"), intake.ocr_language(hint).alias("language"))


@query(
    """
with s as (select p_partkey, p_partkey % 15 * 1000000 as size, ['.txt', '.docx', '.PDF', '.tif', '.exe', ''][(p_partkey % 6 + 1)::int] as ext from part)
select p_partkey, case when size > 10485760 then 'Document exceeds 10 MB.' when ext in ('.exe', '') then 'Unsupported file type ''' || case when ext = '' then 'unknown' else ext end || '''. Supported types: .bmp, .csv, .docx, .jpeg, .jpg, .md, .pdf, .png, .tif, .tiff, .txt, .webp.' end as error from s"""
)
def intake_errors(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("in/file"), F.col("p_partkey").cast("string"), _cycle("p_partkey", [".txt", ".docx", ".PDF", ".tif", ".exe", ""]))
    return _t(spark, d, "part").select("p_partkey", intake.intake_error(intake.extension(name), F.col("p_partkey") % 15 * 1_000_000).alias("error"))


@query("select event_id, md5(transcript) as digest from corpus_events where transcript is not null and not starts_with(transcript, chr(65279))")
def text_decoded(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "corpus_events").where("transcript is not null and not startswith(transcript, '﻿')")
    content = F.encode(F.concat(F.when(F.col("event_id") % 2 == 0, "﻿").otherwise(""), F.col("transcript")), "UTF-8")
    return rows.select("event_id", F.md5(intake.decode_text(content)).alias("digest"))


@query("select page_id, md5(coalesce(text, '')) as digest, case when page_id % 3 = 0 then 'layer' else 'scan' end as source from pdf_pages where trim(coalesce(text, ''), chr(9) || chr(10) || chr(13) || ' ') <> ''")
def layers_or_scans(spark: SparkSession, d: str) -> DataFrame:
    layer = F.when(F.col("page_id") % 3 == 0, F.col("text")).when(F.col("page_id") % 3 == 1, " \n\t ")
    rows = _t(spark, d, "pdf_pages").where(F.length(F.trim(F.coalesce("text", F.lit("")), F.lit("\t\n\r "))) > 0)
    chosen = documents.layer_or_scan(layer, F.col("text"))
    return rows.select("page_id", F.md5(chosen).alias("digest"), F.when(layer.isNotNull() & (F.length(text.strip(layer)) > 0), "layer").otherwise("scan").alias("source"))


@query(
    """
with w as (select p_partkey, p_name as a, p_type as b, list_distinct(list_filter(string_split(p_name, ' '), lambda x: x <> '')) as x, list_distinct(list_filter(string_split(p_type, ' '), lambda x: x <> '')) as y from part),
n as (select *, len(list_intersect(x, y)) as z from w),
s as (select *, case when z = 0 then 0.0 else 2 * (z / len(x)) * (z / len(y)) / (z / len(x) + z / len(y)) end as f1, (greatest(length(a), length(b)) - levenshtein(a, b)) / greatest(length(a), length(b)) as near from n)
select p_partkey, round(case when a is null or b is null or a = '' or b = '' then 0.0 when a = b then 1.0 else greatest(f1, near) end, 9) as score, round(case when a is null or b is null or a = '' or b = '' then 0.0 when a = b then 1.0 else f1 end, 9) as long_score from s"""
)
def phrase_scores(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("p_name"), F.col("p_type")
    return _t(spark, d, "part").select("p_partkey", F.round(similarity.phrase_score(a, b), 9).alias("score"), F.round(similarity.phrase_score(a, b, 0), 9).alias("long_score"))


@query(
    """
select c_custkey as request_id, case c_custkey % 4 when 0 then 200 when 1 then 200 else 401 end as status, case c_custkey % 4 when 0 then n_name when 1 then 'legacy' end as consumer from customer join nation on c_nationkey = n_nationkey"""
)
def auth_decisions(spark: SparkSession, d: str) -> DataFrame:
    named = _t(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("key-"), F.col("n_nationkey").cast("string")).alias("key"))
    keys = named.unionByName(spark.createDataFrame([(None, "shared"), ("blank", "  ")], "name string, key string"))
    k = F.col("c_custkey")
    header = F.when(k % 4 == 0, F.concat(F.lit("Bearer key-"), F.col("c_nationkey").cast("string"))).when(k % 4 == 1, "bearer shared").when(k % 4 == 2, "Bearer other")
    return governance.auth_decisions(_t(spark, d, "customer").select(k.alias("request_id"), header.alias("authorization")), keys)


@query("select field_id, case when coalesce(schema_name, '') = 'bd_nid' then '' else 'bd_nid' end as missing from extracted_fields")
def schemas_missing(spark: SparkSession, d: str) -> DataFrame:
    expected = F.array_compact(F.array(F.col("schema_name"), F.lit("bd_nid")))
    return _t(spark, d, "extracted_fields").select("field_id", F.array_join(evaluation.missing_schemas(expected, F.array_compact(F.array("schema_name"))), ",").alias("missing"))


@query(
    f"""
with p as (select event_id, transcript, event_id % 4 = 3 as fell, list_filter([case when event_id % 4 = 2 then 'fallback must be false on success' end, case when trim(coalesce(transcript, ''), {_TRIM}) = '' then 'transcript_bn missing or empty' end,
  case when transcript is null then 'transcript_raw missing' end, case when dialect_label is null then 'dialect evidence missing (expected DialectInference with status)' end,
  case when coalesce(stt_provider, '') = '' then 'stt_provenance.provider/model missing' end], lambda x: x is not null) as own from corpus_events),
q as (select event_id, fell, case when fell then ['fallback:true (no STT vendor served the request)'] else own end as problems from p)
select event_id, array_to_string(problems, '; ') as problems, len(problems) = 0 or fell as pass, fell as downgraded from q"""
)
def speech_shapes(spark: SparkSession, d: str) -> DataFrame:
    k, t = F.col("event_id") % 4, F.col("transcript")
    fell = F.when(k == 3, True).when(k != 2, False)
    rows = _t(spark, d, "corpus_events").where(F.length(F.coalesce(t, F.lit(""))) >= 0).select("event_id", t.alias("transcript_bn"), F.lit(None).cast("string").alias("gold"), fell.alias("fallback"), evaluation.speech_problems(fell, t, t, F.col("dialect_label"), F.col("stt_provider"), F.col("stt_provider")).alias("problems"))
    return evaluation.score_speech(rows, "gold", "transcript_bn", "problems", "fallback", allow_fallback=True).select("event_id", F.array_join("all_problems", "; ").alias("problems"), "pass", "downgraded")


@query(
    """
select p_partkey, case p_partkey % 4 when 0 then 'a,b' when 1 then 'old,m1,m2' when 2 then 'm1,m2' else 'm2,m1' end as models, case p_partkey % 3 when 0 then 0.1 when 1 then 1.0 else 0.1 end::double as confidence,
  case when p_partkey % 2 = 0 then p_name || chr(10) || p_type else p_name end as joined from part"""
)
def provider_parts(spark: SparkSession, d: str) -> DataFrame:
    configured, legacy = _cycle("p_partkey", [" a, b,a,, ", "", None, " "]), _cycle("p_partkey", [None, "old", "  ", "m2"])
    answer = _cycle("p_partkey", [None, "all seen", "cut"])
    finish = _cycle("p_partkey", ["STOP", "STOP", "LENGTH"])
    part = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("text"))
    parts = F.array(part("text", F.col("p_name")), part("image", F.col("p_brand")), part("text", F.when(F.col("p_partkey") % 2 == 0, F.col("p_type"))))
    return _t(spark, d, "part").select("p_partkey", F.array_join(providers.model_list(configured, legacy, ["m1", "m2"]), ",").alias("models"), providers.text_confidence(answer, F.lit(False), finish).alias("confidence"), providers.join_parts(parts).alias("joined"))


_WS = r"[\t\n\v\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


@query(
    rf"""
with n as (select doc_id, regexp_replace(regexp_replace(translate(coalesce(text, ''), '০১২৩৪৫৬৭৮৯', '0123456789'), '{_WS}+', ' ', 'g'), '^ +| +$', '', 'g') as t, strlen(coalesce(text, '')) as size from documents)
select doc_id, 'page ' || doc_id::varchar || '.TXT' as file_name, '.txt' as file_extension, size::bigint as bytes, md5(t) as digest, md5(t) as pages_digest, t <> '' as extractable, 'Plain-text intake is candidate evidence only until reviewed.' as first_warning from n"""
)
def payload_texts(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    page = F.array(F.struct(F.lit(1).alias("page"), t.alias("text"), F.lit("x").alias("engine"), F.lit(None).cast("double").alias("ocr_quality_score")))
    rows = _t(spark, d, "documents").select("doc_id", "text", F.concat(F.lit("page "), F.col("doc_id").cast("string"), F.lit(".TXT")).alias("name"), F.octet_length(t).alias("size"), page.alias("own"))
    out = documents.document_payload(rows, "doc_id", "text", None, "name", "size", "own")
    whole = F.array_join(F.filter(F.transform("pages", lambda p: p["text"]), lambda x: x != ""), " ")
    return out.select("doc_id", "file_name", "file_extension", "bytes", F.md5("full_text_normalized").alias("digest"), F.md5(whole).alias("pages_digest"), "extractable", F.get("warnings", 0).alias("first_warning"))


@query(
    """
with n as (select event_id as id, value >= 0 as pass, (event_id % 3)::int as kind from events),
s as (select count(*) as total, count(*) filter (where pass) as passed from n)
select 5 as place, '' as key, 'negative-path checks ' || passed::varchar || '/' || total::varchar || ' < 1' as failure from s where passed < total
union all select 6, id::varchar, 'negative ' || id::varchar || ': expected HTTP 400|413, got ' || case kind when 0 then '200' when 1 then '500' else 'null' end from n where not pass
union all select 7, '', 'health: no answer'"""
)
def suite_failures(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 3
    rows = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.array(F.lit(400), F.lit(413)).alias("expected"), F.when(k == 0, 200).when(k == 1, 500).alias("observed"), (F.col("value") >= 0).alias("pass"))
    health = spark.createDataFrame([(False, "no answer")], "pass boolean, problem string")
    return evaluation.suite_failures(negatives=rows, health=health)


@query(
    """
select page_id, case when coalesce(page, 0) = 1 then '' else 'pages: expected 1, got ' || case when page is null then 'null' else page::varchar end end as problems from pdf_pages"""
)
def page_counts(spark: SparkSession, d: str) -> DataFrame:
    pages = F.when(F.col("page") >= 1, F.sequence(F.lit(1), F.col("page")))
    return _t(spark, d, "pdf_pages").select("page_id", F.array_join(evaluation.page_problems(F.lit(1), pages), "; ").alias("problems"))


@query(
    """
select candidate_id, coalesce(phrase, '') as phrase, coalesce(length(phrase), 0)::bigint as characters, 200 as status_code, true as within from dialect_candidates"""
)
def phrases_evaluated(spark: SparkSession, d: str) -> DataFrame:
    out = requests.evaluate_phrases(_t(spark, d, "dialect_candidates").select("candidate_id", "phrase"), "candidate_id", "phrase")
    sizes = out.groupBy("batch").agg((F.count("*") <= 50).alias("within"))
    return out.join(sizes.hint("merge"), "batch").select("candidate_id", "phrase", F.col("characters").cast("long").alias("characters"), "status_code", "within")


@query(
    """
with a as (select user_id, event_id, event_type, event_type <> 'error' and event_id % 3 <> 0 as ok from events),
r as (select *, row_number() over (partition by user_id order by ok desc, event_id, event_type) as n from a)
select user_id, case when ok then 'id ' || event_id::varchar end as transcript_bn, case when ok then event_type end as stt_provider, not ok as fallback, case when ok then 'not_configured' else 'skipped_missing_transcript' end as classifier_status from r where n = 1"""
)
def transcripts_assembled(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    attempts = e.select("user_id", F.col("event_id").alias("priority"), F.col("event_type").alias("provider"), F.when(F.col("event_type") != "error", F.concat(F.lit("  id\t"), F.translate(F.col("event_id").cast("string"), text.ASCII_DIGITS, text.BENGALI_DIGITS))).alias("answer"), F.when(F.col("event_id") % 3 == 0, "timeout").alias("error"))
    return requests.assemble_transcripts(attempts, "user_id").select("user_id", "transcript_bn", "stt_provider", "fallback", "classifier_status")


@query("select label as label, region as region from (values ('dhaka', 'Dhaka'), ('unknown', null)) v(label, region) where false")
def regions_of_unknown_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "nation").select(F.col("n_name").alias("label"))
    return rows.select("label", dialect.region_of(F.col("label")).alias("region")).where("region is not null")


_LOW = "lower(replace(replace(replace(replace(replace(replace(translate(text, '০১২৩৪৫৬৭৮৯', '0123456789'), 'ঘণ্টা', 'hours'), 'সপ্তাহ', 'week'), 'বয়স', 'age'), 'বছর', 'years'), 'নোটিশ', 'notice'), 'দিন', 'days'))"


@query(
    f"""
with n as (select doc_id, {_LOW} as t from documents where text is not null),
f as (
  select doc_id, 'wage_records_current' as fact_key, case when t like '%late wage%' or t like '%missing wage%' or t like '%wage records late%' then 'false' when t like '%current wage%' or t like '%wage records current%' then 'true' end as value from n
  union all select doc_id, 'export_documents_complete', case when t like '%missing export%' or t like '%customs documents missing%' or t like '%shipment documents incomplete%' then 'false' end from n
  union all select doc_id, 'suspicious_transaction_flagged', case when t like '%suspicious%' then 'true' end from n
  union all select doc_id, 'customer_identity_verified', case when t like '%not verified%' or t like '%without verification%' then 'false' when t like '%verified%' then 'true' end from n
  union all select doc_id, 'worker_type', case when t like '%temporary%' then 'temporary' when t like '%permanent%' then 'permanent' end from n
  union all select doc_id, 'subcontractor_declared_and_approved', case when t like '%subcontract%' or t like '%washing%' or t like '%printing%' or t like '%embroidery%' then case when t like '%approved%' and t not like '%not approved%' then 'true' else 'false' end end from n
  union all select doc_id, 'transaction_amount_bdt', case when regexp_matches(t, '(?:bdt|tk|taka){_WS}*[0-9]') then regexp_extract(t, '(?:bdt|tk|taka){_WS}*([0-9]+(?:[.][0-9]+)?)', 1) end from n)
select doc_id, fact_key, value from f where value is not null"""
)
def facts_by_hand(spark: SparkSession, d: str) -> DataFrame:
    keys = ["wage_records_current", "export_documents_complete", "suspicious_transaction_flagged", "customer_identity_verified", "worker_type", "subcontractor_declared_and_approved", "transaction_amount_bdt"]
    return facts.extract_facts(_t(spark, d, "documents"), "doc_id", "text").where(F.col("fact_key").isin(*keys)).select("doc_id", "fact_key", "value")


@query(
    """
select l_orderkey, l_linenumber, (l_linenumber + 15)::varchar as worker_age_years, case l_orderkey % 3 when 0 then 'false' when 1 then 'true' end as fire_certificate_current, case l_orderkey % 4 when 0 then 'false' when 1 then 'true' end as lc_conditions_met,
  case l_orderkey % 5 when 0 then 'false' when 1 then 'true' end as inspection_certificate_current, case l_orderkey % 6 when 0 then 'true' when 1 then 'true' end as acceptance_qualified, (l_linenumber + 4)::varchar || '.5' as cet1_ratio,
  case when l_orderkey % 7 = 0 then 'false' end as suspicious_report_filed_within_24h, case when l_orderkey % 8 = 0 then 'true' when l_orderkey % 8 = 1 then 'false' end as subcontractor_declared_and_approved from lineitem"""
)
def facts_planted(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("l_linenumber"), "l_orderkey"
    said = F.concat_ws(
        "\n", F.concat(F.lit("The worker is "), (n + 15).cast("string"), F.lit(" years old.")), _cycle(k, ["Fire certificate expired.", "Valid fire certificate.", None]), _cycle(k, ["Payment hold.", "LC conditions met.", None, None]),
        _cycle(k, ["The inspection certificate is missing.", "The inspection certificate is current.", None, None, None]), _cycle(k, ["Qualified acceptance.", "Acceptance is conditional.", None, None, None, None]), F.concat(F.lit("CET1 ratio: "), (n + 4).cast("string"), F.lit(".5 per cent.")),
        F.when(F.col(k) % 7 == 0, "Not reported."), F.when(F.col(k) % 8 == 0, "Embroidery approved.").when(F.col(k) % 8 == 1, "Embroidery not approved."),
    )
    columns = facts.fact_columns(text.norm_facts(said))
    names = ["worker_age_years", "fire_certificate_current", "lc_conditions_met", "inspection_certificate_current", "acceptance_qualified", "cet1_ratio", "suspicious_report_filed_within_24h", "subcontractor_declared_and_approved"]
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[columns[c].alias(c) for c in names])


@query(
    """
with c as (select c_custkey as k from customer),
r as (select k, 'NID 7' || lpad((k % 1000000000)::varchar, 9, '0') as head, case when k % 2 = 0 then ' Tk 12,500.50 and ' else ' ' end as body from c)
select k as c_custkey, 4::int as start, 14::int as "end", '7' || lpad((k % 1000000000)::varchar, 9, '0') as raw, 'bd_extract.v1' as schema_version, true as review_required from r"""
)
def nid_spans(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    body = F.concat(F.lit("NID 7"), F.lpad((k % 1_000_000_000).cast("string"), 9, "0"), F.when(k % 2 == 0, " Tk 12,500.50 and ").otherwise(" "), F.lit("more"))
    rows = extract.extract(_t(spark, d, "customer").select("c_custkey", body.alias("text")), "c_custkey", "text").select("c_custkey", F.explode("extractions").alias("e"))
    fields = rows.where("e.schema = 'bd_nid'").select("c_custkey", "e.schema_version", "e.review_required", F.explode("e.fields").alias("f")).where("f.field = 'nid_number'")
    return fields.select("c_custkey", F.col("f.span.start").alias("start"), F.col("f.span.end").alias("end"), "f.raw", "schema_version", "review_required")


@query(
    rf"""
with n as (select event_id, transcript as t from corpus_events),
s as (select event_id, t, length(regexp_replace(coalesce(t, ''), '[^\x{{0980}}-\x{{09FF}}]', '', 'g')) > 0 as bn, length(regexp_replace(coalesce(t, ''), '[^A-Za-z]', '', 'g')) > 0 as latin from n)
select event_id, case when t is null or not bn and not latin then 'unknown' when bn and latin then 'mixed' when bn then 'bn' else 'latin' end as letters from s"""
)
def script_presence_letters(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("transcript")
    tag = script.presence_tag(c, text.norm_match(c))
    return _t(spark, d, "corpus_events").select("event_id", F.when(tag.isin("banglish", "en"), "latin").otherwise(tag).alias("letters"))
