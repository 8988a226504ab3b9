"""Queries of the core operators over whole tables, and their SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog.cues import CUES, REGIONS
from ..functions import script, similarity, text
from ..operators import dialect, documents, evaluation, extract, facts, governance, providers, resolver
from ..sources import intake
from ..streaming import stream

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

_BN, _EN = text.BENGALI_DIGITS, text.ASCII_DIGITS


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """A table in fewer parts than there are cores, dealt out evenly before work that is all computing."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def _bengali(c: Column) -> Column:
    return F.translate(c, _EN, _BN)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Dialect evidence of all transcripts by language."""
    return dialect_by_language(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# White space of the contract, for DuckDB.
_WS = r"[\t\n\v\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _collapsed(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '{_WS}+', ' ', 'g'), '^ +| +$', '', 'g')"


def _ascii(c: str) -> str:
    return f"translate({c}, '{_BN}', '{_EN}')"


# Dialect cues.


@query()
def dialect_by_language(spark: SparkSession, d: str) -> DataFrame:
    rows = dialect.infer_dialect(_spread(_t(spark, d, "corpus_events").select("language", "transcript")), "transcript")
    return rows.groupBy("language", "status", "script_mix").agg(F.count("*").alias("events"), F.round(F.avg("match_score"), 4).alias("mean_score"))


@query("select * from (values " + ", ".join(f"({i}, 'suggested', '{c[1]}', 1.0::double)" for i, c in enumerate(CUES)) + ") v(ordinal, status, dialect_label, match_score)")
def dialect_catalog_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CUES)], "ordinal int, phrase string")
    return dialect.infer_dialect(rows, "phrase").select("ordinal", "status", "dialect_label", "match_score")


@query("select * from (values " + ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(REGIONS.items())) + ") v(ordinal, dialect_label, speaker_region)")
def dialect_labels(spark: SparkSession, d: str) -> DataFrame:
    return dialect.labels(spark)


@query(
    """
with j as (select m.match_id, m.dialect_label as dl, m.candidate_dialect_label as cl, m.match_score as s,
  case when e.classifier_status = 'ok' then e.dialect_label end as c, e.classifier_confidence as k
  from cue_matches m join corpus_events e using (event_id)),
a as (select *, case when c is not null and coalesce(dl, cl) is not null and coalesce(s >= 0.58, false) then case when coalesce(dl, cl) = c then 'agree' else 'disagree' end else 'none' end as agreement from j),
f as (select *, case when k is not null then round(greatest(0, least(1, case agreement when 'agree' then least(1, k + 0.08) when 'disagree' then greatest(0, k - 0.18) else k end)), 3) end as fused from a)
select match_id, agreement, fused as fused_confidence, (c is not null and coalesce(fused >= 0.72, false)) as resolved from f"""
)
def classifier_fusion(spark: SparkSession, d: str) -> DataFrame:
    events = _t(spark, d, "corpus_events").select("event_id", "classifier_status", F.col("dialect_label").alias("answer"), "classifier_confidence")
    matches = _t(spark, d, "cue_matches").select("match_id", "event_id", "dialect_label", "candidate_dialect_label", "match_score")
    fused = resolver.fuse(matches.join(events, "event_id"), F.when(F.col("classifier_status") == "ok", F.col("answer")), F.col("classifier_confidence"))
    return fused.select("match_id", "agreement", "fused_confidence", "resolved")


@query()
def dialect_resolved(spark: SparkSession, d: str) -> DataFrame:
    e = _spread(_t(spark, d, "corpus_events").select("event_id", "transcript", "classifier_status", "dialect_label", "classifier_confidence"))
    raw = F.when(F.col("classifier_status") == "ok", F.to_json(F.struct(F.coalesce("dialect_label", F.lit("unresolved")).alias("dialect"), F.coalesce("classifier_confidence", F.lit(0.5)).alias("confidence"), F.array(F.substring("transcript", 1, 12)).alias("cues"))))
    out = resolver.resolve_dialect(e.select("event_id", "transcript", raw.alias("raw")), "transcript", "raw")
    return out.select("event_id", "status", "dialect_label", "method", "classifier_status", "agreement", F.round("confidence", 6).alias("confidence"))


# Normalisers, script tags, similarities.


@query("select o_orderkey, o_orderkey::varchar as folded, length(o_orderkey::varchar) as n from orders")
def digits_fold(spark: SparkSession, d: str) -> DataFrame:
    folded = text.ascii_digits(_bengali(F.col("o_orderkey").cast("string")))
    return _t(spark, d, "orders").select("o_orderkey", folded.alias("folded"), F.length(folded).alias("n"))


@query(f"select doc_id, substr({_collapsed(_ascii('text'))}, 1, 1200) as preview, coalesce(length({_collapsed(_ascii('text'))}), 0) as n from documents")
def intake_preview(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return _t(spark, d, "documents").select("doc_id", text.preview(c).alias("preview"), F.coalesce(F.length(text.norm_intake(c)), F.lit(0)).alias("n"))


@query(
    f"""
with s as (select event_id, regexp_replace(transcript, '{_WS}', '', 'g') as t from corpus_events),
c as (select event_id, length(t) as n, length(regexp_replace(t, '[^\\x{{0980}}-\\x{{09FF}}]', '', 'g')) as b, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) as l from s)
select event_id, case when n is null or n = 0 then 'unknown' when b / n >= 0.7 then 'bn' when l / n >= 0.7 then 'en' when b > 0 or l > 0 then 'mixed' else 'unknown' end as tag from c"""
)
def script_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "corpus_events").select("event_id", script.ratio_tag(F.col("transcript")).alias("tag"))


@query("select event_id, coalesce(regexp_matches(transcript, '[\\x{0980}-\\x{09FF}]'), false) as bengali, coalesce(regexp_matches(transcript, '[A-Za-z]'), false) as latin from corpus_events")
def script_letters(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("transcript")
    return _t(spark, d, "corpus_events").select("event_id", F.coalesce(script.has_bengali(c), F.lit(False)).alias("bengali"), F.coalesce(c.rlike(script.LATIN), F.lit(False)).alias("latin"))


@query()
def script_presence(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("transcript")
    return _t(spark, d, "corpus_events").select("event_id", script.presence_tag(c, text.norm_match(c)).alias("script_mix"))


@query(
    f"""
with t as (select doc_id, list_distinct(list_filter(string_split({_collapsed("coalesce(title, '')")}, ' '), lambda x: x <> '')) as a, list_distinct(list_filter(string_split({_collapsed("coalesce(redirect_to, title, '')")}, ' '), lambda x: x <> '')) as b from documents),
n as (select doc_id, len(a) as x, len(b) as y, len(list_intersect(a, b)) as z from t)
select doc_id, round(case when x = 0 or y = 0 or z = 0 then 0.0 else 2 * (z / x) * (z / y) / (z / x + z / y) end, 9) as f1 from n"""
)
def token_f1_titles(spark: SparkSession, d: str) -> DataFrame:
    a, b = text.collapse(F.coalesce("title", F.lit(""))), text.collapse(F.coalesce("redirect_to", "title", F.lit("")))
    return _t(spark, d, "documents").select("doc_id", F.round(similarity.token_f1(a, b), 9).alias("f1"))


@query("select p_partkey, round(case when p_name is null or p_type is null or p_name = '' or p_type = '' then 0.0 when p_name = p_type then 1.0 else (greatest(length(p_name), length(p_type)) - levenshtein(p_name, p_type)) / greatest(length(p_name), length(p_type)) end, 9) as similarity from part")
def char_similarity_parts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", F.round(similarity.char_similarity(F.col("p_name"), F.col("p_type")), 9).alias("similarity"))


# Facts.

_DOT = r"[^\n\r\x{2028}\x{2029}]"


def _fact_sql(table: str, key: str, source: str) -> str:
    t = _ascii(source)
    for word, to in text.FACT_WORDS:
        t = f"replace({t}, '{word}', '{to}')"
    columns = []
    for name, rule in facts.NUMBER_RULES.items():
        r = rule.replace(facts.DOT, _DOT).replace(facts._S, _WS + "*")
        groups = 2 if name in ("working_hours_per_week", "notice_period_days") else 1
        value = f"regexp_extract(t, '{r}', 1)"
        value = f"case when {value} <> '' then {value} else regexp_extract(t, '{r}', 2) end" if groups == 2 else value
        columns.append(f"case when regexp_matches(t, '{r}') then {value} end as {name}")
    for name, cases in facts.FLAG_RULES.items():
        columns.append("case " + " ".join("when " + " or ".join(f"contains(t, '{p}')" for p in phrases) + f" then '{value}'" for value, phrases in cases) + f" end as {name}")
    columns.append("case when " + " or ".join(f"contains(t, '{p}')" for p in facts._SUBCONTRACT) + " then case when contains(t, 'approved') and not contains(t, 'not approved') then 'true' else 'false' end end as subcontractor_declared_and_approved")
    return f"with n as (select {key}, lower({t}) as t from {table}) select {key}, {', '.join(columns)} from n"


@query(_fact_sql("pdf_pages", "page_id", "text"))
def facts_of_pages(spark: SparkSession, d: str) -> DataFrame:
    return facts.fact_table(_t(spark, d, "pdf_pages"), "page_id", "text")


@query(_fact_sql("corpus_events", "event_id", "transcript"))
def facts_of_events(spark: SparkSession, d: str) -> DataFrame:
    return facts.fact_table(_t(spark, d, "corpus_events"), "event_id", "transcript")


@query()
def fact_rows(spark: SparkSession, d: str) -> DataFrame:
    return facts.extract_facts(_t(spark, d, "documents"), "doc_id", "text")


@query(
    """
select l_orderkey, l_linenumber, (l_linenumber + 40)::varchar as working_hours_per_week, l_linenumber::varchar as overtime_hours_per_day, (l_orderkey % 10)::varchar as notice_period_days,
  case when l_orderkey % 2 = 0 then 'temporary' else 'permanent' end as worker_type, case when l_orderkey % 3 = 0 then 'false' else 'true' end as customer_identity_verified from lineitem"""
)
def facts_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    li = _spread(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber"))
    s = F.concat(
        F.lit("A permanent contract of "), (F.col("l_linenumber") + 40).cast("string"), F.lit(" hours a week.\nOvertime is "), F.col("l_linenumber").cast("string"), F.lit(" hrs a day.\nNotice of "), (F.col("l_orderkey") % 10).cast("string"), F.lit(" days"),
        F.when(F.col("l_orderkey") % 2 == 0, F.lit("\nA temporary pass.")).otherwise(F.lit("")), F.when(F.col("l_orderkey") % 3 == 0, F.lit("\nIdentity not verified.")).otherwise(F.lit("\nIdentity verified.")),
    )
    columns = facts.fact_columns(text.norm_facts(s))
    return li.select("l_orderkey", "l_linenumber", *[columns[k].alias(k) for k in ("working_hours_per_week", "overtime_hours_per_day", "notice_period_days", "worker_type", "customer_identity_verified")])


# Structured extraction: texts are built from columns, and the columns are what must come out.


def _wide(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """One column per field: the first value of each, per key."""
    return df.select(key, *[_value(n).alias(n) for n in names])


def _value(name: str) -> Column:
    fields = F.flatten(F.transform("extractions", lambda e: e["fields"]))
    return F.get(F.transform(F.filter(fields, lambda f: f["field"] == name), lambda f: f["value"]), 0)


def _status(code: str) -> Column:
    notes = F.flatten(F.transform("extractions", lambda e: e["validations"]))
    return F.get(F.transform(F.filter(notes, lambda n: n["code"] == code), lambda n: n["status"]), 0)


@query(
    "select o_orderkey, 'INV-' || o_orderkey::varchar as invoice_number, strftime(o_orderdate, '%Y-%m-%d') as invoice_date, (o_orderkey % 90000 + 1000)::varchar || '.50' as total_amount_bdt, '+88017' || lpad((o_orderkey % 100000000)::varchar, 8, '0') as phone from orders"
)
def invoice_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    money = F.format_number((key % 90000 + 1000).cast("double") + 0.5, 2)
    body = F.concat(
        F.lit("Invoice No: INV-"), key.cast("string"), F.lit("\nInvoice Date: "), F.when(key % 2 == 0, _bengali(F.date_format("o_orderdate", "dd/MM/yyyy"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")),
        F.lit("\nGrand Total: Tk "), F.when(key % 3 == 0, _bengali(money)).otherwise(money), F.lit("\nPhone: 017"), F.lpad((key % 100000000).cast("string"), 8, "0"),
    )
    rows = _spread(_t(spark, d, "orders")).select("o_orderkey", body.alias("text"))
    return _wide(extract.extract(rows, "o_orderkey", "text"), "o_orderkey", ["invoice_number", "invoice_date", "total_amount_bdt", "phone"])


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as document_date from orders")
def dates_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    months = F.array(*[F.lit(m) for m in ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")])
    bengali = F.array(*[F.lit(dict((n, w) for w, n in extract.BENGALI_MONTHS)[n]) for n in range(1, 13)])
    month = F.element_at(months, F.month(day))
    spelled = F.when(key % 5 == 0, F.date_format(day, "yyyy-MM-dd")).when(key % 5 == 1, F.date_format(day, "d.M.yyyy")).when(key % 5 == 2, F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), month, F.lit(" "), F.year(day).cast("string"))).when(key % 5 == 3, F.concat(month, F.lit(" "), F.dayofmonth(day).cast("string"), F.lit(", "), F.year(day).cast("string"))).otherwise(_bengali(F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), F.element_at(bengali, F.month(day)), F.lit(" "), F.year(day).cast("string"))))
    rows = _spread(_t(spark, d, "orders")).select("o_orderkey", F.concat(F.lit("seen on "), spelled, F.lit(" by a.b@c.org")).alias("text"))
    return _wide(extract.extract(rows, "o_orderkey", "text"), "o_orderkey", ["document_date"])


@query(
    """
with c as (select c_custkey as k, 1950 + c_custkey % 50 as y from customer)
select k as c_custkey, case when k % 3 = 0 then y::varchar || '1' || lpad((k % 1000000000000)::varchar, 12, '0') when k % 3 = 1 then '7' || lpad((k % 1000000000)::varchar, 9, '0') else '8' || lpad((k % 1000000000000)::varchar, 12, '0') end as nid_number,
  case when k % 3 = 0 then '17_digit' when k % 3 = 1 then '10_digit' else '13_digit' end as nid_format, y::varchar || '-03-' || lpad((k % 28 + 1)::varchar, 2, '0') as date_of_birth, 'pass' as format_check,
  case when k % 3 = 0 then 'pass' else 'not_applicable' end as year_check from c"""
)
def nid_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    year = (F.lit(1950) + k % 50).cast("string")
    number = F.when(k % 3 == 0, F.concat(year, F.lit("1"), F.lpad((k % 1000000000000).cast("string"), 12, "0"))).when(k % 3 == 1, F.concat(F.lit("7"), F.lpad((k % 1000000000).cast("string"), 9, "0"))).otherwise(F.concat(F.lit("8"), F.lpad((k % 1000000000000).cast("string"), 12, "0")))
    body = F.concat(F.lit("National ID No: "), F.when(k % 2 == 0, _bengali(number)).otherwise(number), F.lit("\nDate of Birth: "), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("/03/"), year)
    rows = extract.extract(_t(spark, d, "customer").select("c_custkey", body.alias("text")), "c_custkey", "text")
    return rows.select("c_custkey", *[_value(n).alias(n) for n in ("nid_number", "nid_format", "date_of_birth")], _status("nid_format").alias("format_check"), _status("nid_dob_cross_check").alias("year_check"))


@query(
    "select s_suppkey, 'TRAD/DNCC/' || lpad(s_suppkey::varchar, 6, '0') || '/2024' as licence_number, s_name as proprietor_name, 'Firm ' || s_suppkey::varchar as business_name, '2024-07-' || lpad((s_suppkey % 28 + 1)::varchar, 2, '0') as issue_date, '2025-06-30' as expiry_date from supplier"
)
def licence_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    body = F.concat(F.lit("Trade Licence No: TRAD/DNCC/"), F.lpad(k.cast("string"), 6, "0"), F.lit("/2024\nProprietor: "), F.col("s_name"), F.lit("\nBusiness Name: Firm "), k.cast("string"), F.lit("\nIssue Date: "), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("/07/2024\nExpiry Date: 30/06/2025"))
    rows = extract.extract(_t(spark, d, "supplier").select("s_suppkey", body.alias("text")), "s_suppkey", "text")
    return _wide(rows, "s_suppkey", ["licence_number", "proprietor_name", "business_name", "issue_date", "expiry_date"])


def mrz_digit(c: Column) -> Column:
    """The 7-3-1 check digit as a native expression."""
    place = F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    values = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.greatest(F.instr(place, F.substr(c, i, F.lit(1))) - 1, F.lit(0)) * F.element_at(F.array(F.lit(7), F.lit(3), F.lit(1)), (i - 1) % 3 + 1))
    return (F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10).cast("string")


@query(
    """
select c_custkey, 'A' || lpad((c_custkey % 100000000)::varchar, 8, '0') as document_number, 'HOLDER' as surname_mrz, 'C' as given_names_mrz, '19' || (50 + c_custkey % 40)::varchar || '-01-12' as date_of_birth, '2030-12-31' as expiry_date,
  case when c_custkey % 5 = 0 then 'fail' else 'pass' end as number_check, case when c_custkey % 5 = 0 then 'fail' else 'pass' end as whole_check from customer"""
)
def passport_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    number = F.concat(F.lit("A"), F.lpad((k % 100000000).cast("string"), 8, "0"))
    born = F.concat((F.lit(50) + k % 40).cast("string"), F.lit("0112"))
    digit = mrz_digit(number)
    shown = F.when(k % 5 == 0, ((digit.cast("int") + 1) % 10).cast("string")).otherwise(digit)
    fill = F.lit("<" * 15)
    whole = F.concat(number, digit, born, mrz_digit(born), F.lit("301231"), mrz_digit(F.lit("301231")), fill)
    body = F.concat(F.lit("P<BGDHOLDER<<C<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<\n"), number, shown, F.lit("BGD"), born, mrz_digit(born), F.lit("M301231"), mrz_digit(F.lit("301231")), fill, mrz_digit(whole))
    rows = extract.extract(_t(spark, d, "customer").select("c_custkey", body.alias("text")), "c_custkey", "text")
    names = ["document_number", "surname_mrz", "given_names_mrz", "date_of_birth", "expiry_date"]
    return rows.select("c_custkey", *[_value(n).alias(n) for n in names], _status("mrz_document_number_check_digit").alias("number_check"), _status("mrz_composite_check_digit").alias("whole_check"))


@query(
    rf"""
with m as (select page_id, unnest(list_slice(regexp_extract_all({_ascii("text")}, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b'), 1, 5)) as e from pdf_pages)
select page_id, lower(e) as value from m"""
)
def emails_of_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = extract.extract_fields(_spread(_t(spark, d, "pdf_pages").select("page_id", "text")), "page_id", "text")
    return rows.where("field = 'email'").select("page_id", "value")


@query()
def schema_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = extract.extract_fields(_spread(_t(spark, d, "pdf_pages").select("page_id", "text")), "page_id", "text")
    return rows.groupBy("schema", "field", "pattern_strength").agg(F.count("*").alias("fields"), F.countDistinct("page_id").alias("pages"))


@query()
def schema_notes(spark: SparkSession, d: str) -> DataFrame:
    rows = extract.extract_notes(_spread(_t(spark, d, "pdf_pages").select("page_id", "text")), "page_id", "text")
    return rows.groupBy("schema", "code", "status").count()


@query()
def schema_bridge(spark: SparkSession, d: str) -> DataFrame:
    return facts.schema_candidates(extract.extract_fields(_spread(_t(spark, d, "pdf_pages").select("page_id", "text")), "page_id", "text"), "page_id")


# Documents and pages.


@query()
def document_payloads(spark: SparkSession, d: str) -> DataFrame:
    out = documents.document_payload(_spread(_t(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")
    return out.select("doc_id", "text_preview", "extractable", F.size("candidate_facts").alias("facts"), F.size("structured_fields").alias("schemas"), F.array_join("warnings", " | ").alias("warnings"))


@query(
    """
with p as (select file_id, count(distinct page)::int as total_pages from pdf_pages where file_id is not null and page is not null group by 1)
select file_id, total_pages, least(total_pages, 10) as pages_to_process, total_pages > 10 as truncated,
  case when total_pages > 10 then 'Scanned PDF OCR truncated: processed 10 of ' || total_pages::varchar || ' pages (OCR page cap 10). Remaining pages were not OCR''d.' end as warning from p"""
)
def page_plan(spark: SparkSession, d: str) -> DataFrame:
    return documents.plan_files(_t(spark, d, "pdf_pages"))


@query(
    """
with s as (select * from pdf_pages where file_id is not null and coalesce(engine, '') <> 'pdfjs-dist'),
f as (select file_id, engine, row_number() over (partition by file_id order by page, page_id) as r from s)
select s.file_id, any_value(f.engine) as engine, count(distinct s.engine)::int as n_engines, count(*) as pages_ocrd, count(s.ocr_quality_score) as pages_scored,
  case when count(distinct s.engine) > 1 then count(*) filter (where s.engine like 'tesseract%') else 0 end as fallback_pages from s join f on s.file_id = f.file_id and f.r = 1 group by s.file_id"""
)
def ocr_provenance(spark: SparkSession, d: str) -> DataFrame:
    return documents.ocr_provenance(_t(spark, d, "pdf_pages")).select("file_id", "engine", "n_engines", "pages_ocrd", "pages_scored", "fallback_pages")


@query(
    """
with o as (select file_id, page, arg_min(text, page_id) as t from pdf_pages where file_id is not null and page is not null and text is not null group by 1, 2),
k as (select * from o where trim(t, chr(9) || chr(10) || chr(13) || ' ') <> '')
select file_id, md5(string_agg(t, chr(10) || chr(10) order by page)) as digest, count(*)::int as n_pages from k group by 1"""
)
def file_texts(spark: SparkSession, d: str) -> DataFrame:
    pages = _t(spark, d, "pdf_pages").where("text is not null")
    return documents.file_texts(pages).select("file_id", F.md5("text").alias("digest"), "n_pages")


@query(
    f"""
select doc_id, md5({_collapsed("replace(replace(replace(regexp_replace(replace(text, '</w:p>', chr(10)), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')")}) as digest from documents"""
)
def markup_text(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.md5(intake.xml_text(F.col("text"))).alias("digest"))


@query(
    """
with e as (select file_id, regexp_extract(lower(regexp_extract(file_name, '([^/\\\\]*)$', 1)), '(\\.[^.]*)$', 1) as ext from raster_results)
select file_id, ext as file_extension, case when ext in ('.txt', '.md', '.csv') then 'text' when ext = '.docx' then 'docx' when ext = '.pdf' then 'pdf' when ext in ('.png', '.jpg', '.jpeg', '.webp', '.bmp', '.tif', '.tiff') then 'image' else 'unsupported' end as kind from e"""
)
def intake_dispatch(spark: SparkSession, d: str) -> DataFrame:
    ext = intake.extension(F.col("file_name"))
    return _t(spark, d, "raster_results").select("file_id", ext.alias("file_extension"), intake.intake_kind(ext).alias("kind"))


# Providers.


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    return e.select("user_id", F.col("event_id").alias("priority"), F.col("event_type").alias("provider"), F.when(F.col("event_type") != "error", F.col("event_id").cast("string")).alias("answer"), F.when(F.col("event_id") % 3 == 0, "timeout").alias("error"), F.abs(F.col("value") * 100).cast("long").alias("ms"))


@query(
    """
with a as (select user_id, event_id, event_type, event_type <> 'error' and event_id % 3 <> 0 as ok from events),
r as (select *, row_number() over (partition by user_id order by ok desc, event_id, event_type) as n from a)
select user_id, max(case when n = 1 and ok then event_type end) as provider, max(case when n = 1 and ok then event_id::varchar end) as answer, count(*) as attempts, count(*) filter (where not ok) as errors, not bool_or(ok) as fallback from r group by 1"""
)
def provider_first_success(spark: SparkSession, d: str) -> DataFrame:
    return providers.first_success(_attempts(spark, d), "user_id")


@query(
    """
with a as (select user_id, event_id, event_type, least(coalesce(abs(trunc(value * 100))::bigint, 0), 18000) as cost from events),
s as (select *, coalesce(sum(cost) over (partition by user_id order by event_id, event_type rows between unbounded preceding and 1 preceding), 0) as started from a)
select user_id, event_id as priority, started::bigint as started_ms, started >= 54000 as skipped, (case when started >= 54000 then 0 else cost end)::bigint as spent_ms from s"""
)
def provider_budget(spark: SparkSession, d: str) -> DataFrame:
    return providers.within_budget(_attempts(spark, d), "user_id").select("user_id", "priority", "started_ms", "skipped", F.col("spent_ms").cast("long").alias("spent_ms"))


@query("select event_id, json_extract(props, '$.k')::bigint as k from events")
def json_repair(spark: SparkSession, d: str) -> DataFrame:
    dirty = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here it is: "), "props", F.lit(" as asked."))).otherwise(F.col("props"))
    return _t(spark, d, "events").select("event_id", F.try_variant_get(providers.repair_json(dirty), "$.k", "bigint").alias("k"))


@query(
    """
select image_id, coalesce(object_label, 'unknown') as object_label, coalesce(scene, '') as scene, coalesce(intent_guess, '') as intent_guess, md5(coalesce(text_in_image, '')) as text_digest, coalesce(language, 'unknown') as language,
  coalesce(array_to_string(category_hints, '|'), '') as category_hints, coalesce(greatest(0.0, least(1.0, confidence)), 0.5) as confidence from image_intents"""
)
def image_intents_coerced(spark: SparkSession, d: str) -> DataFrame:
    fields = ["object_label", "scene", "intent_guess", "text_in_image", "language", "category_hints", "condition_hints", "confidence"]
    raw = _t(spark, d, "image_intents").select("image_id", F.to_json(F.struct(*fields)).alias("raw"))
    out = providers.coerce_image_intent(raw, "image_id", "raw")
    return out.select("image_id", "object_label", "scene", "intent_guess", F.md5("text_in_image").alias("text_digest"), "language", F.array_join("category_hints", "|").alias("category_hints"), "confidence")


# Evaluation.


def _scored(spark: SparkSession, d: str) -> DataFrame:
    gold = _t(spark, d, "corpus_events").select(F.col("event_id").alias("id"), F.coalesce("consent", F.lit(False)).alias("gate"), F.when(F.col("dialect_label").isNull(), "unresolved").otherwise("suggested").alias("expected_status"), F.col("dialect_label").alias("expected_dialect_label"))
    seen = _t(spark, d, "cue_matches").select(F.col("event_id").alias("id"), "status", "dialect_label")
    return evaluation.score_dialect(gold, seen)


_SCORED = """
with g as (select e.event_id, coalesce(e.consent, false) as gate, coalesce(e.dialect_label, '(none)') as label,
  coalesce(m.status = case when e.dialect_label is null then 'unresolved' else 'suggested' end and m.dialect_label is not distinct from e.dialect_label, false) as pass
  from corpus_events e left join cue_matches m using (event_id)),
p as (select label, count(*) as total, count(*) filter (where pass) as passed, count(*) filter (where pass) / count(*) as accuracy from g where gate group by 1)
"""


@query(_SCORED + "select label, total, passed, round(accuracy, 9) as accuracy from p")
def gold_per_label(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.per_label(_scored(spark, d)).select("label", "total", "passed", F.round("accuracy", 9).alias("accuracy"))


@query(_SCORED + "select count(*) filter (where gate) as gate_total, count(*) filter (where gate and pass) as gate_passed, count(*) filter (where not gate) as probe_total, count(*) filter (where not gate and pass) as probe_matched, round(coalesce(count(*) filter (where gate and pass) / nullif(count(*) filter (where gate), 0), 0), 9) as gate_accuracy from g")
def gold_totals(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.totals(_scored(spark, d)).withColumn("gate_accuracy", F.round("gate_accuracy", 9))


@query(_SCORED + "select label, 'dialect label \"' || label || '\" accuracy ' || printf('%.3f', floor(accuracy * 1000 + 0.5) / 1000) || ' < 1 (' || passed::varchar || '/' || total::varchar || ')' as failure from p where accuracy < 1")
def gold_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.threshold_failures(evaluation.per_label(_scored(spark, d)))


@query()
def field_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "extracted_fields").select("field_id", "field", "value", "raw")
    scored = evaluation.score_texts(rows, "value", "raw", F.col("field") == "email")
    return scored.groupBy("field", "metric").agg(F.count("*").alias("fields"), F.count_if(F.col("pass")).alias("passed"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("select provenance.provider as route, count(*) as count, floor(avg(provenance.latency_ms) + 0.5)::bigint as avg_ms, max(provenance.latency_ms)::bigint as max_ms from image_intents where provenance.latency_ms is not null group by 1")
def latency_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "image_intents").select(F.col("provenance.provider").alias("provider"), F.col("provenance.latency_ms").alias("ms"))
    return evaluation.latency(rows, "provider", "ms")


# Governance.


@query("select event_id, sha256(transcript) as transcript_hash, audio_sha256, image_sha256 from corpus_events where consent")
def consent_filter_hash(spark: SparkSession, d: str) -> DataFrame:
    kept = governance.consented_events(_t(spark, d, "corpus_events"))
    return kept.select("event_id", governance.content_hash(F.col("transcript")).alias("transcript_hash"), "audio_sha256", "image_sha256")


@query("select event_id, dialect_label, dialect_match_score, method, classifier_status, classifier_confidence from corpus_events")
def corpus_projection(spark: SparkSession, d: str) -> DataFrame:
    return governance.corpus_projection(_t(spark, d, "corpus_events"))


@query("select coalesce(dialect_label, '') as dialect_label, count(*) as phrases, sum(coalesce(length(phrase), 0))::bigint as characters, case when count(*) > 50 then 400 when sum(coalesce(length(phrase), 0)) > 8192 then 413 else 200 end as status from dialect_candidates group by 1")
def phrase_requests(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "dialect_candidates").select(F.coalesce("dialect_label", F.lit("")).alias("dialect_label"), "phrase")
    return governance.phrase_requests(rows, "dialect_label", "phrase")


@query("select p_partkey, coalesce(nullif(trim(p_brand), ''), nullif(trim(p_type), ''), p_name) as value, case when nullif(trim(p_brand), '') is not null then 'p_brand' when nullif(trim(p_type), '') is not null then 'p_type' when nullif(trim(p_name), '') is not null then 'p_name' end as source from part")
def env_chain(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part")
    value, source = governance.first_set(part, ["p_brand", "p_type", "p_name"])
    return part.select("p_partkey", value.alias("value"), source.alias("source"))


@query("select * from (values (1, 'a=1;b=2'), (2, 'a=3'), (3, ''), (4, 'x=y:z'), (5, 'n=k')) v(id, pairs)")
def key_map_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "a:1, b:2"), (2, "a:1\na:3,:x,broken"), (3, "  "), (4, "x:y:z"), (5, '{"n":" k ","m":""}')], "id int, raw string")
    entries = F.array_sort(F.transform(F.map_entries(governance.key_map(F.col("raw"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return rows.select("id", F.array_join(entries, ";").alias("pairs"))


# Streams, as tables.


@query("select date_trunc('day', ts)::timestamp as window_start, product, count(*) as events, count(*) filter (where consent) as consented from corpus_events where ts is not null group by 1, 2")
def daily_events(spark: SparkSession, d: str) -> DataFrame:
    return stream.windowed_counts(_t(spark, d, "corpus_events").select("ts", "product", "consent"))


from . import contracts, cue_sql  # noqa: E402, F401  (they register their queries)
