"""Queries of the corpus operators, by problem; each reads the whole tables it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, lookalike, mixing, pii, scan, sentences, spans, tokenize
from .common import table


def _of(name: str, df: DataFrame) -> DataFrame:
    """Rows whose first column is an id, with the table it belongs to."""
    return df.select(F.lit(name).alias("record_table"), F.col(df.columns[0]).alias("record_id"), *df.columns[1:])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scan.found(table(spark, d, "pdf_pages"), table(spark, d, "raster_results"), table(spark, d, "image_intents"))


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pdf_pages")
    reader = scan.fit(pages)
    files = _of("raster_results", scan.repaired(table(spark, d, "raster_results"), reader, "file_id", "text"))
    images = _of("image_intents", scan.repaired(table(spark, d, "image_intents"), reader, "image_id", "text_in_image", False))
    return _of("pdf_pages", scan.repaired_pages(pages, reader)).unionByName(files).unionByName(images)


def _p2_sources(spark: SparkSession, d: str) -> list:
    return [("corpus_events", table(spark, d, "corpus_events"), "event_id", "transcript"), ("dialect_candidates", table(spark, d, "dialect_candidates"), "candidate_id", "phrase"), ("pdf_pages", table(spark, d, "pdf_pages"), "page_id", "text")]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.found(_p2_sources(spark, d))


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    sources = _p2_sources(spark, d)
    words, rest = lookalike.vocabulary([(df, text) for _, df, _, text in sources])
    events, phrases, pages = (_of(name, lookalike.canonical(df, words, id_col, text, rest=rest)) for name, df, id_col, text in sources)
    return events.unionByName(phrases).unionByName(pages)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "corpus_events").select("event_id", "transcript")
    pages = table(spark, d, "pdf_pages").where("engine = 'pdfjs-dist'").select("page_id", "text")
    clean = table(spark, d, "lang_samples")
    model = sentences.fit([(events, "transcript", False), (pages, "text", True)], clean)
    return sentences.sentences(events, clean, "event_id", "transcript", False, "corpus_events", model).unionByName(sentences.sentences(pages, clean, "page_id", "text", True, "pdf_pages", model))


_ID_FIELDS = ("field", ["document_number", "nid_number"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    names = pii.name_parts(table(spark, d, "name_parts"))
    pages = pii.find(table(spark, d, "pdf_pages"), names, "page_id", "text", "pdf_pages")
    fields = pii.find(table(spark, d, "extracted_fields"), names, "field_id", "raw", "extracted_fields", _ID_FIELDS)
    events = pii.find(table(spark, d, "corpus_events"), names, "event_id", "transcript", "corpus_events")
    return pages.unionByName(fields).unionByName(events)


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    names = pii.name_parts(table(spark, d, "name_parts"))
    pages = _of("pdf_pages", pii.redact(table(spark, d, "pdf_pages"), names, "page_id", "text"))
    fields = _of("extracted_fields", pii.redact(table(spark, d, "extracted_fields"), names, "field_id", "raw", _ID_FIELDS))
    events = _of("corpus_events", pii.redact(table(spark, d, "corpus_events"), names, "event_id", "transcript"))
    return pages.unionByName(fields).unionByName(events)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.found(table(spark, d, "corpus_events"), table(spark, d, "documents"), table(spark, d, "cue_matches"), table(spark, d, "lang_samples"))


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "corpus_events")
    model = langid.fit(table(spark, d, "lang_samples"), [(events, "language", "transcript")])
    documents = _of("documents", langid.segments(table(spark, d, "documents"), model, "doc_id", "text", markup=True))
    return _of("corpus_events", langid.segments(events, model, "event_id", "transcript")).unionByName(documents)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(table(spark, d, "documents"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mixture(table(spark, d, "documents"), targets), targets)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"))


def p8_parts(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_parts(table(spark, d, "documents"))


def p8_lines(spark: SparkSession, d: str) -> DataFrame:
    return spans.repeated_lines(table(spark, d, "documents"))


P8_LINES_SQL = """
with split as (select doc_id, string_split(text, chr(10)) as parts from documents where length(text) >= 200),
lines as (select doc_id, unnest(parts) as line, unnest(range(len(parts))) as i, parts from split),
placed as (select doc_id, line, (list_sum([0] || [length(x) + 1 for x in parts[1:i]]))::bigint as start_pos from lines where length(line) >= 200),
ranked as (select *, first_value(doc_id) over w as kept_id, first_value(start_pos) over w as kept_pos from placed window w as (partition by line order by doc_id, start_pos))
select doc_id, start_pos, start_pos + length(line) as end_pos, kept_id, kept_pos from ranked where (doc_id, start_pos) <> (kept_id, kept_pos)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_canonical, p3_found, p4_found, p4_redacted, p5_found, p5_segments, p6_ids, p7_mixture, p7_shares, p8_found, p8_parts, p8_lines)}


def oracle_sql() -> dict[str, str]:
    return {"p8_lines": P8_LINES_SQL}
