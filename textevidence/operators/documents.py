"""Document assembly: page plans, warnings, provenance of scans, and the payload of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.script import has_bengali
from ..functions.text import PREVIEW_CHARS, clamp_score, norm_intake, strip
from ..sources.intake import DOCX, extension
from .extract import extractions
from .facts import facts_array

#: Page caps and time budgets as (default, least, most).
TEXT_PAGES, OCR_PAGES, OCR_MS, TEXT_MS = (50, 1, 200), (10, 1, 50), (50_000, 1_000, 55_000), (30_000, 1_000, 55_000)
SHORT_LAYER = 40


def bounded_int(raw: Column, limits: tuple[int, int, int]) -> Column:
    """A setting's text as a whole number held in its limits; its default for none, blank or no number."""
    default, least, most = limits
    value = F.floor(strip(raw).try_cast("double"))
    return F.when(raw.isNull() | value.isNull() | F.isnan(strip(raw).try_cast("double")), default).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), value))).cast("int")


def page_plan(total: Column, cap: Column) -> Column:
    """struct(pages_to_process, truncated): never below zero."""
    whole, most = (F.greatest(F.lit(0), F.coalesce(F.floor(x), F.lit(0))).cast("int") for x in (total, cap))
    return F.struct(F.least(whole, most).alias("pages_to_process"), (whole > F.least(whole, most)).alias("truncated"))


def truncation_warning(kind: str, reason: Column, processed: Column, total: Column, cap: Column, budget: Column) -> Column:
    """The sentence that says how far a file was read; kind is text or ocr, reason page_cap or time_budget."""
    stopped, cut, end, cap_name = ("PDF text extraction stopped early", "PDF text extraction truncated", "extracted", "text") if kind == "text" else ("Scanned PDF OCR stopped early", "Scanned PDF OCR truncated", "OCR'd", "OCR")
    early = F.format_string(f"{stopped}: processed %s of %s pages before the time budget (%sms) was reached. Remaining pages were not {end}.", processed.cast("string"), total.cast("string"), budget.cast("string"))
    capped = F.format_string(f"{cut}: processed %s of %s pages ({cap_name} page cap %s). Remaining pages were not {end}.", processed.cast("string"), total.cast("string"), cap.cast("string"))
    return F.when(F.coalesce(reason, F.lit("")) == "time_budget", early).otherwise(capped)


def plan_files(pages: DataFrame, cap: int = OCR_PAGES[0]) -> DataFrame:
    """(file_id, total_pages, pages_to_process, truncated, warning) of scanned files, from their page numbers.

    A page delivered twice counts once; pages without a file are left out.
    """
    totals = pages.where("file_id is not null and page is not null").groupBy("file_id").agg(F.countDistinct("page").cast("int").alias("total_pages"))
    plan = totals.withColumn("plan", page_plan(F.col("total_pages"), F.lit(cap)))
    warning = F.when(F.col("plan.truncated"), truncation_warning("ocr", F.lit("page_cap"), F.col("plan.pages_to_process"), F.col("total_pages"), F.lit(cap), F.lit(OCR_MS[0])))
    return plan.select("file_id", "total_pages", "plan.pages_to_process", "plan.truncated", warning.alias("warning"))


def ocr_provenance(pages: DataFrame) -> DataFrame:
    """(file_id, engine, engines, n_engines, pages_ocrd, pages_scored, fallback_pages, ocr_quality_score, status) of scans.

    The engine is that of the first page (ties: the least page_id); the quality is the mean over all pages, a
    missing score counting as 0; local engines count as fallback where another engine is in the file.  One
    partial aggregate per file and no ordered list, so a file may hold any number of pages.
    """
    scans = pages.where("file_id is not null and coalesce(engine, '') != 'pdfjs-dist'")
    local = F.col("engine").startswith("tesseract")
    out = scans.groupBy("file_id").agg(
        F.min_by("engine", F.struct("page", "page_id")).alias("engine"),
        F.array_sort(F.collect_set("engine")).alias("engines"),
        F.count("*").alias("pages_ocrd"),
        F.count("ocr_quality_score").alias("pages_scored"),
        F.count_if(local).alias("local_pages"),
        F.avg(F.coalesce(F.col("ocr_quality_score"), F.lit(0.0)).cast("decimal(20,10)")).cast("double").alias("mean"),
        F.count_if(F.length(strip(F.coalesce("text", F.lit("")))) > 0).alias("filled"),
    )
    return out.select("file_id", "engine", "engines", F.size("engines").alias("n_engines"), "pages_ocrd", "pages_scored", F.when(F.size("engines") > 1, F.col("local_pages")).otherwise(0).cast("long").alias("fallback_pages"), clamp_score(F.col("mean"), 4).alias("ocr_quality_score"), F.when(F.col("filled") > 0, "text_extracted_candidate_only").otherwise("no_text_detected").alias("status"))


def file_texts(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """(file_id, text, n_pages): the non-empty pages of a file in order, each page number once, joined by a blank line.

    Of a page delivered twice the least page_id stays.  The text of a file is one value, so it must fit a row.
    """
    once = pages.where("file_id is not null and page is not null").groupBy("file_id", "page").agg(F.min_by(F.col(text_col), F.col("page_id")).alias("t"))
    listed = once.where(F.length(strip(F.col("t"))) > 0).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("page", "t"))).alias("p"))
    return listed.select("file_id", F.array_join(F.col("p.t"), "\n\n").alias("text"), F.size("p").alias("n_pages"))


def layer_or_scan(layer: Column, scan: Column) -> Column:
    """The text layer, or the scan's text where the layer is null or blank."""
    return F.when(F.length(strip(F.coalesce(layer, F.lit("")))) > 0, layer).otherwise(scan)


#: What is said of a document by the way its text was read, and of what was found in it.
NOTES = {
    "text": "Plain-text intake is candidate evidence only until reviewed.",
    "docx": "DOCX text extraction provides candidate evidence only; this content has not been reviewed.",
    "pdf_text": "PDF text layer extracted (not OCR). Candidate evidence only until validated.",
    "short": "PDF text layer is present but very short; scanned/image pages in this document may not have been OCR'd. Treat extraction as possibly incomplete and review the source pages.",
    "bengali": "Bengali (Bangla) text detected in uploaded content. Extraction is review-gated and candidate-only.",
    "bare": "Structured extraction is unavailable for this document. Preview text is candidate evidence only.",
    "empty": "Structured extraction is unavailable because no readable text was extracted.",
}
_PAGE = "struct<page:int,text:string,engine:string,ocr_quality_score:double>"


def document_payload(df: DataFrame, id_col: str, text_col: str, kind_col: str | None = None, name_col: str | None = None, bytes_col: str | None = None, pages_col: str | None = None, notes_col: str | None = None, provenance_col: str | None = None) -> DataFrame:
    """(id, file_name, file_extension, bytes, intake_kind, text_preview, full_text_normalized, pages, candidate_facts,
    structured_fields, extractable, warnings, ocr_provenance).

    Facts and fields come from the raw text, preview, full text and pages (structs of page, text, engine, quality;
    each in intake form, so that the non-empty ones joined by spaces give the full text) from the intake form.
    ``notes_col``: warnings of the intake itself (a failed layer, pages cut off, an engine's), which stand before the
    others; what a column is not given for is null.  One row per row of ``df`` with an id; null texts count as empty.
    One pass: nothing is joined or shuffled.
    """
    given = lambda name, kind: (F.col(name) if name else F.lit(None)).cast(kind)
    base = df.where(df[id_col].isNotNull()).select(
        F.col(id_col), (F.col(kind_col) if kind_col else F.lit("document")).alias("intake_kind"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), given(name_col, "string").alias("file_name"), given(bytes_col, "long").alias("bytes"),
        given(pages_col, f"array<{_PAGE}>").alias("pages"), F.coalesce(given(notes_col, "array<string>"), F.array().cast("array<string>")).alias("_notes"), (F.col(provenance_col) if provenance_col else F.lit(None).cast("string")).alias("ocr_provenance"),
    )
    step = base.withColumn("structured_fields", extractions(F.col("_text"))).withColumn("full_text_normalized", norm_intake(F.col("_text"))).withColumn("candidate_facts", facts_array(F.col("_text")))
    step = step.withColumn("file_extension", extension(F.col("file_name"))).withColumn("pages", F.transform("pages", lambda p: p.withField("text", norm_intake(p["text"]))))
    full, seen, kind = F.col("full_text_normalized"), F.length(strip(F.col("_text"))), F.col("intake_kind")
    before = F.array_compact(F.array(F.when((kind == "document") & (F.coalesce("file_extension", F.lit("")) == DOCX), NOTES["docx"]).when(kind == "document", NOTES["text"])))
    layer = F.when(kind == "pdf_text", F.array(F.lit(NOTES["pdf_text"]))).otherwise(F.array().cast("array<string>"))
    after = F.array_compact(F.array(
        F.when((kind == "pdf_text") & (seen > 0) & (seen < SHORT_LAYER), NOTES["short"]),
        F.when(has_bengali(F.col("_text")), NOTES["bengali"]),
        F.when((full != "") & (F.size("candidate_facts") == 0) & (F.size("structured_fields") == 0), NOTES["bare"]),
        F.when(full == "", NOTES["empty"]),
    ))
    return step.select(
        id_col, "file_name", "file_extension", "bytes", "intake_kind", F.substring(full, 1, PREVIEW_CHARS).alias("text_preview"), "full_text_normalized", "pages", "candidate_facts", "structured_fields", (full != "").alias("extractable"),
        F.concat(before, layer, F.col("_notes"), after).alias("warnings"), "ocr_provenance",
    )


def extract_documents(files: DataFrame, layer: DataFrame | None = None, scan: DataFrame | None = None, text_cap: int = TEXT_PAGES[0], scan_cap: int = OCR_PAGES[0]) -> DataFrame:
    """The payload of files (path, bytes, kind, text, error) as ``sources.intake.read_documents`` gives them.

    ``layer`` and ``scan`` are pages (path, page, text, engine, ocr_quality_score, total_pages, truncation_reason,
    error) of ``sources.engines.read_pages``: of the text layer of PDFs, and of scans.  A PDF without a readable layer
    takes its scanned pages.  Files that intake refuses are left out.  The pages of one file meet in one row.
    """
    known = files.where("error is null").select("path", "bytes", "kind", F.col("text").alias("_own"))

    def by_file(pages: DataFrame | None, kind: str, cap: int, budget: int) -> DataFrame:
        name, empty = f"_{kind}", "path string, page int, text string, engine string, ocr_quality_score double, total_pages int, truncation_reason string, error string"
        pages = pages if pages is not None else files.sparkSession.createDataFrame([], empty)
        read = F.col("page").isNotNull()
        out = pages.groupBy("path").agg(
            F.array_sort(F.collect_list(F.when(read, F.struct("page", "text", "engine", "ocr_quality_score")))).alias("pages"),
            F.max("total_pages").alias("total"), F.count_if(read).alias("n"), F.max("truncation_reason").alias("reason"), F.min("error").alias("error"),
        )
        text = F.array_join(F.filter(F.transform("pages", lambda p: p["text"]), lambda t: F.length(strip(F.coalesce(t, F.lit("")))) > 0), "\n\n")
        note = F.when(F.col("reason").isNotNull(), truncation_warning(kind, F.col("reason"), F.col("n"), F.col("total"), F.lit(cap), F.lit(budget)))
        return out.select("path", F.struct("pages", "total", "n", "error", text.alias("text"), note.alias("note"), F.col("reason").isNotNull().alias("truncated")).alias(name))

    step = known.join(by_file(layer, "text", text_cap, TEXT_MS[0]), "path", "left").join(by_file(scan, "ocr", scan_cap, OCR_MS[0]), "path", "left")
    has_layer = F.length(strip(F.coalesce("_text.text", F.lit("")))) > 0
    kind = F.when((F.col("kind") == "pdf") & has_layer, "pdf_text").when(F.col("kind") == "pdf", "pdf_scan_ocr").when(F.col("kind") == "image", "image_scan").otherwise("document")
    step = step.withColumn("_kind", kind)
    scanned = F.col("_kind").isin("pdf_scan_ocr", "image_scan")
    failed = F.when((F.col("_kind") == "pdf_scan_ocr") & F.col("_text.error").isNotNull(), F.concat(F.lit("PDF text-layer read failed ("), F.col("_text.error"), F.lit("); falling back to page OCR.")))
    provenance = F.to_json(F.when(F.col("_kind") == "pdf_text", F.struct(F.lit("pdf_text_intake.v1").alias("schema_version"), F.lit("pdfjs-dist").alias("engine"), F.lit("text_layer_candidate_only").alias("status"), F.col("_text.total").alias("total_pages"), F.col("_text.n").alias("pages_extracted"), F.lit(text_cap).alias("max_text_pages"), F.col("_text.truncated").alias("truncated"))))
    step = step.select(
        "path", "bytes", "_kind", F.when(F.col("_kind") == "document", F.col("_own")).when(scanned, F.col("_ocr.text")).otherwise(F.col("_text.text")).alias("_full"),
        F.when(F.col("_kind") == "pdf_text", F.col("_text.pages")).when(F.col("_kind") == "pdf_scan_ocr", F.col("_ocr.pages")).alias("_pages"),
        F.array_compact(F.array(failed, F.when(F.col("_kind") == "pdf_text", F.col("_text.note")).when(scanned, F.col("_ocr.note")))).alias("_notes"), provenance.alias("_provenance"), F.regexp_extract("path", r"([^/\\]*)\z", 1).alias("_name"),
    )
    return document_payload(step, "path", "_full", "_kind", "_name", "bytes", "_pages", "_notes", "_provenance")
