"""Consent, batches, prefixes, requests, and documents put together from files and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from textevidence.functions import text
from textevidence.operators import documents, evaluation, extract, governance, requests


def test_consent_depends_on_the_type(spark):
    df = spark.createDataFrame([(True, 1, " YES ", 1.0, ["true"]), (False, 0, "on", 0.0, []), (None, None, None, None, None)], "a boolean, b int, c string, d double, e array<string>")
    got = [tuple(r) for r in df.select(*[governance.consent(F.col(c)) for c in "abcde"]).collect()]
    assert got == [(True, False, True, False, False), (False,) * 5, (False,) * 5]


def test_no_batch_is_too_large(spark):
    for n in (0, 1, 50, 5000):
        made = evaluation.batches(spark.range(n), "id", 50)
        sizes = [r["count"] for r in made.groupBy("batch").count().collect()]
        assert sum(sizes) == n and max(sizes, default=0) <= 50
    same = [sorted((r["id"], r["batch"]) for r in evaluation.batches(spark.range(500).repartition(k), "id").collect()) for k in (1, 7)]
    assert same[0] == same[1]


def test_prefix_counts_units(spark):
    rows = [("abcdef",), ("ab😀cd",), ("😀😀😀",), ("abc",), (None,), ("",), ("abc😀",)]
    cut, flag = text.prefix(F.col("x"), 4)
    got = [tuple(r) for r in spark.createDataFrame(rows, "x string").select(cut.alias("a"), flag.alias("b")).collect()]
    assert got == [("abcd", True), ("ab😀", True), ("😀😀", True), ("abc", False), (None, False), ("", False), ("abc", True)]


def test_month_far_before_the_day():
    assert [d for d, _ in extract.find_dates(f"on January{' ' * 300}12, 1990")] == ["1990-01-12"]


def test_phrases(spark):
    df = spark.createDataFrame([(1, "একটি কথা"), (2, None), (3, "x" * 9000)], "id int, phrase string")
    got = {r["id"]: r for r in requests.evaluate_phrases(df, "id", "phrase").collect()}
    assert got[2]["status"] == "missing_transcript" and got[3]["status_code"] == 413 and got[3]["characters"] == 9000 and len(got) == 3
    assert requests.evaluate_phrases(df.where("false"), "id", "phrase").count() == 0


def test_documents_from_pages(spark):
    files = spark.createDataFrame([("f:/d/a.TXT", 5, "text", "plain ৫", None), ("f:/d/b.pdf", 9, "pdf", None, None), ("f:/d/c.pdf", 9, "pdf", None, None), ("f:/d/e.exe", 1, "unsupported", None, "no"), ("f:/d/g.docx", 3, "docx", "", None)], "path string, bytes long, kind string, text string, error string")
    page = "path string, page int, text string, engine string, ocr_quality_score double, total_pages int, truncation_reason string, error string"
    layer = spark.createDataFrame([("f:/d/b.pdf", 2, "two  ২", "pdfjs-dist", None, 60, "page_cap", None), ("f:/d/b.pdf", 1, "one", "pdfjs-dist", None, 60, "page_cap", None), ("f:/d/c.pdf", None, None, "pdfjs-dist", None, 0, None, "Error: bad")], page)
    scan = spark.createDataFrame([("f:/d/c.pdf", 1, "scanned", "tesseract.js", 0.9, 1, None, None)], page)
    got = {r["path"][-5:]: r for r in documents.extract_documents(files, layer, scan).collect()}
    assert set(got) == {"a.TXT", "b.pdf", "c.pdf", ".docx"}
    assert (got["a.TXT"]["file_extension"], got["a.TXT"]["bytes"], got["a.TXT"]["full_text_normalized"], got["a.TXT"]["pages"]) == (".txt", 5, "plain 5", None)
    b = got["b.pdf"]
    assert b["intake_kind"] == "pdf_text" and [p["text"] for p in b["pages"]] == ["one", "two 2"] and b["full_text_normalized"] == "one two 2" and '"truncated":true' in b["ocr_provenance"]
    assert [w[:30] for w in b["warnings"][:3]] == ["PDF text layer extracted (not ", "PDF text extraction truncated:", "PDF text layer is present but "]
    c = got["c.pdf"]
    assert c["intake_kind"] == "pdf_scan_ocr" and c["full_text_normalized"] == "scanned" and c["warnings"][0] == "PDF text-layer read failed (Error: bad); falling back to page OCR."
    assert got[".docx"]["warnings"] == [documents.NOTES["docx"], documents.NOTES["empty"]]
    assert documents.extract_documents(files.where("false")).count() == 0


def test_speech_scores(spark):
    rows = [(1, "one two three", "one two three", [], False), (2, "one two three four", "five six", [], False), (3, None, None, ["fallback:true (x)"], True), (4, "a b", "a b", ["transcript_raw missing"], False)]
    df = spark.createDataFrame(rows, "id int, gold string, bn string, problems array<string>, fallback boolean")
    for allow, want in ((False, [True, False, False, False]), (True, [True, False, True, False])):
        got = evaluation.score_speech(df, "gold", "bn", "problems", "fallback", allow_fallback=allow).orderBy("id").collect()
        assert [r["pass"] for r in got] == want and [r["downgraded"] for r in got] == [False, False, allow, False]
    assert got[1]["all_problems"] == ["transcript token-F1 0.000 < 0.6"] and got[2]["score"] is None


def test_auth(spark):
    asked = spark.createDataFrame([(1, "Bearer k"), (2, "Bearer x"), (3, None)], "request_id int, authorization string")
    keys = spark.createDataFrame([("me", "k"), ("none", " ")], "name string, key string")
    assert sorted(tuple(r) for r in governance.auth_decisions(asked, keys).collect()) == [(1, 200, "me"), (2, 401, None), (3, 401, None)]
    for bypass, status in ((False, 403), (True, 200)):
        assert {r["status"] for r in governance.auth_decisions(asked, keys.where("false"), bypass).collect()} == {status}


def test_no_score_is_not_the_best(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (-1.0,), (2.0,), (0.12345,)], "x double")
    assert [r[0] for r in rows.select(text.clamp_score(F.col("x"), 3)).collect()] == [None, None, 0.0, 1.0, 0.123]
