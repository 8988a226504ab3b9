"""Intake, documents, providers, governance, evaluation and streams."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from textevidence.operators import documents, evaluation, governance, providers
from textevidence.sources import intake
from textevidence.streaming import stream


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("﻿নাম".encode())
    (tmp_path / "b.csv").write_bytes("x,y".encode("utf-16-le"))
    (tmp_path / "c.exe").write_bytes(b"x")
    (tmp_path / "d.md").write_bytes(b"")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", "<w:p>One &amp;lt; two</w:p><w:p>three</w:p>")
    (tmp_path / "e.docx").write_bytes(buffer.getvalue())
    (tmp_path / "f.docx").write_bytes(b"no zip")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in intake.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.TXT"]["text"] == "নাম" and "d.md" not in rows  # the reader skips empty files
    assert rows["e.docx"]["text"] == "One &lt; two three" and rows["f.docx"]["text"] is None
    assert rows["c.exe"]["kind"] == "unsupported" and rows["c.exe"]["error"].startswith("Unsupported file type '.exe'")


def test_kinds(spark):
    assert one(spark, "a/b.c/Name.JPG", intake.extension) == ".jpg" and one(spark, "x.d/name", intake.extension) == ""
    assert one(spark, None, intake.ocr_language) == "ben+eng" and one(spark, " English ", intake.ocr_language) == "eng"
    assert one(spark, "audio/x-WAV; codecs=1", intake.audio_kind) == "audio/wav"
    assert one(spark, bytearray(b"RIFFxxxxWEBP"), intake.photo_kind, "binary") == "image/webp"
    assert one(spark, bytearray(b"zz"), intake.photo_kind, "binary") == "image/jpeg" and one(spark, bytearray(b"zz"), intake.scan_kind, "binary") == "image/png"
    assert one(spark, "{", intake.body_status) == 400 and one(spark, "null", intake.body_status) == 200 and one(spark, '"' + "x" * 70_000 + '"', intake.body_status) == 413


def test_gold(spark, tmp_path):
    path = tmp_path / "gold.json"
    path.write_text(json.dumps({"schema_version": "ocr_gold.v1", "entries": [{"id": "a", "kind": "txt", "gate": True}, {"id": "b", "kind": "png", "gate": False}]}))
    assert [r["id"] for r in intake.read_gold(spark, str(path)).orderBy("id").collect()] == ["a", "b"]


@pytest.mark.parametrize(("raw", "want"), [(None, 10), ("", 10), ("abc", 10), ("7.9", 7), ("0", 1), ("999", 50), (" 12 ", 12), ("NaN", 10)])
def test_bounded(spark, raw, want):
    assert one(spark, raw, lambda c: documents.bounded_int(c, documents.OCR_PAGES)) == want


def test_pages(spark):
    rows = [(1, 9, 1, "b", "tesseract.js", 0.5), (2, 9, 1, "c", "gemini_vision", None), (3, 9, 2, "  ", "tesseract.js", 0.7), (4, None, 1, "x", "tesseract.js", 0.1), (5, 8, 1, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, file_id long, page int, text string, engine string, ocr_quality_score double")
    got = {r["file_id"]: r for r in documents.ocr_provenance(pages).collect()}
    assert got[9]["engine"] == "tesseract.js" and got[9]["engines"] == ["gemini_vision", "tesseract.js"] and got[9]["fallback_pages"] == 2 and got[9]["ocr_quality_score"] == 0.4
    assert got[8]["status"] == "no_text_detected"
    assert {r["file_id"]: r["text"] for r in documents.file_texts(pages).collect()} == {9: "b"}
    assert {r["file_id"]: r["truncated"] for r in documents.plan_files(pages, 1).collect()} == {9: True, 8: False}


def test_payload(spark):
    df = spark.createDataFrame([(1, "নোটিশ ৩০ দিন"), (2, None), (3, "plain"), (4, "verified, a@b.org")], "id int, text string")
    got = {r["id"]: r for r in documents.document_payload(df, "id", "text").collect()}
    assert not got[2]["extractable"] and got[2]["warnings"][-1].endswith("no readable text was extracted.")
    assert got[1]["full_text_normalized"] == "নোটিশ 30 দিন" and any("Bengali" in w for w in got[1]["warnings"])
    assert any("unavailable for this document" in w for w in got[3]["warnings"])
    assert got[4]["candidate_facts"][0]["fact_key"] == "customer_identity_verified" and got[4]["structured_fields"][0]["schema"] == "generic_invoice"


def test_providers(spark):
    rows = [("k", 2, "b", "B", None), ("k", 1, "a", None, "boom"), ("n", 1, "a", "A", "late")]
    got = {r["key"]: r for r in providers.first_success(spark.createDataFrame(rows, "key string, priority int, provider string, answer string, error string"), "key").collect()}
    assert (got["k"]["provider"], got["k"]["answer"], got["k"]["errors"], got["k"]["fallback"]) == ("b", "B", 1, False) and got["n"]["fallback"]
    models = spark.createDataFrame([(" a, b,a", None), ("", "old"), (None, " ")], "c string, l string").select(providers.model_list(F.col("c"), F.col("l")).alias("m")).collect()
    assert models[0]["m"] == ["a", "b"] and models[1]["m"] == ["old", *providers.DEFAULT_MODELS] and models[2]["m"] == providers.DEFAULT_MODELS
    confidence = spark.createDataFrame([("a b", False, "STOP"), ("", False, None), ("x", True, None), ("abcd", None, "MAX")], "t string, b boolean, f string")
    assert [r[0] for r in confidence.select(providers.text_confidence(F.col("t"), F.col("b"), F.col("f"))).collect()] == [1.0, 0.1, 0.1, 0.1]
    raws = ["{\"scene\":\"s\"}", "```json\n{\"scene\":\"s\"}\n```", "so: {\"scene\":\"s\"} ok", "nothing", None, "{\"scene\":5,\"confidence\":9,\"category_hints\":[1,\"a\"]}"]
    got = {r["id"]: r for r in providers.coerce_image_intent(spark.createDataFrame(list(enumerate(raws)), "id int, raw string"), "id", "raw").collect()}
    assert [got[i]["scene"] for i in range(3)] == ["s"] * 3 and got[3]["fallback"] and got[4]["fallback"] and got[4]["object_label"] == "unknown"
    assert got[5]["scene"] == "" and got[5]["confidence"] == 1.0 and got[5]["category_hints"] == ["1", "a"]


def test_governance(spark, tmp_path):
    assert [one(spark, x, governance.consent) for x in (None, "TRUE ", "1", "yes", "no", "2", "")] == [False, True, True, True, False, False, False]
    events = spark.createDataFrame([(1, True, "t"), (2, False, "u"), (3, None, "v")], "event_id int, consent boolean, transcript string")
    assert [r["event_id"] for r in governance.consented_events(events).collect()] == [1]
    assert governance.consented_events(events, enabled=False).count() == 0
    governance.append_events(events, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 1
    maps = [one(spark, x, governance.key_map) for x in (None, "a:1,b:2", "a:1\na:2", ":x, y:", '{"n":" k ","m":3}', "{bad")]
    assert maps == [{}, {"a": "1", "b": "2"}, {"a": "2"}, {}, {"n": "k", "m": "3"}, {}]
    assert one(spark, "Bearer  abc ", governance.bearer) == "abc" and one(spark, "Basic abc", governance.bearer) is None
    keys = spark.createDataFrame([("one", "k1"), (None, "k2")], "name string, key string")
    tokens = spark.createDataFrame([(1, "k1"), (2, "k2"), (3, "k3"), (4, None)], "token_id int, token string")
    assert {r["token_id"]: r["consumer"] for r in governance.match_consumer(tokens, keys).collect()} == {1: "one", 2: "legacy", 3: None, 4: None}
    phrases = spark.createDataFrame([("a", "x" * 9000), ("b", None)] + [("c", "y")] * 51, "request string, phrase string")
    assert {r["request"]: r["status"] for r in governance.phrase_requests(phrases, "request", "phrase").collect()} == {"a": 413, "b": 200, "c": 400}


def test_evaluation(spark):
    gold = spark.createDataFrame([("1", True, "suggested", "sylhet"), ("2", True, "suggested", "sylhet"), ("3", True, "unresolved", None), ("4", False, "suggested", "dhaka"), ("5", True, "suggested", "dhaka")], "id string, gate boolean, expected_status string, expected_dialect_label string")
    seen = spark.createDataFrame([("1", "suggested", "sylhet"), ("2", "suggested", "dhaka"), ("3", "unresolved", None), ("4", "unresolved", None)], "id string, status string, dialect_label string")
    scored = evaluation.score_dialect(gold, seen)
    labels = {r["label"]: (r["total"], r["passed"]) for r in evaluation.per_label(scored).collect()}
    assert labels == {"sylhet": (2, 1), "(none)": (1, 1), "dhaka": (1, 0)}
    total = evaluation.totals(scored).first()
    assert (total["gate_total"], total["gate_passed"], total["gate_accuracy"], total["probe_total"], total["probe_matched"]) == (4, 2, 0.5, 1, 0)
    assert evaluation.totals(scored.where("false")).first()["gate_accuracy"] == 0.0
    failures = {r["label"]: r["failure"] for r in evaluation.threshold_failures(evaluation.per_label(scored)).collect()}
    assert failures["sylhet"] == 'dialect label "sylhet" accuracy 0.500 < 1 (1/2)' and set(failures) == {"sylhet", "dhaka"}
    rows = spark.createDataFrame([("a ১", "a 1", True), ("a b c d", "a b c d e", False), ("a", None, False)], "e string, o string, x boolean")
    assert [r["pass"] for r in evaluation.score_texts(rows, "e", "o", F.col("x"), 0.85).collect()] == [True, True, False]
    speech = spark.createDataFrame([(False, "t", "t", "s", "p", "m"), (True, None, None, None, None, None), (None, "", None, None, "", None)], "f boolean, b string, r string, s string, p string, m string")
    assert [len(r[0]) for r in speech.select(evaluation.speech_problems(*(F.col(c) for c in "fbrspm"))).collect()] == [0, 1, 5]
    times = spark.createDataFrame([("a", 1.5), ("a", 2.0), ("b", None)], "route string, ms double")
    assert [tuple(r) for r in evaluation.latency(times, "route", "ms").collect()] == [("a", 2, 2, 2)]


def test_streams(spark, tmp_path, data):
    schema = spark.read.parquet(f"{data}/corpus_events.parquet").schema
    source = tmp_path / "in"
    spark.read.parquet(f"{data}/corpus_events.parquet").repartition(3).write.parquet(str(source))
    events = stream.stream_table(spark, str(source), schema)
    stream.write_stream(stream.stream_dialect(events.select("event_id", "transcript")), str(tmp_path / "d"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "d")).count() == spark.read.parquet(str(source)).count()
    stream.sink_consented(events, str(tmp_path / "k"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.json(str(tmp_path / "k")).count() == spark.read.parquet(str(source)).where("consent").count()
    spark.read.parquet(f"{data}/pdf_pages.parquet").write.parquet(str(tmp_path / "pages"))
    fields = stream.stream_fields(stream.stream_table(spark, str(tmp_path / "pages"), spark.read.parquet(str(tmp_path / "pages")).schema), "page_id", "text")
    stream.write_stream(fields, str(tmp_path / "f"), str(tmp_path / "c3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "f")).count() > 0
    late = stream.deduplicated(events.select("event_id", "ts", "transcript"), ["transcript"])
    stream.write_stream(late, str(tmp_path / "u"), str(tmp_path / "c4")).awaitTermination()
    assert 0 < spark.read.parquet(str(tmp_path / "u")).count() <= spark.read.parquet(str(source)).count()


def test_engines(spark):
    from textevidence.sources import engines

    class FakeEngine:
        name = "fake"

        def open(self, content, language):
            if content == b"bad":
                raise RuntimeError("broken")
            pages = content.decode().split("|")
            return len(pages), ((f" {p}  {language}\n", 0.123456) for p in pages)

    files = spark.createDataFrame([("a", bytearray(b"p1|p2|p3")), ("b", bytearray(b"bad")), ("c", bytearray(b"x")), ("d", None)], "path string, content binary")
    rows = engines.read_pages(files, "fake", FakeEngine, "eng", cap=2).orderBy("path", "page").collect()
    assert [(r["path"], r["page"], r["text"], r["truncation_reason"]) for r in rows] == [("a", 1, "p1 eng", "page_cap"), ("a", 2, "p2 eng", "page_cap"), ("b", None, None, None), ("c", 1, "x eng", None)]
    assert rows[2]["error"] == "RuntimeError: broken" and rows[0]["ocr_quality_score"] == 0.1235
    late = engines.read_pages(files.where("path = 'a'"), "fake", FakeEngine, "eng", budget_ms=0).collect()
    assert len(late) == 1 and late[0]["truncation_reason"] == "time_budget"
    with pytest.raises(ValueError, match="language"):
        engines.read_pages(files, "fake", FakeEngine, "xx")
    assert "<<<TRANSCRIPT\nকথা\nTRANSCRIPT>>>" in one(spark, "কথা", lambda c: engines.prompt(c, ["sylhet"]))


def test_media(spark, tmp_path):
    status = lambda mime, n: spark.createDataFrame([(mime, bytearray(n))], "m string, c binary").select(intake.media_status(F.col("m"), F.col("c"), intake.AUDIO_KINDS, 5)).first()[0]
    assert [status("audio/wave", 3), status("audio/wav;x=1", 9), status("text/plain", 3), status("audio/ogg", 0), status(None, 1)] == [200, 413, 415, 400, 415]
    assert one(spark, "AAEC", lambda c: intake.decode_audio(c)["content"]) == bytearray([0, 1, 2]) and one(spark, "?", lambda c: intake.decode_audio(c)["status"]) == 400
    evaluation.write_report({"a": spark.range(2)}, str(tmp_path))
    assert spark.read.json(str(tmp_path / "a")).count() == 2
