"""The corpus operators do the whole job: every record, every table, one result whatever the sample."""

from __future__ import annotations

import hashlib

import pytest

pytest.importorskip("textevidence.llm")
from textevidence.llm import langid, lookalike, scan  # noqa: E402
from textevidence.llm import queries as q  # noqa: E402


def test_one_canonical_text_a_look(spark):
    dirty, clean = "\u0456n D\u0456e r\u0430nk", "in Die rank"
    rows = [(1, dirty), (2, dirty), (3, clean), (4, clean), (5, clean), (6, f"{dirty} again"), (7, f"{clean} again"), (8, "\ufdfa"), (9, "\u0635\u0644\u0649 \u0627\u0644\u0644\u0647 \u0639\u0644\u064a\u0647 \u0648\u0633\u0644\u0645")]
    df = spark.createDataFrame(rows, "id long, text string")
    for some in (df, df.where("id < 4 or id > 5")):  # the clean spelling is the more or the less frequent one
        got = {r["id"]: r["text"] for r in lookalike.canonical(df, lookalike.vocabulary([(some, "text")])[0], "id", "text").collect()}
        assert got[1] == got[3] and got[6] == got[7] and got[8] == got[9]
    assert {r["text"] for r in lookalike.canonical(df.where("id < 6"), lookalike.vocabulary([(df, "text")])[0], "id", "text").collect()} == {clean}


def test_the_walk_decides(spark):
    raw = {"Ｈｅｌｌｏ": "Hello", "р\u0430rk": "park", "e\u0301t\u0435\u0301": "\u00e9t\u00e9", "re\u200bad\u00ading": "reading", "\ufb01sh": "fish", "a\u2011b": "a-b", "\u0e19\u0e49\u0e33": "\u0e19\u0e49\u0e4d\u0e32", "\uff76\uff9e": "\u30ac"}
    words = [(lookalike.bare(w), lookalike.bare(w), 2) for w in raw.values()] + [("rank", "r\u0430nk", 3)]
    trie = lookalike.Trie(words)
    assert {w: trie.find(w) for w in raw} == {w: lookalike.bare(x) for w, x in raw.items()}
    canon, asked = lookalike.Canon(words), []
    canon.trie = type("Asked", (), {"find": lambda _, word, cost=0.0: (asked.append(word), trie.find(word, cost))[1]})()
    assert canon.text("р\u0430rk rank") == "park r\u0430nk" and asked == ["р\u0430rk", "rank"]
    df = spark.createDataFrame([(1, "rank"), (2, "\u0433\u0430nk"), (3, "r\u0430nk")], "id long, text string")
    looks = {r["record_id"]: bytes(r["look"]) for r in lookalike.digests(df, words, "id", "text", "t").collect()}
    assert looks[1] == looks[3] == hashlib.blake2b("r\u0430nk".encode(), digest_size=16).digest()


TABLES = {
    "p1_repaired": {"pdf_pages": "engine != 'pdfjs-dist'", "raster_results": "true", "image_intents": "true"},
    "p2_canonical": {"corpus_events": "true", "dialect_candidates": "true", "pdf_pages": "true"},
    "p4_redacted": {"pdf_pages": "true", "extracted_fields": "true", "corpus_events": "true"},
}


@pytest.mark.parametrize("name", sorted(TABLES))
def test_every_table_comes_out(name, spark, data):
    rows = q.queries()[name](spark, data).groupBy("record_table").count().collect()
    assert {r["record_table"]: r["count"] for r in rows} == {t: spark.read.parquet(f"{data}/{t}.parquet").where(x).count() for t, x in TABLES[name].items()}


def test_segments_of_both_tables(spark, data):
    assert {r[0] for r in q.queries()["p5_segments"](spark, data).select("record_table").distinct().collect()} == {"corpus_events", "documents"}


def test_words_broken_over_pages(spark, data):
    reader = scan.fit(spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/pdf_pages.parquet"))
    rows = [(1, 7, 1, "The board met at the east-", "x"), (2, 7, 2, "ern, wide canal.", "x"), (3, 7, 3, None, "x"), (4, None, 1, "The fcrry", "x"), (5, 7, 4, "text layer", "pdfjs-dist"), (6, 8, 1, "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, file_id long, page int, text string, engine string")
    got = {r["page_id"]: r["text"] for r in scan.repaired_pages(pages, reader).collect()}
    assert got == {1: "The board met at the eastern,", 2: "wide canal.", 3: None, 4: "The ferry", 6: ""}


def test_spellings_of_whole_texts_count(spark):
    usual = "x" * 1500 + " r\u200dal r\u200dal r\u200dal \u0430b \u0430b cd"
    df = spark.createDataFrame([(1, "ral ab"), (2, usual), (3, None), (4, "ral ab"), (5, usual), (6, "")], "id long, text string")
    words, rest = lookalike.vocabulary([(df, "text")])
    assert rest is None and {f: w for f, w, _ in words if f != w} == {"ral": "r\u200dal", "ab": "\u0430b"}
    want = {r["id"]: r["text"] for r in lookalike.canonical(df, words, "id", "text").collect()}
    assert want[1] == want[4] == "r\u200dal \u0430b" and want[2] == usual and want[3] is None
    for bound in ({"words": 1}, {"words": 0}, {"letters": 3}):  # what the trie cannot hold is joined
        words, rest = lookalike.vocabulary([(df, "text")], **bound)
        assert len(words) <= 1 and rest is not None
        assert sorted((r["id"], r["text"] or "") for r in lookalike.canonical(df, words, "id", "text", rest=rest).collect()) == sorted((i, t or "") for i, t in want.items())


def test_segments_have_places(spark, data):
    model = langid.train([tuple(r) for r in spark.read.parquet(f"{data}/lang_samples.parquet").select("lang", "text").collect()])
    en = ["The river station repaired the wooden gate before the heavy rain.", "The old office near the river was closed for the whole month."]
    bn = "\u09a8\u09a6\u09c0\u09b0 \u0998\u09be\u099f\u09c7\u09b0 \u0985\u09ab\u09bf\u09b8 \u09ae\u09be\u09b8\u09c7\u09b0 \u09b6\u09c7\u09b7 \u09b8\u09aa\u09cd\u09a4\u09be\u09b9\u09c7 \u099b\u09be\u09a6\u09c7\u09b0 \u09b0\u0982 \u09ab\u09bf\u09b0\u09bf\u09af\u09bc\u09c7\u099b\u09c7\u0964"
    text = f"{en[0].replace('re', 're\u200b')} {en[1]} {bn} {en[1]}"
    first, second = len(text) - len(en[1]), text.index(bn)
    df = spark.createDataFrame([(1, text), (2, None), (3, " ")], "id long, text string")
    want = [(1, 0, second - 1, "en", 2, "en"), (1, second, first - 1, "bn", 1, "en"), (1, first, len(text), "en", 1, "en")]
    columns = ["id", "start_pos", "end_pos", "lang", "sentences", "main_lang"]
    assert sorted(tuple(r) for r in langid.segments(df, model, "id", "text").select(columns).collect()) == want
    wiki = f"{{{{Infobox|a=b}}}}{chr(39) * 3}{en[0]}{chr(39) * 3}\n== Head ==\n{bn}<ref>x</ref>\n"
    got = langid.segments(spark.createDataFrame([(1, wiki)], "id long, text string"), model, "id", "text", True).collect()
    assert {r["lang"]: wiki[r["start_pos"] : r["end_pos"]] for r in got} == {"en": en[0], "bn": bn}


def test_models_do_not_depend_on_the_order_of_rows(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    pages, events = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("pdf_pages", "corpus_events"))
    clean = spark.read.parquet(f"{data}/lang_samples.parquet")
    readers = [scan.fit(p, train_pages=60) for p in (pages.repartition(1), pages.repartition(5, "page_id").sortWithinPartitions("text"))]
    assert readers[0].editor.model.weights == readers[1].editor.model.weights and readers[0].furniture.lead == readers[1].furniture.lead
    models = [langid.fit(clean, [(e, "language", "transcript")], rows=200) for e in (events.repartition(1), events.repartition(5, "event_id").sortWithinPartitions("transcript"))]
    assert (models[0][0] == models[1][0]).all() and models[0][1] == models[1][1]
