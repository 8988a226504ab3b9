"""Normalisers, script tags and similarities on their hazards."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textevidence.functions import script, similarity, text
from textevidence.functions.editbits import Phrases
from textevidence.operators import dialect


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("  a 　b\n", "a b"), ("", ""), (" ﻿", ""), (None, None), ("a\n", "a")])
def test_collapse(spark, raw, want):
    assert one(spark, raw, text.collapse) == want


def test_forms_differ(spark):
    raw = " Ａbc ১২।  "
    assert one(spark, raw, text.norm_transcript) == "Abc 12."
    assert one(spark, raw, text.norm_match) == "abc 12।"
    assert one(spark, raw, text.norm_compare) == "Abc 12।"
    assert one(spark, raw, text.norm_intake) == "Ａbc 12।"
    assert one(spark, None, text.norm_compare) == ""
    assert one(spark, "৩০ দিন নোটিশ Wage", text.norm_facts) == "30 days notice wage"


def test_utf16_and_prefix(spark):
    assert one(spark, "a😀", text.utf16_length) == 3
    assert one(spark, "x" * 2001, lambda c: text.prefix(c, 2000)[1]) is True
    assert one(spark, None, lambda c: text.prefix(c, 2000)[1]) is False


def test_score_rounds_the_exact_value(spark):
    assert one(spark, 1.0005, lambda c: text.clamp_score(c - 1 + 0.5, 3), "double") == 0.5
    assert one(spark, 0.6475, lambda c: text.clamp_score(c, 3), "double") == 0.647  # just below the tie
    assert one(spark, 7.0, lambda c: text.clamp_score(c, 3), "double") == 1.0


def test_labels_and_amounts(spark):
    assert one(spark, "transaction_amount_bdt", text.fact_label) == "transaction amount BDT"
    assert one(spark, "bdt_bdt_hr_hrs", text.fact_label) == "BDT bdt HR hrs"
    assert one(spark, "001,260.50", text.amount) == "1260.50"
    assert one(spark, "0", text.amount) == "0"


@pytest.mark.parametrize(("raw", "want"), [("আমি ভাত খাই", "bn"), ("plain words", "en"), ("আমি rice খাই", "mixed"), ("12 3।", "unknown"), ("", "unknown"), (None, "unknown")])
def test_ratio_tag(spark, raw, want):
    assert one(spark, raw, script.ratio_tag) == want


@pytest.mark.parametrize(("raw", "want"), [("আমি", "bn"), ("plain English words only", "en"), ("আমি go", "mixed"), ("ami kal office jabo na, basay thaki", "banglish"), ("12।", "unknown"), (None, "unknown"), ("the taka and the taka in this long English text about one taka", "en")])
def test_presence_tag(spark, raw, want):
    assert one(spark, raw, lambda c: script.presence_tag(c, text.norm_match(c))) == want


def test_similarities(spark):
    pair = lambda a, b, f: spark.createDataFrame([(a, b)], "a string, b string").select(f(F.col("a"), F.col("b"))).first()[0]
    assert pair("আমি", "আম", similarity.char_similarity) == pytest.approx(2 / 3)
    assert pair("", "x", similarity.char_similarity) == 0.0
    assert pair(None, "x", similarity.phrase_score) == 0.0
    assert pair("a b c", "b c d e", similarity.token_f1) == pytest.approx(2 * (2 / 3) * 0.5 / (2 / 3 + 0.5))
    assert pair("x" * 301, "x" * 300 + "y", similarity.phrase_score) == 0.0
    assert pair("abc", "abd", similarity.phrase_score) == pytest.approx(2 / 3)


def plain_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abে ি😀", min_size=1, max_size=140), min_size=1, max_size=3), st.lists(st.text("abcে ি", max_size=150), min_size=1, max_size=4))
def test_bit_distances(phrases, texts):
    got = Phrases(phrases).distances(texts)
    assert [[plain_distance(p, t) for p in phrases] for t in texts] == got.tolist()


def test_romanised_forms_agree(spark):
    for raw in ["ami sylheti bhashay kotha koi", "kita kortaso? amra cumillay thaki", "আমি, কথা।", "o'clock taka!", ""]:
        native = one(spark, raw, lambda c: dialect.norm_romanised(text.norm_match(c)))
        assert native == dialect.romanised_form(raw)
    assert dialect.romanised_form("ami sylheti bhashay kotha koi") == dialect.romanised_form("আমি সিলেটি ভাষায় কথা কই")
