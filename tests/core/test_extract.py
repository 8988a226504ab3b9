"""Structured extraction and facts on known cases."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textevidence.operators import extract, facts
from textevidence.operators.extract import check_digit, extract_text, find_dates, iso_date


def values(text: str, schema: str) -> dict[str, str]:
    return {f["field"]: f["value"] for e in extract_text(text) if e["schema"] == schema for f in e["fields"]}


def notes(text: str, schema: str) -> dict[str, str]:
    return {n["code"]: n["status"] for e in extract_text(text) if e["schema"] == schema for n in e["validations"]}


def test_nid():
    text = "National ID No: 19901234567890123\nDate of Birth: 12 Jan 1990"
    assert values(text, "bd_nid") == {"nid_number": "19901234567890123", "nid_format": "17_digit", "date_of_birth": "1990-01-12"}
    assert notes(text, "bd_nid")["nid_dob_cross_check"] == "pass"
    assert notes(text.replace("12 Jan 1990", "12 Jan 1991"), "bd_nid")["nid_dob_cross_check"] == "fail"
    bengali = "জাতীয় পরিচয়পত্র নং: ১২৩৪৫৬৭৮৯০\nজন্ম তারিখ: ৫ মার্চ ১৯৯৫"
    assert values(bengali, "bd_nid") == {"nid_number": "1234567890", "nid_format": "10_digit", "date_of_birth": "1995-03-05"}


@pytest.mark.parametrize("text", ["1111111111", "NID 1111111111", "1234567890", "Ref 1234567890123", "NID 123456789", "NID 12345678901", ""])
def test_no_nid(text):
    assert values(text, "bd_nid") == {}


def test_spans_and_raw():
    text = "😀 NID: ১২৩৪ ৫৬৭ ৮৯০"
    field = extract_text(text)[0]["fields"][0]
    units = text.encode("utf-16-le")
    start, end = field["span"]["start"], field["span"]["end"]
    assert units[2 * start : 2 * end].decode("utf-16-le") == field["raw"] == "১২৩৪ ৫৬৭ ৮৯০"
    assert field["value"] == "1234567890"


def test_licence():
    text = "Trade Licence No: DNCC-2023-778899\nProprietor: Karim    Phone\nIssue Date: 15/01/2024\nExpiry Date: 14/01/2023"
    assert values(text, "bd_trade_licence") == {"licence_number": "DNCC-2023-778899", "proprietor_name": "Karim", "issue_date": "2024-01-15", "expiry_date": "2023-01-14"}
    assert notes(text, "bd_trade_licence") == {"licence_date_order": "fail"}


def mrz(number: str = "A01234567") -> str:
    two = number + check_digit(number) + "BGD900112" + check_digit("900112") + "M301231" + check_digit("301231") + "<" * 15
    return "P<BGDRAHIM<<ABDUL<KARIM" + "<" * 21 + "\r\n" + two + check_digit(two[:10] + two[13:20] + two[21:43])


def test_passport():
    got = values(mrz(), "bd_passport")
    assert got == {"surname_mrz": "RAHIM", "given_names_mrz": "ABDUL KARIM", "document_number": "A01234567", "date_of_birth": "1990-01-12", "expiry_date": "2030-12-31"}
    assert set(notes(mrz(), "bd_passport").values()) == {"pass"}
    broken = notes(mrz().replace("A01234567", "A01234568"), "bd_passport")
    assert broken["mrz_document_number_check_digit"] == broken["mrz_composite_check_digit"] == "fail"
    assert check_digit("A01234567") == "8"
    assert values("পাসপোর্ট নং: EA0987654", "bd_passport") == {"document_number": "EA0987654"}


def test_invoice():
    text = "Invoice No: INV-2024-0042\nInvoice Date: 05/11/2024\nGrand Total: Tk 126,000.00\nPaid Tk 6,000\nPhone 01712-345678 Email: A.B@Example.com"
    assert values(text, "generic_invoice") == {"invoice_number": "INV-2024-0042", "invoice_date": "2024-11-05", "total_amount_bdt": "126000.00", "amount_bdt": "6000", "phone": "+8801712345678", "email": "a.b@example.com"}
    many = " ".join(f"a{i}@b.org" for i in range(12))
    assert sum(f["field"] == "email" for e in extract_text(many) for f in e["fields"]) == 5
    assert values("৳500 and 300 taka", "generic_invoice") == {"amount_bdt": "300"}
    assert values("Invoice Date: 2024-01-01", "generic_invoice")["invoice_number"] == "Date"
    assert values("billing", "generic_invoice")["invoice_number"] == "ing"
    assert extract_text("A plain story of a river.") == []


def test_dates():
    assert find_dates("2024-02-30 31/12/99 Marketing 5, 2020") == [("1999-12-31", (11, 19)), ("2020-03-05", (20, 37))]
    assert iso_date(29, 2, 2000) == "2000-02-29" and iso_date(29, 2, 1900) is None and iso_date(31, 4, 2000) is None


@settings(max_examples=100, deadline=None)
@given(st.dates(min_value=__import__("datetime").date(1900, 1, 1), max_value=__import__("datetime").date(2100, 12, 31)))
def test_every_day(day):
    assert iso_date(day.day, day.month, day.year) == day.isoformat()
    assert find_dates(f"x {day.day}.{day.month}.{day.year} y")[0][0] == day.isoformat()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    for e in extract_text(text):
        for f in e["fields"]:
            assert f["raw"] == text.encode("utf-16-le", "surrogatepass")[2 * f["span"]["start"] : 2 * f["span"]["end"]].decode("utf-16-le", "surrogatepass")


def test_frame_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "no cue at all", "x"), (4, "mail a@b.org", "x"), (4, "mail a@b.org", "x")], "id int, text string, extractions string")
    rows = extract.extract(df, "id", "text").collect()
    assert sorted((r["id"], len(r["extractions"])) for r in rows) == [(1, 0), (2, 0), (3, 0), (4, 1), (4, 1)]
    assert extract.extract(df.where("false"), "id", "text").count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("wage 12", {"worker_age_years": "12"}), ("unqualified acceptance", {"acceptance_qualified": "true"}), ("notice of 30 days", {"notice_period_days": "0"}),
        ("Tk 12,600", {"transaction_amount_bdt": "12"}), ("unverified", {"customer_identity_verified": "true"}), ("permanent then temporary", {"worker_type": "temporary"}),
        ("48 hours per week", {"working_hours_per_week": "48"}), ("weekly: 40.5 hrs", {"working_hours_per_week": "40.5"}), ("week\n40 hours", {}),
        ("washing not approved", {"subcontractor_declared_and_approved": "false"}), ("printing approved", {"subcontractor_declared_and_approved": "true"}),
        ("CET1\nratio 10.5", {"cet1_ratio": "10.5"}), ("৩০ দিন নোটিশ", {"notice_period_days": "30"}), ("", {}), ("nothing", {}),
    ],
)
def test_facts(spark, text, want):
    rows = facts.extract_facts(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text").collect()
    assert {r["fact_key"]: r["value"] for r in rows} == want
