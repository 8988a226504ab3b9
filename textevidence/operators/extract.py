"""Structured extraction: identity numbers, licences, passports and invoices as fields with spans and checks.

The scanner is plain Python (usable and testable without Spark) behind one Arrow pass per text; a native
pre-filter keeps texts without any cue away from Python.  Spans count UTF-16 units of the given text.
Everything found is a candidate for review, never a verified fact.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import ASCII_DIGITS, BENGALI_DIGITS

VERSION = "bd_extract.v1"
_W = "[\t\n\x0b\f\r    -     　﻿]"  # white space of the contract
_D = str.maketrans(BENGALI_DIGITS, ASCII_DIGITS)
_B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"  # border of an ASCII word
_I = re.IGNORECASE
# Python folds the dotted and dotless i and the long s onto ASCII letters; the contract does so, too, in no pattern here.


def _re(pattern: str, flags: int = 0) -> re.Pattern[str]:
    return re.compile(pattern.replace(r"[\s", _W[:-1]).replace(r"\s", _W).replace(r"\b", _B), flags)


# Labels and contexts.
DOB = _re(r"date\s+of\s+birth|d\.?o\.?b\.?|birth\s+date|জন্ম\s*তারিখ|জন্মতারিখ", _I)
ISSUED = _re(r"date\s+of\s+issue|issue\s+date|issued\s+on|ইস্যুর\s*তারিখ|প্রদানের\s*তারিখ", _I)
EXPIRES = _re(r"date\s+of\s+expiry|expiry\s+date|expires?\s+on|valid\s+(?:until|till|thru)|মেয়াদ\s*উত্তীর্ণের\s*তারিখ|মেয়াদের\s*তারিখ|মেয়াদ", _I)
NID_LABEL = _re(r"(?:national\s+id(?:entity)?(?:\s+card)?|\bn\.?i\.?d\.?\b|জাতীয়\s+পরিচয়পত্র|পরিচয়পত্র|এনআইডি)(?:\s*(?:no\.?|number|নং|নম্বর))?", _I)
NID_CONTEXT = _re(r"national\s+id|\bn\.?i\.?d\.?\b|জাতীয়\s+পরিচয়পত্র|এনআইডি", _I)
HOLDER = _re(r"(?:^|\n)\s*(?:name|নাম)(?:\s*(?:\(english\)|ইংরেজিতে))?", _I)
LICENCE_LABEL = _re(r"(?:trade\s+licen[cs]e|licen[cs]e|ট্রেড\s*লাইসেন্স|লাইসেন্স)\s*(?:no\.?|number|নং|নম্বর)?", _I)
LICENCE_CONTEXT = _re(r"trade\s+licen[cs]e|ট্রেড\s*লাইসেন্স", _I)
PROPRIETOR = _re(r"proprietor(?:'s)?(?:\s+name)?|owner(?:'s)?(?:\s+name)?|স্বত্বাধিকারী|প্রোপ্রাইটর|মালিকের\s+নাম|মালিক", _I)
BUSINESS = _re(r"business\s+name|name\s+of\s+(?:business|firm|enterprise)|firm\s+name|প্রতিষ্ঠানের\s+নাম|ব্যবসা\s*প্রতিষ্ঠানের\s+নাম", _I)
PASSPORT_LABEL = _re(r"passport\s*(?:no\.?|number)?|পাসপোর্ট(?:\s*নং|\s*নম্বর)?", _I)
INVOICE_LABEL = _re(r"(?:invoice|bill|receipt|voucher|memo)\s*(?:no\.?|number|#)?|ইনভয়েস\s*নং|রসিদ\s*নং|চালান\s*নং", _I)
INVOICE_DATE = _re(r"invoice\s+date|bill\s+date|receipt\s+date|\bdate\b|তারিখ", _I)
TOTAL_LABEL = _re(r"grand\s+total|net\s+(?:amount|payable|total)|total\s*(?:amount|payable)?|amount\s+due|সর্বমোট|মোট\s*টাকা|মোট", _I)

# Shapes of what follows a label, the characters looked at behind it, months, amounts and caps.
LINE_VALUE = _re(r"[\s:\-–—।]*([^\n\r]{2,90})")
LICENCE_VALUE = _re(r"[\s:\-–—]*([A-Za-z0-9][A-Za-z0-9/-]{2,40}[A-Za-z0-9])")
PASSPORT_VALUE = _re(r"[\s:\-–—]*([A-Za-z]{1,2}[0-9]{6,9})")
INVOICE_VALUE = _re(r"[\s:#\-–—]*([A-Za-z0-9][A-Za-z0-9/-]{1,30}[A-Za-z0-9]|[A-Za-z0-9]{1,32})")
_AMOUNT = r"[0-9]{1,3}(?:,[0-9]{2,3})+(?:\.[0-9]{1,2})?|[0-9]+(?:\.[0-9]{1,2})?"
_MONEY = r"৳|\bBDT\b|\bTk\.?|\bTaka\b|টাকা"
TOTAL_VALUE = _re(rf"[\s:=\-–—]*(?:{_MONEY})?\s*({_AMOUNT})", _I)
AMOUNT = _re(rf"(?:{_MONEY})\s*({_AMOUNT})(?![0-9])|(?<![0-9.])({_AMOUNT})\s*(?:/-|{_MONEY})", _I)
PHONE = _re(r"(?<![0-9])(?:\+?880|0)[ \-]?1[3-9](?:[ \-]?[0-9]){8}(?![0-9])")
EMAIL = _re(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b")
NUMBER_RUN = _re(r"(?<![0-9])[0-9]+(?:[ \-][0-9]+)*(?![0-9])")
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
BENGALI_MONTHS = [("জানুয়ারি", 1), ("জানুয়ারী", 1), ("ফেব্রুয়ারি", 2), ("ফেব্রুয়ারী", 2), ("মার্চ", 3), ("এপ্রিল", 4), ("মে", 5), ("জুন", 6), ("জুলাই", 7), ("আগস্ট", 8), ("সেপ্টেম্বর", 9), ("অক্টোবর", 10), ("নভেম্বর", 11), ("ডিসেম্বর", 12)]
MOST_AMOUNTS, MOST_PHONES, MOST_EMAILS = 20, 5, 5

Span = tuple[int, int]


def iso_date(day: int, month: int, year: int) -> str | None:
    """ISO form of a calendar day of 1900 to 2100; None for any other."""
    if not (1900 <= year <= 2100 and 1 <= month <= 12 and day >= 1):
        return None
    days = 30 + (month + month // 8) % 2 if month != 2 else 28 + (year % 4 == 0 and (year % 100 != 0 or year % 400 == 0))
    return f"{year}-{month:02d}-{day:02d}" if day <= days else None


def full_year(text: str) -> int:
    return int(text) if len(text) == 4 else int(text) + (2000 if int(text) <= 69 else 1900)


def _month(name: str) -> int:
    """A month's number by the first letters of its name, however the word goes on; 0 for none."""
    low = name.lower()
    return 9 if low.startswith("sept") else MONTHS.index(low[:3]) + 1 if low[:3] in MONTHS else 0


_BENGALI_MONTH = dict(BENGALI_MONTHS)
_DAY_YEAR = _re(r"(?<![0-9])([0-9]{1,2})(?:st|nd|rd|th)?,?\s+([0-9]{4})(?![0-9])", _I)
_MONTH_BEFORE = _re(r"(?<![A-Za-z0-9_])([A-Za-z]{3,9})\.?\s+\Z")


def _shaped(pattern: str, day: int, month: int, year: int, flags: int = 0) -> Callable[[str], Iterator[tuple[str | None, Span]]]:
    """A finder of dates of one shape; the numbers are the groups of day, month and year."""
    compiled = _re(pattern, flags)

    def find(text: str) -> Iterator[tuple[str | None, Span]]:
        for m in compiled.finditer(text):
            name = m[month]
            number = int(name) if name.isdigit() else _BENGALI_MONTH.get(name) or _month(name)
            yield iso_date(int(m[day]), number, full_year(m[year])), m.span()

    return find


def _month_first(text: str) -> Iterator[tuple[str | None, Span]]:
    """Month, day, year: looked for from the day on, as nearly every word could be a month's name."""
    for m in _DAY_YEAR.finditer(text):
        from_ = m.start()  # back over spaces and one word, however far
        while from_ > 0 and text[from_ - 1].isspace():
            from_ -= 1
        from_ = max(0, from_ - 11)
        if before := _MONTH_BEFORE.search(text[from_ : m.start()]):
            yield iso_date(int(m[1]), _month(before[1]), int(m[2])), (from_ + before.start(), m.end())


# Date shapes in the order of their right to a place.
DATE_SHAPES = [
    _shaped(r"(?<![0-9])([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})(?![0-9])", 3, 2, 1),
    _shaped(r"(?<![0-9])([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4}|[0-9]{2})(?![0-9])", 1, 2, 3),
    _shaped(r"(?<![0-9])([0-9]{1,2})\s*(?:st|nd|rd|th)?\s+([A-Za-z]{3,9})\.?,?\s+([0-9]{4})(?![0-9])", 1, 2, 3, _I),
    _month_first,
    _shaped(rf"(?<![0-9])([0-9]{{1,2}})\s+({'|'.join(name for name, _ in BENGALI_MONTHS)})\s+([0-9]{{4}})(?![0-9])", 1, 2, 3),
]


def find_dates(text: str) -> list[tuple[str, Span]]:
    """(ISO date, span) of the valid dates, in order; of overlapping ones the earlier shape's stays."""
    spans: list[Span] = []
    dates: list[str] = []
    for shape in DATE_SHAPES:
        for iso, (start, end) in shape(text):
            at = bisect_left(spans, (start, end))
            if iso and (at == 0 or spans[at - 1][1] <= start) and (at == len(spans) or end <= spans[at][0]):
                spans.insert(at, (start, end))
                dates.insert(at, iso)
    return list(zip(dates, spans, strict=True))


def check_digit(characters: str) -> str:
    """The 7-3-1 digit over 0-9, A=10 to Z=35, filler 0."""
    values = (int(c, 36) if c.isascii() and c.isalnum() and not c.islower() else 0 for c in characters)
    return str(sum(v * (7, 3, 1)[i % 3] for i, v in enumerate(values)) % 10)


def decimal_amount(text: str) -> str:
    whole, dot, rest = text.replace(",", "").partition(".")
    return (whole.lstrip("0") or whole[-1:]) + dot + rest


def phone_numbers(text: str) -> list[tuple[str, Span]]:
    out = []
    for m in PHONE.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if len(digits) == 11 and digits[:2] == "01":
            out.append(("+880" + digits[1:], m.span()))
        elif len(digits) == 13 and digits[:4] == "8801":
            out.append(("+" + digits, m.span()))
    return out


_BENGALI_DIGIT = re.compile("[০-৯]+")

# For each label: if none of these stands in the lower-case text, the label does not, either.
_KEYS = {
    DOB: ["birth", "ob", "o.b", "জন্ম"], ISSUED: ["issue", "তারিখ"], EXPIRES: ["exp", "valid", "মেয়াদ", "মেয\u09bcাদ"], NID_LABEL: ["national", "id", "i.d", "পরিচ", "এনআইডি"], NID_CONTEXT: ["national", "id", "i.d", "পরিচ", "এনআইডি"],
    HOLDER: ["name", "নাম"], LICENCE_LABEL: ["licen", "লাইসেন্স"], PROPRIETOR: ["proprietor", "owner", "স্বত্বাধিকারী", "প্রোপ্রাইটর", "মালিক"], BUSINESS: ["name", "নাম"], PASSPORT_LABEL: ["passport", "পাসপোর্ট"],
    INVOICE_LABEL: ["invoice", "bill", "receipt", "voucher", "memo", "নং"], INVOICE_DATE: ["date", "তারিখ"], TOTAL_LABEL: ["total", "amount", "net", "মোট"], AMOUNT: ["৳", "/-", "টাকা", "bdt", "tk", "taka"], EMAIL: ["@"],
}


@dataclass
class Scan:
    """One text under extraction: the raw text, its ASCII-digit form of the same length, and its dates."""

    raw: str
    text: str = ""
    low: str = ""
    dates: list[tuple[str, Span]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.text = self.raw if self.raw.isascii() else _BENGALI_DIGIT.sub(lambda m: m.group().translate(_D), self.raw)
        self.low = self.text.lower()
        self.dates = find_dates(self.text)

    def hits(self, label: re.Pattern[str]) -> Iterator[re.Match[str]]:
        """Places of a label; a text without any of its key words is not scanned."""
        return label.finditer(self.text) if any(k in self.low for k in _KEYS[label]) else iter(())

    def field(self, name: str, value: str, span: Span, label: str | None) -> dict:
        return {"field": name, "value": value, "raw": self.raw[slice(*span)], "span": span, "source_label": label, "pattern_strength": "unlabelled" if label is None else "labelled", "verification_status": "candidate_only"}

    def behind(self, label: re.Pattern[str], value: re.Pattern[str], reach: int) -> tuple[str, Span, str] | None:
        """The first label with a value right behind it: (value, span, label)."""
        for m in self.hits(label):
            at = m.end()
            got = value.match(self.text[at : at + reach])
            if got:
                return got[1], (at + got.start(1), at + got.end(1)), _strip(m.group())
        return None

    def line_behind(self, label: re.Pattern[str]) -> tuple[str, Span, str] | None:
        """The rest of the line behind a label; wide gaps end it."""
        got = self.behind(label, LINE_VALUE, 120)
        if got is None:
            return None
        value, (start, _), name = got
        gap = re.search(f"{_W}{{3,}}", value)
        if gap and gap.start() > 0:
            value = value[: gap.start()]
        value = _strip(re.sub(rf"(?:{_W}|[,;।])+\Z", "", value))
        return (value, (start, start + len(value)), name) if len(value) >= 2 else None

    def date_behind(self, name: str, label: re.Pattern[str]) -> dict | None:
        """The first label with a date that begins within 60 characters behind it."""
        for m in self.hits(label):
            at = bisect_left(self.dates, m.end(), key=lambda d: d[1][0])
            if at < len(self.dates) and self.dates[at][1][0] <= m.end() + 60:
                return self.field(name, *self.dates[at], _strip(m.group()))
        return None


def _strip(text: str) -> str:
    return re.sub(rf"^{_W}+|{_W}+\Z", "", text)


def _note(code: str, of: str | None, status: str, detail: str) -> dict:
    return {"code": code, "field": of, "status": status, "detail": detail}


def _plausible_nid(digits: str) -> bool:
    return len(digits) in (10, 13, 17) and len(set(digits)) > 1 and (len(digits) != 17 or 1900 <= int(digits[:4]) <= 2030)


def _nid_number(scan: Scan) -> tuple[str, Span, str | None] | None:
    places = [(m.end(), m.end() + 80, _strip(m.group())) for m in scan.hits(NID_LABEL)]
    if next(scan.hits(NID_CONTEXT), None):
        places.append((0, len(scan.text), None))  # without a label a number counts only if the text speaks of such numbers
    for start, stop, label in places:
        window = scan.text[start:stop]
        for m in NUMBER_RUN.finditer(window):
            digits = re.sub("[^0-9]", "", m.group())
            if _plausible_nid(digits):
                return digits, (start + m.start(), start + m.end()), label
    return None


def nid(scan: Scan) -> dict:
    got = _nid_number(scan)
    if got is None:
        return {"schema": "bd_nid", "fields": [], "validations": [_note("nid_number_missing", "nid_number", "missing", "no number of 10, 13 or 17 digits behind a label or in context")]}
    digits, span, label = got
    fields = [scan.field("nid_number", digits, span, label), scan.field("nid_format", f"{len(digits)}_digit", span, label)]
    notes = [_note("nid_format", "nid_number", "pass", f"{len(digits)} digits; form only, there is no public check digit")]
    if holder := scan.line_behind(HOLDER):
        fields.append(scan.field("holder_name", *holder))
    if born := scan.date_behind("date_of_birth", DOB):
        fields.append(born)
    if len(digits) != 17:
        notes.append(_note("nid_dob_cross_check", "date_of_birth", "not_applicable", f"{len(digits)} digits hold no birth year"))
    elif not born:
        notes.append(_note("nid_dob_cross_check", "date_of_birth", "missing", f"no labelled birth date to compare with {digits[:4]}"))
    else:
        notes.append(_note("nid_dob_cross_check", "date_of_birth", "pass" if born["value"][:4] == digits[:4] else "fail", f"number begins with {digits[:4]}, birth date is {born['value']}"))
    return {"schema": "bd_nid", "fields": fields, "validations": notes}


def licence(scan: Scan) -> dict:
    fields, notes = [], []
    if got := scan.behind(LICENCE_LABEL, LICENCE_VALUE, 60):
        fields.append(scan.field("licence_number", *got))
    else:
        notes.append(_note("licence_number_missing", "licence_number", "missing", "no labelled licence number"))
    for name, label in (("proprietor_name", PROPRIETOR), ("business_name", BUSINESS)):
        if got := scan.line_behind(label):
            fields.append(scan.field(name, *got))
    issued, expires = scan.date_behind("issue_date", ISSUED), scan.date_behind("expiry_date", EXPIRES)
    fields += [x for x in (issued, expires) if x]
    if issued and expires:
        notes.append(_note("licence_date_order", "expiry_date", "pass" if expires["value"] >= issued["value"] else "fail", f"issued {issued['value']}, expires {expires['value']}"))
    return {"schema": "bd_trade_licence", "fields": sorted(fields, key=lambda f: f["span"][0]), "validations": notes}


def _mrz(text: str) -> tuple[str, Span, str, Span] | None:
    lines, at = [], 0
    for line in text.split("\n"):
        body = line[:-1] if line.endswith("\r") else line
        lines.append((re.sub(_W, "", body.upper()), (at, at + len(body))))
        at += len(line) + 1
    for (one, span1), (two, span2) in zip(lines, lines[1:], strict=False):
        if len(one) >= 30 and re.match("P[<A-Z]", one) and re.fullmatch("[A-Z0-9<]{28,}", two):
            return one, span1, two, span2
    return None


def _mrz_date(text: str, expiry: bool) -> str | None:
    if not re.fullmatch("[0-9]{6}", text):
        return None
    year = int(text[:2])
    return iso_date(int(text[4:]), int(text[2:4]), year + (2000 if expiry or year <= 29 else 1900))


def passport(scan: Scan) -> dict:
    fields, notes = [], []
    mrz = _mrz(scan.text)
    if mrz:
        one, span1, two, span2 = mrz
        surname, _, given = one[5:].rstrip("<").partition("<<")
        found = [("document_number", two[:9].rstrip("<"), span2), ("surname_mrz", surname.replace("<", " ").strip(), span1), ("given_names_mrz", given.split("<<")[0].replace("<", " ").strip(), span1), ("date_of_birth", _mrz_date(two[13:19], False), span2), ("expiry_date", _mrz_date(two[21:27], True), span2)]
        fields = [scan.field(name, value, span, "mrz_line_1" if span == span1 else "mrz_line_2") for name, value, span in found if value]
        checks = [("mrz_document_number_check_digit", "document_number", two[:9], two[9:10]), ("mrz_dob_check_digit", "date_of_birth", two[13:19], two[19:20]), ("mrz_expiry_check_digit", "expiry_date", two[21:27], two[27:28])]
        if len(two) >= 44:
            checks.append(("mrz_composite_check_digit", None, two[:10] + two[13:20] + two[21:43], two[43]))
        notes = [_note(code, of, "pass" if digit.isdigit() and check_digit(part) == digit else "fail", f"check digit of {of or 'the whole line'}") for code, of, part, digit in checks]
    else:
        if got := scan.behind(PASSPORT_LABEL, PASSPORT_VALUE, 40):
            fields.append(scan.field("document_number", got[0].upper(), got[1], got[2]))
        else:
            notes.append(_note("passport_document_number_missing", "document_number", "missing", "neither machine-readable lines nor a labelled number"))
        fields += [x for x in (scan.date_behind("date_of_birth", DOB), scan.date_behind("expiry_date", EXPIRES)) if x]
    return {"schema": "bd_passport", "fields": sorted(fields, key=lambda f: f["span"][0]), "validations": notes}


def invoice(scan: Scan) -> dict:
    fields, notes = [], []
    if got := scan.behind(INVOICE_LABEL, INVOICE_VALUE, 40):
        fields.append(scan.field("invoice_number", *got))
    day = scan.date_behind("invoice_date", INVOICE_DATE)
    if day is None and scan.dates:
        day = scan.field("document_date", scan.dates[0][0], scan.dates[0][1], None)
    if day:
        fields.append(day)
    total = scan.behind(TOTAL_LABEL, TOTAL_VALUE, 50)
    if total:
        fields.append(scan.field("total_amount_bdt", decimal_amount(total[0]), total[1], total[2]))
    else:
        notes.append(_note("invoice_total_missing", "total_amount_bdt", "missing", "no labelled total"))
    amounts = [(m[g], m.span(g)) for m in scan.hits(AMOUNT) for g in (1 if m[1] is not None else 2,)]
    fields += [scan.field("amount_bdt", decimal_amount(a), span, None) for a, span in [x for x in amounts if not total or x[1] != total[1]][:MOST_AMOUNTS]]
    fields += [scan.field("phone", value, span, None) for value, span in phone_numbers(scan.text)[:MOST_PHONES]]
    fields += [scan.field("email", m.group().lower(), m.span(), None) for m in [*scan.hits(EMAIL)][:MOST_EMAILS]]
    return {"schema": "generic_invoice", "fields": sorted(fields, key=lambda f: f["span"][0]), "validations": notes}


def extract_text(raw: str) -> list[dict]:
    """The schemas a text shows, in fixed order, each with its fields and validation notes."""
    scan = Scan(raw)
    units = _utf16(raw)
    out = []
    for made in (nid(scan), licence(scan), passport(scan), invoice(scan)):
        names = {f["field"] for f in made["fields"]}
        shown = {
            "bd_nid": "nid_number" in names,
            "bd_trade_licence": "licence_number" in names or "proprietor_name" in names and LICENCE_CONTEXT.search(raw) is not None,
            "bd_passport": "document_number" in names,
            "generic_invoice": bool(names & {"invoice_number", "total_amount_bdt", "amount_bdt", "phone", "email"}),
        }[made["schema"]]
        if shown:
            made |= {"schema_version": VERSION, "review_required": True}
            for f in made["fields"]:
                start, end = f["span"]
                f["span"] = {"start": units(start), "end": units(end)}
            out.append(made)
    return out


def _utf16(text: str) -> Callable[[int], int]:
    if text.isascii() or max(text) < "\U00010000":
        return lambda i: i
    return lambda i: i + sum(c >= "\U00010000" for c in text[:i])


_FIELD = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("field", "value", "raw")), T.StructField("span", T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])),
    *(T.StructField(n, T.StringType()) for n in ("source_label", "pattern_strength", "verification_status")),
])
_NOTE = T.StructType([T.StructField(n, T.StringType()) for n in ("code", "field", "status", "detail")])
EXTRACTIONS = T.ArrayType(T.StructType([T.StructField("schema", T.StringType()), T.StructField("schema_version", T.StringType()), T.StructField("review_required", T.BooleanType()), T.StructField("fields", T.ArrayType(_FIELD)), T.StructField("validations", T.ArrayType(_NOTE))]))


@F.arrow_udf(EXTRACTIONS)
def _extract(text: pa.Array) -> pa.Array:
    return pa.array([extract_text(t) if t else [] for t in text.to_pylist()], to_arrow_type(EXTRACTIONS))


#: Evaluated once per row, whatever filters stand above it.
_extract_once = _extract.asNondeterministic()


def may_hold(text: Column) -> Column:
    """False only for texts that no schema can be found in; keeps them away from Python."""
    return text.rlike(r"(?i)[0-9০-৯৳@]|licen[cs]e|লাইসেন্স|invoice|bill|receipt|voucher|memo|নং")


def extractions(text: Column) -> Column:
    """The structured fields of a text; none for null, empty and cue-less texts."""
    return _extract_once(F.when(may_hold(text), text))


def extract(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, extractions): the structured fields of each text; null, empty and cue-less texts have none."""
    return df.select(df[id_col].alias(id_col), extractions(df[text_col]).alias("extractions"))


def extract_fields(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, schema, field, value, raw, span, source_label, pattern_strength, verification_status): one row per field."""
    rows = extract(df.where(may_hold(df[text_col])), id_col, text_col).select(id_col, F.explode("extractions").alias("e"))
    return rows.select(id_col, "e.schema", F.explode("e.fields").alias("f")).select(id_col, "schema", "f.*")


def extract_notes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, schema, code, field, status, detail): one row per validation note of a shown schema."""
    rows = extract(df.where(may_hold(df[text_col])), id_col, text_col).select(id_col, F.explode("extractions").alias("e"))
    return rows.select(id_col, "e.schema", F.explode("e.validations").alias("n")).select(id_col, "schema", "n.*")
