"""Text functions as columns.  Each normaliser is its own function: they differ on purpose.

Regular expressions spell out white space and word borders, as Java's own classes would read other characters
than the contract does.
"""

from __future__ import annotations

import unicodedata
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the contract (fixed values), as the inside of a character class.
WS = r"\t\n\x0B\f\r    -     　﻿"
#: Any character but a line's end, and borders of ASCII words (use the side that the next character needs).
DOT = r"[^\n\r  ]"
NO_WORD_BEFORE, NO_WORD_AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

BENGALI_DIGITS, ASCII_DIGITS = "০১২৩৪৫৬৭৮৯", "0123456789"

#: Keywords of the fact rules and what stands for them, in this order.
FACT_WORDS = [("ঘণ্টা", "hours"), ("সপ্তাহ", "week"), ("বয়স", "age"), ("বছর", "years"), ("নোটিশ", "notice"), ("দিন", "days")]

PREVIEW_CHARS = 1200


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """NFKC.  ASCII texts reach Python as nulls and come back untouched."""
    plain = c.rlike(r"^[\x00-\x7F]*\z")
    return F.coalesce(_nfkc(F.when(~plain, c)), c)


def collapse(c: Column) -> Column:
    """Runs of white space to one space, none at the ends; null stays null."""
    return F.regexp_replace(F.regexp_replace(c, f"[{WS}]+", " "), r"^ +| +\z", "")


def strip(c: Column) -> Column:
    """No white space at the ends."""
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+\z", "")


def ascii_digits(c: Column) -> Column:
    """Bengali digits to ASCII; length and offsets stay."""
    return F.translate(c, BENGALI_DIGITS, ASCII_DIGITS)


def norm_transcript(c: Column) -> Column:
    """NFKC, collapsed, ASCII digits, danda to full stop; case stays."""
    return F.translate(ascii_digits(collapse(nfkc(c))), "।॥", "..")


def norm_match(c: Column) -> Column:
    """NFKC, collapsed, lower case, ASCII digits; danda stays."""
    return ascii_digits(F.lower(collapse(nfkc(c))))


def norm_compare(c: Column) -> Column:
    """For gold comparison: null as empty, NFKC, collapsed, ASCII digits; case stays."""
    return ascii_digits(collapse(nfkc(F.coalesce(c, F.lit("")))))


def norm_intake(c: Column) -> Column:
    """ASCII digits, collapsed; neither NFKC nor lower case."""
    return collapse(ascii_digits(c))


def norm_facts(c: Column) -> Column:
    """ASCII digits, Bengali keywords replaced one after another wherever they stand, lower case."""
    out = ascii_digits(c)
    for word, to in FACT_WORDS:
        out = F.replace(out, F.lit(word), F.lit(to))
    return F.lower(out)


def preview(c: Column, chars: int = PREVIEW_CHARS) -> Column:
    return F.substring(norm_intake(c), 1, chars)


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def prefix(c: Column, most: int) -> tuple[Column, Column]:
    """The first ``most`` UTF-16 units, and whether any were cut off (null counts as not cut).  A character of two
    units that would be cut in half is left out."""
    start, empty = F.substring(c, 1, most), F.struct(F.lit(0).alias("units"), F.lit(0).alias("n"))
    unit = lambda x: F.when(x.rlike(r"[\x{10000}-\x{10FFFF}]"), 2).otherwise(1)
    whole = F.aggregate(F.split(start, ""), empty, lambda a, x: F.struct((a["units"] + unit(x)).alias("units"), (a["n"] + F.when(a["units"] + unit(x) <= most, F.when(x == "", 0).otherwise(1)).otherwise(0)).alias("n")), lambda a: a["n"])
    return F.when(utf16_length(start) <= most, start).otherwise(F.substr(start, F.lit(1), whole)), F.coalesce(utf16_length(c) > most, F.lit(False))


def fact_label(c: Column) -> Column:
    """A fact key for people: underscores to spaces, the first bdt and cet1 and every word hr in capitals."""
    out = F.replace(c, F.lit("_"), F.lit(" "))
    out = F.regexp_replace(out, r"(?s)^(.*?)bdt", "$1BDT")
    out = F.regexp_replace(out, r"(?s)^(.*?)cet1", "$1CET1")
    return F.regexp_replace(out, f"(?i){NO_WORD_BEFORE}hr{NO_WORD_AFTER}", "HR")


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def amount(c: Column) -> Column:
    """Money as a decimal string: no commas, no leading zeros, the fraction as written."""
    return F.regexp_replace(F.regexp_replace(c, ",", ""), "^0+(?=[0-9])", "")


@F.pandas_udf(T.DoubleType())
def _half_up(s: pd.Series, places: pd.Series) -> pd.Series:
    """Rounds the exact binary value, so a tie of the shortest spelling is none."""

    def one(x: float | None, n: int) -> float | None:
        return None if x is None or x != x else float(Decimal(x).quantize(Decimal(1).scaleb(-int(n)), ROUND_HALF_UP))

    return pd.Series([one(x, n) for x, n in zip(s, places, strict=True)], dtype="float64")


def clamp_score(c: Column, places: int) -> Column:
    """Rounded to ``places`` on the exact value, then held within 0 and 1; null (and no number) stays null."""
    rounded = _half_up(c.cast("double"), F.lit(places))
    return F.when(rounded < 0, 0.0).when(rounded > 1, 1.0).otherwise(rounded)
