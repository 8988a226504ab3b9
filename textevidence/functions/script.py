"""Script tags of texts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog.cues import VARIANTS
from .text import WS, norm_match

BENGALI, LATIN = r"[ঀ-৿]", "[A-Za-z]"


def has_bengali(c: Column) -> Column:
    return c.rlike(BENGALI)


def has_bengali_script(c: Column) -> Column:
    """By the script property, which differs from the block."""
    return c.rlike(r"\p{IsBengali}")


def ratio_tag(c: Column) -> Column:
    """bn or en from 70 per cent of the visible characters on, mixed with any letter of either, else unknown."""
    seen = F.regexp_replace(c, f"[{WS}]", "")
    total, bn, en = F.length(seen), F.regexp_count(seen, F.lit(BENGALI)), F.regexp_count(seen, F.lit(LATIN))
    return (
        F.when(c.isNull() | (total == 0), "unknown")
        .when(bn / total >= 0.7, "bn")
        .when(en / total >= 0.7, "en")
        .when((bn > 0) | (en > 0), "mixed")
        .otherwise("unknown")
    )


def token_core(token: Column) -> Column:
    """A token as the romanised list knows it: edges stripped, lower case, no apostrophes; null if not all a-z."""
    core = F.replace(F.lower(F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\z", "")), F.lit("'"), F.lit(""))
    return F.when(core.rlike(r"^[a-z]+\z"), core)


def romanised_tokens(normal: Column) -> Column:
    """Number of known romanised words in a text in match form."""
    return F.size(F.filter(F.split(normal, " "), lambda t: F.coalesce(token_core(t).isin(*VARIANTS), F.lit(False))))


def has_romanised(c: Column) -> Column:
    return romanised_tokens(norm_match(c)) > 0


def presence_tag(c: Column, normal: Column) -> Column:
    """mixed, bn, banglish, en or unknown, by the letters present; ``normal`` is the text in match form."""
    bn, latin = c.rlike(BENGALI), c.rlike(LATIN)
    words = F.size(F.filter(F.split(normal, " "), lambda t: t != ""))
    known = romanised_tokens(normal)
    dense = ((known >= 2) & (known / words >= 0.25)) | ((known >= 1) & (known / words >= 0.5))
    return F.when(c.isNull() | (~bn & ~latin), "unknown").when(bn & latin, "mixed").when(bn, "bn").when((words > 0) & dense, "banglish").otherwise("en")
