"""Similarities of two texts as columns; empty or null sides give 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog.cues import LONGEST_EDIT


def char_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise((longer - F.levenshtein(a, b)) / longer)


def token_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, " "), lambda t: t != ""))


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two arrays of distinct tokens."""
    common = F.size(F.array_intersect(a, b))
    precision, recall = common / F.size(a), common / F.size(b)
    return F.when((F.size(a) <= 0) | (F.size(b) <= 0) | (common == 0), 0.0).otherwise(2 * precision * recall / (precision + recall))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the distinct words of two collapsed texts."""
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(set_f1(token_set(a), token_set(b)))


def phrase_score(a: Column, b: Column, longest: int = LONGEST_EDIT) -> Column:
    """The better of both; long texts skip the edit distance, whose cost is the product of the lengths."""
    return (
        F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.0)
        .when(a == b, 1.0)
        .when(F.greatest(F.length(a), F.length(b)) > longest, token_f1(a, b))
        .otherwise(F.greatest(char_similarity(a, b), token_f1(a, b)))
    )
