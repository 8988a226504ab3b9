"""Dialect cue matching: every text against the cue catalog, the best cue, and a floor.

Forms, tags and floors are native expressions.  Scoring is one Arrow pass: the built-in edit distance takes about
4 ms for a Bengali text against 19 cues in two views, the bit-parallel one 0.1 ms.  There is no join and no exchange.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog.cues import CUES, CURATED_FLOOR, CURATED_LABELS, FLOOR, LONGEST_EDIT, MOST_CHARS, REGIONS, VARIANTS
from ..functions.editbits import Phrases
from ..functions.script import presence_tag, token_core
from ..functions.text import ASCII_DIGITS, BENGALI_DIGITS, norm_match, prefix

_SPACE = "[\t\n\x0b\f\r    -     　﻿]+"


def match_form(text: str) -> str:
    """norm_match in Python, for the catalog's side."""
    text = re.sub(_SPACE, " ", unicodedata.normalize("NFKC", text)).strip(" ").lower()
    return text.translate(str.maketrans(BENGALI_DIGITS, ASCII_DIGITS))


def _edges(token: str, kinds: str) -> str:
    inner = [i for i, c in enumerate(token) if unicodedata.category(c)[0] in kinds]
    return token[inner[0] : inner[-1] + 1] if inner else ""


def romanised_form(text: str) -> str:
    """norm_romanised in Python, for the catalog's side."""
    out = []
    for token in match_form(text).split(" "):
        core = _edges(token, "LN").lower().replace("'", "")
        out.append(VARIANTS.get(core) or _edges(token, "LMN"))
    return " ".join(t for t in out if t)


def norm_romanised(normal: Column) -> Column:
    """A text in match form with known romanised words in Bengali and no punctuation at the edges of words."""
    lookup = F.create_map(*[F.lit(x) for pair in VARIANTS.items() for x in pair])
    words = F.transform(F.split(normal, " "), lambda t: F.coalesce(F.try_element_at(lookup, token_core(t)), F.regexp_replace(t, r"^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+\z", "")))
    return F.array_join(F.filter(words, lambda t: t != ""), " ")


class _View:
    """One view of the catalog: the forms of all cues and their words."""

    def __init__(self, form):
        self.forms = [form(c[0]) for c in CUES]
        self.phrases = Phrases(self.forms)
        self.sizes = np.array([len({w for w in f.split(" ") if w}) for f in self.forms])
        self.lengths = np.array([len(f) for f in self.forms])
        self.cues_of: dict[str, list[int]] = {}
        for i, f in enumerate(self.forms):
            for w in {w for w in f.split(" ") if w}:
                self.cues_of.setdefault(w, []).append(i)

    def scores(self, texts: list[str]) -> np.ndarray:
        """phrase_score of every text (rows) against every cue (columns)."""
        out = np.zeros((len(texts), len(self.forms)))
        for i, text in enumerate(texts):
            words = {w for w in text.split(" ") if w}
            common = np.zeros(len(self.forms))
            for w in words & self.cues_of.keys():
                common[self.cues_of[w]] += 1
            if common.any():
                p, r = common / self.sizes, common / len(words)
                out[i] = np.divide(2 * p * r, p + r, out=np.zeros_like(p), where=common > 0)
        near = [i for i, t in enumerate(texts) if 0 < len(t) <= LONGEST_EDIT]
        if near:
            some = [texts[i] for i in near]
            longer = np.maximum(np.array([len(t) for t in some])[:, None], self.lengths[None, :])
            out[near] = np.maximum(out[near], (longer - self.phrases.distances(some)) / longer)
        return out


@lru_cache(maxsize=1)
def _views() -> tuple[_View, _View]:
    return _View(match_form), _View(romanised_form)


_BEST = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("at", T.IntegerType())])


@F.pandas_udf(_BEST)
def _best_cue(normal: pd.Series, romanised: pd.Series) -> pd.DataFrame:
    """The best score over both views and the cue's place in the catalog; of equal scores the first cue stays."""
    score, at = np.zeros(len(normal)), np.zeros(len(normal), np.int32)
    for start in range(0, len(normal), 4000):
        part = slice(start, start + 4000)
        both = np.maximum(*(view.scores(side.iloc[part].fillna("").tolist()) for view, side in zip(_views(), (normal, romanised), strict=True)))
        at[part] = both.argmax(1)
        score[part] = both.max(1)
    return pd.DataFrame({"score": score, "at": at})


#: Evaluated once per row, whatever filters stand above it.
best_cue = _best_cue.asNondeterministic()


def infer_dialect(df: DataFrame, text_col: str) -> DataFrame:
    """Adds status, source, dialect_label, speaker_region, match_score, candidate_label, candidate_dialect_label,
    script_mix, input_truncated, method and confidence; columns of these names are replaced.

    Null, empty and blank texts get missing_transcript; only the first 2000 characters of a text are scored.
    """
    cut, truncated = prefix(F.coalesce(df[text_col], F.lit("")), MOST_CHARS)
    step = df.withColumns({"_cut": cut, "_truncated": truncated}).withColumn("_normal", norm_match(F.col("_cut")))
    step = step.withColumns({"_script": presence_tag(F.col("_cut"), F.col("_normal")), "_romanised": norm_romanised(F.col("_normal"))})
    step = step.withColumn("_fold", best_cue(F.col("_normal"), F.col("_romanised")))
    facts = F.array(*[F.struct(*(F.lit(x).alias(n) for x, n in zip(c[1:], ("label", "region", "candidate", "source"), strict=True))) for c in CUES])
    step = step.withColumns({"_best": F.get(facts, F.col("_fold.at")), "_score": F.col("_fold.score")})
    missing, best = F.col("_normal") == "", F.col("_best")
    floor = F.when(best["label"].isin(*CURATED_LABELS), CURATED_FLOOR).otherwise(FLOOR)
    suggested = ~missing & (F.col("_score") >= floor)
    score = F.when(~missing, F.col("_score"))
    return step.withColumns({
        "status": F.when(missing, "missing_transcript").when(suggested, "suggested").otherwise("unresolved"),
        "source": F.when(suggested, best["source"]).otherwise("transcript_match"),
        "dialect_label": F.when(suggested, best["label"]),
        "speaker_region": F.when(suggested, best["region"]),
        "match_score": score,
        "candidate_label": F.when(~missing, best["candidate"]),
        "candidate_dialect_label": F.when(~missing, best["label"]),
        "script_mix": F.col("_script"),
        "input_truncated": F.col("_truncated"),
        "method": F.lit("cue_match"),
        "confidence": score,
    }).drop("_cut", "_truncated", "_normal", "_script", "_romanised", "_fold", "_best", "_score")


def region_of(label: Column) -> Column:
    """The region first listed for a dialect label; null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in REGIONS.items() for x in pair]), label)


def labels(spark) -> DataFrame:
    """(ordinal, dialect_label, speaker_region): the catalog's labels, each once."""
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(REGIONS.items())], "ordinal int, dialect_label string, speaker_region string")
