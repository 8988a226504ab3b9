"""The cue matching of phrases in plain SQL: forms, both views, scores, the first best cue, floors and tags.

DuckDB has no NFKC and counts bytes in edit distances, so wide forms are narrowed letter by letter, and Bengali
letters stand for single bytes where distances are taken; letters of other scripts, which no cue has, for one more.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog.cues import CUES, CURATED_FLOOR, CURATED_LABELS, FLOOR, VARIANTS
from ..functions import text
from ..operators import dialect
from .registry import _SQL, _t, query

#: Letters whose compatibility form is another single letter, from the character database: wide, joined, raised.
_PAIRS = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in (*range(0xFB50, 0xFEFD), *range(0xFF01, 0xFFEF), *map(ord, "⁰¹²³⁴⁵⁶⁷⁸⁹ªº"))]
_PAIRS = [(a, b) for a, b in _PAIRS if a != b and len(b) == 1 and b != " "]
_WIDE, _NARROW = "".join(a for a, _ in _PAIRS), "".join(b for _, b in _PAIRS)
#: Those of several letters that texts are likely to have.
_SEVERAL = [(c, unicodedata.normalize("NFKC", c)) for c in "…ﬁﬂﬀﬃﬄำﻵﻷﻹﻻﻶﻸﻺﻼ"]
_BENGALI = "".join(chr(c) for c in (*range(0x0981, 0x0984), *range(0x0985, 0x098D), 0x098F, 0x0990, *range(0x0993, 0x09A9), *range(0x09AA, 0x09B1), 0x09B2, *range(0x09B6, 0x09BA), 0x09BC, *range(0x09BE, 0x09C5), 0x09C7, 0x09C8, 0x09CB, 0x09CC, 0x09CD, 0x09CE, 0x0964))
_BYTES = "".join(chr(c) for c in (*range(1, 9), *range(14, 32), *range(65, 91), *map(ord, "`~^|{}[]<>=_$"), 127))[: len(_BENGALI)]
_SPACE = r"[\t\n\v\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _narrow(c: str) -> str:
    """Compatibility form and white space collapsed, in any case."""
    c = f"translate({c}, {_quoted(_WIDE)}, {_quoted(_NARROW)})"
    for wide, narrow in _SEVERAL:
        c = f"replace({c}, {_quoted(wide)}, {_quoted(narrow)})"
    return f"regexp_replace(regexp_replace(nfc_normalize({c}), '{_SPACE}+', ' ', 'g'), '^ +| +$', '', 'g')"


def _form(c: str) -> str:
    return f"translate(lower({_narrow(c)}), '০১২৩৪৫৬৭৮৯', '0123456789')"


def _core(t: str) -> str:
    return rf"replace(lower(regexp_replace({t}, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), '''', '')"


def _romanised(form: str) -> str:
    stripped = r"regexp_replace(t, '^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$', '', 'g')"
    return f"array_to_string(list_filter(list_transform(string_split({form}, ' '), lambda t: coalesce(known[{_core('t')}], {stripped})), lambda t: t <> ''), ' ')"


def _words(form: str) -> str:
    return f"list_distinct(list_filter(string_split({form}, ' '), lambda t: t <> ''))"


def _bytes(form: str) -> str:
    return rf"regexp_replace(translate({form}, {_quoted(_BENGALI)}, {_quoted(_BYTES)}), '[^\x{{00}}-\x{{7F}}]', '@', 'g')"


def _score(a: str, b: str) -> str:
    same = f"len(list_intersect({_words(a)}, {_words(b)}))"
    f1 = f"case when {same} = 0 then 0.0 else 2 * ({same} / len({_words(a)})) * ({same} / len({_words(b)})) / ({same} / len({_words(a)}) + {same} / len({_words(b)})) end"
    longer = f"greatest(length({a}), length({b}))"
    near = f"({longer} - levenshtein({_bytes(a)}, {_bytes(b)})) / {longer}"
    return f"case when {a} = '' or {b} = '' then 0.0 when {a} = {b} then 1.0 when {longer} > 300 then {f1} else greatest({near}, {f1}) end"


_CUES = ", ".join(f"({i}, {_quoted(c[0])}, {_quoted(c[1])})" for i, c in enumerate(CUES))
_KNOWN = ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in VARIANTS.items())
_LABELS = ", ".join(map(_quoted, CURATED_LABELS))


def evidence_sql(table: str, key: str, text: str, also: str = "") -> str:
    """(key, also, status, dialect_label, match_score, script_mix, input_truncated) of every row of a table."""
    return rf"""
with m as (select map {{{_KNOWN}}} as known),
cues as (select i, label, {_form("phrase")} as b, known from (values {_CUES}) v(i, phrase, label), m),
cut as (select *, substr(coalesce({text}, ''), 1, 2000) as c, coalesce(length({text}), 0) > 2000 as input_truncated from {table}),
forms as (select *, {_form("c")} as a from cut, m),
pairs as (select f.{key}, c.i, c.label, f.a, c.b, {_romanised("f.a").replace("known[", "f.known[")} as ra, {_romanised("c.b").replace("known[", "f.known[")} as rb from forms f, cues c),
scored as (select {key}, i, label, greatest({_score("a", "b")}, {_score("ra", "rb")}) as score from pairs),
best as (select {key}, score, label, row_number() over (partition by {key} order by score desc, i) as r from scored),
tags as (select *, regexp_matches(c, '[\x{{0980}}-\x{{09FF}}]') as bn, regexp_matches(c, '[A-Za-z]') as latin,
  len(list_filter(string_split(a, ' '), lambda t: t <> '')) as n, len(list_filter(string_split(a, ' '), lambda t: regexp_full_match({_core("t")}, '[a-z]+') and known[{_core("t")}] is not null)) as k from forms)
select t.{key}{also}, case when a = '' then 'missing_transcript' when score >= case when label in ({_LABELS}) then {CURATED_FLOOR} else {FLOOR} end then 'suggested' else 'unresolved' end as status,
  case when a <> '' and score >= case when label in ({_LABELS}) then {CURATED_FLOOR} else {FLOOR} end then label end as dialect_label, case when a <> '' then score end as match_score,
  case when not bn and not latin then 'unknown' when bn and latin then 'mixed' when bn then 'bn' when n > 0 and (k >= 2 and k / n >= 0.25 or k >= 1 and k / n >= 0.5) then 'banglish' else 'en' end as script_mix, input_truncated
from tags t join best on best.{key} = t.{key} and r = 1"""


@query(f"select candidate_id, status, dialect_label, round(match_score, 6) as match_score, script_mix, input_truncated from ({evidence_sql('dialect_candidates', 'candidate_id', 'phrase')})")
def dialect_of_candidates(spark: SparkSession, d: str) -> DataFrame:
    out = dialect.infer_dialect(_t(spark, d, "dialect_candidates").select("candidate_id", "phrase"), "phrase")
    return out.select("candidate_id", "status", "dialect_label", F.round("match_score", 6).alias("match_score"), "script_mix", "input_truncated")


@query(f"select event_id, status, dialect_label, round(match_score, 6) as match_score, script_mix, input_truncated from ({evidence_sql('corpus_events', 'event_id', 'transcript')})")
def dialect_of_events(spark: SparkSession, d: str) -> DataFrame:
    out = dialect.infer_dialect(_t(spark, d, "corpus_events").select("event_id", "transcript"), "transcript")
    return out.select("event_id", "status", "dialect_label", F.round("match_score", 6).alias("match_score"), "script_mix", "input_truncated")


_DIGITS = "'০১২৩৪৫৬৭৮৯', '0123456789'"


@query(
    rf"""
with m as (select map {{{_KNOWN}}} as known)
select candidate_id, translate(translate({_narrow("phrase")}, {_DIGITS}), '।॥', '..') as transcript_form, {_form("phrase")} as match_form, {_romanised(_form("phrase"))} as romanised_form, translate({_narrow("coalesce(phrase, '')")}, {_DIGITS}) as compare_form from dialect_candidates, m"""
)
def norm_forms(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("phrase")
    return _t(spark, d, "dialect_candidates").select("candidate_id", text.norm_transcript(c).alias("transcript_form"), text.norm_match(c).alias("match_form"), dialect.norm_romanised(text.norm_match(c)).alias("romanised_form"), text.norm_compare(c).alias("compare_form"))


_SQL["dialect_by_language"] = f"select language, status, script_mix, count(*) as events, round(avg(match_score), 4) as mean_score from ({evidence_sql('corpus_events', 'event_id', 'transcript', ', t.language')}) group by 1, 2, 3"
_SQL["script_presence"] = rf"""
with m as (select map {{{_KNOWN}}} as known), forms as (select event_id, coalesce(transcript, '') as c, {_form("coalesce(transcript, '')")} as a, known from corpus_events, m),
tags as (select event_id, regexp_matches(c, '[\x{{0980}}-\x{{09FF}}]') as bn, regexp_matches(c, '[A-Za-z]') as latin, len(list_filter(string_split(a, ' '), lambda t: t <> '')) as n,
  len(list_filter(string_split(a, ' '), lambda t: regexp_full_match({_core("t")}, '[a-z]+') and known[{_core("t")}] is not null)) as k from forms)
select event_id, case when not bn and not latin then 'unknown' when bn and latin then 'mixed' when bn then 'bn' when n > 0 and (k >= 2 and k / n >= 0.25 or k >= 1 and k / n >= 0.5) then 'banglish' else 'en' end as script_mix from tags"""
