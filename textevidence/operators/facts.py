"""Fact rules: keyword and number hints of a text as rows, and the bridge from extracted fields to such rows.

Every rule is one native expression over the lower-cased text; a rule that fires without a number gives "".
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DOT, WS, fact_label, norm_facts

_NUM, _S = r"([0-9]+(?:\.[0-9]+)?)", f"[{WS}]*"
_HOURS = r"(?:hours?|hrs?)"

#: Number rules, as alternatives tried at each place; the first group that holds something counts.
NUMBER_RULES = {
    "working_hours_per_week": f"{_NUM}{_S}{_HOURS}{DOT}{{0,40}}(?:week|weekly)|(?:week|weekly){DOT}{{0,40}}?{_NUM}{_S}{_HOURS}",
    "overtime_hours_per_day": f"overtime{DOT}{{0,40}}?{_NUM}{_S}{_HOURS}",
    "worker_age_years": f"(?:age|aged|worker is|workers are|old){DOT}{{0,20}}?([0-9]{{1,2}})",
    "notice_period_days": f"([0-9]+){_S}(?:day|days){DOT}{{0,35}}notice|notice{DOT}{{0,35}}([0-9]+){_S}(?:day|days)",
    "cet1_ratio": f"cet1[^0-9]*{_NUM}",
    "transaction_amount_bdt": f"(?:bdt|tk|taka){_S}{_NUM}",
}

#: Flag rules, tried in order; the first whose phrases occur gives its value.
FLAG_RULES = {
    "worker_type": [("temporary", ["temporary"]), ("permanent", ["permanent"])],
    "fire_certificate_current": [("false", ["expired fire", "missing fire", "fire certificate expired"]), ("true", ["fire certificate current", "valid fire certificate"])],
    "wage_records_current": [("false", ["late wage", "missing wage", "wage records late"]), ("true", ["current wage", "wage records current"])],
    "lc_conditions_met": [("false", ["shipment finance due", "lc condition missing", "payment hold"]), ("true", ["lc conditions met", "finance conditions met"])],
    "export_documents_complete": [("false", ["missing export", "customs documents missing", "shipment documents incomplete"])],
    "inspection_certificate_current": [
        ("false", ["inspection certificate is missing", "missing inspection", "expired inspection", "inspection certificate is not current", "inspection certificate is not valid", "inspection certificate expired"]),
        ("true", ["inspection certificate is current", "valid inspection certificate"]),
    ],
    "acceptance_qualified": [("true", ["qualified acceptance", "acceptance is qualified", "conditional acceptance", "acceptance is conditional"]), ("false", ["unqualified acceptance", "acceptance is unqualified"])],
    "customer_identity_verified": [("false", ["not verified", "without verification"]), ("true", ["verified"])],
    "suspicious_transaction_flagged": [("true", ["suspicious"])],
    "suspicious_report_filed_within_24h": [("false", ["not reported", "unreported"])],
}
_SUBCONTRACT = ["subcontract", "washing", "printing", "embroidery"]

SOURCE, BRIDGE_SOURCE = "document_text_hint", "bd_extract.v1_candidate"

#: All fact keys in the order of rows.
KEYS = sorted([*NUMBER_RULES, *FLAG_RULES, "subcontractor_declared_and_approved"])


def _any(text: Column, phrases: list[str]) -> Column:
    out = F.contains(text, F.lit(phrases[0]))
    for p in phrases[1:]:
        out = out | F.contains(text, F.lit(p))
    return out


def fact_columns(text: Column) -> dict[str, Column]:
    """Fact key to its value column (null: the rule does not fire); ``text`` is in fact form."""
    out = {}
    for key, rule in NUMBER_RULES.items():
        value = F.regexp_extract(text, rule, 1)
        if re.compile(rule).groups > 1:
            value = F.when(value != "", value).otherwise(F.regexp_extract(text, rule, 2))
        out[key] = F.when(text.rlike(rule), value)
    for key, cases in FLAG_RULES.items():
        column = F.when(_any(text, cases[0][1]), cases[0][0])
        for value, phrases in cases[1:]:
            column = column.when(_any(text, phrases), value)
        out[key] = column
    approved = F.contains(text, F.lit("approved")) & ~F.contains(text, F.lit("not approved"))
    out["subcontractor_declared_and_approved"] = F.when(_any(text, _SUBCONTRACT), approved.cast("string"))
    return out


def fact_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, one column per fact key): values as strings, null where a rule does not fire or the text is null."""
    step = df.select(df[id_col].alias(id_col), norm_facts(df[text_col]).alias("_text"))
    columns = fact_columns(F.col("_text"))
    return step.select(id_col, *[columns[k].alias(k) for k in KEYS])


def extract_facts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fact_key, label, value, source): one row per rule that fires; null and empty texts give none."""
    table = fact_table(df.where(df[text_col].isNotNull()), id_col, text_col)
    rows = F.filter(F.array(*[F.struct(F.lit(k).alias("fact_key"), F.col(k).alias("value")) for k in KEYS]), lambda r: r["value"].isNotNull())
    long = table.select(id_col, F.explode(rows).alias("r"))
    return long.select(id_col, "r.fact_key", fact_label(F.col("r.fact_key")).alias("label"), "r.value", F.lit(SOURCE).alias("source"))


def facts_array(text: Column) -> Column:
    """All facts of a raw text as an array of (fact_key, label, value, source), sorted by key."""
    columns = fact_columns(norm_facts(text))
    rows = F.array(*[F.struct(F.lit(k).alias("fact_key"), fact_label(F.lit(k)).alias("label"), columns[k].alias("value"), F.lit(SOURCE).alias("source")) for k in KEYS])
    return F.filter(rows, lambda r: r["value"].isNotNull())


def schema_candidates(extracted: DataFrame, id_col: str) -> DataFrame:
    """(id, fact_key, label, value, source) from rows of extracted fields (schema, field, value)."""
    key = F.concat_ws(".", "schema", "field")
    return extracted.select(id_col, key.alias("fact_key"), fact_label(key).alias("label"), "value", F.lit(BRIDGE_SOURCE).alias("source"))
