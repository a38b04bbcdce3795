"""Judge answers -> verdict, score, reason. Strict mode names what is wrong with them."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import blank_to_empty, py_strip

# Labels and text patterns of the judge contract.
PASSING = ("CORRECT", "PASS")
FAILING = ("WRONG", "FAIL")
STRICT_VERDICT = r"(?:VERDICT|JUDGMENT)\s*:\s*(CORRECT|WRONG|PASS|FAIL)"
TEXT_PATTERNS = {
    "locomo": (r"VERDICT:\s*(CORRECT|WRONG)", r"REASON:\s*(.*)"),
    "longmemeval": (STRICT_VERDICT, r"REASON\s*:\s*(.*)"),
}
STRICT_LABELS = {
    "locomo": ("CORRECT", "WRONG"),
    "longmemeval": ("CORRECT", "WRONG", "PASS", "FAIL"),
}

_NAMES = ("label", "judgment", "reasoning", "reason")
_FIELDS = T.StructType(
    [T.StructField("is_object", T.BooleanType()), *[T.StructField(n, T.StringType()) for n in _NAMES]]
)


def json_object(text: str | None) -> dict | None:
    """The object a judge answered with, or None. Trailing text makes it not JSON."""
    try:
        value = json.loads(text or "")
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


@F.pandas_udf(_FIELDS)
def _judge_fields(text: pd.Series) -> pd.DataFrame:
    rows = []
    for value in text:
        found = json_object(value)
        rows.append(
            (found is not None, *(str(found[n]) if found and n in found else None for n in _NAMES))
        )
    return pd.DataFrame(rows, columns=["is_object", *_NAMES])


def judge_fields(text: Column) -> Column:
    return _judge_fields(text)


def _json_label(fields: Column, with_judgment: bool) -> Column:
    label = F.coalesce(fields["label"], fields["judgment"]) if with_judgment else fields["label"]
    return F.upper(blank_to_empty(label))


def _first_group(text: Column, pattern: str, flags: str) -> Column:
    return F.regexp_extract(text, f"{flags}{pattern}", 1)


def parse_judge(text: Column, fields: Column, benchmark: str) -> Column:
    """Struct ``(judgment, score, reason)``; anything unreadable is WRONG.

    ``fields`` is :func:`judge_fields` of the same text, as its own column, so that the
    JSON test runs once per row.
    """
    verdict_pattern, reason_pattern = TEXT_PATTERNS[benchmark]
    longmemeval = benchmark == "longmemeval"
    text_label = F.upper(_first_group(text, verdict_pattern, "(?i)"))
    label = F.when(fields["is_object"], _json_label(fields, longmemeval)).otherwise(text_label)
    accepted = PASSING if longmemeval else ("CORRECT",)
    correct = label.isin(*accepted)

    json_reason = F.coalesce(fields["reasoning"], fields["reason"]) if longmemeval else fields["reasoning"]
    json_reason = blank_to_empty(json_reason)
    has_reason = text.rlike(f"(?is){reason_pattern}")
    reason = (
        F.when(fields["is_object"] & (json_reason != ""), json_reason)
        .when(~fields["is_object"] & has_reason, py_strip(_first_group(text, reason_pattern, "(?is)")))
        .otherwise(py_strip(text))
    )
    return F.struct(
        F.when(correct, F.lit("CORRECT")).otherwise(F.lit("WRONG")).alias("judgment"),
        F.when(correct, F.lit(1.0)).otherwise(F.lit(0.0)).alias("score"),
        reason.alias("reason"),
    )


def strict_parse_error(text: Column, fields: Column, benchmark: str) -> Column:
    """Why a judge answer must be refused, or null."""
    label = _json_label(fields, True)
    stripped = blank_to_empty(text)
    return (
        F.when(stripped == "", F.lit("empty response"))
        .when(fields["is_object"] & ~label.isin(*STRICT_LABELS[benchmark]), F.lit("no recognized label"))
        .when(~fields["is_object"] & ~stripped.rlike(f"(?i){STRICT_VERDICT}"), F.lit("no recognized verdict"))
    )


def response_problem(text: str | None, benchmark: str) -> str | None:
    """The same refusal rule for one answer, used while a judge is being called."""
    stripped = (text or "").strip()
    if not stripped:
        return "empty response"
    found = json_object(stripped)
    if found is not None:
        label = str(found.get("label", found.get("judgment", ""))).strip().upper()
        return None if label in STRICT_LABELS[benchmark] else "no recognized label"
    return None if re.search(STRICT_VERDICT, stripped, re.IGNORECASE) else "no recognized verdict"


def normalize_verdict(judgment: Column, label: Column | None = None) -> Column:
    """CORRECT, WRONG, or null for a label outside the contract."""
    raw = judgment if label is None else F.coalesce(judgment, label)
    upper = F.upper(blank_to_empty(raw))
    return F.when(upper.isin(*PASSING), F.lit("CORRECT")).when(upper.isin(*FAILING), F.lit("WRONG"))
