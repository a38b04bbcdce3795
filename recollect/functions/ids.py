"""Identifiers. They are positional in the materialised dataset, so sampling changes them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded(prefix: str, number: Column, digits: int) -> Column:
    """A prefix and a number of at least ``digits`` digits; longer numbers keep all of them."""
    text = number.cast("bigint").cast("string")
    zeros = F.repeat(F.lit("0"), F.greatest(F.lit(digits) - F.length(text), F.lit(0)))
    return F.concat(F.lit(prefix), zeros, text)


def conversation_id(conversation_idx: Column) -> Column:
    return padded("conversation-", conversation_idx.cast("bigint") + 1, 4)


def question_id(conversation_idx: Column, question_idx: Column) -> Column:
    return F.concat(
        F.lit("conv"), conversation_idx.cast("string"), F.lit("_q"), question_idx.cast("string")
    )


def pair_record_id(session_id: Column, pair_index: Column) -> Column:
    return F.concat(session_id, F.lit(":pair:"), pair_index.cast("string"))


def short_hash(value: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(value.cast("string"), 256), 1, length)


def resource_namespace(run_id: Column, fingerprint: Column) -> Column:
    return short_hash(F.concat_ws(":", run_id, fingerprint), 64)
