"""The two date notations of the datasets. All times are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_strip

# Accepted notations, first match wins.
CONVERSATION_DATE_PATTERNS = (
    "h:m a 'on' d MMMM, yyyy",
    "h:ma 'on' d MMMM, yyyy",
    "d MMMM, yyyy",
)
QUESTION_DATE_PATTERN = "yyyy/M/d H:m"


def conversation_timestamp(value: Column, strict: bool = False) -> Column:
    """``9:00 am on 01 January, 2024`` -> timestamp; null (or an error) otherwise."""
    cleaned = F.regexp_replace(py_strip(F.coalesce(value, F.lit(""))), r"\s+", " ")
    parsed = F.coalesce(*[F.try_to_timestamp(cleaned, F.lit(p)) for p in CONVERSATION_DATE_PATTERNS])
    if not strict:
        return parsed
    problem = F.raise_error(F.concat(F.lit("unsupported conversation date: "), cleaned))
    return F.when(parsed.isNull(), problem.cast("timestamp")).otherwise(parsed)


def conversation_epoch(value: Column, strict: bool = False) -> Column:
    return F.unix_timestamp(conversation_timestamp(value, strict)).cast("double")


def _question_timestamp(value: Column) -> Column:
    cleaned = py_strip(F.regexp_replace(value, r"(?U)\s*\([A-Za-z]+\)\s*", " "))
    return F.try_to_timestamp(cleaned, F.lit(QUESTION_DATE_PATTERN))


def question_epoch(value: Column) -> Column:
    """``2023/05/01 (Mon) 21:05`` -> epoch seconds, null when it does not parse."""
    return F.unix_timestamp(_question_timestamp(value))


def human_date(value: Column) -> Column:
    """``Monday, May 01, 2023``, or the input unchanged when it does not parse."""
    return F.coalesce(F.date_format(_question_timestamp(value), "EEEE, MMMM dd, yyyy"), value)


def created_at(epoch_seconds: Column) -> Column:
    """Epoch seconds -> ISO-8601 with a ``+00:00`` offset."""
    return F.date_format(F.timestamp_seconds(epoch_seconds.cast("bigint")), "yyyy-MM-dd'T'HH:mm:ssxxx")


def micros(value: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without time zone."""
    return F.unix_micros((F.col(value) if isinstance(value, str) else value).cast("timestamp"))
