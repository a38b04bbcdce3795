"""Canonical JSON, digests, secret checks: small per-row helpers on JSON text."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Key names that mark a secret.
SECRET_FIELD_NAMES = (
    "api_key",
    "apikey",
    "authorization",
    "credentials",
    "password",
    "secret",
    "token",
)
SECRET_KEY_PARTS = ("api_key", "apikey", "authorization", "password", "secret", "token")
SECRET_TEXT_MARKERS = ("api_key=", "apikey=", "password=", "secret=", "token=")
SECRET_SUFFIXES = ("_password", "_secret", "_token")
REDACTED = "<redacted>"


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON text -> sorted keys, no spaces, UTF-8 characters kept."""

    def one(value):
        if value is None:
            return None
        return json.dumps(
            json.loads(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False
        )

    return text.map(one)


@F.pandas_udf(T.StringType())
def context_text(text: pd.Series, is_string: pd.Series) -> pd.Series:
    """A text context passes unchanged, any other JSON value is printed with indent 2."""
    return pd.Series(
        [
            t if s or t is None else json.dumps(json.loads(t), ensure_ascii=False, indent=2)
            for t, s in zip(text, is_string)
        ],
        dtype="object",
    )


def fingerprint(json_text: Column) -> Column:
    return F.sha2(canonical_json(json_text), 256)


def row_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The whole row as JSON text, nulls kept."""
    return F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"})


def row_digest(df: DataFrame, columns: list[str] | None = None) -> Column:
    return fingerprint(row_json(df, columns))


def _named(patterns: list[str]) -> re.Pattern:
    """A key matches whatever its case, and with ``-`` for ``_``."""
    return re.compile("|".join(patterns).replace("_", "[_-]"), re.IGNORECASE)


# What marks a key as secret (to be reported), as one to hide, and what in a text precedes a secret.
REPORTED_KEY = _named([f"^{n}$" for n in SECRET_FIELD_NAMES] + ["api_key"] + [f"{x}$" for x in SECRET_SUFFIXES])
HIDDEN_KEY = _named(list(SECRET_KEY_PARTS))
MARKED_TEXTS = [re.compile(f"({m})[^ ]*", re.IGNORECASE) for m in SECRET_TEXT_MARKERS]


def _entries(node) -> list[tuple]:
    """(key or position, child) of an object or array; nothing of other values."""
    if isinstance(node, dict):
        return list(node.items())
    return list(enumerate(node)) if isinstance(node, list) else []


def _reported(document) -> list[str]:
    """Paths in document order, by an explicit stack."""
    paths, stack = [], [("", "", document)]
    while stack:
        key, path, node = stack.pop()
        if isinstance(key, str) and REPORTED_KEY.search(key):
            paths.append(path)
        steps = [(k, f"{path}[{k}]" if isinstance(k, int) else f"{path}.{k}".lstrip("."), c) for k, c in _entries(node)]
        stack.extend(reversed(steps))
    return paths


@F.pandas_udf(T.ArrayType(T.StringType()))
def secret_paths(text: pd.Series) -> pd.Series:
    """Paths of all secret-named keys, anywhere in a JSON document."""
    return text.map(lambda t: [] if t is None else _reported(json.loads(t)))


def redact_text(value: Column) -> Column:
    """Hide what follows the first hit of each marker, up to the next blank."""
    for marker in SECRET_TEXT_MARKERS:
        # The lazy prefix stops at the first hit; the rest of the text is kept as it is.
        value = F.regexp_replace(value, rf"(?is)^(.*?{marker})[^ ]*(.*)$", rf"$1{REDACTED}$2")
    return value


def _hidden(document):
    """The document with secret keys and marked texts replaced in place."""
    root = [document]
    open_nodes: list = [root]
    while open_nodes:
        node = open_nodes.pop()
        for at, child in _entries(node):
            if isinstance(at, str) and HIDDEN_KEY.search(at):
                node[at] = REDACTED
            elif isinstance(child, str):
                node[at] = reduce(lambda t, p: p.sub(rf"\1{REDACTED}", t, count=1), MARKED_TEXTS, child)
            else:
                open_nodes.append(child)
    return root[0]


@F.pandas_udf(T.StringType())
def redact_json(text: pd.Series) -> pd.Series:
    """Redact secret-named keys and marked text anywhere in a JSON document."""
    return text.map(lambda t: None if t is None else json.dumps(_hidden(json.loads(t)), ensure_ascii=False))
