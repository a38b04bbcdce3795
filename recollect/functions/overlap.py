"""Token overlap and longest common subsequence of two answers, one Arrow pass for both.

Both need per-row state that column expressions can only give in quadratic time (nested
``aggregate`` over arrays), so this is the one scoring step that leaves the JVM.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import normalize_text

OVERLAP_TYPE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("n_pred", "n_gold", "overlap", "lcs")])


def lcs_length(left: list, right: list) -> int:
    """Bit-parallel LCS (Hyyro 2004): one big-integer row per left token."""
    if not left or not right:
        return 0
    where: dict = {}
    for position, token in enumerate(right):
        where[token] = where.get(token, 0) | (1 << position)
    full = (1 << len(right)) - 1
    row = full
    for token in left:
        hit = row & where.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(right) - row.bit_count()


def _overlap(with_lcs: bool):
    @F.pandas_udf(OVERLAP_TYPE)
    def overlap(prediction: pd.Series, gold: pd.Series) -> pd.DataFrame:
        rows = []
        for p_text, g_text in zip(prediction, gold):
            p, g = (p_text or "").split(), (g_text or "").split()
            lcs = lcs_length(p, g) if with_lcs else None
            rows.append((len(p), len(g), (Counter(p) & Counter(g)).total(), lcs))
        frame = pd.DataFrame(rows, columns=["n_pred", "n_gold", "overlap", "lcs"])
        return frame.astype({"lcs": "Int32"})

    return overlap


def normalized_overlap(prediction: Column, gold: Column, lcs: bool = True) -> Column:
    """Struct ``(n_pred, n_gold, overlap, lcs)`` of two texts that are normalised already.

    Without ``lcs`` that field is null and costs nothing; ``token_f1`` needs no more.
    """
    return _overlap(lcs)(prediction, gold)


def answer_overlap(prediction: Column, gold: Column, lcs: bool = True) -> Column:
    """Struct ``(n_pred, n_gold, overlap, lcs)`` over normalised tokens."""
    return normalized_overlap(normalize_text(prediction), normalize_text(gold), lcs)


def _f1(hits: Column, n_pred: Column, n_gold: Column) -> Column:
    both_empty = (n_pred == 0) & (n_gold == 0)
    # 2PR/(P+R) with P=h/p and R=h/g, kept in the order of the definition.
    precision, recall = hits / n_pred, hits / n_gold
    return (
        F.when(both_empty, F.lit(1.0))
        .when((n_pred == 0) | (n_gold == 0) | (hits == 0), F.lit(0.0))
        .otherwise(2 * precision * recall / (precision + recall))
    )


def token_f1(overlap: Column) -> Column:
    return _f1(overlap["overlap"], overlap["n_pred"], overlap["n_gold"])


def rouge_l(overlap: Column) -> Column:
    return _f1(overlap["lcs"], overlap["n_pred"], overlap["n_gold"])
