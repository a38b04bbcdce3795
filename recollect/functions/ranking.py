"""Ranked-list columns: id extraction, recall, precision, reciprocal rank, nDCG.

A result is a struct with ``metadata`` holding ``source_unit_id`` and
``source_unit_ids``. Everything here is a higher-order function on one row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_strip

EMPTY_IDS = "array<string>"


def nonempty_ids(values: Column) -> Column:
    """Distinct non-empty ids in first-seen order; null becomes an empty array."""
    kept = F.filter(values, lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.array_distinct(kept), F.array().cast(EMPTY_IDS))


def trimmed_ids(values: Column) -> Column:
    """Distinct ids after trimming, first-seen order, blanks dropped."""
    return nonempty_ids(F.transform(values, lambda x: py_strip(F.coalesce(x, F.lit("")))))


def cutoff_k(memories_evaluated: Column, results: Column) -> Column:
    """How many results count: the stated number, or all of them when none is stated."""
    return F.coalesce(memories_evaluated.cast("int"), F.size(results), F.lit(0))


def _source_ids(item: Column, alias_mode: str) -> Column:
    single = item["metadata"]["source_unit_id"]
    many = F.coalesce(item["metadata"]["source_unit_ids"], F.array().cast(EMPTY_IDS))
    has_single = single.isNotNull() & (single != "")
    one = F.array(single)
    if alias_mode == "union":
        return F.when(has_single, F.concat(one, many)).otherwise(many)
    if alias_mode == "first":
        return F.when(has_single, one).otherwise(many)
    raise ValueError(f"alias_mode must be 'union' or 'first', not {alias_mode!r}")


def candidate_source_ids(results: Column, alias_mode: str) -> Column:
    """Source ids of all candidates, in rank order and distinct.

    ``union`` takes the scalar id and the id list of a candidate, ``first`` takes the
    list only where there is no scalar id.
    """
    return nonempty_ids(F.flatten(F.transform(results, lambda r: _source_ids(r, alias_mode))))


def retrieved_ids(results: Column, k: Column, alias_mode: str) -> Column:
    n = F.size(results)
    upto = F.when(k < 0, F.greatest(n + k, F.lit(0))).otherwise(k)
    return candidate_source_ids(F.slice(results, F.lit(1), upto), alias_mode)


def recall_at_k(ids: Column, gold: Column) -> Column:
    return F.when(F.size(gold) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(ids, gold)) / F.size(gold)
    )


def precision_at_k(ids: Column, gold: Column) -> Column:
    hits = F.size(F.filter(ids, lambda x: F.array_contains(gold, x)))
    return F.when(F.size(ids) == 0, F.lit(0.0)).otherwise(hits / F.size(ids))


def _hit_ranks(ids: Column, gold: Column) -> Column:
    ranks = F.transform(ids, lambda x, i: F.when(F.array_contains(gold, x), i + 1))
    return F.filter(ranks, lambda r: r.isNotNull())


def reciprocal_rank(ids: Column, gold: Column) -> Column:
    return F.coalesce(1.0 / F.array_min(_hit_ranks(ids, gold)), F.lit(0.0))


def _discounted(ranks: Column) -> Column:
    return F.aggregate(ranks, F.lit(0.0), lambda total, r: total + 1.0 / F.log2(r + 1.0))


def ndcg_at_k(ids: Column, gold: Column) -> Column:
    ideal = F.least(F.size(gold), F.size(ids))
    # sequence(1, 0) counts down, so it is only built for a positive bound.
    best = _discounted(F.sequence(F.lit(1), F.greatest(ideal, F.lit(1))))
    return F.when(ideal <= 0, F.lit(0.0)).otherwise(_discounted(_hit_ranks(ids, gold)) / best)


def ranking_metrics(ids: Column, gold: Column) -> dict[str, Column]:
    return {
        "recall_at_k": recall_at_k(ids, gold),
        "precision_at_k": precision_at_k(ids, gold),
        "mrr": reciprocal_rank(ids, gold),
        "ndcg_at_k": ndcg_at_k(ids, gold),
    }
