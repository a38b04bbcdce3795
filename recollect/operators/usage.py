"""Token accounting: per row, per role, per scope.

A provider usage column is a MAP: a missing key is not the same as a zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_empty
from .ordered import previous_row

# Usage keys and roles of a report.
PROVIDER_KEYS = ("prompt_tokens_total", "completion_tokens", "total_tokens")
MEMORY_FIELDS = ("prompt_tokens", "completion_tokens", "total_tokens", "calls")
TOTAL_FIELDS = ("calls", "prompt_tokens", "completion_tokens", "total_tokens")
ROLES = ("answerer", "judge", "memory_internal")
TOKEN_TYPES = {"prompt": "prompt_tokens", "completion": "completion_tokens", "total": "total_tokens"}
SCOPES = {
    "benchmark": ("memory_internal", "answerer"),
    "evaluation": ("judge",),
    "overall": ("memory_internal", "answerer", "judge"),
}


def _number(usage: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(usage, F.lit(key)).cast("bigint"), F.lit(0).cast("bigint"))


def _names(column: str) -> Column:
    return F.array_sort(F.collect_set(F.nullif(blank_to_empty(F.col(column)), F.lit(""))))


def _sum(value: Column, name: str) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias(name)


def _role_sums(role: str) -> list[Column]:
    """Aggregates of the provider usage of ``answerer`` or ``judge``."""
    usage = F.coalesce(F.col(f"{role}_usage"), F.create_map().cast("map<string,bigint>"))
    reported = reduce(lambda a, b: a | b, [F.map_contains_key(usage, k) for k in PROVIDER_KEYS])
    prompt, completion = _number(usage, "prompt_tokens_total"), _number(usage, "completion_tokens")
    stated = _number(usage, "total_tokens")
    total = F.when(stated == 0, prompt + completion).otherwise(stated)
    return [
        F.count(F.lit(1)).alias("calls"),
        F.count_if(reported).alias("reported_calls"),
        F.count_if(~reported).alias("missing_usage_calls"),
        _sum(F.when(reported, prompt), "prompt_tokens"),
        _sum(F.when(reported, completion), "completion_tokens"),
        _sum(F.when(reported, total), "total_tokens"),
    ]


def _memory_sums(usage: str = "memory_internal_usage") -> list[Column]:
    return [_sum(F.col(f"{usage}.{f}").cast("bigint"), f) for f in TOTAL_FIELDS]


def usage_by_role(evaluations: DataFrame, role: str) -> DataFrame:
    """One row of provider usage for ``answerer`` or ``judge``."""
    row = evaluations.agg(
        *_role_sums(role),
        _names(f"{role}_provider").alias("providers"),
        _names(f"{role}_model").alias("models"),
    )
    return row.select(
        F.lit(role).alias("role"),
        (F.col("reported_calls") > 0).alias("available"),
        (F.col("missing_usage_calls") == 0).alias("complete"),
        *row.columns,
    )


def memory_usage(evaluations: DataFrame, usage: str = "memory_internal_usage") -> DataFrame:
    """One row of memory-internal usage. A present object without the flag counts as available."""
    flag = F.col(usage).isNotNull() & F.coalesce(F.col(f"{usage}.available"), F.lit(True))
    return evaluations.agg(
        F.coalesce(F.bool_or(flag), F.lit(False)).alias("available"),
        *_memory_sums(usage),
        _names(f"{usage}.framework").alias("frameworks"),
    )


def usage_components(evaluations: DataFrame) -> DataFrame:
    """One row per role with the four totals, from one pass over the evaluations."""
    sums = {"answerer": _role_sums("answerer"), "judge": _role_sums("judge"), "memory_internal": _memory_sums()}
    row = evaluations.agg(*[F.struct(*columns).alias(role) for role, columns in sums.items()])
    roles = [F.struct(F.lit(r).alias("role"), *[F.col(r)[f].alias(f) for f in TOTAL_FIELDS]) for r in sums]
    return row.select(F.inline(F.array(*roles)))


def usage_totals(components: DataFrame) -> DataFrame:
    """Totals by scope: benchmark = memory + answerer, evaluation = judge, overall = both."""
    scopes = F.array(
        *[F.when(F.col("role").isin(*members), F.lit(scope)) for scope, members in SCOPES.items()]
    )
    rows = components.withColumn("scope", F.explode(F.array_compact(scopes)))
    return rows.groupBy("scope").agg(*[F.sum(f).cast("bigint").alias(f) for f in TOTAL_FIELDS])


def tokens_long(components: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(role, token_type, tokens) for every role and type; a missing role counts as zero."""
    keys = keys or []
    wide = components.groupBy(*keys).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("role") == r, F.col(column))), F.lit(0)).cast("bigint").alias(f"{r}|{t}")
            for r in ROLES
            for t, column in TOKEN_TYPES.items()
        ]
    )
    cells = [c for c in wide.columns if c not in keys]
    long = wide.unpivot(keys, cells, "__cell", "tokens")
    part = F.split("__cell", r"\|")
    return long.select(*keys, part[0].alias("role"), part[1].alias("token_type"), "tokens")


def add_usage(*usages: Column) -> Column:
    """Sum of memory-usage structs: first named framework, available if any is."""
    def total(name: str) -> Column:
        return reduce(lambda a, b: a + b, [F.coalesce(u[name].cast("bigint"), F.lit(0)) for u in usages])

    available = reduce(
        lambda a, b: a | b, [u.isNotNull() & F.coalesce(u["available"], F.lit(True)) for u in usages]
    )
    return F.struct(
        F.coalesce(*[u["framework"] for u in usages]).alias("framework"),
        available.alias("available"),
        *[total(f).alias(f) for f in MEMORY_FIELDS],
    )


def usage_delta(
    snapshots: DataFrame, keys: list[str], order: list[Column], bucket: Column | None = None,
    fields: tuple[str, ...] = MEMORY_FIELDS,
) -> DataFrame:
    """Differences of cumulative counters along ``keys``, floored at 0; the first row keeps its value."""
    before = {f"__p_{f}": F.col(f) for f in fields}
    rows = previous_row(snapshots, keys, order, bucket, before)
    deltas = {
        f: F.greatest(F.lit(0), F.col(f) - F.coalesce(F.col(f"__p_{f}"), F.lit(0))) for f in fields
    }
    return rows.withColumns({f"{f}_delta": d for f, d in deltas.items()}).drop(*before)
