"""Run-level reports put together from the smaller ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import ordered_position

# Evaluators of a run; the ablation needs a framework with stage diagnostics.
REQUIRED_EVALUATORS = ("primary_judge_score", "rigorous_report")
OPTIONAL_EVALUATORS = ("ablation_report",)


def run_summary(run: DataFrame, counts: DataFrame, usage: DataFrame, timing: DataFrame) -> DataFrame:
    """One row: run identity, counts, usage totals by scope, timing by stage.

    ``run`` and ``counts`` hold one row; ``usage`` and ``timing`` are the small reports.
    """
    usage_map = usage.agg(
        F.map_from_entries(F.collect_list(F.struct("scope", F.struct(*[c for c in usage.columns if c != "scope"]))))
        .alias("m")
    )
    timing_map = timing.agg(
        F.map_from_entries(F.collect_list(F.struct("stage", F.struct(*[c for c in timing.columns if c != "stage"]))))
        .alias("m")
    )
    return run.select(
        "*",
        counts.select(F.struct(*counts.columns)).scalar().alias("counts"),
        usage_map.scalar().alias("usage"),
        timing_map.scalar().alias("timing"),
    )


def committed_item_count(units: DataFrame, committed: DataFrame, per_question: bool) -> DataFrame:
    """Committed items: question ids of committed conversations, or committed units."""
    kept = units.join(committed.select("unit_id"), "unit_id", "left_semi")
    value = F.sum(F.size("question_ids")) if per_question else F.count(F.lit(1))
    return kept.agg(F.coalesce(value, F.lit(0)).cast("bigint").alias("committed_items"))


def conversation_aggregate(predictions: DataFrame, order: list[Column], bucket: Column, payload: list[str]) -> DataFrame:
    """(conversation_id, item_pos, payload): a conversation's predictions, numbered in order.

    One row per prediction for conversations of every size; no array has to fit in one task.
    """
    placed = ordered_position(predictions, ["conversation_id"], order, bucket, "item_pos")
    return placed.select("conversation_id", "item_pos", *payload)


def evaluation_plan(runs: DataFrame, frameworks_with_diagnostics: tuple[str, ...]) -> DataFrame:
    """(keys, evaluator, required, status) for every run."""
    has_diagnostics = F.col("framework").isin(*frameworks_with_diagnostics)
    entries = [F.struct(F.lit(n).alias("evaluator"), F.lit(True).alias("required"), F.lit("REQUIRED").alias("status"))
               for n in REQUIRED_EVALUATORS]
    entries += [
        F.struct(
            F.lit(n).alias("evaluator"),
            F.lit(False).alias("required"),
            F.when(has_diagnostics, F.lit("OPTIONAL")).otherwise(F.lit("NOT_APPLICABLE")).alias("status"),
        )
        for n in OPTIONAL_EVALUATORS
    ]
    rows = runs.select("run_id", "benchmark", "framework", F.explode(F.array(*entries)).alias("e"))
    return rows.select("run_id", "benchmark", "framework", "e.*")


def evaluator_coverage(plan: DataFrame, reports: DataFrame) -> DataFrame:
    """Required evaluators of each run without a COMPLETED report."""
    done = reports.filter(F.col("status") == "COMPLETED").select("run_id", "evaluator")
    return plan.filter("required").join(done, ["run_id", "evaluator"], "left_anti").select(
        "run_id", "benchmark", "framework", "evaluator"
    )


def flatten_results(reports: DataFrame, default_evaluator: str) -> DataFrame:
    """(keys, evaluator, metric, value) for the numeric entries of JSON ``overall`` metrics.

    In: ``evaluator_version`` (nullable) and ``overall_json``. Texts and booleans are dropped.
    """
    keys = [c for c in reports.columns if c not in ("evaluator_version", "overall_json")]
    rows = reports.select(
        *keys,
        F.coalesce("evaluator_version", F.lit(default_evaluator)).alias("evaluator"),
        F.parse_json("overall_json").alias("overall"),
    ).filter(F.schema_of_variant("overall").startswith("OBJECT"))
    entries = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("overall").outer()))
    # Only JSON numbers have a numeric type in a variant; texts, booleans and nested values do not.
    number = F.schema_of_variant("value").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return entries.filter(number).select(
        *keys, "evaluator", F.col("key").alias("metric"), F.col("value").cast("double").alias("value")
    )
