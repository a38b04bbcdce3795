"""Pipeline and attempt timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import micros

# Stages in report order and their two scopes.
STAGES = ("ingestion", "qa", "retrieval_pipeline", "backend_search", "answer_generation", "judge")
QUESTION, CONVERSATION = "question", "conversation"
MS_DIGITS = 6


def timing_long(records: DataFrame) -> DataFrame:
    """(position, stage, ms, scope, identity), one row per measured stage.

    In: ``position``, ``conversation_idx``, ``question_id`` and the MAP ``pipeline_timing``
    with ``<stage>_ms`` and ``<stage>_scope``. Negative times count as 0, unknown scopes as
    question.
    """
    timing = F.col("pipeline_timing")
    cells = F.array(
        *[
            F.struct(
                F.lit(stage).alias("stage"),
                F.try_element_at(timing, F.lit(f"{stage}_ms")).cast("double").alias("ms"),
                F.lower(F.trim(F.coalesce(F.try_element_at(timing, F.lit(f"{stage}_scope")), F.lit(QUESTION)))).alias("scope"),
            )
            for stage in STAGES
        ]
    )
    rows = records.select("position", "conversation_idx", "question_id", F.explode(cells).alias("c")).filter(
        "c.ms is not null"
    )
    scope = F.when(F.col("c.scope").isin(QUESTION, CONVERSATION), F.col("c.scope")).otherwise(F.lit(QUESTION))
    rows = rows.select(
        "position", "conversation_idx", "question_id", F.col("c.stage").alias("stage"),
        F.greatest(F.col("c.ms"), F.lit(0.0)).alias("ms"), scope.alias("scope"),
    )
    by_conversation = (F.col("scope") == CONVERSATION) & F.col("conversation_idx").isNotNull()
    identity = (
        F.when(by_conversation, F.concat(F.lit("conversation:"), F.col("conversation_idx").cast("string")))
        .when(F.col("question_id").isNotNull(), F.concat(F.lit("question:"), F.col("question_id")))
        .otherwise(F.concat(F.lit("index:"), F.col("position").cast("string")))
    )
    return rows.select("position", "stage", "ms", "scope", identity.alias("identity"))


def timing_report(records: DataFrame) -> DataFrame:
    """Per stage: scope, count, total, mean, min, max; the last record of an identity wins.

    ``position`` must be unique, since it decides what is last. All buffers are numbers or
    flags where it is a number, so both steps are hash aggregations.
    """
    shared = (F.col("scope") == CONVERSATION).alias("shared")
    last = (
        timing_long(records)
        .groupBy("stage", "identity")
        .agg(
            F.max_by("ms", "position").alias("ms"),
            F.max_by(shared, F.col("position")).alias("shared"),
            F.max("position").alias("position"),
        )
    )
    report = last.groupBy("stage").agg(
        F.max_by("shared", "position").alias("shared"),
        F.count(F.lit(1)).alias("count"),
        F.sum("ms").alias("__sum"),
        F.min("ms").alias("min_ms"),
        F.max("ms").alias("max_ms"),
    )
    return report.select(
        "stage",
        F.when(F.col("shared"), F.lit(CONVERSATION)).otherwise(F.lit(QUESTION)).alias("scope"),
        "count",
        F.round("__sum", MS_DIGITS).alias("total_ms"),
        F.round(F.col("__sum") / F.col("count"), MS_DIGITS).alias("avg_ms"),
        "min_ms",
        "max_ms",
    )


def execution_seconds(started_at: Column, measured_at: Column) -> Column:
    """Seconds between two timestamps, never below 0, six decimals."""
    elapsed = micros(measured_at) - micros(started_at)
    return F.round(F.greatest(elapsed, F.lit(0)) / 1e6, 6)


def stage_seconds(timing: DataFrame) -> DataFrame:
    """(keys, stage, seconds) from a MAP ``pipeline`` of stage -> struct with ``total_ms``."""
    keys = [c for c in timing.columns if c != "pipeline"]
    rows = timing.select(*keys, F.explode("pipeline").alias("stage", "values"))
    ms = F.coalesce(F.col("values.total_ms").cast("double"), F.lit(0.0))
    return rows.select(*keys, "stage", (ms / 1000.0).alias("seconds"))


def cpu_percent(cpu_seconds: Column, wall_seconds: Column) -> Column:
    return F.when(wall_seconds == 0, F.lit(0.0)).otherwise(F.bround(cpu_seconds / wall_seconds * 100, 3))
