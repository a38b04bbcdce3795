"""Prediction and judgment rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.canonical import fingerprint, row_digest
from ..functions.ranking import nonempty_ids
from ..functions.verdicts import normalize_verdict

SCHEMA_VERSION = 2


def _or(column: str, default) -> Column:
    return F.coalesce(F.col(column), default if isinstance(default, Column) else F.lit(default))


def _shared_columns(framework: str) -> list[Column]:
    results = F.coalesce("search_results", F.array())
    return [
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.lit(framework).alias("framework"),
        _or("answerer_provider", "").alias("answerer_provider"),
        _or("answerer_model", "").alias("answerer_model"),
        "answerer_finish_reason",
        "answerer_usage",
        _or("cutoff_label", "top_unknown").alias("cutoff_label"),
        "memory_internal_usage",
        "pipeline_timing",
        "prompt",
        "native_context",
        F.struct(
            F.coalesce("question", F.lit("")).alias("search_query"),
            results.alias("search_results"),
            F.size(results).alias("total_results"),
            _or("memories_evaluated", F.size(results)).alias("memories_evaluated"),
            F.col("recall_diagnostics"),
        ).alias("retrieval"),
    ]


def _with_parts(questions: DataFrame, retrievals: DataFrame, answers: DataFrame) -> DataFrame:
    """Every question, with what was retrieved and answered, and ``problem`` naming what is missing."""
    rows = questions.join(retrievals.withColumn("__r", F.lit(True)), "question_id", "left").join(
        answers.withColumn("__a", F.lit(True)), "question_id", "left"
    )
    missing = F.array_compact(
        F.array(F.when(F.col("__r").isNull(), F.lit("no retrieval")), F.when(F.col("__a").isNull(), F.lit("no answer")))
    )
    return rows.withColumn("problem", F.when(F.size(missing) > 0, F.array_join(missing, ", "))).drop("__r", "__a")


def build_conversation_predictions(
    questions: DataFrame, retrievals: DataFrame, answers: DataFrame, framework: str
) -> DataFrame:
    """One flat row per question of a conversation: question + retrieval + answer."""
    rows = _with_parts(questions, retrievals, answers)
    category, answer = F.coalesce("category", F.lit(0)), F.coalesce("answer", F.lit(""))
    generated = X.normalize_generated_answer(category, F.coalesce("generated_answer", F.lit("")), answer)
    return rows.select(
        F.lit("locomo").alias("benchmark"),
        "question_id",
        "conversation_id",
        "conversation_idx",
        "question_idx",
        F.coalesce("question", F.lit("")).alias("question"),
        X.gold_answer(category, answer).alias("ground_truth_answer"),
        category.alias("category"),
        X.category_name(category).alias("category_name"),
        nonempty_ids(F.col("evidence")).alias("evidence"),
        generated.alias("generated_answer"),
        *_shared_columns(framework),
        "problem",
    )


def build_question_predictions(
    questions: DataFrame, retrievals: DataFrame, answers: DataFrame, framework: str
) -> DataFrame:
    """One flat row per question record: question + retrieval + answer."""
    rows = _with_parts(questions, retrievals, answers)
    return rows.select(
        F.lit("longmemeval").alias("benchmark"),
        "question_id",
        "question_type",
        "question",
        F.col("answer").alias("ground_truth_answer"),
        _or("question_date", "").alias("question_date"),
        X.is_abstention_id(F.col("question_id")).alias("is_abstention"),
        F.coalesce("answer_session_ids", F.array().cast("array<string>")).alias("answer_session_ids"),
        F.coalesce("generated_answer", F.lit("")).alias("generated_answer"),
        *_shared_columns(framework),
        "problem",
    )


def with_digests(predictions: DataFrame, provider: str, model: str, judge_fingerprint: str) -> DataFrame:
    """Add ``prediction_sha256`` and ``judge_input_fingerprint`` to prediction rows."""
    rows = predictions.withColumn("prediction_sha256", row_digest(predictions))
    asked = F.to_json(
        F.struct(
            F.lit(SCHEMA_VERSION).alias("schema_version"),
            "question_id",
            "prediction_sha256",
            F.lit(provider).alias("judge_provider"),
            F.lit(model).alias("judge_requested_model"),
            F.lit(judge_fingerprint).alias("judge_fingerprint"),
        )
    )
    return rows.withColumn("judge_input_fingerprint", fingerprint(asked))


def attach_judgment(predictions: DataFrame, judgments: DataFrame) -> DataFrame:
    """Prediction rows (with digests) plus the verdict columns of the judge.

    A prediction without a verdict stays, with ``judgment_problem`` set.

    ``judgments``: (question_id, judgment, score, reason, judge_*).
    """
    verdict = judgments.withColumns(
        {
            "judgment": normalize_verdict(F.col("judgment")),
            "score": F.coalesce(F.col("score").cast("double"), F.lit(0.0)),
            "reason": F.coalesce("reason", F.lit("")),
        }
    )
    missing = F.when(F.col("__v").isNull(), F.lit("no judgment"))
    joined = predictions.join(verdict.withColumn("__v", F.lit(True)), "question_id", "left")
    return joined.withColumn("judgment_problem", missing).drop("__v")


def resume_judging(predictions: DataFrame, stored: DataFrame) -> DataFrame:
    """Predictions whose judge input has no stored judgment (new or changed)."""
    known = stored.select("question_id", "judge_input_fingerprint")
    return predictions.join(known, ["question_id", "judge_input_fingerprint"], "left_anti")
