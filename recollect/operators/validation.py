"""Data-quality rules. Each returns the rows that break it; an empty result passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_empty
from ..functions.verdicts import normalize_verdict
from .ordered import previous_row

# Required keys, schema version and the legal state changes.
QUESTION_KEYS = (
    "question_id",
    "question_type",
    "question",
    "answer",
    "haystack_session_ids",
    "haystack_dates",
    "haystack_sessions",
)
SCHEMA_VERSION = 2
RUN_TRANSITIONS = {
    "CREATED": ("PREFLIGHT",),
    "PREFLIGHT": ("RUNNING", "JUDGING", "EVALUATING", "FAILED_PREFLIGHT", "INTERRUPTING"),
    "RUNNING": ("JUDGING", "PARTIAL", "FAILED_RUNNING", "INTERRUPTING"),
    "JUDGING": ("EVALUATING", "PARTIAL", "FAILED_JUDGING", "INTERRUPTING"),
    "EVALUATING": ("REPORTING", "PARTIAL", "FAILED_EVALUATION", "INTERRUPTING"),
    "REPORTING": ("PUBLISHING", "FAILED_REPORTING", "INTERRUPTING"),
    "PUBLISHING": ("VERIFYING", "FAILED_PUBLISHING", "INTERRUPTING"),
    "VERIFYING": ("COMPLETED", "FAILED_VERIFYING", "INTERRUPTING"),
    "INTERRUPTING": ("INTERRUPTED",),
    "INTERRUPTED": ("RESUMING",),
    "FAILED_PREFLIGHT": ("RESUMING",),
    "FAILED_RUNNING": ("RESUMING",),
    "FAILED_JUDGING": ("RESUMING",),
    "FAILED_EVALUATION": ("RESUMING",),
    "FAILED_REPORTING": ("RESUMING",),
    "FAILED_PUBLISHING": ("RESUMING",),
    "FAILED_VERIFYING": ("RESUMING",),
    "RESUMING": ("PREFLIGHT", "RUNNING", "JUDGING", "EVALUATING", "REPORTING", "PUBLISHING", "VERIFYING"),
    "PARTIAL": ("RESUMING",),
    "COMPLETED": (),
}
UNIT_TRANSITIONS = {
    "PENDING": ("PREPARING",),
    "PREPARING": ("INGESTING", "FAILED"),
    "INGESTING": ("PREDICTING", "FAILED"),
    "PREDICTING": ("PREDICTED", "FAILED"),
    "PREDICTED": ("JUDGING", "COMMITTED", "FAILED"),
    "JUDGING": ("JUDGED", "FAILED"),
    "JUDGED": ("COMMITTED", "FAILED"),
    "COMMITTED": (),
    "FAILED": ("PREPARING",),
}


def require_empty(violations: DataFrame, message: str) -> None:
    """Raise when a rule has violations, showing a few of them."""
    bad = violations.limit(5).collect()
    if bad:
        raise ValueError(f"{message}: {[r.asDict() for r in bad]}")


def check_required(rows: DataFrame, json_column: str, keys: Sequence[str] = QUESTION_KEYS) -> DataFrame:
    """Rows whose JSON object lacks a key (a present null passes), with the missing keys."""
    fields = F.from_json(json_column, "map<string,string>")
    absent = F.array_compact(
        F.array(*[F.when(~F.coalesce(F.map_contains_key(fields, k), F.lit(False)), F.lit(k)) for k in keys])
    )
    return rows.withColumn("missing", absent).filter(F.size("missing") > 0)


def check_conversation_structure(rows: DataFrame, json_column: str) -> DataFrame:
    """Rows whose ``conversation`` is not an object or whose ``qa`` is not a list."""
    def starts(path: str, mark: str) -> Column:
        value = F.ltrim(F.get_json_object(json_column, path))
        return F.coalesce(F.startswith(value, F.lit(mark)), F.lit(False))

    problem = F.when(~starts("$.conversation", "{"), F.lit("conversation is not an object")).when(
        ~starts("$.qa", "["), F.lit("qa is not a list")
    )
    return rows.withColumn("problem", problem).filter("problem is not null")


def flat_row_problems(evaluations: DataFrame, benchmark: str) -> DataFrame:
    """Rows without an answer and rows of the older nested layout, with ``problem``.

    An answer is ``generated_answer``; conversation rows may have ``prediction`` in its place.
    """
    names = ("generated_answer", "prediction") if benchmark == "locomo" else ("generated_answer",)
    present = [n for n in names if n in evaluations.columns]
    answer = F.coalesce(*[F.col(n).cast("string") for n in present]) if present else F.lit(None)
    nested = F.col("cutoff_results").isNotNull() if "cutoff_results" in evaluations.columns else F.lit(False)
    problem = F.when(nested, F.lit("nested layout")).when(answer.isNull(), F.lit("no answer"))
    return evaluations.withColumn("problem", problem).filter("problem is not null")


def check_flat_rows(evaluations: DataFrame, benchmark: str) -> None:
    """Refuse evaluations with ``flat_row_problems``, and question evaluations without a row."""
    require_empty(flat_row_problems(evaluations, benchmark), f"unsupported {benchmark} evaluation rows")
    if benchmark == "longmemeval" and evaluations.isEmpty():
        raise ValueError(f"unsupported {benchmark} evaluation rows: there are none")


def check_complete(predictions: DataFrame, expected: DataFrame) -> DataFrame:
    """Differences between predictions (``position``, ``question_id``, ``schema_version``)
    and the expected list (``position``, ``question_id``): (question_id, problem)."""
    seen = predictions.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("times"),
        F.min("position").alias("at"),
        F.bool_or(F.coalesce(F.col("schema_version"), F.lit(-1)) != SCHEMA_VERSION).alias("old"),
    )
    wanted = expected.select("question_id", F.col("position").alias("wanted_at"))
    both = seen.join(wanted, "question_id", "full")
    problems = F.array_compact(
        F.array(
            F.when(F.col("old"), F.lit("schema_version")),
            F.when(F.col("question_id") == "", F.lit("empty_id")),
            F.when(F.col("times") > 1, F.lit("duplicate")),
            F.when(F.col("times").isNull(), F.lit("missing")),
            F.when(F.col("wanted_at").isNull(), F.lit("unexpected")),
            F.when(F.col("at") != F.col("wanted_at"), F.lit("order")),
        )
    )
    return both.select("question_id", F.explode(problems).alias("problem"))


def check_judgments(judgments: DataFrame, expected: dict[str, Column | str]) -> DataFrame:
    """(question_id, broken rules) of judgments that do not match their run.

    ``expected`` gives the required value of ``scientific_fingerprint``, ``judge_provider``,
    ``judge_requested_model`` and ``judge_fingerprint``, each a column or a constant, and
    optionally of ``prediction_sha256``.
    """
    def wanted(value) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    rules = {"schema_version": F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION))}
    rules["question_id"] = F.coalesce("question_id", F.lit("")) != ""
    for name, value in expected.items():
        rules[name] = F.col(name).eqNullSafe(wanted(value))
    rules["judge_model"] = blank_to_empty(F.col("judge_model")) != ""
    rules["judgment"] = normalize_verdict(F.col("judgment")).isNotNull()
    rules["score"] = F.expr("try_cast(score as double)").isNotNull()
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))
    return judgments.select("question_id", broken.alias("broken")).filter(F.size("broken") > 0)


def check_unique_combination(configs: DataFrame) -> DataFrame:
    """Repeated (benchmark, framework) configs and benchmarks with several dataset objects.

    In: (benchmark, framework, dataset_digest).
    """
    pairs = configs.groupBy("benchmark", "framework").agg(
        F.count(F.lit(1)).alias("configs"), F.min("dataset_digest").alias("lo"), F.max("dataset_digest").alias("hi")
    )
    repeated = pairs.filter("configs > 1").select(
        "benchmark", "framework", F.lit("duplicate config").alias("problem"), "configs"
    )
    mixed = (
        pairs.groupBy("benchmark")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("configs").alias("configs"))
        .filter("lo <> hi")
        .select("benchmark", F.lit(None).cast("string").alias("framework"),
                F.lit("several datasets").alias("problem"), "configs")
    )
    return repeated.unionByName(mixed)


def legal_step(before: Column, after: Column, transitions: dict[str, tuple[str, ...]]) -> Column:
    legal = F.lit(False)
    for state, following in transitions.items():
        if following:
            legal = F.when(before == state, after.isin(*following)).otherwise(legal)
    return legal


def check_transitions(
    states: DataFrame, key: str, order: list[Column], bucket: Column | None = None,
    transitions: dict[str, tuple[str, ...]] = RUN_TRANSITIONS,
) -> DataFrame:
    """Steps of one ``key`` that the state machine does not allow (``previous`` -> ``state``)."""
    rows = previous_row(states, [key], order, bucket, {"previous": F.col("state")})
    return rows.filter(
        F.col("previous").isNotNull() & ~legal_step(F.col("previous"), F.col("state"), transitions)
    )


def check_expected_unique(manifests: DataFrame, ids: str = "expected_item_ids") -> DataFrame:
    """Manifests that list an id twice."""
    return manifests.filter(F.size(F.array_distinct(ids)) < F.size(ids))
