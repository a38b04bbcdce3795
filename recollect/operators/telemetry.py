"""Telemetry over event tables: labels, counters, histograms, gauges, rates, alerts.

These run on batch frames; the stateless ones and the aggregations also run on streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import micros
from ..functions.text import bounded_label, one_of
from .ledger import percentage, progress_ratio
from .ordered import scan, stretches

# Vocabularies, bucket bounds and alert limits.
ALLOWED_EVENTS = (
    "run.preflight.started",
    "run.preflight.completed",
    "run.started",
    "run.completed",
    "run.failed",
    "run.interrupt.requested",
    "run.interrupted",
    "unit.prediction.started",
    "unit.prediction.committed",
    "judge.started",
    "judge.completed",
    "evaluation.started",
    "evaluation.completed",
    "report.written",
    "artifact.publish.started",
    "artifact.publish.completed",
    "artifact.publish.failed",
    "metrics.snapshot.written",
)
EVENT_SCHEMA = (
    "schema_version int, timestamp timestamp, level string, event string, message string, "
    "run_id string, attempt_id string, benchmark string, framework string, phase string, "
    "unit_index int, unit_id_hash string, elapsed_seconds double, outcome string, "
    "error_type string, retryable boolean"
)
PHASES = (
    "PREFLIGHT",
    "RUNNING",
    "JUDGING",
    "EVALUATING",
    "REPORTING",
    "PUBLISHING",
    "VERIFYING",
    "COMPLETED",
    "FAILED",
    "FAILED_EVALUATION",
)
RUN_STATES = (
    "CREATED",
    "PREFLIGHT",
    "RUNNING",
    "JUDGING",
    "EVALUATING",
    "REPORTING",
    "PUBLISHING",
    "VERIFYING",
    "COMPLETED",
    "PARTIAL",
    "INTERRUPTING",
    "INTERRUPTED",
    "FAILED_PREFLIGHT",
    "FAILED_RUNNING",
    "FAILED_JUDGING",
    "FAILED_EVALUATION",
    "FAILED_REPORTING",
    "FAILED_PUBLISHING",
    "FAILED_VERIFYING",
)
ROLES = ("answerer", "judge", "memory_internal", "embedding", "reranker")
OPERATIONS = ("create_collection", "delete_collection", "count", "upsert", "search", "query", "retrieve", "health")
BACKENDS = ("local-only", "local", "s3-compatible")
PHASE_BUCKETS = (0.1, 0.5, 1.0, 2.5, 5.0, 15.0, 30.0, 60.0, 300.0, 900.0, float("inf"))
OPERATION_BUCKETS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0, float("inf"))
PUBLISH_BUCKETS = (0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 15.0, 60.0, float("inf"))
STALL_SECONDS = 900
STALL_HOLD_SECONDS = 300
DOWN_HOLD_SECONDS = 60


# --- events and labels ------------------------------------------------------------------


def event_problem(event: Column, fields: Column | None = None, allowed_fields: tuple[str, ...] = ()) -> Column:
    """Why an event row is refused, or null."""
    problem = F.when(~F.coalesce(event, F.lit("")).isin(*ALLOWED_EVENTS), F.lit("unknown event"))
    if fields is None:
        return problem
    extra = F.array_except(fields, F.array(*[F.lit(f) for f in allowed_fields]))
    return F.coalesce(problem, F.when(F.size(extra) > 0, F.lit("unknown field")))


def split_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted events, rejected events with ``problem``)."""
    marked = events.withColumn("problem", event_problem(F.col("event")))
    return marked.filter("problem is null").drop("problem"), marked.filter("problem is not null")


def phase_name(value: Column) -> Column:
    return one_of(F.upper(value), PHASES, "FAILED")


def role_name(value: Column) -> Column:
    return one_of(F.lower(value), ROLES, "other")


def operation_name(value: Column) -> Column:
    return one_of(F.replace(F.lower(value), F.lit("-"), F.lit("_")), OPERATIONS, "other")


def backend_name(value: Column) -> Column:
    return one_of(F.lower(value), BACKENDS, "other")


# --- counters and histograms ------------------------------------------------------------


def request_counters(requests: DataFrame) -> DataFrame:
    """Requests and tokens by (role, provider, outcome); negatives count as 0 and a missing
    total is prompt + completion."""
    def floor0(name: str) -> Column:
        return F.greatest(F.coalesce(F.col(name), F.lit(0)), F.lit(0))

    prompt, completion = floor0("prompt_tokens"), floor0("completion_tokens")
    total = F.greatest(F.coalesce("total_tokens", prompt + completion), F.lit(0))
    return requests.groupBy(
        role_name(F.col("role")).alias("role"),
        bounded_label(F.col("provider")).alias("provider"),
        bounded_label(F.col("outcome")).alias("outcome"),
    ).agg(
        F.sum(F.greatest(F.coalesce("request_count", F.lit(1)), F.lit(0))).cast("bigint").alias("requests"),
        F.sum(prompt).cast("bigint").alias("prompt_tokens"),
        F.sum(completion).cast("bigint").alias("completion_tokens"),
        F.sum(total).cast("bigint").alias("total_tokens"),
    )


def count_by(events: DataFrame, labels: dict[str, Column], name: str) -> DataFrame:
    """A plain labelled counter (attempts, retries, operations, publishes)."""
    return events.groupBy(*[c.alias(n) for n, c in labels.items()]).agg(F.count(F.lit(1)).alias(name))


def histogram(observations: DataFrame, labels: list[str], value: str, bounds: tuple[float, ...]) -> DataFrame:
    """Cumulative buckets, one row per (labels, le), plus sum and count of the series."""
    buckets = [F.count_if(F.col(value) <= F.lit(b)).alias(f"__b{i}") for i, b in enumerate(bounds)]
    wide = observations.groupBy(*labels).agg(F.count(value).alias("count"), F.sum(value).alias("sum"), *buckets)
    cells = F.array(
        *[F.struct(F.lit(b).alias("le"), F.col(f"__b{i}").alias("bucket_count")) for i, b in enumerate(bounds)]
    )
    rows = wide.select(*labels, "count", "sum", F.explode(cells).alias("c"))
    return rows.select(*labels, "c.le", "c.bucket_count", "count", F.round("sum", 6).alias("sum"))


# --- gauges -----------------------------------------------------------------------------


def last_gauges(updates: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The newest value of every run gauge, with the ratios.

    In: expected_items, committed_items, expected_units, committed_units (units default to
    items), activity_stage, activity_completed, activity_total.
    """
    names = [
        "expected_items", "committed_items", "expected_units", "committed_units",
        "activity_stage", "activity_completed", "activity_total",
    ]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*names), order).alias("g")).select(*keys, "g.*")
    units_expected = F.coalesce("expected_units", "expected_items")
    units_committed = F.coalesce("committed_units", "committed_items")
    total = F.greatest(F.coalesce("activity_total", F.lit(0)), F.lit(0))
    done = F.least(total, F.greatest(F.coalesce("activity_completed", F.lit(0)), F.lit(0)))
    return last.select(
        *keys,
        F.col("expected_items"),
        F.col("committed_items"),
        progress_ratio(F.col("committed_items"), F.col("expected_items")).alias("item_progress_ratio"),
        units_expected.alias("expected_units"),
        units_committed.alias("committed_units"),
        progress_ratio(units_committed, units_expected).alias("progress_ratio"),
        F.when(F.col("activity_stage").isNotNull(), bounded_label(F.col("activity_stage"))).alias("activity_stage"),
        total.alias("activity_expected"),
        done.alias("activity_completed"),
        progress_ratio(done, total).alias("activity_progress_ratio"),
    )


def activity_gauges(updates: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """(keys, stage, expected, completed, active): the stage of the newest update shows its
    numbers, all earlier stages are reset to 0."""
    last = updates.groupBy(*keys).agg(
        F.max_by(F.struct("activity_stage", "activity_completed", "activity_total"), order).alias("g")
    )
    stages = updates.filter("activity_stage is not null").select(*keys, bounded_label(F.col("activity_stage")).alias("stage")).distinct()
    rows = stages.join(last, keys)
    active = F.coalesce(F.col("stage") == bounded_label(F.col("g.activity_stage")), F.lit(False))
    total = F.greatest(F.coalesce("g.activity_total", F.lit(0)), F.lit(0))
    done = F.least(total, F.greatest(F.coalesce("g.activity_completed", F.lit(0)), F.lit(0)))
    return rows.select(
        *keys, "stage",
        F.when(active, total).otherwise(0).alias("expected"),
        F.when(active, done).otherwise(0).alias("completed"),
        active.alias("active"),
    )


def one_hot(df: DataFrame, column: str, vocabulary: tuple[str, ...], out: str) -> DataFrame:
    """One row per (row, vocabulary entry) with 1 for the current entry and 0 otherwise."""
    keep = [c for c in df.columns if c != column]
    entry = F.explode(F.array(*[F.lit(v) for v in vocabulary]))
    rows = df.withColumn("__v", entry)
    return rows.select(*keep, F.col("__v").alias(out), (F.col("__v") == F.upper(column)).cast("int").alias("active"))


def activity(update: DataFrame) -> DataFrame:
    """A progress update as shown: percentage, record number, and what is wrong with it."""
    broken = (
        F.when((F.col("completed") < 0) | (F.col("total") < 0), F.lit("negative count"))
        .when(F.col("completed") > F.col("total"), F.lit("completed exceeds total"))
    )
    return update.withColumns(
        {
            "percentage": percentage(F.col("completed"), F.col("total")),
            "record_number": F.col("unit_index") + 1,
            "problem": broken,
        }
    )


def live_progress(events: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Add ``committed``: how many items of the run were done after each event, in an ``order`` without ties."""
    return scan(events, [key], order, sums={"committed": F.lit(1)})


# --- queries over series ----------------------------------------------------------------


def counter_increase(samples: DataFrame, series: list[str], ties: tuple[str, ...] = ()) -> DataFrame:
    """Add ``increase`` since the previous sample of the series; a drop is a counter reset
    and counts the new value. The first sample has no increase. Samples of one time follow
    each other by ``ties``, then by value."""
    order = [F.col(c) for c in ("ts", *ties, "value")]
    rows = scan(samples, series, order, previous={"__v": F.col("value")})
    step = F.when(F.col("__v").isNull(), F.lit(0.0)).when(F.col("value") < F.col("__v"), F.col("value"))
    return rows.withColumn("increase", step.otherwise(F.col("value") - F.col("__v"))).drop("__v")


def rate(samples: DataFrame, series: list[str], window_seconds: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """Per-second increase of each series in fixed windows, not extrapolated to the edges."""
    steps = counter_increase(samples, series, ties)
    slot = F.floor(F.unix_timestamp("ts") / window_seconds) * window_seconds
    return steps.groupBy(*series, slot.cast("bigint").alias("window_start")).agg(
        F.round(F.sum("increase") / window_seconds, 9).alias("rate")
    )


def sum_by(rates: DataFrame, labels: list[str], value: str = "rate") -> DataFrame:
    return rates.groupBy(*labels).agg(F.round(F.sum(value), 6).alias(value))


def attach_labels(samples: DataFrame, info: DataFrame, labels: list[str]) -> DataFrame:
    """Give every sample the labels of the one info series (several rows are an error)."""
    one = info.select(F.struct(*labels)).scalar()
    return samples.withColumn("__l", one).filter("__l is not null").select(*samples.columns, *[F.col(f"__l.{n}").alias(n) for n in labels])


def clamped_ratio(part: Column, whole: Column) -> Column:
    """``part / clamp_min(whole, 1)``."""
    return part / F.greatest(whole, F.lit(1))


def label_matches(column: Column, pattern: str) -> Column:
    """A fully anchored regular expression on a label."""
    return column.rlike(f"^(?:{pattern})$")


def latest_results(results: DataFrame, benchmark: str = ".*", framework: str = ".*") -> DataFrame:
    """The results panel: every metric but the judged count."""
    return results.filter(
        label_matches(F.col("benchmark"), benchmark)
        & label_matches(F.col("framework"), framework)
        & (F.col("metric") != "judged_count")
    )


# --- alerts -----------------------------------------------------------------------------


def stall_alerts(
    progress: DataFrame, key: str, until: Column | None = None,
    quiet_seconds: int = STALL_SECONDS, hold_seconds: int = STALL_HOLD_SECONDS,
) -> DataFrame:
    """(key, last_progress, fired_at, resumed_at): gaps longer than quiet + hold.

    ``until`` (an end time) also reports series that never came back.
    """
    limit = quiet_seconds + hold_seconds
    gaps = scan(
        progress.select(key, F.col("ts").alias("last_progress")), [key], [F.col("last_progress")],
        following={"resumed_at": F.col("last_progress")},
    )
    end = F.coalesce("resumed_at", until if until is not None else F.col("resumed_at"))
    silent = micros(end) - micros("last_progress")
    fired = F.timestamp_micros(micros("last_progress") + limit * 1_000_000)
    return gaps.filter(silent > limit * 1_000_000).select(key, "last_progress", fired.alias("fired_at"), "resumed_at")


def failed_state_alerts(states: DataFrame) -> DataFrame:
    """Rows in a failed state; they fire at once."""
    return states.filter(label_matches(F.col("state"), "FAILED_.*"))


def down_alerts(samples: DataFrame, key: str, ties: tuple[str, ...] = (), hold_seconds: int = DOWN_HOLD_SECONDS) -> DataFrame:
    """(key, down_since, last_down, samples): stretches of ``up = 0`` held long enough.

    Samples of one time follow each other by ``ties``, then by ``up``.
    """
    found = stretches(
        samples, [key], [F.col(c) for c in ("ts", *ties, "up")], F.col("up"),
        {"first": F.min("ts"), "last": F.max("ts"), "n": F.count(F.lit(1))},
        {"down_since": F.min("first"), "last_down": F.max("last"), "samples": F.sum("n")},
    )
    held = micros("last_down") - micros("down_since") >= hold_seconds * 1_000_000
    return found.filter((F.col("value") == 0) & held).drop("value")
