"""The run ledger as tables: latest run, progress, resume, digests, comparability."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import fingerprint
from ..functions.dates import micros
from ..functions.text import title_case
from .ordered import previous_row, scan

# Phases after prediction, in order; what a run identity is made of.
PHASES = ("JUDGING", "EVALUATING", "REPORTING", "PUBLISHING", "VERIFYING")
EXCLUDED_ROOTS = ("publish-staging", "final")
IDENTITY_COLUMNS = ("dataset_id", "revision", "source_sha256", "materialized_sha256", "sampling")
DATASET_KEYS = ("name", "source", "revision", "sha256", "registry_id", "expected_schema")
FRAMEWORK_KEYS = ("format", "profile", "sha256")
MODEL_KEYS = ("provider", "endpoint_identity", "requested_model", "parameters")
MODEL_ROLES = ("answerer", "judge")
FINGERPRINT_VERSION = 2
# What a source can say about a unit or phase of a run, as bits.
EXPECTED, COMMITTED, BAD = 1, 2, 4
PHASE_LABELS: dict[str, str] = {}


# --- runs -------------------------------------------------------------------------------


def _newest_first(time: str, run_id: str) -> Column:
    return F.struct(-micros(time), F.col(run_id))


def latest_run(runs: DataFrame, keys: tuple[str, ...] = ("benchmark", "framework")) -> DataFrame:
    """The newest run per key by ``modified_at``; equal times go to the smaller run id."""
    rest = [c for c in runs.columns if c not in keys]
    best = F.min_by(F.struct(*rest), _newest_first("modified_at", "run_id")).alias("__r")
    return runs.groupBy(*keys).agg(best).select(*keys, "__r.*")


def list_runs(runs: DataFrame) -> DataFrame:
    """Visible runs with derived state, phase and update time, newest first.

    In: (run_id, benchmark, framework, state, phase, manifest_at, status_at, completed_at,
    verified_artifact_count); times are null when the file is not there.
    """
    completed = F.col("completed_at").isNotNull()
    state = F.coalesce(F.nullif("state", F.lit("")), F.when(completed, F.lit("COMPLETED")).otherwise(F.lit("CREATED")))
    visible = runs.filter(~F.startswith(F.col("run_id"), F.lit(".")))
    return visible.select(
        "run_id",
        F.coalesce("benchmark", F.lit("unknown")).alias("benchmark"),
        F.coalesce("framework", F.lit("unknown")).alias("framework"),
        state.alias("state"),
        F.coalesce(F.nullif("phase", F.lit("")), state).alias("phase"),
        completed.alias("completed"),
        F.coalesce("completed_at", "status_at", "manifest_at").alias("updated_at"),
        "completed_at",
        F.coalesce("verified_artifact_count", F.lit(0)).cast("bigint").alias("artifact_count"),
    ).orderBy(F.desc("updated_at"), "run_id")


def progress_ratio(committed: Column, expected: Column) -> Column:
    return F.when(F.coalesce(expected, F.lit(0)) == 0, F.lit(0.0)).otherwise(
        F.coalesce(committed, F.lit(0)) / expected
    )


def capped_activity(completed: Column, total: Column) -> Column:
    """Completed work of the current activity, never more than its total."""
    return F.least(F.coalesce(total, F.lit(0)), F.coalesce(completed, F.lit(0)))


def percentage(done: Column, total: Column) -> Column:
    """Share in percent, between 0 and 100, one decimal; 0 for no total."""
    share = done / F.nullif(total, F.lit(0)) * 100.0
    return F.coalesce(F.bround(F.least(F.lit(100.0), F.greatest(F.lit(0.0), share)), 1), F.lit(0.0))


def phase_label(state: Column, phase: Column, labels: dict[str, str] | None = None) -> Column:
    """``Failed during <phase>`` for failed states, else a given label, else the phase in words."""
    shown = F.coalesce(phase, state)
    label = title_case(F.replace(shown, F.lit("_"), F.lit(" ")))
    for name, text in (labels or PHASE_LABELS).items():
        label = F.when(shown == name, F.lit(text)).otherwise(label)
    failed = F.concat(F.lit("Failed during "), F.lower(F.regexp_replace(state, "^FAILED_", "")))
    return F.when(F.startswith(state, F.lit("FAILED_")), failed).otherwise(label)


def operator_status(status: DataFrame) -> DataFrame:
    """What an operator sees of each run.

    In: (run_id, state, phase, items struct, units struct, current_activity struct).
    """
    return status.select(
        "run_id",
        F.coalesce("state", F.lit("UNKNOWN")).alias("state"),
        F.coalesce("phase", "state", F.lit("UNKNOWN")).alias("phase"),
        phase_label(F.coalesce("state", F.lit("UNKNOWN")), F.coalesce("phase", "state", F.lit("UNKNOWN"))).alias("phase_label"),
        percentage(F.col("items.committed"), F.col("items.expected")).alias("percentage"),
        F.coalesce("items.committed", F.lit(0)).alias("items_completed"),
        F.coalesce("items.expected", F.lit(0)).alias("items_total"),
        F.coalesce("items.failed", F.lit(0)).alias("items_failed"),
        F.coalesce("units.committed", F.lit(0)).alias("records_completed"),
        F.coalesce("units.expected", F.lit(0)).alias("records_total"),
        percentage(F.col("current_activity.completed"), F.col("current_activity.total")).alias("activity_percentage"),
        (F.coalesce("state", F.lit("")) == "COMPLETED").alias("ready_for_verification"),
    )


def latest_attempt(attempts: DataFrame) -> DataFrame:
    """Per run the attempt with the greatest (started_at, attempt_id)."""
    best = F.max(F.struct("started_at", "attempt_id")).alias("__a")
    return attempts.groupBy("run_id").agg(best).select("run_id", "__a.started_at", "__a.attempt_id")


def terminal_items(manifests: DataFrame) -> DataFrame:
    """(run_id, position, item_id): the expected questions if listed, else the units."""
    listed = F.when(F.size("expected_question_ids") > 0, F.col("expected_question_ids"))
    return manifests.select(
        "run_id", F.posexplode(F.coalesce(listed, F.col("expected_item_ids"))).alias("position", "item_id")
    )


# --- artifacts --------------------------------------------------------------------------


def is_unsafe_path(path: Column) -> Column:
    """Absolute paths and paths that step upwards."""
    return F.startswith(path, F.lit("/")) | path.rlike(r"(^|/)\.\.(/|$)")


def verify_manifest(manifest: DataFrame, observed: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, path, problem) of listed artifacts that are not there as listed.

    Both frames: (keys, path, sha256, bytes).
    """
    by = [*keys, "path"]
    listed = manifest.groupBy(*by).agg(
        F.count(F.lit(1)).alias("times"), F.min("sha256").alias("sha256"), F.min("bytes").alias("bytes")
    )
    seen = observed.select(*by, F.col("sha256").alias("seen_sha256"), F.col("bytes").alias("seen_bytes"))
    joined = listed.join(seen, by, "left")
    problem = (
        F.when(is_unsafe_path(F.col("path")), F.lit("unsafe_path"))
        .when(F.col("times") > 1, F.lit("duplicate"))
        .when(F.col("seen_bytes").isNull(), F.lit("missing"))
        .when(F.col("seen_bytes") != F.col("bytes"), F.lit("size"))
        .when(F.col("seen_sha256") != F.col("sha256"), F.lit("checksum"))
    )
    return joined.select(*by, problem.alias("problem")).filter("problem is not null")


def manifest_count_mismatch(manifest: DataFrame, markers: DataFrame) -> DataFrame:
    """Runs whose completion marker states another number of artifacts than the manifest lists."""
    counts = manifest.groupBy("run_id").agg(F.count(F.lit(1)).alias("listed"))
    return (
        markers.join(counts, "run_id", "left")
        .select("run_id", "verified_artifact_count", F.coalesce("listed", F.lit(0)).alias("listed"))
        .filter("not (verified_artifact_count <=> listed)")
    )


# --- resume -----------------------------------------------------------------------------


def unit_flags(expected: DataFrame, checkpoints: DataFrame, bad_units: DataFrame) -> DataFrame:
    """(run_id, unit_id, flags): what three sources say about units, one row per statement.

    A source that says several of these in one row adds up its flags itself and is read once.
    """
    keys = ["run_id", "unit_id"]
    committed = checkpoints.filter(F.col("status") == "COMMITTED")
    parts = ((expected, EXPECTED), (committed, COMMITTED), (bad_units, BAD))
    return reduce(DataFrame.unionByName, [part.select(*keys, F.lit(flag).alias("flags")) for part, flag in parts])


def phase_flags(phases: DataFrame, bad_phases: DataFrame) -> DataFrame:
    """(run_id, phase, flags, predecessor_digest, checkpoint_digest) of checkpoints and bad artifacts."""
    committed = F.when(F.col("status") == "COMMITTED", COMMITTED).otherwise(0)
    said = phases.select("run_id", "phase", committed.alias("flags"), "predecessor_digest", "checkpoint_digest")
    bad = bad_phases.select("run_id", "phase", F.lit(BAD).alias("flags"))
    return said.unionByName(bad, allowMissingColumns=True)


def _expected_units(units: DataFrame) -> DataFrame:
    """(run_id, unit_id, open) of the expected units, from all that is said about each."""
    state = units.groupBy("run_id", "unit_id").agg(F.bit_or("flags").alias("__f"))
    is_open = F.col("__f").bitwiseAND(COMMITTED | BAD) != COMMITTED
    return state.filter(F.col("__f").bitwiseAND(EXPECTED) != 0).select("run_id", "unit_id", is_open.alias("open"))


def restart_units(units: DataFrame) -> DataFrame:
    """(run_id, unit_id) of expected units that are not committed or have a bad artifact.

    In: (run_id, unit_id, flags), see ``unit_flags``.
    """
    return _expected_units(units).filter("open").select("run_id", "unit_id")


def with_ordinal(checkpoints: DataFrame) -> DataFrame:
    """Add the 1-based place of a phase in the lifecycle; unknown phases get 0."""
    return checkpoints.withColumn("ordinal", F.array_position(F.array(*[F.lit(p) for p in PHASES]), F.col("phase")))


def resume_plan(units: DataFrame, phases: DataFrame) -> DataFrame:
    """(run_id, next_phase, restart_units): RUNNING while units are open, else the first
    phase without a valid checkpoint, else VERIFYING.

    A phase is valid when it is COMMITTED, follows the digest of the phase before it and
    has no bad artifact. Runs are those with expected units. ``units`` as from
    ``unit_flags``, ``phases`` as from ``phase_flags``; each is read once and aggregated
    before it is shuffled by run. A run has one checkpoint per phase; statements that
    repeat count once.
    """
    entry = F.struct("ordinal", "flags", "predecessor_digest", "checkpoint_digest")
    known = with_ordinal(phases).filter("ordinal > 0")
    chains = known.groupBy("run_id").agg(F.collect_set(entry).alias("__c"))

    def stated(i: Column, flag: int) -> Column:
        return F.filter("__c", lambda c: (c["ordinal"] == i) & (c["flags"].bitwiseAND(flag) != 0))

    def checkpoint(i: Column) -> Column:
        good = F.size(stated(i, BAD)) == 0
        return F.when(good, F.get(F.array_sort(stated(i, COMMITTED)), F.lit(0)))

    def follows(i: Column) -> Column:
        given = checkpoint(i)["predecessor_digest"]
        return F.when(i == 1, given.isNull()).otherwise(given == checkpoint(i - 1)["checkpoint_digest"])

    steps = F.sequence(F.lit(1), F.lit(len(PHASES)))
    broken = F.filter(
        steps, lambda i: checkpoint(i).isNull() | ~F.coalesce(follows(i), F.lit(False))
    )
    first_broken = F.array_min(F.when(F.col("__c").isNull(), F.array(F.lit(1))).otherwise(broken))
    next_phase = F.get(F.array(*[F.lit(p) for p in PHASES]), F.coalesce(first_broken, F.lit(len(PHASES))) - 1)
    runs = _expected_units(units).groupBy("run_id").agg(F.count_if("open").alias("restart_units"))
    return runs.join(chains, "run_id", "left").select(
        "run_id",
        F.when(F.col("restart_units") > 0, F.lit("RUNNING")).otherwise(next_phase).alias("next_phase"),
        "restart_units",
    )


def phase_chain(checkpoints: DataFrame, order: list[Column] | None = None, bucket: Column | None = None) -> DataFrame:
    """Checkpoints that do not name the digest of the one before them."""
    rows = previous_row(
        checkpoints,
        ["run_id"],
        order or [F.col("ordinal")],
        F.floor(F.col("ordinal") / 1000) if bucket is None else bucket,
        {"expected_predecessor": F.col("checkpoint_digest")},
    )
    return rows.filter(~F.col("predecessor_digest").eqNullSafe(F.col("expected_predecessor")))


# --- identity ---------------------------------------------------------------------------


def effective_report(original: DataFrame, derived: DataFrame) -> DataFrame:
    """The newest derived report of a run, else its original one.

    In: ``original`` (run_id, evaluator_version, report), ``derived`` the same plus
    ``modified_at``.
    """
    newest = derived.groupBy("run_id").agg(
        F.min_by(F.struct("evaluator_version", "report"), F.struct(-micros("modified_at"), F.col("evaluator_version"))).alias("__d")
    )
    joined = original.join(newest, "run_id", "left")
    return joined.select(
        "run_id",
        F.coalesce("__d.evaluator_version", "evaluator_version").alias("evaluator_version"),
        F.coalesce("__d.report", "report").alias("report"),
        F.col("__d").isNotNull().alias("is_derived"),
    )


def identity_key(columns: tuple[str, ...] = IDENTITY_COLUMNS) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def _one_run(runs: DataFrame, on: str, run: str, identity: str) -> DataFrame:
    """(on, run, identity), an error where a side has several runs (see :func:`latest_run`)."""
    rows = runs.groupBy(on).agg(
        F.count(F.lit(1)).alias("__n"), F.min(F.struct("run_id", identity_key().alias("identity"))).alias("__r")
    )
    several = F.raise_error(F.concat(F.lit("more than one run for "), F.col(on).cast("string")))
    only = rows.select(on, F.when(F.col("__n") == 1, F.col("__r")).otherwise(several).alias("__r"))
    return only.select(on, F.col("__r.run_id").alias(run), F.col("__r.identity").alias(identity))


def comparable(left: DataFrame, right: DataFrame, on: str = "benchmark") -> DataFrame:
    """Pair the one run per ``on`` of each side and tell whether they used the same sample."""
    pairs = _one_run(left, on, "run_a", "__a").join(_one_run(right, on, "run_b", "__b"), on)
    return pairs.select(on, "run_a", "run_b", (F.col("__a") == F.col("__b")).alias("comparable"))


def comparable_groups(runs: DataFrame) -> DataFrame:
    """Runs per identical sample identity: (identity, runs, frameworks)."""
    return runs.groupBy(identity_key().alias("identity")).agg(
        F.count(F.lit(1)).alias("runs"), F.countDistinct("framework").alias("frameworks")
    )


def config_drift(recorded: DataFrame, current: DataFrame, key: str = "config_id") -> DataFrame:
    """Configs that changed or disappeared since they were recorded. Both: (key, sha256)."""
    now = current.select(key, F.col("sha256").alias("observed"))
    joined = recorded.select(key, F.col("sha256").alias("expected")).join(now, key, "left")
    return joined.filter(~F.col("expected").eqNullSafe(F.col("observed")))


# What a run's identity takes from its config: a path, and what stands for it where the
# config has nothing usable there (``None`` a JSON null, ``{}`` an empty object, ``...`` no entry).
# An object that is only partly taken has an entry of its own that starts it empty.
IDENTITY_RULES: tuple[tuple[str, object], ...] = (
    ("benchmark", None),
    ("framework", None),
    ("selection", {}),
    ("evaluation", {}),
    *((f"dataset.{k}", ...) for k in DATASET_KEYS),
    *((f"framework_config.{k}", ...) for k in FRAMEWORK_KEYS),
    *((f"models.{role}.{k}", ...) for role in MODEL_ROLES for k in MODEL_KEYS),
)
IDENTITY_OBJECTS = ("dataset", "framework_config", *(f"models.{role}" for role in MODEL_ROLES))


def _put(target: dict, path: str, value) -> None:
    *parents, last = path.split(".")
    reduce(lambda at, step: at.setdefault(step, {}), parents, target)[last] = value


def _at(document, path: str):
    return reduce(lambda at, step: at.get(step) if isinstance(at, dict) else None, path.split("."), document)


def _projected(document: dict) -> dict:
    """The parts of a config that ``IDENTITY_RULES`` name; numbers stay as they are written."""
    out: dict = {}
    for path in IDENTITY_OBJECTS:
        _put(out, path, {})
    for path, otherwise in IDENTITY_RULES:
        value = _at(document, path)
        if value is None or (otherwise == {} and not isinstance(value, dict)):
            value = otherwise
        if value is not ...:
            _put(out, path, value)
    return out


def scientific_inputs(
    config_json: Column, judge_contracts: dict | None = None, expected_question_ids: Column | None = None
) -> Column:
    """JSON of the config parts that can change a result; paths and tuning are left out.

    ``judge_contracts`` maps a benchmark to the identity of its judge prompt and parser.
    ``expected_question_ids`` (an array), where given, makes the set of questions part of
    the identity.
    """
    contracts = judge_contracts or {}

    @F.pandas_udf(T.StringType())
    def inputs(text: pd.Series, asked: pd.Series) -> pd.Series:
        def one(t, ids):
            if t is None:
                return None
            found = _projected(json.loads(t)) | {"schema_version": FINGERPRINT_VERSION}
            found["judge_contract"] = contracts.get(found["benchmark"], {})
            if ids is not None:
                found["expected_question_ids"] = list(ids)
            return json.dumps(found, ensure_ascii=False)

        return pd.Series([one(t, ids) for t, ids in zip(text, asked)], dtype="object")

    asked = F.lit(None).cast("array<string>") if expected_question_ids is None else expected_question_ids
    return inputs(config_json, asked)


def config_fingerprint(
    config_json: Column, judge_contracts: dict | None = None, expected_question_ids: Column | None = None
) -> Column:
    return fingerprint(scientific_inputs(config_json, judge_contracts, expected_question_ids))


def set_digest(rows: DataFrame, digest: str, position: str, fan_in: int = 4096, levels: int = 1) -> DataFrame:
    """(row_count, set_sha256): one digest over all row digests in order of ``position``, which has no ties.

    Ranks come from sampled ranges, so positions may have gaps. Digests are joined and hashed
    ``fan_in`` at a time, level by level (``levels`` at least), until one is left; no task
    ever holds more than ``fan_in`` of them.
    """
    count = rows.count()
    while fan_in**levels < count:
        levels += 1
    ranked = scan(rows.select(F.col(position).alias("__at"), F.col(digest).alias("d")), [], [F.col("__at")], position="p")
    level = ranked.select(F.col("p").cast("bigint").alias("p"), "d", F.lit(1).cast("bigint").alias("n"))
    for _ in range(levels):
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: x["d"])
        level = level.groupBy(F.expr(f"p div {fan_in}").alias("p")).agg(
            F.sha2(F.array_join(ordered, "\n"), 256).alias("d"), F.sum("n").alias("n")
        )
    return level.select(F.col("n").alias("row_count"), F.col("d").alias("set_sha256"))
