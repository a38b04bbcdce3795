"""Readers of run folders: predictions, timing, manifests, status, events, artifacts."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import EXCLUDED_ROOTS
from ..operators.telemetry import EVENT_SCHEMA
from . import schemas as S
from .datasets import file_digests


def _path_part(from_end: int) -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -from_end)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents; unreadable ones become rows of nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def path_exists(spark: SparkSession, pattern: str) -> bool:
    """Whether a path or glob matches anything; only the listing is done."""
    try:
        spark.read.text(pattern)
        return True
    except AnalysisException:
        return False


def read_predictions(spark: SparkSession, run_dir: str, benchmark: str, expected: DataFrame) -> DataFrame:
    """Prediction rows with ``position``: the order of the manifest, then of the file.

    ``expected``: (position, item_id) of the manifest's units.
    """
    unit = _path_part(2).alias("unit_id")
    if benchmark == "longmemeval":
        rows = _json(spark, f"{run_dir}/items/*/prediction.json", S.PREDICTION_FIELDS)
        rows = rows.select(unit, F.lit(0).alias("in_unit"), *rows.columns)
    elif benchmark == "locomo":
        item = f"struct<{S.PREDICTION_FIELDS}>"
        files = _json(spark, f"{run_dir}/items/*/predictions.json", f"predictions array<{item}>")
        rows = files.select(unit, F.posexplode("predictions").alias("in_unit", "p")).select("unit_id", "in_unit", "p.*")
    else:
        raise ValueError(f"unsupported benchmark: {benchmark!r}")
    wanted = expected.select(F.col("item_id").alias("unit_id"), F.col("position").alias("unit_position"))
    return rows.join(wanted, "unit_id").withColumn("position", F.struct("unit_position", "in_unit")).drop(
        "unit_position", "in_unit"
    )


def read_evaluations(spark: SparkSession, path: str) -> DataFrame:
    """Judged rows: JSON documents, or a JSON array of them."""
    return _json(spark, path, S.JUDGMENT_FIELDS)


def read_timing(spark: SparkSession, run_dir: str, evaluations: DataFrame | None = None) -> DataFrame:
    """Timing records with ``position`` in file order: item files, else the evaluations, then
    judgment files."""
    def files(rank: int, *patterns: str) -> list[DataFrame]:
        frames = []
        for i, pattern in enumerate(patterns):
            if path_exists(spark, f"{run_dir}/{pattern}"):
                frame = _json(spark, f"{run_dir}/{pattern}", S.TIMING_FIELDS)
                position = F.struct(F.lit(rank + i).alias("part"), F.col("_metadata.file_path").alias("path"))
                frames.append(frame.select(position.alias("position"), *frame.columns))
        return frames

    parts = files(0, "items/*/timing.json", "items/*/timing/*.json")
    if not parts and evaluations is not None:
        position = F.struct(F.lit(0).alias("part"), F.col("question_id").alias("path"))
        parts = [evaluations.select(position.alias("position"), "conversation_idx", "question_id", "pipeline_timing")]
    parts += files(2, "judgments/timing/*.json")
    if not parts:
        return spark.createDataFrame([], f"position struct<part:int,path:string>, {S.TIMING_FIELDS}")
    return reduce(DataFrame.unionByName, parts)


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """One row per run folder that has a readable manifest and status.

    ``modified_at`` is the time of the status file.
    """
    run = _path_part(2).alias("run_id")
    manifests = _json(spark, f"{root}/*/run-manifest.json", S.MANIFEST_FIELDS)
    manifests = manifests.filter("fingerprint_inputs is not null").select(
        run,
        F.coalesce("fingerprint_inputs.benchmark", F.lit("unknown")).alias("benchmark"),
        F.coalesce("fingerprint_inputs.framework", F.lit("unknown")).alias("framework"),
        "scientific_fingerprint",
        "expected_item_ids",
        F.col("fingerprint_inputs.expected_question_ids").alias("expected_question_ids"),
        F.col("_metadata.file_modification_time").alias("manifest_at"),
    )
    status = _json(spark, f"{root}/*/run-status.json", S.STATUS_FIELDS).filter("state is not null")
    status = status.select(
        run, "state", "phase", "items", "units", "current_activity",
        F.col("_metadata.file_modification_time").alias("modified_at"),
    )
    return manifests.join(status, "run_id")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The JSON-lines run log as a batch."""
    return spark.read.schema(EVENT_SCHEMA).json(path)


def read_event_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The JSON-lines run log as a stream over a folder."""
    return spark.readStream.schema(EVENT_SCHEMA).options(**options).json(path)


def artifact_manifest(spark: SparkSession, run_dir: str) -> DataFrame:
    """(path, sha256, bytes) of the files of a run, staging and final copies left out."""
    files = file_digests(spark, run_dir)
    root = run_dir.rstrip("/").split(":")[-1]
    relative = F.substring_index(F.col("path"), root + "/", -1)
    return files.select(relative.alias("path"), "sha256", "bytes").filter(
        ~F.substring_index("path", "/", 1).isin(*EXCLUDED_ROOTS)
    )
