"""Writers: samples in their nested shape, report documents, the long metrics table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import micros
from ..functions.text import bounded_label
from ..operators.ledger import capped_activity, progress_ratio
from ..operators.scoring import rules_for
from ..operators.extensions import Registry
from .runs import path_exists


def write_sample(sample: DataFrame, manifest: DataFrame, path: str, order: str) -> None:
    """A sampled dataset as JSON lines in dataset order, with its one-row manifest."""
    sample.repartitionByRange(F.col(order)).sortWithinPartitions(order).write.json(f"{path}/data")
    manifest.write.json(f"{path}/manifest")


def write_reports(reports: dict[str, DataFrame], path: str, table_format: str = "json") -> None:
    """Each report under its own name."""
    for name, frame in reports.items():
        frame.write.format(table_format).save(f"{path}/{name}")


def derive_evaluation(
    evaluations: DataFrame, run_id: str, benchmark: str, path: str, source_sha256: str, registry: Registry | None = None
) -> dict:
    """Re-score committed rows under ``path/run_id/<evaluator version>``, once per version.

    A version that is already there is reused when it was made from the same source, and
    refused when it was not.
    """
    spark = evaluations.sparkSession
    version = rules_for(benchmark).evaluator_version
    target = f"{path}/{run_id}/{version}"
    if path_exists(spark, f"{target}/derivation"):
        known = spark.read.json(f"{target}/derivation").first()
        if known["source_sha256"] != source_sha256:
            raise ValueError(f"{target} was derived from other evaluations")
        return {**known.asDict(), "reused": True}
    plugins = registry or Registry()
    names = ("rigorous_report", "ablation_report")
    write_reports({n: plugins.evaluator(n, benchmark).run(evaluations) for n in names}, target)
    record = {"run_id": run_id, "evaluator_version": version, "source_sha256": source_sha256}
    # Written last: a version without it is incomplete and is not read.
    spark.createDataFrame([tuple(record.values())], list(record)).write.json(f"{target}/derivation")
    return {**record, "reused": False}


_LABELS = "map<string,string>"


def _gauge(name: str, value: Column, labels: dict[str, Column] | None = None, given: Column | None = None) -> Column:
    """One gauge of a row as a struct, null where ``given`` does not hold."""
    pairs = [part for key, column in (labels or {}).items() for part in (F.lit(key), column.cast("string"))]
    label_map = F.create_map(*pairs) if pairs else F.create_map().cast(_LABELS)
    gauge = F.struct(F.lit(name).alias("metric"), label_map.alias("labels"), value.cast("double").alias("value"))
    return gauge if given is None else F.when(given, gauge)


def _gauges(frame: DataFrame, *gauges: Column) -> DataFrame:
    """All gauges of a frame in one pass over it."""
    rows = frame.select("benchmark", "framework", F.explode(F.array_compact(F.array(*gauges))).alias("g"))
    return rows.select("benchmark", "framework", "g.*")


def metrics_table(
    runs: DataFrame,
    tokens: DataFrame,
    execution: DataFrame,
    stages: DataFrame,
    resources: DataFrame,
    results: DataFrame,
) -> DataFrame:
    """All 17 gauges of the latest runs as (benchmark, framework, metric, labels, value).

    ``runs``: latest runs with (items, units, current_activity, state, modified_at). The
    others carry (benchmark, framework) and: ``tokens`` (role, token_type, tokens),
    ``execution`` (seconds), ``stages`` (stage, seconds), ``resources`` (cpu_seconds,
    cpu_percent, peak_rss_bytes), ``results`` (evaluator, metric, value).
    """
    def count(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    active = F.col("current_activity").isNotNull()
    total = count("current_activity.total")
    done = capped_activity(F.col("current_activity.completed"), F.col("current_activity.total"))
    stage = {"stage": bounded_label(F.col("current_activity.stage"))}
    parts = [
        _gauges(
            runs,
            _gauge("expected_input_records", count("units.expected")),
            _gauge("completed_input_records", count("units.committed")),
            _gauge("expected_evaluation_items", count("items.expected")),
            _gauge("completed_evaluation_items", count("items.committed")),
            _gauge("progress_ratio", progress_ratio(F.col("items.committed"), F.col("items.expected"))),
            _gauge("current_activity_expected_items", total, stage, active),
            _gauge("current_activity_completed_items", done, stage, active),
            _gauge("current_activity_progress_ratio", progress_ratio(done, total), stage, active),
            _gauge("state", F.lit(1), {"state": F.coalesce("state", F.lit("UNKNOWN"))}),
            _gauge("last_update_timestamp_seconds", micros("modified_at") / 1e6),
        ),
        _gauges(tokens, _gauge("llm_tokens", F.col("tokens"), {"role": F.col("role"), "token_type": F.col("token_type")})),
        _gauges(execution, _gauge("execution_seconds", F.col("seconds"))),
        _gauges(stages, _gauge("pipeline_duration_seconds", F.col("seconds"), {"stage": F.col("stage")})),
        _gauges(
            resources,
            _gauge("process_cpu_seconds", F.col("cpu_seconds")),
            _gauge("average_cpu_percent", F.col("cpu_percent")),
            _gauge("peak_rss_bytes", F.col("peak_rss_bytes")),
        ),
        _gauges(results, _gauge("result", F.col("value"), {"evaluator": F.col("evaluator"), "metric": F.col("metric")})),
    ]
    return reduce(DataFrame.unionByName, parts)
