"""All registered queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dataset, evaluation, retrieval, runs, telemetry

_MODULES = (evaluation, dataset, retrieval, runs, telemetry)


def _in_utc(fn):
    """All dates of the datasets are UTC."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _in_utc(fn) for module in _MODULES for name, fn in module.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: text for module in _MODULES for name, text in module.ORACLES.items()}
