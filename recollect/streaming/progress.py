"""Streaming counters, rates and live progress.

State is one row per label set (counters) or per label set and window (rates); how late rows
may come is for the caller to say. Results go through ``foreachBatch`` to a table keyed by the
batch, and :func:`latest_values` reads the newest value of every key, which is right also
when a batch is written twice after a restart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_counters(events: DataFrame, labels: dict[str, Column], value: Column, name: str) -> DataFrame:
    """Total of ``value`` per label set since the start of the stream (update mode)."""
    return events.groupBy(*[c.alias(n) for n, c in labels.items()]).agg(F.sum(value).alias(name))


def windowed_increase(
    events: DataFrame, labels: dict[str, Column], value: Column, window_seconds: int, lateness: str,
    time: str = "ts", name: str = "increase",
) -> DataFrame:
    """Sum of increments per window and label set; rate = increase / window length.

    Windows that end more than ``lateness`` before the newest row are closed: later rows of
    theirs are not counted (Spark reports their number as ``numRowsDroppedByWatermark``).
    """
    watermarked = events.withWatermark(time, lateness)
    windows = watermarked.groupBy(
        F.window(time, f"{window_seconds} seconds"), *[c.alias(n) for n, c in labels.items()]
    ).agg(F.sum(value).alias(name))
    return windows.select(
        F.unix_timestamp("window.start").alias("window_start"),
        *labels,
        name,
        (F.col(name) / window_seconds).alias("rate"),
    )


def live_commits(events: DataFrame, key: str) -> DataFrame:
    """Committed items per run so far (update mode)."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("committed"))


def write_updates(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start a query that appends every update with its ``batch_id`` to ``path``."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def latest_values(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest update of every key."""
    rows = spark.read.parquet(path).drop("batch")
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = F.max_by(F.struct(*values), "batch_id").alias("__v")
    return rows.groupBy(*keys).agg(newest).select(*keys, "__v.*")
