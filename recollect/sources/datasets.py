"""Readers of the two datasets, the registry of pinned sources, and the pin check.

The published files are one JSON array each, which many tasks read (``layout='array'``,
``json_array``). Data may also come as JSON lines that carry their own position
(``layout='lines'``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S
from .json_array import array_records
from .run_folder import file_system

WHOLE_BYTES = 256 << 20
BLOCK_BYTES = 8 << 20

# The published sources and their pins.
PINNED_DATASETS = (
    {
        "dataset_id": "locomo-official-v1",
        "benchmark": "locomo",
        "source_url": "https://raw.githubusercontent.com/snap-research/locomo/3eb6f2c585f5e1699204e3c3bdf7adc5c28cb376/data/locomo10.json",
        "revision": "3eb6f2c585f5e1699204e3c3bdf7adc5c28cb376",
        "sha256": "79fa87e90f04081343b8c8debecb80a9a6842b76a7aa537dc9fdf651ea698ff4",
        "filename": "locomo10.json",
        "expected_schema": "locomo10-json-array-v1",
    },
    {
        "dataset_id": "longmemeval-s-official-v1",
        "benchmark": "longmemeval",
        "source_url": "https://huggingface.co/datasets/xiaowu0162/longmemeval-cleaned/resolve/98d7416c24c778c2fee6e6f3006e7a073259d48f/longmemeval_s_cleaned.json",
        "revision": "98d7416c24c778c2fee6e6f3006e7a073259d48f",
        "sha256": "d6f21ea9d60a0d56f34a05b609c79c88a451d2ae03597821ea3d5a9678c3a442",
        "filename": "longmemeval_s_cleaned.json",
        "expected_schema": "longmemeval-cleaned-json-array-v1",
    },
)


def _array_items(spark: SparkSession, path: str, item: str, position: str) -> DataFrame:
    """(position, item, path) of files whose root is a JSON array; positions count inside a file."""
    records = array_records(spark, path)
    return records.select(F.col("position").cast("long").alias(position), F.from_json("value", item).alias("item"), "path")


def _line_items(spark: SparkSession, path: str, item: str, position: str) -> DataFrame:
    """(position, item, path) of JSON lines that state their own position."""
    lines = spark.read.text(path)
    at = F.get_json_object("value", f"$.{position}").cast("long")
    return lines.select(at.alias(position), F.from_json("value", item).alias("item"), F.col("_metadata.file_path").alias("path"))


def _items(spark, path, item, position, layout) -> DataFrame:
    if layout not in ("array", "lines"):
        raise ValueError(f"layout must be 'array' or 'lines', not {layout!r}")
    read = _array_items if layout == "array" else _line_items
    return read(spark, path, item, position)


def read_locomo(spark: SparkSession, path: str, layout: str = "lines", source: str | None = None) -> DataFrame:
    """(conversation_idx, conversation map, qa array); the map keeps the dynamic session keys.

    ``source`` names a further column for the path of the file, as positions of arrays count inside it.
    """
    rows = _items(spark, path, S.CONVERSATION, "conversation_idx", layout)
    valid = F.col("item.conversation").isNotNull() & F.col("item.qa").isNotNull()
    checked = F.when(valid, F.col("item")).otherwise(
        F.raise_error(F.lit("a conversation needs a conversation object and a qa list")).cast(S.CONVERSATION)
    )
    named = [F.col("path").alias(source)] if source else []
    return rows.withColumn("item", checked).select("conversation_idx", "item.*", *named)


def read_longmemeval(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """(question_pos, question fields and haystack arrays)."""
    rows = _items(spark, path, S.QUESTION, "question_pos", layout)
    return rows.select("question_pos", "item.*")


def dataset_registry(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Pinned sources, one row each; a repeated ``dataset_id`` is an error."""
    if path is None:
        columns = list(PINNED_DATASETS[0])
        rows = [tuple(d[c] for c in columns) for d in PINNED_DATASETS]
        registry = spark.createDataFrame(rows, S.REGISTRY_FIELDS)
    else:
        document = spark.read.text(path, wholetext=True)
        parsed = F.from_json("value", f"datasets array<struct<{S.REGISTRY_FIELDS.replace(' string', ':string')}>>")
        registry = document.select(F.explode(parsed["datasets"]).alias("d")).select("d.*")
    repeated = registry.groupBy("dataset_id").count().filter("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"duplicate dataset_id in registry: {repeated[0]['dataset_id']}")
    return registry.withColumn("pinned", F.coalesce("sha256", F.lit("")) != "")


def _streamed_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of files that are read block by block."""
    for batch in batches:
        digests = []
        for path in batch["path"]:
            system, name = file_system(path)
            digest = hashlib.sha256()
            with system.open_input_stream(name) as stream:
                while block := stream.read(BLOCK_BYTES):
                    digest.update(block)
            digests.append(digest.hexdigest())
        yield pd.DataFrame({"path": batch["path"], "sha256": digests, "bytes": batch["length"]})


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, sha256, bytes) of files, hashed where they are read.

    Spark reads files up to ``WHOLE_BYTES`` as values. Larger ones, which no value can hold, are
    read block by block, for which tasks must reach them as files. Spark lists no empty files,
    so these have no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    whole = files.filter(F.col("length") <= WHOLE_BYTES).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    large = files.filter(F.col("length") > WHOLE_BYTES).select("path", "length")
    found = whole.unionByName(large.mapInPandas(_streamed_digests, "path string, sha256 string, bytes long"))
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "sha256", "bytes")


def verify_pinned(spark: SparkSession, path: str, registry: DataFrame) -> DataFrame:
    """Files whose bytes do not have the pinned digest of their file name."""
    pins = registry.filter("pinned").select("dataset_id", "filename", F.col("sha256").alias("expected_sha256"))
    return file_digests(spark, path).join(pins, "filename").filter("sha256 <> expected_sha256")
