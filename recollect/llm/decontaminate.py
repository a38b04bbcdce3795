"""Benchmark decontamination: MinHash containment search, partitioned by item size.

Items are partitioned by their number of shingles. The sketch of an item is its ``k``
smallest shingle hashes (bottom-k MinHash), with ``k`` from the size partition so that an
item contained to ``threshold`` misses fewer than ``k`` shingles: at least one sketch hash
must then be among the document's, so the search loses nothing. The long documents need no
sketch of their own; a task tests all their shingle hashes against a bitmap of the sketches.
A document that hits sends its hashes that may belong to items, and an equi-join with the
items' shingles counts the exact containment.

The bitmaps are the only thing sent to all tasks: at most ``MAX_BITS`` bits each (16 MB), whatever
the number of items. More items only mean more false hits, which the join removes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordRolling, bitmap, bitmap_bits, by_bytes, set_in, stage, text_bytes, word_bounds

SHINGLE, SEED = 5, 1


def needed(n: int, threshold: float) -> int:
    """How many of ``n`` shingles are a containment of ``threshold``."""
    return max(1, math.ceil(Fraction(str(threshold)) * n))


def sketch_size(n: int, threshold: float) -> int:
    """Of the size partition of ``n`` (up to the next power of two): one more than its largest item may miss."""
    largest = 1 << (n - 1).bit_length()
    return min(n, largest - needed(largest, threshold) + 1)


def _hashes(rolling: WordRolling, words: list[bytes], widths: list[int]) -> np.ndarray:
    """Distinct hashes of the runs of each width."""
    if not words:
        return np.zeros(0, np.uint64)
    prefix = rolling.prefix(*word_bounds(words))
    runs = [rolling.runs(prefix, w) for w in widths if w <= len(words)]
    return np.unique(np.concatenate(runs)) if runs else np.zeros(0, np.uint64)


def item_shingles(items: DataFrame, threshold: float) -> DataFrame:
    """(item_row, item_id, width, n, hash, in_sketch), a row per distinct shingle of each item."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = WordRolling(SEED)
        for batch in batches:
            rows = []
            for row, item_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = text_bytes(text).lower().split()
                width = min(SHINGLE, len(words))
                hashes = _hashes(rolling, words, [width])
                k = sketch_size(len(hashes), threshold) if len(hashes) else 0
                rows += [(row, item_id, width, len(hashes), int(h), i < k) for i, h in enumerate(hashes.view(np.int64))]
            names = ["item_row", "item_id", "width", "n", "hash", "in_sketch"]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    schema = "item_row long, item_id long, width int, n long, hash long, in_sketch boolean"
    numbered = items.select(F.monotonically_increasing_id().alias("item_row"), F.col("item_id").cast("long"), "text")
    return numbered.mapInArrow(shingles, schema)


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_shared, containment`` where containment reaches ``threshold``.

    Words are lower-cased (A-Z); shingles are runs of five words, of an item with fewer the
    whole sequence, which a document contains where the same words follow each other. Null
    and empty texts contain nothing and are contained in nothing. Repeated documents and
    items each have their rows; null ids stay null. Other columns are not carried.
    """
    parts = stage(item_shingles(items, threshold), "items")
    shape = parts.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("width")).alias("widths")).first()
    bits = bitmap_bits(64 * shape["n"])
    sketches, shingles = bitmap(parts.filter("in_sketch"), bits), bitmap(parts, bits)
    widths = list(shape["widths"])

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = WordRolling(SEED)
        for batch in batches:
            rows, ids, found = [], [], []
            for i, (row, doc_id) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                hashes = _hashes(rolling, text_bytes(batch.column(2)[i].as_py()).lower().split(), widths)
                if len(hashes) and set_in(sketches, hashes).any():
                    hashes = hashes[set_in(shingles, hashes)]
                    rows += [row] * len(hashes)
                    ids += [doc_id] * len(hashes)
                    found.append(hashes.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))],
                ["row", "doc_id", "hash"],
            )

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    found = by_bytes(numbered).mapInArrow(hits, "row long, doc_id long, hash long")
    counted = (
        found.join(parts.withColumn("item", F.struct("item_row", "item_id", "n")), "hash")
        .groupBy("row", "doc_id", "item")
        .agg(F.count("*").alias("n_shared"), F.max("in_sketch").alias("candidate"))
    )
    n, shared = F.col("item.n"), F.col("n_shared")
    top, bottom = Fraction(str(threshold)).as_integer_ratio()
    return counted.filter(F.col("candidate") & (shared * bottom >= n * top)).select(
        "doc_id", F.col("item.item_id").alias("item_id"), n.alias("n_shingles"), shared, (shared / n).alias("containment")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` without those that contain an item; rows that share an id go together."""
    bad = contained_items(docs, items, threshold).select(F.col("doc_id").alias("__bad_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("__bad_id")), "left_anti")
