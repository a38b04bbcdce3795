"""Corpus preparation in five stages, each written as Parquet and read again by the next.

Quality classifier, near-duplicate removal, benchmark decontamination, pseudonyms, packing.
Stages 1 to 4 return the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import recollect  # noqa: E402
from recollect.llm import decontaminate, near_dedup, packing, pii, quality, queries  # noqa: E402
from recollect.llm.common import stage, table  # noqa: E402

cloudpickle.register_pickle_by_value(recollect)

NEAR_PERCENT = 80
SCORE, SPANS = "__quality_score", "__pii_spans"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the threshold, learned from the labels."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, to=SCORE).filter(F.col(SCORE) >= quality.THRESHOLD).drop(SCORE)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate class."""
    return near_dedup.keep_one(docs, NEAR_PERCENT)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in their texts; lengths do not change."""
    return pii.pseudonymize(docs, queries.PII_KEY, spans=SPANS).drop(SPANS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences."""
    return packing.pack(docs, queries.byte_bpe())


STAGES = [
    ("quality", good_quality),
    ("near_dedup", one_of_each),
    ("decontamination", uncontaminated),
    ("pii", pseudonymous),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of ``documents`` after all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
