"""Exact cosine search in big units through pivots.

Records and queries of a unit go to the nearest of a few of its records, the pivots, and
every cluster is packed into blocks of bounded size, one row each, that know their radius:
the largest angle between the pivot and a member. Angles on the sphere obey the triangle
inequality, so no query of one block is nearer to a record of another than the angle of
their pivots less both radii. A first pass over one block of the own cluster gives each query
block the k-th score that it already has; from then on it meets only blocks that can still
reach that score. What travels for a pair of blocks is two rows, and pairs that cannot
matter are never formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

PIVOTS = 256  # of a unit, whatever its size
SLACK = 1e-6  # of an angle, far above the error of its arc cosine
ZERO = -1  # the cluster of vectors without a direction
SCORE_DIGITS = 9  # scores are rounded before ranking, so that equal scores tie the same way everywhere
BLOCK = "unit_id string, cluster int, part int, radius double, n int, ids array<string>, vectors binary"
FOUND = "unit_id string, qc int, qp int, query_id string, record_id string, score double"


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def cosines(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Cosine of every row of ``q`` with every row of ``r``; 0 where one has no length."""
    norms = np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(r, axis=1))
    return np.divide(q @ r.T, norms, out=np.zeros_like(norms), where=norms > 0)


def angles(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines(q, r), -1.0, 1.0))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the ``k`` best columns of each row, equal scores by id."""
    by_id = np.argsort(ids, kind="stable")
    scores = np.round(scores[:, by_id], SCORE_DIGITS)
    at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return ids[by_id][at], np.take_along_axis(scores, at, axis=1)


def _nearest(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    if rows.empty or pivots.empty:
        return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("unit_id", "id", "v", "cluster", "angle")})
    v = matrix(rows["v"])
    away = angles(v, matrix(pivots.sort_values("pivot")["v"]))
    cluster = away.argmin(axis=1)
    angle = away[np.arange(len(v)), cluster]
    none = ~(np.linalg.norm(v, axis=1) > 0)
    return pd.DataFrame(
        {
            "unit_id": rows["unit_id"], "id": rows["id"], "v": rows["v"],
            "cluster": np.where(none, ZERO, cluster).astype(np.int32), "angle": np.where(none, 0.0, angle),
        }
    )


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    first = rows.iloc[0]
    return pd.DataFrame(
        [(first["unit_id"], first["cluster"], first["part"], rows["angle"].max(), len(rows), rows["id"].tolist(), matrix(rows["v"]).tobytes())],
        columns=["unit_id", "cluster", "part", "radius", "n", "ids", "vectors"],
    )


def pivots_of(records: DataFrame, big: DataFrame, block_rows: int) -> DataFrame:
    """(unit_id, pivot, v): a bounded number of records of each big unit, chosen by hash."""
    order = Window.partitionBy("unit_id").orderBy(F.xxhash64("id"), "id")
    ranked = records.join(big, "unit_id").withColumn("pivot", F.row_number().over(order) - 1).filter(F.col("pivot") < PIVOTS)
    return materialize(ranked.filter(F.col("pivot") < F.ceil(F.col("records") / block_rows)).select("unit_id", "pivot", "v"), "pivots")


def blocks_of(rows: DataFrame, big: DataFrame, pivots: DataFrame, count: str, block_rows: int) -> DataFrame:
    """``rows`` (unit_id, id, v) of the big units as packed blocks of one cluster each."""
    cells = F.ceil(F.col(count) / block_rows).cast("int")
    dealt = rows.join(big.withColumn("cells", cells), "unit_id").select(
        "unit_id", "id", "v", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int").alias("cell")
    )
    copies = pivots.join(big.withColumn("cells", cells), "unit_id").select(
        F.col("unit_id"), "pivot", "v", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell")
    )
    placed = (
        dealt.groupBy("unit_id", "cell")
        .cogroup(copies.toDF(*copies.columns).groupBy("unit_id", "cell"))
        .applyInPandas(_nearest, "unit_id string, id string, v array<double>, cluster int, angle double")
    )
    placed = materialize(placed, "placed")
    sizes = placed.groupBy("unit_id", "cluster").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("parts"))
    parted = placed.join(sizes, ["unit_id", "cluster"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    return materialize(parted.groupBy("unit_id", "cluster", "part").applyInPandas(_packed, BLOCK), "blocks")


def scored(pairs: DataFrame, queries: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """The ``k`` best records of each query in each pair of blocks (unit_id, qc, qp, rc, rp, least), none below ``least``."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                q = np.frombuffer(row.q_vectors).reshape(row.q_n, -1)
                r = np.frombuffer(row.r_vectors).reshape(row.r_n, -1)
                ids, scores = best(cosines(q, r), np.array(row.r_ids, dtype=object), k)
                rows, columns = np.nonzero(scores >= row.least)
                yield pd.DataFrame(
                    {
                        "unit_id": row.unit_id, "qc": row.qc, "qp": row.qp,
                        "query_id": np.array(row.q_ids, dtype=object)[rows],
                        "record_id": ids[rows, columns], "score": scores[rows, columns],
                    }
                )

    def side(blocks: DataFrame, s: str) -> DataFrame:
        names = [F.col(c).alias(f"{s}_{c}") for c in ("n", "ids", "vectors")]
        return blocks.select("unit_id", F.col("cluster").alias(f"{s}c"), F.col("part").alias(f"{s}p"), *names)

    met = pairs.join(side(queries, "q"), ["unit_id", "qc", "qp"]).join(side(records, "r"), ["unit_id", "rc", "rp"])
    return met.mapInPandas(score, FOUND)


def first_pairs(queries: DataFrame, records: DataFrame) -> DataFrame:
    """One record block of the own cluster for each query block."""
    parts = records.groupBy("unit_id", "cluster").agg(F.count(F.lit(1)).alias("parts"))
    return queries.join(parts, ["unit_id", "cluster"]).select(
        "unit_id",
        F.col("cluster").alias("qc"),
        F.col("part").alias("qp"),
        F.col("cluster").alias("rc"),
        F.expr("cast(part % parts as int)").alias("rp"),
        F.lit(-2.0).alias("least"),
    )


def further_pairs(queries: DataFrame, records: DataFrame, pivots: DataFrame, first: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The other pairs of blocks in which a record can still be among the ``k`` best of a query."""

    def between(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pivot")
        v = matrix(rows["v"])
        at = np.indices((len(rows), len(rows)))
        return pd.DataFrame(
            {"unit_id": rows["unit_id"].iloc[0], "qc": at[0].ravel(), "rc": at[1].ravel(), "apart": angles(v, v).ravel()}
        )

    apart = pivots.groupBy("unit_id").applyInPandas(between, "unit_id string, qc int, rc int, apart double")
    reached = found.groupBy("unit_id", "qc", "qp", "query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(-2.0).alias("kth")
    )
    least = reached.groupBy("unit_id", "qc", "qp").agg(F.min("kth").alias("least"))
    q = queries.select("unit_id", F.col("cluster").alias("qc"), F.col("part").alias("qp"), F.col("radius").alias("q_radius"))
    r = records.select("unit_id", F.col("cluster").alias("rc"), F.col("part").alias("rp"), F.col("radius").alias("r_radius"))
    pairs = (
        q.join(least, ["unit_id", "qc", "qp"], "left")
        .withColumn("least", F.coalesce("least", F.lit(-2.0)))
        .join(r, "unit_id")
        .join(apart, ["unit_id", "qc", "rc"], "left")
    )
    # Vectors without a direction have no angle; their blocks are always met.
    nearest = F.greatest(F.coalesce("apart", F.lit(0.0)) - F.col("q_radius") - F.col("r_radius") - SLACK, F.lit(0.0))
    reach = pairs.filter(F.cos(nearest) >= F.col("least") - SLACK)
    done = first.select("unit_id", "qc", "qp", "rc", "rp")
    return reach.select("unit_id", "qc", "qp", "rc", "rp", "least").join(done, ["unit_id", "qc", "qp", "rc", "rp"], "left_anti")


def pivot_topk(queries: DataFrame, records: DataFrame, big: DataFrame, k: int, block_rows: int) -> DataFrame:
    """(unit_id, query_id, record_id, score) with at least the ``k`` best records of each query in the big units.

    ``queries`` and ``records`` are (unit_id, id, v); ``big`` is (unit_id, queries, records)
    with the row counts of each unit to be searched.
    """
    pivots = pivots_of(records, big, block_rows)
    q_blocks = blocks_of(queries, big, pivots, "queries", block_rows)
    r_blocks = blocks_of(records, big, pivots, "records", block_rows)
    first = first_pairs(q_blocks, r_blocks)
    found = materialize(scored(first, q_blocks, r_blocks, k), "found")
    more = scored(further_pairs(q_blocks, r_blocks, pivots, first, found, k), q_blocks, r_blocks, k)
    return found.unionByName(more).drop("qc", "qp")
