"""Exact top-k by inner product with MaxScore over vector components.

Components are the terms, a shard's column of a component is its posting list. A term's
contribution to a score, moved to start at zero, is bounded by ``|q| * (max - min)`` over
the shard. A few terms with the largest bounds give leaders, and the k-th best exact score
of those is the threshold. Essential are the fewest terms, largest bounds first, without
which no vector can reach the threshold: their postings are traversed for all vectors. The
non-essential terms are probed in groups, only for vectors whose partial score plus the
bounds of the terms left is still competitive. Shards give their k best, and the shards'
lists are merged by rank.

Sums of products of doubles are exact up to 2^53. Vectors with components too large for that
are scored in whole numbers of any size: doubles with a bound on their error leave out what
cannot be among the k best.

Queries and candidates meet in blocks: candidates are cut into shards, queries into blocks,
and a task holds one shard and one block.
"""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

PROBE = 8  # terms traversed for the leaders, and non-essential terms probed at a time
SHARD_BYTES = 32 << 20  # of a shard's components
SMALL_SHARD = 2048  # rows; smaller shards do not pay for their queries
MOST, LEAST = (1 << 63) - 1, -(1 << 63)
FOUND = "query_id long, vec_id long, score long, beyond binary"


def whole_vectors(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v array<double>): ``floor(scale * x) / scale`` of each component, one row per id.

    ``scale`` is a power of two, so that the quotient is exact for every finite component.
    Null ids and vectors, and vectors with a null or non-finite component take no part. Of
    rows that repeat an id, the largest vector counts.
    """
    if scale < 1 or scale & (scale - 1):
        raise ValueError("the scale must be a power of two")
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # From 2^53 / scale on, a double is a multiple of 1 / scale already.
    v = F.transform(
        "x", lambda c: F.when(F.abs(c) < float(1 << 53) / scale, F.floor(c * scale) / F.lit(float(scale))).otherwise(c)
    )
    return (
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"), fine.alias("fine"))
        .filter("vec_id is not null and fine")
        .select("vec_id", v.alias("v"))
        .groupBy("vec_id")
        .agg(F.max("v").alias("v"))
    )


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of equal width; missing components are 0."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    offsets, flat = np.asarray(lists.offsets), np.asarray(lists.values, dtype=np.float64)
    out = np.zeros((len(offsets) - 1, width))
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)] = flat[offsets[0] : offsets[-1]]
    return out


def _width(lists: pa.ChunkedArray) -> int:
    return max((len(x) for x in lists), default=0)


def _integer(x: float, scale: int) -> int:
    """``x * scale``, which is whole, also where the product is beyond doubles."""
    return int(x * scale) if abs(x) < 1 << 53 else int(x) * scale


def _beyond(score: int) -> bytes:
    """Bytes that order scores with one and the same value after cutting to 64 bits."""
    if LEAST <= score <= MOST:
        return b"\x01"
    size = abs(score)
    body = size.bit_length().to_bytes(2, "big") + size.to_bytes((size.bit_length() + 7) // 8, "big")
    return b"\x02" + body if score > 0 else b"\x00" + bytes(255 - b for b in body)


def _scaled(values: np.ndarray) -> tuple[np.ndarray, int]:
    """``values`` times a power of two that leaves none above 1."""
    exponent = int(np.frexp(np.abs(values).max(initial=0))[1])
    return np.ldexp(values, -exponent), exponent


class Shard:
    """A shard's vectors with the bounds of each component.

    ``vectors`` are whole after multiplication by ``scale``; the rows whose products with a
    query of the same kind sum exactly in doubles are ``plain``, the others ``wide``.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, scale: int = 1) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.scale = ids[order], vectors[order], scale
        self.width = vectors.shape[1]
        self.limit = math.isqrt((1 << 53) // max(1, self.width)) / scale
        fits = np.abs(self.vectors).max(1, initial=0) < self.limit
        self.plain, self.wide = np.flatnonzero(fits), np.flatnonzero(~fits)
        self.rows = self.vectors[self.plain] * scale
        self.columns = np.ascontiguousarray(self.rows.T)
        self.high, self.low = self.rows.max(0, initial=-math.inf), self.rows.min(0, initial=math.inf)

    def search(self, query_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best, ties to smaller ids; without ``query_id``."""
        if np.abs(q).max(initial=0) < self.limit:
            found = self._plain(query_id, q * self.scale, k) + self._wide(self.wide, query_id, q, k)
        else:
            found = self._wide(np.arange(len(self.ids)), query_id, q, k)
        return sorted(found, key=lambda f: (-f[0], f[1]))[:k]

    def _plain(self, query_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        others = np.flatnonzero(self.ids[self.plain] != query_id)
        width = self.width
        if len(others) <= 4 * k or not width:
            return self._best(others, self.rows[others] @ q, k)
        spread = np.abs(q) * (self.high - self.low)
        terms = np.argsort(-spread, kind="stable")
        base = np.minimum(q * self.high, q * self.low)[terms]
        left = np.append(np.cumsum(spread[terms][::-1])[::-1], 0)  # bounds of the terms from a place on
        q = q[terms]
        # leaders by the first terms, and the threshold that they set
        done = min(PROBE, width)
        partial = q[:done] @ self.columns[terms[:done]]
        leaders = others[np.argpartition(-partial[others], 4 * k)[: 4 * k]]
        threshold = np.partition(self.rows[leaders] @ self._spread_back(q, terms), -k)[-k]
        # essential: without them a vector has at most the bounds of the rest
        essential = np.count_nonzero(base.sum() + left >= threshold)
        essential = min(width, max(done, essential))
        partial += q[done:essential] @ self.columns[terms[done:essential]]
        offset, done = base[essential:].sum(), essential
        alive, partial = others, partial[others]
        while True:
            keep = partial + offset + left[done] >= threshold
            alive, partial = alive[keep], partial[keep]
            if done >= width:
                return self._best(alive, partial, k)
            more = slice(done, min(done + PROBE, width))
            partial = partial + q[more] @ self.columns[np.ix_(terms[more], alive)]
            offset -= base[more].sum()
            done = more.stop

    @staticmethod
    def _spread_back(q: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """The query in the order of its components."""
        out = np.empty_like(q)
        out[terms] = q
        return out

    def _best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
        best = np.lexsort((rows, -scores))[:k]  # ids are sorted, so row order is id order
        return [(int(s), int(i)) for s, i in zip(scores[best], self.ids[self.plain[rows[best]]])]

    @cached_property
    def _estimates(self) -> np.ndarray:
        return _scaled(self.vectors)[0]

    def _wide(self, rows: np.ndarray, query_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        rows = rows[self.ids[rows] != query_id]
        if len(rows) > k:
            near, asked = self._estimates[rows], _scaled(q)[0]
            score = near @ asked
            error = (np.abs(near) @ np.abs(asked)) * (self.width * 2.0**-50) + self.width * 2.0**-1070
            rows = rows[score + error >= np.partition(score - error, -k)[-k]]
        terms = np.flatnonzero(q)
        asked = [_integer(x, self.scale) for x in q[terms].tolist()]
        return [
            (sum(a * _integer(x, self.scale) for a, x in zip(asked, v)), int(i))
            for i, v in zip(self.ids[rows], self.vectors[np.ix_(rows, terms)].tolist())
        ]


def top_k(
    candidates: DataFrame,
    queries: DataFrame,
    k: int = 10,
    scale: int = 1,
    shard_rows: int | None = None,
    block_rows: int = 4096,
) -> DataFrame:
    """The ``k`` best of ``candidates`` for each of ``queries``, both (vec_id long, v array<double>) with unique ids.

    Components are whole after multiplication by ``scale``, and so is ``score``, the inner
    product of those. A score beyond 64 bits is ranked by its true value and shown as the
    nearest 64-bit number. Returns ``query_id, rank, vec_id, score``; ties go to the smaller
    id, and a query's own id is left out. Vectors of other lengths count as filled with
    zeros. With fewer candidates all are returned; empty tables give no rows.

    A shard has ``shard_rows`` rows; by default ``SHARD_BYTES`` of components, or fewer where
    that leaves cores without one.
    """
    size = candidates.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    if shard_rows is None:
        cores = candidates.sparkSession.sparkContext.defaultParallelism
        largest = max(SMALL_SHARD, SHARD_BYTES // (8 * max(1, size["width"] or 0)))
        shard_rows = min(largest, max(SMALL_SHARD, math.ceil(size["n"] / cores)))
    shards = max(1, math.ceil(size["n"] / shard_rows))
    blocks = max(1, math.ceil(queries.count() / block_rows))
    left = candidates.select(
        "vec_id", "v", F.expr(f"pmod(xxhash64(vec_id), {shards})").alias("shard"),
        F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"),
    )
    right = queries.select(
        "vec_id", "v", F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("shard"),
        F.expr(f"pmod(xxhash64(vec_id), {blocks})").alias("block"),
    )

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and asked.num_rows:
            width = max(_width(rows["v"]), _width(asked["v"]))
            shard = Shard(np.asarray(rows["vec_id"]), _matrix(rows["v"], width), scale)
            for query_id, q in zip(asked["vec_id"].to_pylist(), _matrix(asked["v"], width)):
                for score, vec_id in shard.search(query_id, q, k):
                    out.append((query_id, vec_id, max(LEAST, min(MOST, score)), _beyond(score)))
        query_ids, vec_ids, scores, beyond = zip(*out) if out else ((), (), (), ())
        return pa.table({
            "query_id": pa.array(query_ids, pa.int64()), "vec_id": pa.array(vec_ids, pa.int64()),
            "score": pa.array(scores, pa.int64()), "beyond": pa.array(beyond, pa.binary()),
        })

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(search, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def search_table(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024, k: int = 10, every: int = 100
) -> DataFrame:
    """``top_k`` of all vectors for the queries whose id is divisible by ``every``.

    ``score`` is the inner product of ``floor(scale * x)`` of the components.
    """
    rows = stage(whole_vectors(vectors, vec_id, vector, scale), "vectors")
    return top_k(rows, rows.filter(F.col("vec_id") % every == 0), k, scale)
