"""Document quality by Bradley-Terry ranking.

A document's strength is a linear score of features of its text. Pairs of a good and a bad
labelled document say which one wins; logistic loss on the differences of their features
gives the weights (Newton steps with a ridge). The cut is the quantile of the training
scores at the share of bad labels, and ``score`` is the logistic of the distance to the cut,
moved so that the cut is at ``THRESHOLD``.

The fit covers every pair of all labelled rows, without forming them. What a pair adds depends
on the difference of its scores by a smooth function, which Chebyshev interpolation gives to
double precision. So tasks sum the rows of each unit of score at ``NODES`` points, and pairs
meet as pairs of points. The cut is an exact order statistic of all training scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, stage, text_bytes

THRESHOLD = 0.7
NODES = 14  # points in a unit of score
CELL_SUMS = "good boolean, cell long, sums binary"
QUANTILE_ROWS = 100_000  # scores that are sorted in one place
QUANTILE_BINS = 4096
DIGITS = 12  # kept of fitted values, so that the order of sums does not show
SEGMENT = 200  # words in which repeats are counted, so that long texts compare with short ones
NAMES = ("words", "distinct", "repeat", "upper", "shouted", "symbols", "marked", "digits", "word_length", "lines", "same_lines")


def features(text: str | None) -> np.ndarray:
    """Features of the whole text; an empty one has zeros."""
    data = text_bytes(text)
    words = data.split()
    if not words:
        return np.zeros(len(NAMES))
    n, counts = len(words), np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    distinct = most = shouted = 0
    for at in range(0, n, SEGMENT):
        seen = Counter(words[at : at + SEGMENT])
        distinct += len(seen)
        most += max(seen.values())
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    shouted = sum(map(bytes.isupper, words))
    letters = upper + lower + counts[128:].sum() / 2
    digits = counts[48:58].sum()
    usual = counts[[9, 10, 13, 32, 39, 44, 45, 46]].sum()
    symbols = max(0, counts[:128].sum() - upper - lower - digits - usual)
    lines = data.split(b"\n")
    return np.array(
        [
            np.log1p(n),
            distinct / n,
            most / n,
            upper / max(letters, 1),
            shouted / n,
            np.log1p(20 * symbols / n),
            symbols / len(data),
            digits / len(data),
            np.log(letters / n + 1),
            len(lines) / n,
            1 - len(set(lines)) / len(lines),
        ]
    )


@dataclass(frozen=True)
class Model:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    cut: float
    width: float

    def score(self, x: np.ndarray) -> np.ndarray:
        s = ((x - np.array(self.mean)) / np.array(self.scale)) @ np.array(self.weights)
        z = (s - self.cut) / self.width + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


EVEN = Model((0.0,) * len(NAMES), (1.0,) * len(NAMES), (0.0,) * len(NAMES), -30.0, 1.0)


def _rounded(values) -> np.ndarray:
    return np.array([float(f"{v:.{DIGITS}g}") for v in values])


def _points() -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(NODES) + 1) / (2 * NODES))


def cell_sums(z: np.ndarray, s: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(cell, sums) of rows ``z`` by their scores ``s``: at each point of the cell the sums of 1, z and z z'.

    A row counts at a point by the interpolation weight of its score.
    """
    spread = np.polynomial.chebyshev.chebvander(_points(), NODES - 1).T * (2 / NODES)
    spread[0] /= 2
    cells = np.floor(s + 0.5)
    order = np.argsort(cells, kind="stable")
    for me in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
        if not len(me):
            continue
        cell = cells[me[0]]
        weights = np.polynomial.chebyshev.chebvander(2 * (s[me] - cell), NODES - 1) @ spread
        square = (z[me, :, None] * z[me, None, :]).reshape(len(me), -1)
        yield int(cell), weights.T @ np.hstack([np.ones((len(me), 1)), z[me], square])


def pair_sums(good: dict[int, np.ndarray], bad: dict[int, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the logistic loss, summed over all pairs of a good and a bad row, from ``cell_sums``."""
    gradient, hessian = np.zeros(width), np.zeros((width, width))
    points = _points() / 2
    losers = np.concatenate([c + points for c in sorted(bad)])
    held = np.concatenate([bad[c] for c in sorted(bad)])
    for cell in sorted(good):
        ones, firsts, seconds = np.split(good[cell], [1, 1 + width], axis=1)
        p = 1 / (1 + np.exp(np.clip(cell + points[:, None] - losers, -700, 700)))
        flat = p @ held[:, : 1 + width]
        gradient += firsts.T @ flat[:, 0] - flat[:, 1:].T @ ones[:, 0]
        curved = (p * (1 - p)) @ held
        mixed = firsts.T @ curved[:, 1 : 1 + width]
        whole = seconds.T @ curved[:, 0] + curved[:, 1 + width :].T @ ones[:, 0]
        hessian += whole.reshape(width, width) - mixed - mixed.T
    return gradient, hessian


def _strengths(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    z = (x - mean) / scale
    return z, z @ w


def _rows_of(column) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _all_sums(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> dict[bool, dict[int, np.ndarray]]:
    """``cell_sums`` of the good and of the bad rows; a cell's sums come to the driver, not its rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bool, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z, s = _strengths(_rows_of(batch.column(0)), mean, scale, w)
            flags = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            for flag in (False, True):
                for cell, sums in cell_sums(z[flags == flag], s[flags == flag]):
                    held[flag, cell] = held.get((flag, cell), 0) + sums
        columns = [k[0] for k in held], [k[1] for k in held], [v.tobytes() for v in held.values()]
        types = pa.bool_(), pa.int64(), pa.binary()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["good", "cell", "sums"])

    def total(table: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(b) for b in table["sums"].to_pylist())
        return table.slice(0, 1).set_column(2, "sums", pa.array([whole.tobytes()], pa.binary()))

    found: dict[bool, dict[int, np.ndarray]] = {False: {}, True: {}}
    summed = rows.select("x", "good").mapInArrow(partial, CELL_SUMS).groupBy("good", "cell").applyInArrow(total, CELL_SUMS)
    for row in summed.collect():
        found[row["good"]][row["cell"]] = np.frombuffer(row["sums"]).reshape(NODES, -1)
    return found


def quantile(scores: DataFrame, share: float) -> float:
    """The exact quantile of column ``s`` (linear between neighbours), narrowed down by counts of value ranges."""
    low, high, n = scores.agg(F.min("s"), F.max("s"), F.count("s")).first()
    at = (n - 1) * share
    first, part = int(at), at - int(at)
    while n > QUANTILE_ROWS and low < high:
        bin_ = F.least(F.floor((F.col("s") - low) / (high - low) * QUANTILE_BINS), F.lit(QUANTILE_BINS - 1))
        bins = scores.groupBy(bin_.alias("bin")).agg(F.count("s").alias("n"), F.min("s").alias("low"), F.max("s").alias("high"))
        bins = sorted(bins.collect())
        while first >= bins[0]["n"]:
            first -= bins.pop(0)["n"]
        if first + 1 == bins[0]["n"]:  # the last of its range; the next one is the first of the next range
            after = bins[1]["low"] if len(bins) > 1 else bins[0]["high"]
            return bins[0]["high"] + part * (after - bins[0]["high"])
        _, n, low, high = bins[0]
        scores = scores.filter(F.col("s").between(low, high))
    if low == high:
        return low
    values = sorted(r["s"] for r in scores.select("s").collect())
    after = values[min(first + 1, n - 1)]
    return values[first] + part * (after - values[first])


def fit_pairs(rows: DataFrame, ridge: float = 1e-3, steps: int = 30) -> Model:
    """The model of ``rows`` (x array of features, good boolean) whose good ones win against the others, from all pairs.

    Without rows of both kinds there is nothing to learn and all texts score high.
    """
    width = len(NAMES)
    spread = [f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(width)]
    n, good, *stats = rows.agg(F.count("x"), F.count_if("good"), *spread).first()
    if good in (0, n):
        return EVEN
    mean, scale = _rounded(stats[:width]), _rounded(np.array(stats[width:]) + 1e-6)
    pairs = good * (n - good)
    w = np.zeros(width)
    for _ in range(steps):
        sums = _all_sums(rows, mean, scale, w)
        gradient, hessian = pair_sums(sums[True], sums[False], width)
        step = np.linalg.solve(hessian / pairs + ridge * np.eye(width), gradient / pairs - ridge * w)
        w += step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
        if np.abs(step).max() < 1e-8:
            break
    w = _rounded(w)

    @F.pandas_udf("double")
    def strength(x: pd.Series) -> pd.Series:
        return pd.Series(_strengths(np.stack(x.to_list()), mean, scale, w)[1])

    scores = stage(rows.select(strength("x").alias("s")), "quality-scores")
    spread = scores.agg(F.stddev_pop("s")).first()[0]
    cut = quantile(scores, 1 - good / n)
    return Model(*(tuple(map(float, v)) for v in (mean, scale, w)), float(cut), float(_rounded([spread / 4 + 1e-9])[0]))


def features_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def make(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    return make(text)


def score_column(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def make(texts: pd.Series) -> pd.Series:
        rows = np.array([features(t) for t in texts]).reshape(-1, len(NAMES))
        return pd.Series(model.score(rows))

    return make(text)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int | None = None) -> Model:
    """Learns from ``labels`` (doc_id, quality 0 or 1) joined to ``docs`` (doc_id, text).

    All labelled rows are used, or the first ``max_rows`` ids by a hash of the id. Null ids and
    labels teach nothing; of repeated labels the smallest counts.
    """
    chosen = (
        labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    )
    if max_rows is not None:
        chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # Features are shuffled to their labels, not texts.
    known = by_bytes(docs).select("doc_id", features_column(F.col("text")).alias("x"))
    rows = known.join(chosen, "doc_id").select("x", (F.col("quality") == 1).alias("good"))
    return fit_pairs(stage(rows, "quality-rows"))


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with ``to``, 0 to 1; null and empty texts have a score too. A column of that name is replaced."""
    return by_bytes(docs).withColumn(to, score_column(model, F.col(text)))
