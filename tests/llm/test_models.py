"""Search, language model, classifier and the pipeline."""

import math
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import maxscore, ppm, quality
from recollect.llm.queries import op10_quality

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("spread", [1.0, 0.0])
def test_top_k_equals_brute_force(spark, spread):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(700, 24)) * spread
    data[100:160] = data[7]
    rows = [(int(i) - 100, v.tolist()) for i, v in enumerate(data)]
    rows += [(5000, None), (5100, [1.0, None]), (5200, [float("nan")] * 24), (5300, [float("inf")] * 24), (None, [1.0] * 24), (5400, [0.5])]
    got = maxscore.search_table(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    good = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = set()
    for q in (i for i in good if i % 100 == 0):
        scores = sorted((-sum(a * b for a, b in zip(good[q], good[c])), c) for c in good if c != q)[:10]
        want |= {(q, r, c, -s) for r, (s, c) in enumerate(scores, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_large_components_and_few_candidates(spark):
    rows = [(100, [60000.5] * 40), (200, [-60000.0] * 40), (300, []), (100, [1.0])]
    got = {tuple(r) for r in maxscore.search_table(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    big = sum(math.floor(1024 * 60000.5) * -60000 * 1024 for _ in range(40))
    assert got == {(100, 1, 300, 0), (100, 2, 200, big), (200, 1, 300, 0), (200, 2, 100, big), (300, 1, 100, 0), (300, 2, 200, 0)}
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert maxscore.search_table(empty).count() == 0


@pytest.mark.parametrize("shard_rows", [None, 60])
def test_components_of_any_size(spark, shard_rows):
    """Vectors of all magnitudes in one table; scores beyond 64 bits are cut when shown, not when ranked."""
    rng = np.random.default_rng(8)
    data = rng.normal(size=(400, 12))
    data[::3] *= 10.0 ** rng.integers(0, 14, size=(134, 1))
    data[1::7] *= 10.0 ** rng.integers(100, 280, size=(57, 12))
    data[5], data[6], data[200], data[300] = 1.7e308, -1.7e308, 1.7e308, 70000.0
    data[50:60] = data[8]
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    vectors = maxscore.whole_vectors(spark.createDataFrame(rows, "vec_id long, x array<double>"), "vec_id", "x", 1024)
    some = vectors.filter("vec_id % 20 = 0 or vec_id in (5, 6, 8, 9)")
    got = {tuple(r) for r in maxscore.top_k(vectors, some, 10, 1024, shard_rows).collect()}
    whole = {i: [math.floor(1024 * Fraction(x)) for x in v] for i, v in rows}
    want = set()
    for q in (i for i in whole if i % 20 == 0 or i in (5, 6, 8, 9)):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q)[:10]
        want |= {(q, r, c, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, c) in enumerate(scores, 1)}
    assert got == want


def test_the_scale_is_a_power_of_two(spark):
    with pytest.raises(ValueError):
        maxscore.whole_vectors(spark.range(1).selectExpr("id", "array(1d) as x"), "id", "x", 1000)


def brute_ppm(rows, learned, order):
    words = [(t or "").encode().lower().split() for t in rows]
    coded = [[0] * order + [b + 1 for b in b" ".join(w)] + [257] for w in words]
    counts = defaultdict(Counter)
    for s, use in zip(coded, learned):
        for j in range(order, len(s)) if use else ():
            for k in range(order + 1):
                counts[tuple(s[j - k : j])][s[j]] += 1
    out = []
    for s in coded:
        total = 0.0
        for j in range(order, len(s)):
            gone: set = set()
            for k in range(order, -1, -1):
                here = {x: n for x, n in counts.get(tuple(s[j - k : j]), {}).items() if x not in gone}
                if not here:
                    continue
                if s[j] in here:
                    total += math.log10((here[s[j]] - 0.5) / sum(here.values()))
                    break
                total += math.log10(0.5 * len(here) / sum(here.values()))
                gone |= set(here)
            else:
                total -= math.log10(257 - len(gone))
        out.append(total)
    tokens = Counter(x for w, use in zip(words, learned) if use for x in [*w, "end"])
    n, v = sum(tokens.values()), len(tokens)
    base = [sum(math.log10((tokens[x] + 1) / (n + v + 1)) for x in [*w, "end"]) for w in words]
    known = [sum(tokens[x] > 0 for x in [*w, "end"]) for w in words]
    return out, base, known, n


@pytest.mark.parametrize("order,chunk", [(5, 1 << 20), (2, 900)])
def test_ppm_equals_brute_force(spark, awkward, awkward_rows, order, chunk):
    got = {r.doc_id: r for r in ppm.score(awkward, "doc_id % 30 <> 0", order, chunk).collect()}
    learned = [r[0] % 30 != 0 for r in awkward_rows]
    scores, base, known, n = brute_ppm([r[1] for r in awkward_rows], learned, order)
    for (doc_id, *_), use, s, b, k in zip(awkward_rows, learned, scores, base, known):
        r = got[doc_id]
        assert (r.learned, r.n_known, r.train_tokens) == (use, k, n)
        assert r.score == pytest.approx(s, rel=1e-9) and r.base_score == pytest.approx(b, rel=1e-9)


def test_ppm_without_anything_to_learn(awkward, unnamed, empty_docs):
    rows = ppm.score(awkward, "false").collect()
    assert len(rows) == awkward.count() and all(r.base_score == 0 and r.n_known == 0 for r in rows)
    assert all(r.score == pytest.approx(-math.log10(257) * n) for r in rows for n in [round(-r.score / math.log10(257))])
    assert ppm.score(unnamed, "doc_id > 7").count() == unnamed.count()
    assert ppm.score(empty_docs, "true").count() == 0


def test_quality_on_held_out_labels(spark):
    scored = op10_quality(spark, SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality")
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.97


def test_quality_takes_awkward_rows(spark, awkward, unnamed, empty_docs):
    labels = spark.createDataFrame([(-40, 1), (-40, 0), (None, 1), (110, 1), (170, None), (70, 0), (0, 7)], "doc_id long, quality int")
    model = quality.fit(awkward, labels)
    got = quality.score(awkward, model, to="score")
    assert got.columns == awkward.columns and got.filter("score between 0 and 1").count() == awkward.count()
    for rows in (labels.limit(0), labels.filter("quality = 1 and doc_id is not null")):
        model = quality.fit(awkward, rows)
        assert model == quality.EVEN and quality.score(unnamed, model).filter(F.col("score") >= 0.7).count() == unnamed.count()
    assert quality.score(empty_docs, model).count() == 0


def test_fit_is_bounded_by_its_parameter(awkward, spark):
    labels = awkward.selectExpr("doc_id", "cast(pmod(doc_id, 20) = 0 as int) as quality")
    assert quality.fit(awkward, labels, max_rows=1) == quality.EVEN


def test_quality_is_fitted_on_all_pairs(spark):
    """Every pair counts, far scores too; the cut is the quantile of all training scores."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, len(quality.NAMES))) * rng.uniform(0.1, 5, len(quality.NAMES))
    x[::50] *= 20
    good = x[:, 0] + 0.3 * x[:, 3] + rng.normal(size=600) * 2 > 0.5
    frame = spark.createDataFrame([(r.tolist(), bool(g)) for r, g in zip(x, good)], "x array<double>, good boolean")
    model = quality.fit_pairs(frame.repartition(3))
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    d = (z[good][:, None] - z[~good][None]).reshape(-1, z.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(d @ w))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(len(w)), d.T @ p / len(d) - 1e-3 * w)
        w += step * min(1.0, 2.0 / np.abs(step).max())
    assert np.allclose(model.weights, w, rtol=0, atol=1e-7)
    assert np.isclose(model.cut, np.quantile(z @ w, 1 - good.mean()), rtol=0, atol=1e-6)


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.7312, 1.0])
def test_quantile_narrows_to_the_exact_value(spark, monkeypatch, share):
    monkeypatch.setattr(quality, "QUANTILE_ROWS", 3)
    monkeypatch.setattr(quality, "QUANTILE_BINS", 4)
    values = [1.0] * 40 + [2.0] * 40 + [float(v) for v in np.random.default_rng(2).normal(size=121)] + [1e9]
    for some in (values, values[:80]):
        found = quality.quantile(spark.createDataFrame([(v,) for v in some], "s double"), share)
        assert np.isclose(found, np.quantile(some, share), rtol=1e-12)
