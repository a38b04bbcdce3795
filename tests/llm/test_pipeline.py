"""The stages, each on what its predecessor kept, and the whole against plain versions."""

import numpy as np
import pytest

import corpus_pipeline as pipeline
from recollect.llm import pii, quality, queries
from recollect.llm.common import stage

from .test_near import brute_components, brute_contained

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, function in pipeline.STAGES:
        out.append(stage(function(spark, out[-1], SF), name))
    return out


def rows(frame):
    return {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}


def test_stages_return_documents(results):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "packing"]
    assert all(f.columns == results[0].columns for f in results[:-1])


def test_each_stage_equals_its_plain_version(spark, results):
    docs, good, single, clean, private, pieces = results
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {k: model.score(quality.features(t)) for k, t in rows(docs).items()}
    assert set(rows(good)) == {k for k, s in scores.items() if s >= quality.THRESHOLD}
    assert rows(single).keys() == {c for _, _, c in brute_components(list(rows(good).items()), 80)}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    leaked = {d for d, *_ in brute_contained(list(rows(single).items()), items)}
    assert rows(clean).keys() == rows(single).keys() - leaked
    apply = pii.pseudonymizer(queries.PII_KEY)
    assert rows(private) == {k: apply(t)[0] for k, t in rows(clean).items()}
    encode = queries.byte_bpe()()
    held = {}
    for p in sorted(pieces.collect(), key=lambda p: p.start):
        held.setdefault(p.doc_id, []).extend(np.frombuffer(p.ids, "<u4").tolist())
    assert held == {k: [*encode(t).tolist(), 0] for k, t in rows(private).items()}


def test_run_equals_the_stages(spark, results):
    got, want = pipeline.run(spark, SF), results[-1]
    total = lambda f: f.selectExpr("count(distinct doc_id) as docs", "sum(octet_length(ids)) as bytes").first()
    assert total(got) == total(want)


def test_most_labelled_good_documents_stay(spark, results):
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").join(results[0], "doc_id")
    kept = labels.join(results[1].select("doc_id"), "doc_id", "left_semi")
    assert kept.count() >= 0.97 * labels.count()


def test_awkward_tables(spark, awkward, empty_docs, unnamed):
    for docs in (awkward, empty_docs, unnamed):
        columns = docs.columns
        for name, function in pipeline.STAGES:
            docs = stage(function(spark, docs, SF), name)
            assert name == "packing" or docs.columns == columns
        docs.count()
