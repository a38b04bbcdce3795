import math
import random

import pytest
from pyspark.sql import functions as F

from recollect.operators import retrieval as R
from recollect.operators import vector_index as V
from recollect.operators.extensions import MultiChannelRetriever, Registry, VectorRetriever


def cosine(a, b):
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b)) / (na * nb), 9) if na and nb else 0.0


@pytest.fixture(scope="module")
def corpus(spark):
    """One unit holds most rows; some vectors are exact copies."""
    rng = random.Random(3)
    rows = []
    for i in range(90):
        unit = "hot" if i < 60 else f"u{i % 4}"
        vector = [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]
        words = " ".join(rng.choice(["cat", "dog", "the", "sun", "sea"]) for _ in range(rng.randrange(6)))
        rows.append((unit, f"r{i:03d}", vector, words))
    return rows, spark.createDataFrame(rows, "unit_id string, record_id string, embedding array<double>, text string")


@pytest.mark.parametrize("block_rows", [1, 7, 2048])
@pytest.mark.parametrize("k", [1, 5, 200])
def test_vector_topk_is_exact_for_any_block_size(corpus, block_rows, k):
    rows, frame = corpus
    if block_rows == 1 and k == 200:
        pytest.skip("covered by the other sizes")
    found = R.vector_topk(frame.withColumnRenamed("record_id", "query_id"), frame, k, block_rows=block_rows)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["record_id"], r["score"])
    for unit, query, vector, _ in rows:
        want = sorted(((-cosine(vector, v), rid) for u, rid, v, _ in rows if u == unit))[:k]
        assert [got[query][i + 1] for i in range(len(want))] == [(rid, -s) for s, rid in want]


def test_lexical_topk_and_merge(spark, corpus):
    rows, frame = corpus
    queries = frame.withColumnRenamed("record_id", "query_id")
    lexical = {(r["query_id"], r["record_id"]): r["score"] for r in R.lexical_topk(queries, frame, 100, slice_rows=9).collect()}
    for u, q, _, words in rows:
        wanted = {w for w in words.split() if w != "the"}
        for u2, rid, _, other in rows:
            share = round(len(wanted & set(other.split())) / len(wanted), 9) if wanted and u == u2 else 0
            assert lexical.get((q, rid), 0) == share
    merged = MultiChannelRetriever(k=3, prefetch_k=4).retrieve(queries, frame).collect()
    per_query = {}
    for r in merged:
        per_query.setdefault(r["query_id"], []).append(r)
        assert set(r["channels"]) <= {"raw_lexical", "raw_semantic"} and r["channels"]
    assert all(len(v) == 3 for v in per_query.values())


def test_units_without_records_or_queries_give_nothing(spark):
    schema = "unit_id string, query_id string, embedding array<double>"
    queries = spark.createDataFrame([("a", "q", [1.0])], schema)
    records = spark.createDataFrame([("b", "r", [1.0])], schema.replace("query_id", "record_id"))
    assert R.vector_topk(queries, records, 3).count() == 0


def test_distance_filter_and_registry(corpus):
    _, frame = corpus
    queries = frame.withColumnRenamed("record_id", "query_id")
    near = Registry().retriever("vector", {"k": 8, "threshold": 0.5}).retrieve(queries, frame)
    assert near.filter("score < 0.5").count() == 0
    assert R.distance_filter(R.vector_topk(queries, frame, 8), 2.0, limit=2).filter("rank > 2").count() == 0
    with pytest.raises(KeyError):
        Registry().retriever("nope", {})
    assert isinstance(Registry(retrievers={"vector": lambda s: VectorRetriever(1)}).retriever("vector", {}), VectorRetriever)


def test_search_surface(spark):
    rows = [('{"results": [{"memory": "a"}]}',), ('[{"memory": "b"}, {"memory": "c"}]',), (None,), ('{"results": null}',), ("null",)]
    frame = spark.createDataFrame(rows, "raw string").select(R.extract_surface(F.col("raw"), "struct<memory:string>").alias("s"))
    assert [[x["memory"] for x in r["s"]] for r in frame.collect()] == [["a"], ["b", "c"], [], [], []]
    bad = spark.createDataFrame([('{"results": "x"}',)], "raw string").select(R.extract_surface(F.col("raw"), "struct<memory:string>"))
    with pytest.raises(Exception, match="list of results"):
        bad.collect()


def test_equal_scores_keep_the_original_order(spark):
    rows = [("q", 0, "a", 0.5), ("q", 1, None, None), ("q", 2, "c", 0.9), ("q", 3, "d", 0.5)]
    frame = spark.createDataFrame(rows, "query_id string, pos int, memory string, score double")
    frame = frame.withColumns({c: F.lit(None).cast("string") for c in ("id", "created_at", "updated_at")})
    frame = frame.withColumn("metadata", F.create_map(F.lit("junk"), F.lit("x")))
    got = R.normalize_search(frame).orderBy("rank").collect()
    assert [r["pos"] for r in got] == [2, 0, 3, 1]
    assert (got[3]["memory"], got[3]["score"], got[3]["metadata"]) == ("", 0.0, None)


def test_contexts(col_values):
    ok = col_values("t array<string>, a string", [(["x", "y"], R.ACTIVE_HEADER)], c=R.render_context(F.col("t"), F.col("a")))
    assert ok == [(f"{R.RECALLED_HEADER}\nx\ny\n\n{R.ACTIVE_HEADER}",)]
    assert col_values("t array<string>, a string", [([], "z")], c=R.render_context(F.col("t"), F.col("a"))) == [("z",)]
    texts = [(ok[0][0],), (R.ACTIVE_HEADER,), ("x",), (R.ACTIVE_HEADER + R.RECALLED_HEADER,)]
    got = col_values("t string", texts, i=R.inspect_context(F.col("t")))
    assert [tuple(g[0]) for g in got] == [
        (True, True, None), (False, True, None), (False, False, "missing active header"), (True, True, "recalled after active"),
    ]


def test_shares_sum_to_the_total_also_for_a_hot_unit(spark):
    items = spark.createDataFrame([("hot" if i % 5 else "u", i) for i in range(100)], "unit_id string, at int")
    totals = spark.createDataFrame([("hot", 1003, 7), ("u", 19, 0)], "unit_id string, prompt_tokens bigint, calls bigint")
    shares = R.apportion_usage(items, totals, [F.col("at")], F.floor(F.col("at") / 8), ("prompt_tokens", "calls"))
    sums = shares.groupBy("unit_id").agg(F.sum("prompt_tokens").alias("p"), F.sum("calls").alias("c"))
    assert {tuple(r) for r in sums.collect()} == {("hot", 1003, 7), ("u", 19, 0)}
    first = [r["prompt_tokens"] for r in shares.filter("unit_id = 'hot'").orderBy("at").collect()]
    assert first == [13] * (1003 % 80) + [12] * (80 - 1003 % 80)


def clusters(seed, groups, members, dimensions=12):
    """Vectors close around far-apart directions."""
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        centre = [rng.gauss(0, 1) for _ in range(dimensions)]
        for m in range(members):
            rows.append((f"r{g * members + m:04d}", [c + rng.gauss(0, 0.03) for c in centre]))
    return rows


def test_pivots_leave_out_blocks_that_cannot_matter(spark):
    rows = [("u", i, v) for i, v in clusters(5, 10, 40)] + [("u", "zero", [0.0] * 12), ("u", "same", clusters(5, 10, 40)[3][1])]
    frame = spark.createDataFrame(rows, "unit_id string, id string, v array<double>")
    big = spark.createDataFrame([("u", len(rows), len(rows))], "unit_id string, queries long, records long")
    pivots = V.pivots_of(frame, big, 10)
    blocks = V.blocks_of(frame, big, pivots, "records", 10)
    assert blocks.agg(F.sum("n")).first()[0] == len(rows) and blocks.agg(F.max("n")).first()[0] < 40
    first = V.first_pairs(blocks, blocks)
    found = V.scored(first, blocks, blocks, 5)
    more = V.further_pairs(blocks, blocks, pivots, first, found, 5).filter(f"qc <> {V.ZERO} and rc <> {V.ZERO}")
    n = blocks.filter(f"cluster <> {V.ZERO}").count()
    assert more.count() + n < n * n / 2

    both = frame.withColumnRenamed("id", "record_id").withColumnRenamed("v", "embedding")
    got = {}
    for r in R.vector_topk(both.withColumnRenamed("record_id", "query_id"), both, 5, block_rows=10).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["record_id"], r["score"])
    for _, query, vector in rows:
        want = sorted((-cosine(vector, v), i) for _, i, v in rows)[:5]
        assert [got[query][i + 1] for i in range(5)] == [(i, -s) for s, i in want]


def test_a_unit_of_few_records_and_many_queries(spark):
    vectors = clusters(6, 3, 30, 4)
    queries = spark.createDataFrame([("u", i, v) for i, v in vectors], "unit_id string, query_id string, embedding array<double>")
    records = spark.createDataFrame([("u", i, v) for i, v in vectors[::15]], "unit_id string, record_id string, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["record_id"] for r in R.vector_topk(queries, records, 4, block_rows=8).collect()}
    for query, vector in vectors:
        want = sorted((-cosine(vector, v), i) for i, v in vectors[::15])[:4]
        assert [got[query, n + 1] for n in range(4)] == [i for _, i in want]


def test_a_common_term_is_spread(spark):
    rows = [("u", f"r{i:03d}", f"common w{i % 7}") for i in range(200)]
    records = spark.createDataFrame(rows, "unit_id string, record_id string, text string")
    asked = spark.createDataFrame([("u", "q", "Common w3"), ("u", "none", "the"), ("u", "null", None)], "unit_id string, query_id string, text string")
    got = R.lexical_topk(asked, records, 40, slice_rows=20).collect()
    best = [f"r{i:03d}" for i in range(200) if i % 7 == 3]
    rest = [f"r{i:03d}" for i in range(200) if i % 7 != 3]
    assert [(r["record_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == (
        [(i, 1.0) for i in best] + [(i, 0.5) for i in rest]
    )[:40]


def test_unknown_names_are_refused(spark):
    empty = spark.createDataFrame([], "prompt string")
    for call in (lambda r: r.answer("x", empty), lambda r: r.judge("x", empty, "locomo"), lambda r: r.read_predictions("x", "path")):
        with pytest.raises(KeyError, match="not registered"):
            call(Registry())


def test_lexical_units_of_any_size_and_odd_ids(spark, monkeypatch):
    """Units matched in one task and units joined on terms give the same rows, also across slabs of terms."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(f"u{i % 3}" if i % 20 else None, f"é{i % 40:02d}" if i % 11 else None, " ".join(rng.choices(words, k=i % 9))) for i in range(130)]
    frame = spark.createDataFrame([*rows, ("u0", "none", None)], "unit_id string, record_id string, text string")
    queries = frame.withColumnRenamed("record_id", "query_id").filter("text is null or text not like '%w7%'")
    monkeypatch.setattr(R, "TERM_SLAB", 16)
    found = [sorted(map(repr, R.lexical_topk(queries, frame, 4, slice_rows=3, block_rows=n).collect())) for n in (1, 42, 1024)]
    assert found[0] and found[0] == found[1] == found[2]
