import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recollect.operators import sampling as P


@pytest.mark.parametrize("rounding", P.ROUNDINGS)
@pytest.mark.parametrize("fraction", [0.005, 0.25, 0.5, 1.0])
def test_sample_size(col_values, rounding, fraction):
    sizes = [0, 1, 2, 3, 9, 10, 199]

    def plain(n):
        if n <= 0:
            return 0
        value = {"ceil": math.ceil, "floor": math.floor, "round": lambda x: math.floor(x + 0.5)}[rounding](n * fraction)
        return min(n, max(1, value))

    got = col_values("n bigint", [(n,) for n in sizes], k=P.sample_size(F.col("n"), fraction, rounding))
    assert [g[0] for g in got] == [plain(n) for n in sizes]


def test_bad_settings_are_refused(spark):
    frame = spark.range(3)
    with pytest.raises(ValueError):
        P.stratified_sample(frame, ["id"], 0.0)
    with pytest.raises(ValueError):
        P.sample_size(F.lit(1), 0.5, "up")
    with pytest.raises(ValueError):
        P.sample_qa(frame, 0.5, stratify_by="lang")


@pytest.mark.parametrize("prefix", [1, 3])
def test_hash_sample_is_the_first_in_hash_order_even_with_a_hot_stratum(spark, prefix):
    rows = [(i, "hot" if i % 10 else f"s{i % 3}") for i in range(800)]
    frame = spark.createDataFrame(rows, "id bigint, s string")
    size = P.sample_size(F.col("population"), 0.13, "ceil")
    got = {r["id"] for r in P.hash_sample(frame, ["id"], F.col("s"), size, 7, prefix).collect()}
    want = set()
    for s in {s for _, s in rows}:
        ids = sorted((i for i, t in rows if t == s), key=lambda i: hashlib.sha256(f"7:{i}".encode()).hexdigest())
        want |= set(ids[: math.ceil(len(ids) * 0.13)])
    assert got == want


def questions(spark, per_category):
    rows = [(0, i, c) for i, c in enumerate(c for c, n in per_category.items() for _ in range(n))]
    return spark.createDataFrame(rows, "conversation_idx bigint, question_idx int, category int")


def test_one_of_two_per_category(spark):
    frame = questions(spark, {1: 2, 2: 2})
    sample = P.sample_qa(frame, 0.5, 7, "ceil", "category")
    assert Counter(r["category"] for r in sample.collect()) == {1: 1, 2: 1}
    counts = P.sampling_counts(frame, sample, ["question_idx"], F.col("category"))
    row = P.sampling_manifest(counts, {"fraction": 0.5}, True).first()
    assert row["population_by_group"] == {"1": 2, "2": 2} and row["sample_by_group"] == {"1": 1, "2": 1}
    assert (row["population_count"], row["sample_count"]) == (4, 2)


def test_one_conversation_of_twenty(spark):
    frame = spark.range(20).select(F.col("id").alias("conversation_idx"))
    assert P.sample_conversations(frame, 0.05, 7, "ceil").count() == 1


def test_per_type_takes_known_types_only(spark):
    rows = [(f"q{i}", ("multi-session", "temporal-reasoning", "mystery")[i % 3]) for i in range(30)]
    frame = spark.createDataFrame(rows, "question_id string, question_type string")
    got = Counter(r["question_type"] for r in P.sample_per_type(frame, 4, 7).collect())
    assert got == {"multi-session": 4, "temporal-reasoning": 4}
    assert P.sample_per_type(frame, 99, 7, ["mystery"]).count() == 10


def test_regroup_keeps_order_and_drops_empty_conversations(spark):
    docs = spark.createDataFrame([(0, ["a", "b", "c"]), (1, ["d"])], "conversation_idx bigint, qa array<string>")
    sample = spark.createDataFrame([(0, 2), (0, 0)], "conversation_idx bigint, question_idx int")
    assert [tuple(r) for r in P.regroup_sample(docs, sample).collect()] == [(0, ["a", "c"])]


def test_rows_without_a_stratum_are_sampled_too(spark):
    frame = spark.createDataFrame([(i, "s" if i % 2 else None) for i in range(20)], "id bigint, s string")
    got = P.stratified_sample(frame, ["id"], 0.5, stratum=F.col("s"))
    assert Counter(r["s"] for r in got.collect()) == {"s": 5, None: 5}
    counts = P.sampling_counts(frame, got, ["id"], F.col("s"))
    assert {tuple(r) for r in counts.collect()} == {("s", 10, 5), ("None", 10, 5)}
