"""Order-dependent columns against brute force, with one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from recollect.operators import ordered as O


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", at, rng.randrange(10)) for at in rng.sample(range(5000), 600)]
    return data, spark.createDataFrame(data, "k string, at int, v int").repartition(5)


def expected(data):
    out = {}
    for k, at, v in sorted(data, key=lambda r: r[1]):
        out.setdefault(k, []).append((at, v))
    return out


@pytest.mark.parametrize("width", [1, 37, 10_000])
def test_position_sum_and_previous(rows, width):
    data, frame = rows
    bucket, order = F.floor(F.col("at") / width), [F.col("at")]
    pos = {(r["k"], r["at"]): r["position"] for r in O.ordered_position(frame, ["k"], order, bucket).collect()}
    sums = {(r["k"], r["at"]): r["s"] for r in O.running_sum(frame, ["k"], order, bucket, F.col("v"), "s").collect()}
    prev = {(r["k"], r["at"]): r["p"] for r in O.previous_row(frame, ["k"], order, bucket, {"p": F.col("v")}).collect()}
    assert len(pos) == len(sums) == len(prev) == len(data)
    for k, series in expected(data).items():
        total = 0
        for i, (at, v) in enumerate(series):
            total += v
            assert pos[k, at] == i
            assert sums[k, at] == total
            assert prev[k, at] == (series[i - 1][1] if i else None)


def test_previous_row_crosses_empty_buckets(spark):
    frame = spark.createDataFrame([("a", 0, 1), ("a", 500, 2), ("a", 501, 3)], "k string, at int, v int")
    got = O.previous_row(frame, ["k"], [F.col("at")], F.floor(F.col("at") / 10), {"p": F.col("v")})
    assert {r["at"]: r["p"] for r in got.collect()} == {0: None, 500: 1, 501: 2}


def test_a_null_key_is_an_error_and_not_a_lost_row(spark):
    frame = spark.createDataFrame([("a", 1), (None, 2)], "k string, at int")
    with pytest.raises(Exception, match="must not be null"):
        O.ordered_position(frame, ["k"], [F.col("at")], F.col("at")).collect()


@pytest.fixture
def small_slices(monkeypatch):
    monkeypatch.setattr(O, "SLICE_ROWS", 20)
    monkeypatch.setattr(O, "SAMPLE", 256)


@pytest.fixture(scope="module")
def one_moment(spark):
    """One key with all its rows at one time, ordered by id alone, beside small keys."""
    rng = random.Random(8)
    data = [("hot", 7, i, rng.randrange(3)) for i in rng.sample(range(9000), 700)]
    data += [(f"k{i % 9}", rng.randrange(4), 10_000 + i, rng.randrange(3)) for i in range(60)]
    return data, spark.createDataFrame(data, "k string, at int, id int, v int").repartition(4)


def test_scan_gives_all_columns_at_once(spark, one_moment, small_slices):
    data, frame = one_moment
    order = [F.col("at"), F.col("id")]
    got = O.scan(
        frame, ["k"], order, position="n", sums={"s": F.col("v"), "c": F.lit(1)}, previous={"p": F.col("id")}, following={"f": F.col("v")}
    )
    assert got.columns == ["k", "at", "id", "v", "n", "s", "c", "p", "f"]
    series = {}
    for k, at, i, v in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        series.setdefault(k, []).append((at, i, v))
    want = {}
    for k, rows in series.items():
        for n, (at, i, v) in enumerate(rows):
            total = sum(r[2] for r in rows[: n + 1])
            want[i] = (k, at, i, v, n, total, n + 1, rows[n - 1][1] if n else None, rows[n + 1][2] if n + 1 < len(rows) else None)
    assert {r["id"]: tuple(r) for r in got.collect()} == want


def test_a_hot_key_at_one_time_is_cut(spark, one_moment, small_slices):
    _, frame = one_moment
    sizes = O.sliced(frame, ["k"], [F.col("at"), F.col("id")]).groupBy("k", "__bucket").count().collect()
    hot = [r["count"] for r in sizes if r["k"] == "hot"]
    assert len(hot) > 15 and max(hot) < 150
    bounds = O.sliced(frame, ["k"], [F.col("at"), F.col("id")]).filter("k = 'hot'").groupBy("__bucket").agg(F.min("id"), F.max("id"))
    spans = sorted(tuple(r)[1:] for r in bounds.collect())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_few_rows_and_no_rows(spark):
    frame = spark.createDataFrame([("a", 1)], "k string, at int")
    assert [tuple(r) for r in O.scan(frame, ["k"], [F.col("at")], position="n").collect()] == [("a", 1, 0)]
    assert O.scan(frame.limit(0), ["k"], [F.col("at")], position="n").collect() == []


@pytest.mark.parametrize("values", [2, 1])
def test_stretches_equal_brute_force(spark, one_moment, small_slices, values):
    data, frame = one_moment
    flag = (F.col("v") / 2).cast("int") if values == 2 else F.lit(None).cast("int")
    got = O.stretches(
        frame, ["k"], [F.col("at"), F.col("id")], flag, {"a": F.min("id"), "b": F.max("id"), "n": F.count("*")},
        {"a": F.min("a"), "b": F.max("b"), "n": F.sum("n")},
    )
    want = []
    for k, at, i, v in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        v = v // 2 if values == 2 else None
        if want and want[-1][:2] == [k, v]:
            want[-1][2:] = [min(want[-1][2], i), max(want[-1][3], i), want[-1][4] + 1]
        else:
            want.append([k, v, i, i, 1])
    assert sorted(map(repr, map(list, got.collect()))) == sorted(map(repr, want))


def test_stretches_read_their_rows_once(spark, one_moment, tmp_path):
    path = str(tmp_path / "rows")
    one_moment[1].write.parquet(path)
    frame = spark.read.parquet(path)
    got = O.stretches(
        frame, ["k"], [F.col("at"), F.col("id")], F.col("v"), {"n": F.count("*")}, {"n": F.sum("n")}, bucket=F.floor(F.col("id") / 100)
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
