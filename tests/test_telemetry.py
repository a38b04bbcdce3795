import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recollect.operators import telemetry as TE
from recollect.session import new_path
from recollect.streaming import alerts, progress

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_counter_resets_count_the_new_value(spark):
    rows = [("s", at(0), 5.0), ("s", at(30), 9.0), ("s", at(90), 2.0), ("s", at(100), 3.0)]
    frame = spark.createDataFrame(rows, "series string, ts timestamp, value double")
    got = {r["window_start"] % 86400: r["rate"] for r in TE.rate(frame, ["series"], 60).collect()}
    assert got == {0: round(4 / 60, 9), 60: round(3 / 60, 9)}


def test_histogram_is_cumulative(spark):
    frame = spark.createDataFrame([("p", 0.05), ("p", 0.5), ("p", 1000.0)], "phase string, seconds double")
    rows = TE.histogram(frame, ["phase"], "seconds", TE.PHASE_BUCKETS).orderBy("le").collect()
    assert [r["bucket_count"] for r in rows] == [1, 2, 2, 2, 2, 2, 2, 2, 2, 2, 3]
    assert rows[0]["count"] == 3 and rows[0]["sum"] == 1000.55


def test_event_vocabulary(spark):
    frame = spark.createDataFrame([("run.started",), ("run.exploded",), (None,)], "event string")
    accepted, rejected = TE.split_events(frame)
    assert accepted.count() == 1 and rejected.count() == 2


def test_stall_and_down_alerts(spark):
    seen = spark.createDataFrame([("r", at(0)), ("r", at(1200)), ("r", at(2401))], "run_id string, ts timestamp")
    got = TE.stall_alerts(seen, "run_id").collect()
    assert [(r["last_progress"], r["fired_at"], r["resumed_at"]) for r in got] == [(at(1200), at(2400), at(2401))]
    late = TE.stall_alerts(seen, "run_id", until=F.lit(at(9000))).filter("resumed_at is null").collect()
    assert [r["last_progress"] for r in late] == [at(2401)]
    ups = [(0, 1), (10, 0), (40, 0), (69, 0), (80, 1), (90, 0), (151, 0)]
    frame = spark.createDataFrame([("j", at(t), u) for t, u in ups], "job string, ts timestamp, up int")
    got = TE.down_alerts(frame, "job").collect()
    assert [(r["down_since"], r["samples"]) for r in got] == [(at(90), 2)]


def test_labels_come_from_exactly_one_series(spark):
    samples = spark.createDataFrame([("x", 1.0)], "name string, value double")
    info = spark.createDataFrame([("b", "f")], "benchmark string, framework string")
    assert [tuple(r) for r in TE.attach_labels(samples, info, ["benchmark", "framework"]).collect()] == [("x", 1.0, "b", "f")]
    assert TE.attach_labels(samples, info.limit(0), ["benchmark"]).count() == 0


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def run_all(query, **options):
    query.processAllAvailable()
    query.stop()


def streamed_alerts(spark, files, lateness, restart=False):
    """Alert events of (run_id, ts) files that arrive one after another, and the alerts and late rows in them."""
    schema = "run_id string, ts timestamp"
    source, out, state = (new_path(spark, name) for name in ("stall-in", "stall-out", "stall-state"))
    own = spark.newSession()
    own.conf.set(alerts.STATE_STORE, alerts.ROCKSDB)

    def run():
        stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/part=*")
        found = alerts.stall_alert_stream(stream, "run_id", lateness)
        writer = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        writer.trigger(availableNow=True).start().awaitTermination()

    for i, rows in enumerate(files):
        write(spark, source, f"part={i:03}", rows, schema)
        if restart:
            run()
    run()
    found, late = alerts.split_events(spark.read.parquet(out))
    base = int(START.timestamp() * 1000)
    seconds = lambda ms: None if ms is None else (ms - base) // 1000
    return (
        {(r.series, seconds(r.last_progress_ms), seconds(r.resumed_at_ms)) for r in found.collect()},
        sorted((r.series, seconds(r.late_ms)) for r in late.collect()),
    )


@pytest.mark.parametrize("restart", [False, True])
def test_stall_stream_fires_resumes_and_reports_late_rows(spark, restart):
    files = [
        [("quiet", at(0)), ("busy", at(0))],
        [("busy", at(600)), ("busy", at(100))],
        [("busy", at(1900))],
        [("busy", at(2000)), ("quiet", at(30))],
        [("quiet", at(5000)), ("busy", at(2100)), (None, at(1)), ("busy", None)],
        [("busy", at(10_000))],
    ]
    found, late = streamed_alerts(spark, files, "0 seconds", restart)
    # busy: 600 -> 1900 and 2100 -> 10000 are longer than 1200 s; quiet: silent from 0 to 5000 and from there on.
    assert found == {("busy", 600, 1900), ("quiet", 0, 5000), ("busy", 2100, None), ("quiet", 5000, None)}
    assert late == [("quiet", 30)]


def test_shuffled_files_give_the_alerts_of_the_batch(spark):
    rng = random.Random(12)
    rows = [(f"r{rng.randrange(4)}", rng.randrange(0, 60_000)) for _ in range(130)]
    rows = sorted(set(rows), key=lambda r: r[1] + rng.randrange(3000))  # up to 3,000 s out of order
    files = [[(k, at(t)) for k, t in rows[i : i + 12]] for i in range(0, len(rows), 12)]
    found, late = streamed_alerts(spark, files, "3000 seconds")
    passed = max(t for _, t in rows) - 3000
    frame = spark.createDataFrame([(k, at(t)) for k, t in rows], "run_id string, ts timestamp")
    batch = TE.stall_alerts(frame, "run_id", until=F.lit(at(10**6)))
    start = START.timestamp()
    after = lambda t: None if t is None else int(t.timestamp() - start)
    want = {(r.run_id, after(r.last_progress), after(r.resumed_at)) for r in batch.collect()}
    want = {(k, last, resumed if resumed is not None and resumed < passed else None) for k, last, resumed in want if last + 1200 < passed}
    assert found == want and late == [] and len(want) > 10


def test_streamed_counters_equal_the_batch_after_a_restart(spark):
    schema = "kind string, n bigint, ts timestamp"
    source, out, state = new_path(spark, "c-in"), new_path(spark, "c-out"), new_path(spark, "c-state")
    for i in range(3):
        write(spark, source, f"part={i}", [("a", i + 1, at(i)), (f"k{i}", 10, at(i))], schema)
        stream = spark.readStream.schema(schema).parquet(f"{source}/part=*")
        counters = progress.running_counters(stream, {"kind": F.col("kind")}, F.col("n"), "total")
        progress.write_updates(counters, out, state).awaitTermination()
    got = {r["kind"]: r["total"] for r in progress.latest_values(spark, out, ["kind"]).collect()}
    assert got == {"a": 6, "k0": 10, "k1": 10, "k2": 10}


def test_a_series_reads_and_writes_its_state_once_a_call():
    """Every access to the state is a message to the JVM, so their number must not grow with the slots."""
    import pandas as pd

    calls = {"get": 0, "update": 0, "timer": 0}

    class State:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            calls["get"] += 1
            return self.value

        def update(self, value):
            calls["update"] += 1
            self.value = value

    class Handle:
        def getValueState(self, *_):
            return State()

        def registerTimer(self, _):
            calls["timer"] += 1

    class Timers:
        def __init__(self, passed):
            self.passed = passed

        def getCurrentWatermarkInMs(self):
            return self.passed

    processor = alerts.StallProcessor(1000)
    processor.init(Handle())
    times = [2500 * i for i in range(400)]
    assert list(processor.handleInputRows(("a",), iter([pd.DataFrame({"ts_ms": times[::-1]})]), Timers(0))) == []
    assert max(calls.values()) == 1
    (found,) = processor.handleExpiredTimer(("a",), Timers(500_000), None)
    assert max(calls.values()) == 2
    # The last alert is open: the watermark has not passed the row after it.
    assert found["last_progress_ms"].tolist() == times[:200]
    assert found["resumed_at_ms"].dropna().tolist() == times[1:200]
