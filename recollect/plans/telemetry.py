"""Telemetry over the whole event table, as batch queries and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.dates import micros
from ..operators import telemetry as TE
from ..session import new_path
from ..sources import runs as SR
from ..streaming import alerts, progress
from . import runs as RN
from . import sql as Q
from . import tables as T

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


# --- labels -----------------------------------------------------------------------------

_EVENT_NAME = """CASE event_type WHEN 'signup' THEN 'run.started' WHEN 'click' THEN 'unit.prediction.committed' WHEN 'view' THEN 'judge.completed'
 WHEN 'purchase' THEN 'report.written' ELSE 'unit.exploded' END"""


def _event_name():
    kind = F.col("event_type")
    return (
        F.when(kind == "signup", F.lit("run.started")).when(kind == "click", F.lit("unit.prediction.committed"))
        .when(kind == "view", F.lit("judge.completed")).when(kind == "purchase", F.lit("report.written"))
        .otherwise(F.lit("unit.exploded"))
    )


@query(
    "events_valid",
    f"SELECT event_id, {_EVENT_NAME} AS event, CASE WHEN event_type = 'error' THEN 'unknown event' END AS problem FROM events",
)
def events_valid(spark, d):
    rows = T.table(spark, d, "events").select("event_id", _event_name().alias("event"))
    accepted, rejected = TE.split_events(rows)
    return accepted.withColumn("problem", F.lit(None).cast("string")).unionByName(rejected)


@query(
    "read_events",
    f"SELECT CAST(user_id AS VARCHAR) AS run_id, {_EVENT_NAME} AS event, value AS elapsed_seconds, epoch_us(ts) // 1000 AS at_ms FROM events",
)
def read_events(spark, d):
    """Write the event table as a JSON-lines log and read it with the log reader."""
    path = new_path(spark, "event-log")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    T.steps(spark, d).select(
        "run_id", _event_name().alias("event"), F.col("value").alias("elapsed_seconds"), stamp.alias("timestamp")
    ).write.json(path)
    rows = SR.read_events(spark, path)
    return rows.select("run_id", "event", "elapsed_seconds", F.unix_millis("timestamp").alias("at_ms"))


@query(
    "bounded_label",
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'stage_' || event_type WHEN event_id % 4 = 2 AND length(event_type) * 12 <= 48 THEN repeat(event_type, 12) ELSE 'other' END AS label FROM events",
)
def bounded_label(spark, d):
    at, kind = F.col("event_id") % 4, F.col("event_type")
    label = (
        F.when(at == 0, F.concat(F.lit("Stage-"), kind)).when(at == 1, F.concat(kind, F.lit(" x")))
        .when(at == 2, F.repeat(kind, F.lit(12))).otherwise(F.lit(""))
    )
    return T.table(spark, d, "events").select("event_id", X.bounded_label(label).alias("label"))


@query(
    "vocabulary_labels",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'JUDGING' WHEN 'click' THEN 'RUNNING' ELSE 'FAILED' END AS phase, CASE event_type WHEN 'view' THEN 'judge' ELSE 'other' END AS role,
 CASE event_type WHEN 'view' THEN 'other' WHEN 'click' THEN 'other' WHEN 'signup' THEN 'delete_collection' ELSE 'other' END AS operation, CASE WHEN event_type = 'signup' THEN 's3-compatible' ELSE 'other' END AS backend FROM events""",
)
def vocabulary_labels(spark, d):
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", F.lit("Judging")).when(kind == "click", F.lit("running")).otherwise(kind)
    )
    role = F.when(kind == "view", F.lit("Judge")).otherwise(kind)
    op = F.when(kind == "signup", F.lit("Delete-Collection")).otherwise(kind)
    backend = F.when(kind == "signup", F.lit("S3-Compatible")).otherwise(kind)
    return T.table(spark, d, "events").select(
        "event_id", TE.phase_name(text).alias("phase"), TE.role_name(role).alias("role"),
        TE.operation_name(op).alias("operation"), TE.backend_name(backend).alias("backend"),
    )


# --- counters, histograms, gauges -------------------------------------------------------


def requests(spark, d):
    kind = F.col("event_type")
    return T.table(spark, d, "events").select(
        F.when(kind == "view", F.lit("judge")).when(kind == "click", F.lit("answerer")).otherwise(kind).alias("role"),
        F.concat(F.lit("Prov-"), (F.col("user_id") % 3).cast("string")).alias("provider"),
        F.when(F.col("event_id") % 9 == 0, F.lit("failed")).otherwise(F.lit("completed")).alias("outcome"),
        (F.floor("value") - 10).alias("prompt_tokens"), F.floor(F.col("value") / 2).alias("completion_tokens"),
        F.when(F.col("event_id") % 2 == 0, F.floor(F.col("value") * 2)).alias("total_tokens"),
        F.when(F.col("event_id") % 5 == 0, F.lit(2)).alias("request_count"),
        "user_id", "event_id", "event_type", "value", "ts",
    )


_REQUESTS = """rq AS (SELECT CASE event_type WHEN 'view' THEN 'judge' WHEN 'click' THEN 'answerer' ELSE 'other' END AS role, 'prov_' || (user_id % 3) AS provider,
 CASE WHEN event_id % 9 = 0 THEN 'failed' ELSE 'completed' END AS outcome, greatest(floor(value) - 10, 0) AS p, floor(value / 2) AS c, CASE WHEN event_id % 2 = 0 THEN floor(value * 2) END AS t,
 CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END AS n FROM events)"""
_COUNTERS = f"""WITH {_REQUESTS} SELECT role, provider, outcome, CAST(sum(n) AS BIGINT) AS requests, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens,
 CAST(sum(coalesce(t, p + c)) AS BIGINT) AS total_tokens FROM rq GROUP BY ALL"""


@query("request_counters", _COUNTERS)
def request_counters(spark, d):
    return TE.request_counters(requests(spark, d))


@query("count_by", f"WITH {_REQUESTS} SELECT provider, outcome, count(*) AS attempts FROM rq GROUP BY ALL")
def count_by(spark, d):
    labels = {"provider": X.bounded_label(F.col("provider")), "outcome": X.bounded_label(F.col("outcome"))}
    return TE.count_by(requests(spark, d), labels, "attempts")


_BOUNDS = "[0.1, 0.5, 1.0, 2.5, 5.0, 15.0, 30.0, 60.0, 300.0, 900.0, 'inf'::DOUBLE]"


@query(
    "histogram",
    f"""SELECT event_type, le, count(*) FILTER (value <= le) AS bucket_count, count(*) AS count, round(sum(value), 6) AS sum FROM events, (SELECT unnest({_BOUNDS}::DOUBLE[]) AS le) GROUP BY ALL""",
)
def histogram(spark, d):
    return TE.histogram(T.table(spark, d, "events"), ["event_type"], "value", TE.PHASE_BUCKETS)


def updates(spark, d):
    """Events as status updates of a run."""
    total = F.floor("value") + 5
    return T.steps(spark, d).select(
        "run_id", "ts", (F.floor("value") + 20).alias("expected_items"), F.floor("value").alias("committed_items"),
        F.when(F.col("event_id") % 2 == 0, F.floor(F.col("value") / 4) + 1).alias("expected_units"),
        F.when(F.col("event_id") % 2 == 0, F.floor(F.col("value") / 8)).alias("committed_units"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("activity_stage"),
        F.when(F.col("event_type") != "error", total + 3).alias("activity_completed"),
        F.when(F.col("event_type") != "error", total).alias("activity_total"),
    )


_LAST = """lu AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events)"""


@query(
    "last_gauges",
    f"""WITH {_LAST} SELECT run_id, CAST(floor(value) + 20 AS BIGINT) AS expected_items, CAST(floor(value) AS BIGINT) AS committed_items, floor(value) / (floor(value) + 20) AS item_progress_ratio,
 CASE WHEN event_id % 2 = 0 THEN floor(value / 8) / (floor(value / 4) + 1) ELSE floor(value) / (floor(value) + 20) END AS progress_ratio,
 CASE WHEN event_type <> 'error' THEN event_type END AS activity_stage, CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END::DOUBLE AS activity_progress_ratio FROM lu WHERE rn = 1""",
)
def last_gauges(spark, d):
    return TE.last_gauges(updates(spark, d), ["run_id"], F.col("ts")).select(
        "run_id", "expected_items", "committed_items", "item_progress_ratio", "progress_ratio", "activity_stage", "activity_progress_ratio"
    )


@query(
    "activity_gauges",
    f"""WITH {_LAST}, s AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS run_id, event_type AS stage FROM events WHERE event_type <> 'error')
SELECT run_id, stage, CASE WHEN stage = event_type THEN CAST(floor(value) + 5 AS BIGINT) ELSE 0 END AS expected, CASE WHEN stage = event_type THEN CAST(floor(value) + 5 AS BIGINT) ELSE 0 END AS completed,
 stage = event_type AS active FROM s JOIN lu USING (run_id) WHERE rn = 1""",
)
def activity_gauges(spark, d):
    return TE.activity_gauges(updates(spark, d), ["run_id"], F.col("ts"))


@query(
    "one_hot_state",
    f"""WITH {Q.RUNS}, v AS (SELECT unnest(['{"', '".join(TE.RUN_STATES)}']) AS state)
SELECT run_id, state, CASE WHEN state = CASE framework WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'FAILED_JUDGING' ELSE 'RUNNING' END THEN 1 ELSE 0 END AS active FROM runs, v""",
)
def one_hot_state(spark, d):
    rows = RN.full_runs(spark, d).select("run_id", F.coalesce("state", F.lit("running")).alias("now"))
    return TE.one_hot(rows, "now", TE.RUN_STATES, "state")


@query(
    "activity",
    """SELECT event_id, CASE WHEN floor(value) = 0 THEN 0.0 ELSE round_even(least(100.0, greatest(0.0, (user_id - 3) / floor(value) * 100.0)), 1) END AS percentage, CAST(user_id + 1 AS BIGINT) AS record_number,
 CASE WHEN user_id < 3 THEN 'negative count' WHEN user_id - 3 > floor(value) THEN 'completed exceeds total' END AS problem FROM events""",
)
def activity(spark, d):
    rows = T.table(spark, d, "events").select(
        "event_id", (F.col("user_id") - 3).alias("completed"), F.floor("value").alias("total"), F.col("user_id").alias("unit_index")
    )
    return TE.activity(rows).select("event_id", "percentage", "record_number", "problem")


@query(
    "live_progress",
    "SELECT CAST(user_id AS VARCHAR) AS run_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS committed FROM events WHERE event_type = 'view'",
)
def live_progress(spark, d):
    rows = T.steps(spark, d).filter("event_type = 'view'").select("run_id", "event_id", "ts")
    return TE.live_progress(rows, "run_id", [F.col("ts"), F.col("event_id")]).select("run_id", "event_id", "committed")


# --- rates and panels -------------------------------------------------------------------

_INCREASE = """inc AS (SELECT event_type, ts, user_id, CASE WHEN p IS NULL THEN 0.0 WHEN value < p THEN value ELSE value - p END AS increase
 FROM (SELECT *, lag(value) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS p FROM events))"""
_RATE = f"""{_INCREASE}, rt AS (SELECT event_type, user_id, epoch_us(ts) // 86400000000 * 86400 AS window_start, round(sum(increase) / 86400, 9) AS rate FROM inc GROUP BY ALL)"""


def _rates(spark, d):
    samples = T.table(spark, d, "events").select("event_type", "user_id", "ts", "event_id", "value")
    return TE.rate(samples, ["event_type", "user_id"], 86400, ties=("event_id",))


@query("rate", f"WITH {_RATE} SELECT * FROM rt")
def rate(spark, d):
    return _rates(spark, d)


@query("sum_rate_by", f"WITH {_RATE} SELECT event_type, window_start, round(sum(rate), 6) AS rate FROM rt GROUP BY ALL")
def sum_rate_by(spark, d):
    return TE.sum_by(_rates(spark, d), ["event_type", "window_start"])


@query(
    "attach_labels",
    """SELECT event_id, value, (SELECT max(lang) FROM documents) AS benchmark, (SELECT min(source) FROM documents) AS framework FROM events""",
)
def attach_labels(spark, d):
    info = T.table(spark, d, "documents").agg(F.max("lang").alias("benchmark"), F.min("source").alias("framework"))
    return TE.attach_labels(T.table(spark, d, "events").select("event_id", "value"), info, ["benchmark", "framework"])


@query(
    "clamped_ratio",
    f"""WITH {Q.RUNS} SELECT run_id, committed / greatest(expected, 1) AS ratio FROM runs WHERE regexp_full_match(benchmark, '[12]-.*') AND framework = 'F'""",
)
def clamped_ratio(spark, d):
    rows = T.runs(spark, d).filter(
        TE.label_matches(F.col("benchmark"), "[12]-.*") & TE.label_matches(F.col("framework"), "F")
    )
    return rows.select("run_id", TE.clamped_ratio(F.col("committed"), F.col("expected")).alias("ratio"))


@query(
    "latest_results",
    f"""WITH {Q.RUNS}, r AS ({RN._RESULTS}) SELECT benchmark, framework, CASE WHEN metric = 'committed' THEN 'accuracy' ELSE metric END AS metric, value FROM r JOIN runs USING (run_id)
 WHERE metric = 'price' AND starts_with(benchmark, '1')""",
)
def latest_results(spark, d):
    found = RN.flatten_results(spark, d).withColumn(
        "metric", F.when(F.col("metric") == "committed", F.lit("judged_count")).otherwise(F.col("metric"))
    )
    rows = found.join(T.runs(spark, d).select("run_id", "benchmark", "framework"), "run_id")
    return TE.latest_results(rows, benchmark="1.*").select("benchmark", "framework", "metric", "value")


# --- alerts -----------------------------------------------------------------------------


_STALLS = """WITH g AS (SELECT CAST(user_id AS VARCHAR) AS run_id, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS l, epoch_us(ts) AS r FROM events)"""


@query(
    "stall_alerts",
    f"""{_STALLS}, e AS (SELECT max(epoch_us(ts)) AS until FROM events), o AS (SELECT run_id, l, r, r AS till FROM g
 UNION ALL SELECT run_id, max(r), NULL, any_value(until) FROM g, e GROUP BY run_id)
SELECT run_id, l AS last_progress, l + 1200000000 AS fired_at, r AS resumed_at FROM o WHERE till - l > 1200000000""",
)
def stall_alerts(spark, d):
    """Stalls that ended, and those still open at the last event of all."""
    steps = T.steps(spark, d)
    rows = TE.stall_alerts(steps, "run_id", until=steps.agg(F.max("ts")).scalar())
    return rows.select("run_id", *[micros(c).alias(c) for c in ("last_progress", "fired_at", "resumed_at")])


@query(
    "failed_state_alerts",
    f"WITH {Q.RUNS} SELECT run_id, 'FAILED_JUDGING' AS state FROM runs WHERE framework = 'P'",
)
def failed_state_alerts(spark, d):
    return TE.failed_state_alerts(RN.full_runs(spark, d)).select("run_id", "state")


@query(
    "down_alerts",
    """WITH s AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id, epoch_us(ts) AS t, CASE WHEN event_type IN ('error', 'view', 'click') THEN 0 ELSE 1 END AS up FROM events),
 m AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t, event_id) - row_number() OVER (PARTITION BY run_id, up ORDER BY t, event_id) AS g FROM s)
SELECT run_id, min(t) AS down_since, max(t) AS last_down, count(*) AS samples FROM m WHERE up = 0 GROUP BY run_id, g HAVING max(t) - min(t) >= 60000000""",
)
def down_alerts(spark, d):
    up = F.when(F.col("event_type").isin("error", "view", "click"), 0).otherwise(1)
    rows = T.steps(spark, d).select("run_id", "ts", "event_id", up.alias("up"))
    found = TE.down_alerts(rows, "run_id", ties=("event_id",))
    return found.select("run_id", micros("down_since").alias("down_since"), micros("last_down").alias("last_down"), "samples")


# --- streams ----------------------------------------------------------------------------


def event_stream(spark, d):
    """The event table as a stream of files."""
    source = T.table(spark, d, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/events*.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _run_updates(spark, frame, keys):
    path, state = new_path(spark, "stream"), new_path(spark, "stream-checkpoint")
    progress.write_updates(frame, path, state).awaitTermination()
    return progress.latest_values(spark, path, keys)


@query("stream_counters", "SELECT event_type, CAST(sum(floor(value)) AS BIGINT) AS tokens FROM events GROUP BY 1")
def stream_counters(spark, d):
    labels = {"event_type": X.bounded_label(F.col("event_type"))}
    counters = progress.running_counters(event_stream(spark, d), labels, F.floor("value"), "tokens")
    return _run_updates(spark, counters, ["event_type"])


@query(
    "stream_windowed_rate",
    "SELECT event_type, epoch_us(ts) // 3600000000 * 3600 AS window_start, CAST(sum(floor(value)) AS BIGINT) AS increase, sum(floor(value)) / 3600 AS rate FROM events GROUP BY 1, 2",
)
def stream_windowed_rate(spark, d):
    windows = progress.windowed_increase(
        event_stream(spark, d), {"event_type": F.col("event_type")}, F.floor("value"), 3600, lateness="10 minutes"
    )
    return _run_updates(spark, windows, ["event_type", "window_start"])


@query("stream_live_commits", "SELECT user_id, count(*) AS committed FROM events WHERE event_type = 'view' GROUP BY 1")
def stream_live_commits(spark, d):
    done = event_stream(spark, d).filter("event_type = 'view'")
    return _run_updates(spark, progress.live_commits(done, "user_id"), ["user_id"])


@query(
    "stream_stall_alerts",
    """WITH g AS (SELECT CAST(user_id AS VARCHAR) AS series, epoch_us(ts) // 1000 AS l, lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts) AS r FROM events),
 w AS (SELECT max(epoch_us(ts) // 1000) - 600000 AS passed FROM events)
SELECT series, l AS last_progress_ms, l + 1200000 AS fired_at_ms, CASE WHEN r < passed THEN r END AS resumed_at_ms FROM g, w WHERE (r IS NULL OR r - l > 1200000) AND l + 1200000 < passed""",
)
def stream_stall_alerts(spark, d):
    """The stateful alert over the whole stream, written once to a table and read back."""
    path, state = new_path(spark, "alerts"), new_path(spark, "alerts-checkpoint")
    own = spark.newSession()
    own.conf.set(alerts.STATE_STORE, alerts.ROCKSDB)
    found = alerts.stall_alert_stream(event_stream(own, d), "user_id", lateness="10 minutes")
    writer = found.writeStream.format("parquet").option("path", path).option("checkpointLocation", state)
    writer.trigger(availableNow=True).start().awaitTermination()
    return alerts.split_events(spark.read.parquet(path))[0]
