import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from recollect.functions import canonical as C
from recollect.operators import ledger as L
from recollect.operators import ordered
from recollect.operators import reports as RP
from recollect.operators import timing as TM
from recollect.operators import usage as U
from recollect.operators import validation as V
from recollect.session import materialize, staging
from recollect.sources.runs import path_exists


def test_canonical_json_has_the_bytes_of_sorted_compact_json(col_values):
    documents = [{"b": [1, 1e-5, None], "a": {"é": "x\ny", "c": True}}, [], 0.1, "t"]
    got = col_values("t string", [(json.dumps(d, indent=3),) for d in documents], c=C.canonical_json(F.col("t")), h=C.fingerprint(F.col("t")))
    want = [json.dumps(d, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for d in documents]
    assert got == [(w, hashlib.sha256(w.encode()).hexdigest()) for w in want]


def test_fingerprint_ignores_paths_and_tuning(spark):
    base = {"benchmark": "locomo", "framework": "f", "dataset": {"sha256": "x", "path": "/a"}, "models": {"judge": {"provider": "p", "rpm": 1}}}
    moved = {**base, "dataset": {"sha256": "x", "path": "/b"}, "models": {"judge": {"provider": "p", "rpm": 9}}, "runtime": {"threads": 4}}
    other = {**base, "models": {"judge": {"provider": "q"}}}
    frame = spark.createDataFrame([(json.dumps(c),) for c in (base, moved, other)], "t string")
    a, b, c = [r[0] for r in frame.select(L.config_fingerprint(F.col("t"))).collect()]
    assert a == b != c
    ids = F.array(F.lit("q1"), F.lit("q2"))
    asked = [r[0] for r in frame.select(L.config_fingerprint(F.col("t"), expected_question_ids=ids)).collect()]
    fewer = [r[0] for r in frame.select(L.config_fingerprint(F.col("t"), expected_question_ids=F.slice(ids, 1, 1))).collect()]
    assert len({a, asked[0], fewer[0]}) == 3 and asked[0] == asked[1]


def test_secrets(col_values):
    document = json.dumps({"api_key": 1, "a": [{"db_password": "x", "token_limit": 3}], "headers": {"X-Api-Key": "k"}})
    assert col_values("t string", [(document,)], p=C.secret_paths(F.col("t"))) == [(["api_key", "a[0].db_password", "headers.X-Api-Key"],)]
    redacted = json.loads(col_values("t string", [(document,)], r=C.redact_json(F.col("t")))[0][0])
    assert redacted["a"][0] == {"db_password": "<redacted>", "token_limit": "<redacted>"}
    text = [("go Token=abc token=def end",), ("password=",), ("plain",)]
    assert [r[0] for r in col_values("t string", text, r=C.redact_text(F.col("t")))] == [
        "go Token=<redacted> token=def end", "password=<redacted>", "plain",
    ]


def test_missing_keys_zero_totals_and_names(spark):
    rows = spark.createDataFrame(
        [
            ({"prompt_tokens_total": 10, "completion_tokens": 5, "total_tokens": 0}, " p ", "m2"),
            ({"total_tokens": 7}, "p", ""),
            ({"other": 1}, None, "m1"),
            (None, "", "m1"),
        ],
        "judge_usage map<string,bigint>, judge_provider string, judge_model string",
    )
    got = U.usage_by_role(rows, "judge").first().asDict()
    assert got == {
        "role": "judge", "available": True, "complete": False, "calls": 4, "reported_calls": 2, "missing_usage_calls": 2,
        "prompt_tokens": 10, "completion_tokens": 5, "total_tokens": 22, "providers": ["p"], "models": ["m1", "m2"],
    }
    empty = U.usage_by_role(rows.limit(0), "judge").first()
    assert (empty["available"], empty["complete"], empty["total_tokens"]) == (False, True, 0)


def test_memory_usage_and_scopes(spark):
    rows = spark.createDataFrame(
        [(("f", None, 1, 2, 3, 1),), ((None, False, 10, 20, 30, 2),), (None,)],
        "memory_internal_usage struct<framework:string,available:boolean,prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint,calls:bigint>",
    )
    got = U.memory_usage(rows).first()
    assert (got["available"], got["calls"], got["total_tokens"], got["frameworks"]) == (True, 3, 33, ["f"])
    assert U.memory_usage(rows.filter("memory_internal_usage is null")).first()["available"] is False
    parts = spark.createDataFrame(
        [("answerer", 1, 1, 1, 2), ("judge", 10, 10, 10, 20), ("memory_internal", 100, 100, 100, 200)],
        "role string, calls bigint, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint",
    )
    assert {r["scope"]: r["total_tokens"] for r in U.usage_totals(parts).collect()} == {"benchmark": 202, "evaluation": 20, "overall": 222}
    long = {(r["role"], r["token_type"]): r["tokens"] for r in U.tokens_long(parts.filter("role <> 'judge'")).collect()}
    assert len(long) == 9 and long["judge", "total"] == 0 and long["answerer", "total"] == 2


def test_results_keep_numbers_only(spark):
    reports = spark.createDataFrame(
        [("r", None, '{"judge_pass_rate": 0.7, "n": 3, "ok": true, "name": "x", "text": "1.5", "none": null}')],
        "run_id string, evaluator_version string, overall_json string",
    )
    got = {r["metric"]: (r["evaluator"], r["value"]) for r in RP.flatten_results(reports, "judge").collect()}
    assert got == {"judge_pass_rate": ("judge", 0.7), "n": ("judge", 3.0)}


def test_newest_derived_report_wins(spark):
    original = spark.createDataFrame([("r1", "v1", "old"), ("r2", "v1", "kept")], "run_id string, evaluator_version string, report string")
    derived = spark.createDataFrame(
        [("r1", "v2", "new", datetime(2024, 1, 2)), ("r1", "v3", "stale", datetime(2024, 1, 1))],
        "run_id string, evaluator_version string, report string, modified_at timestamp",
    )
    got = {r["run_id"]: (r["evaluator_version"], r["report"]) for r in L.effective_report(original, derived).collect()}
    assert got == {"r1": ("v2", "new"), "r2": ("v1", "kept")}


def test_resume_plan_steps(spark):
    expected = spark.createDataFrame([("open", "u1"), ("bad", "u1"), ("done", "u1"), ("broken", "u1")], "run_id string, unit_id string")
    checkpoints = spark.createDataFrame(
        [("open", "u1", "FAILED"), ("bad", "u1", "COMMITTED"), ("done", "u1", "COMMITTED"), ("broken", "u1", "COMMITTED")],
        "run_id string, unit_id string, status string",
    )
    bad = spark.createDataFrame([("bad", "u1")], "run_id string, unit_id string")
    units = L.unit_flags(expected, checkpoints, bad)
    assert {r["run_id"] for r in L.restart_units(units).collect()} == {"open", "bad"}
    rows = []
    for run in ("done", "broken"):
        for i, phase in enumerate(L.PHASES):
            before = None if i == 0 else f"{run}{i - 1}"
            rows.append((run, phase, "COMMITTED", "other" if run == "broken" and i == 2 else before, f"{run}{i}"))
    phases = spark.createDataFrame(rows, "run_id string, phase string, status string, predecessor_digest string, checkpoint_digest string")
    none = phases.select("run_id", "phase").limit(0)
    plan = {r["run_id"]: (r["next_phase"], r["restart_units"]) for r in L.resume_plan(units, L.phase_flags(phases, none)).collect()}
    assert plan == {"open": ("RUNNING", 1), "bad": ("RUNNING", 1), "done": ("VERIFYING", 0), "broken": ("REPORTING", 0)}
    worse = phases.filter("run_id = 'done' and phase = 'JUDGING'").select("run_id", "phase")
    plan = {r["run_id"]: r["next_phase"] for r in L.resume_plan(units, L.phase_flags(phases, worse)).collect()}
    assert plan["done"] == "JUDGING"
    assert [r["run_id"] for r in L.phase_chain(L.with_ordinal(phases)).collect()] == ["broken"]


def test_state_machines(spark):
    steps = ["CREATED", "PREFLIGHT", "RUNNING", "JUDGING", "COMPLETED", "RESUMING"]
    rows = spark.createDataFrame([("r", i, s) for i, s in enumerate(steps)], "run_id string, at int, state string")
    got = V.check_transitions(rows, "run_id", [F.col("at")], F.floor(F.col("at") / 2)).orderBy("at").collect()
    assert [(r["previous"], r["state"]) for r in got] == [("JUDGING", "COMPLETED"), ("COMPLETED", "RESUMING")]
    unit = spark.createDataFrame([("u", 0, "FAILED"), ("u", 1, "PREPARING"), ("u", 2, "COMMITTED")], "unit_id string, at int, state string")
    got = V.check_transitions(unit, "unit_id", [F.col("at")], F.lit(0), V.UNIT_TRANSITIONS).collect()
    assert [(r["previous"], r["state"]) for r in got] == [("PREPARING", "COMMITTED")]


def test_manifest_problems(spark):
    schema = "path string, sha256 string, bytes bigint"
    listed = spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("c", "1", 1), ("d", "1", 1), ("d", "1", 1), ("../e", "1", 1), ("f..g", "1", 1)], schema)
    seen = spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("c", "1", 2), ("d", "1", 1), ("f..g", "1", 1)], schema)
    got = {r["path"]: r["problem"] for r in L.verify_manifest(listed, seen).collect()}
    assert got == {"b": "checksum", "c": "size", "d": "duplicate", "../e": "unsafe_path"}
    assert {r["path"]: r["problem"] for r in L.verify_manifest(listed.filter("path = 'a'"), seen.limit(0)).collect()} == {"a": "missing"}


def test_set_digest_is_one_row_at_every_size(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SLICE_ROWS", 100)
    digests = {17 * i - 900: hashlib.sha256(str(i).encode()).hexdigest() for i in range(2000)}
    frame = spark.createDataFrame(list(digests.items()), "at int, d string").repartition(5)
    level = [d for _, d in sorted(digests.items())]
    while len(level) > 1:
        level = [hashlib.sha256("\n".join(level[i : i + 4]).encode()).hexdigest() for i in range(0, len(level), 4)]
    assert [tuple(r) for r in L.set_digest(frame, "d", "at", fan_in=4).collect()] == [(2000, level[0])]


def test_set_digest_depends_on_order_not_on_partitions(spark):
    frame = spark.range(100).select(F.col("id"), F.md5(F.col("id").cast("string")).alias("d"))
    one = L.set_digest(frame, "d", "id", fan_in=7, levels=3).first()
    assert L.set_digest(frame.repartition(9), "d", "id", fan_in=7, levels=3).first() == one and one["row_count"] == 100
    swapped = frame.withColumn("id", F.when(F.col("id") < 2, 1 - F.col("id")).otherwise(F.col("id")))
    assert L.set_digest(swapped, "d", "id", fan_in=7, levels=3).first()["set_sha256"] != one["set_sha256"]


def test_shown_numbers(col_values):
    got = col_values(
        "a bigint, b bigint", [(1, 3), (5, 4), (-1, 4), (1, 0)],
        p=L.percentage(F.col("a"), F.col("b")), r=L.progress_ratio(F.col("a"), F.col("b")), c=L.capped_activity(F.col("a"), F.col("b")),
    )
    assert got == [(33.3, 1 / 3, 1), (100.0, 1.25, 4), (0.0, -0.25, -1), (0.0, 0.0, 0)]
    labels = col_values("s string, p string", [("FAILED_JUDGING", "X"), ("RUNNING", "LATE_WORK")], l=L.phase_label(F.col("s"), F.col("p")))
    assert labels == [("Failed during judging",), ("Late Work",)]
    assert col_values("c double, w double", [(31.25, 12.5), (1.0, 0.0)], p=TM.cpu_percent(F.col("c"), F.col("w"))) == [(250.0,), (0.0,)]


def test_coverage_needs_a_completed_report(spark):
    runs = spark.createDataFrame([("r1", "locomo", "f"), ("r2", "locomo", "g")], "run_id string, benchmark string, framework string")
    plan = RP.evaluation_plan(runs, ("f",))
    status = {(r["run_id"], r["evaluator"]): r["status"] for r in plan.collect()}
    assert status["r1", "ablation_report"] == "OPTIONAL" and status["r2", "ablation_report"] == "NOT_APPLICABLE"
    reports = spark.createDataFrame([("r1", e, "COMPLETED") for e in RP.REQUIRED_EVALUATORS] + [("r2", "rigorous_report", "FAILED")], "run_id string, evaluator string, status string")
    got = {(r["run_id"], r["evaluator"]) for r in RP.evaluator_coverage(plan, reports).collect()}
    assert got == {("r2", e) for e in RP.REQUIRED_EVALUATORS}


def test_incomplete_predictions_are_named(spark):
    expected = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "position int, question_id string")
    seen = spark.createDataFrame([(0, "b", 2), (1, "a", 2), (2, "a", 1), (3, "", 2)], "position int, question_id string, schema_version int")
    got = {(r["question_id"], r["problem"]) for r in V.check_complete(seen, expected).collect()}
    assert got == {("b", "order"), ("a", "duplicate"), ("a", "schema_version"), ("a", "order"), ("c", "missing"), ("", "empty_id"), ("", "unexpected")}
    with pytest.raises(ValueError, match="incomplete"):
        V.require_empty(V.check_complete(seen, expected), "incomplete")
    V.require_empty(expected.limit(0), "fine")


def test_comparable_runs_share_the_whole_sample_identity(spark):
    schema = "run_id string, benchmark string, dataset_id string, revision string, source_sha256 string, materialized_sha256 string, sampling struct<seed:int,fraction:double>"
    base = ("d", None, "s", "m", (7, 0.1))
    left = spark.createDataFrame([("a1", "x", *base), ("a2", "y", *base)], schema)
    right = spark.createDataFrame([("b1", "x", *base), ("b2", "y", *base[:4], (8, 0.1))], schema)
    got = {(r["run_a"], r["run_b"]): r["comparable"] for r in L.comparable(left, right).collect()}
    assert got == {("a1", "b1"): True, ("a2", "b2"): False}
    with pytest.raises(Exception, match="more than one run"):
        L.comparable(left.unionByName(left), right).collect()


def test_a_staging_scope_takes_its_tables_along(spark, tmp_path):
    before = materialize(spark.range(3), "kept")
    with staging(spark) as folder:
        inside = materialize(spark.range(5), "gone")
        with staging(spark) as inner:
            materialize(spark.range(2), "gone")
            assert inner.startswith(folder) and path_exists(spark, inner)
        assert not path_exists(spark, inner) and inside.count() == 5
        inside.write.parquet(str(tmp_path / "result"))
    assert not path_exists(spark, folder)
    assert before.count() == 3 and spark.read.parquet(str(tmp_path / "result")).count() == 5
    with pytest.raises(RuntimeError):
        with staging(spark) as folder:
            materialize(spark.range(1), "gone")
            raise RuntimeError
    assert not path_exists(spark, folder)
    with staging(spark):
        pass
