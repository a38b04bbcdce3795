import pytest
from pyspark.sql import functions as F

from recollect.functions import prompts as P
from recollect.functions import verdicts as V
from recollect.operators import predictions as PR
from recollect.operators.inference import CallPolicy, Reply, RetryableError, batch_infer, judge_infer

ANSWERS = [
    ('{"label": "CORRECT", "reasoning": "same"}', ("CORRECT", 1.0, "same"), ("CORRECT", 1.0, "same"), None),
    ('{"judgment": "pass", "reason": "r"}', ("WRONG", 0.0, '{"judgment": "pass", "reason": "r"}'), ("CORRECT", 1.0, "r"), None),
    ('{"label": null}', ("WRONG", 0.0, '{"label": null}'), ("WRONG", 0.0, '{"label": null}'), "no recognized label"),
    ("VERDICT: correct\nREASON: it\nfits ", ("CORRECT", 1.0, "it\nfits"), ("CORRECT", 1.0, "it\nfits"), None),
    ("Judgment : FAIL", ("WRONG", 0.0, "Judgment : FAIL"), ("WRONG", 0.0, "Judgment : FAIL"), None),
    ("JUDGMENT: PASS", ("WRONG", 0.0, "JUDGMENT: PASS"), ("CORRECT", 1.0, "JUDGMENT: PASS"), None),
    ('{"label": "CORRECT"} and more', ("WRONG", 0.0, '{"label": "CORRECT"} and more'), ("WRONG", 0.0, '{"label": "CORRECT"} and more'), "no recognized verdict"),
    ("[1]", ("WRONG", 0.0, "[1]"), ("WRONG", 0.0, "[1]"), "no recognized verdict"),
    ("  ", ("WRONG", 0.0, ""), ("WRONG", 0.0, ""), "empty response"),
]


def test_lenient_and_strict_parsing(spark):
    frame = spark.createDataFrame([(a[0],) for a in ANSWERS], "t string").withColumn("f", V.judge_fields(F.col("t")))
    got = frame.select(
        V.parse_judge(F.col("t"), F.col("f"), "locomo").alias("a"),
        V.parse_judge(F.col("t"), F.col("f"), "longmemeval").alias("b"),
        V.strict_parse_error(F.col("t"), F.col("f"), "longmemeval").alias("e"),
    ).collect()
    assert [(tuple(r["a"]), tuple(r["b"]), r["e"]) for r in got] == [a[1:] for a in ANSWERS]
    assert [V.response_problem(a[0], "longmemeval") for a in ANSWERS] == [a[3] for a in ANSWERS]
    assert V.response_problem('{"judgment": "pass"}', "locomo") == "no recognized label"


def test_verdict_labels(col_values):
    rows = [("pass", None), (None, "Wrong"), (" FAIL ", "CORRECT"), ("maybe", None)]
    got = col_values("j string, l string", rows, v=V.normalize_verdict(F.col("j"), F.col("l")))
    assert [g[0] for g in got] == ["CORRECT", "WRONG", "WRONG", None]


def scripted(*steps):
    """A client factory that plays the steps in order: replies or errors."""

    def factory():
        left = list(steps)

        def call(system, user):
            step = left.pop(0)
            if isinstance(step, Exception):
                raise step
            text, finish = step if isinstance(step, tuple) else (step, "stop")
            shown = text + ("|hint" if "could not be read" in user else "")
            return Reply(shown, "m", finish, 11, 7, 18)

        return call

    return factory


NO_WAIT = CallPolicy(max_retries=2, partitions=1, sleep=lambda s: None)


def one(spark):
    return spark.createDataFrame([("q1", "ask")], "question_id string, prompt string")


def test_unreadable_answer_is_asked_again_and_all_tokens_count(spark):
    got = judge_infer(one(spark), scripted("cannot say", 'VERDICT: CORRECT'), "locomo", NO_WAIT).first()
    assert (got["attempts"], got["error"]) == (2, None)
    assert got["response"].endswith("|hint")
    assert got["usage"] == {"prompt_tokens_total": 22, "completion_tokens": 14, "total_tokens": 36}


def test_truncated_answer_is_not_scored(spark):
    got = judge_infer(one(spark), scripted(('{"label": "CORRECT"}', "length"), "VERDICT: WRONG"), "locomo", NO_WAIT).first()
    assert got["response"].startswith("VERDICT: WRONG") and got["finish_reason"] == "stop" and got["attempts"] == 2


def test_retries_are_bounded_and_failures_stay_in_their_row(spark):
    got = judge_infer(one(spark), scripted("bad", "bad"), "locomo", NO_WAIT).first()
    assert got["attempts"] == 2 and got["error"] == "no recognized verdict"
    got = batch_infer(one(spark), scripted(RetryableError("busy"), TimeoutError(), " fine "), NO_WAIT).first()
    assert (got["response"], got["error"], got["attempts"]) == ("fine", None, 1)
    got = batch_infer(one(spark), scripted(*[RetryableError("busy")] * 3), NO_WAIT).first()
    assert got["response"] is None and "busy" in got["error"]
    got = batch_infer(one(spark), scripted(ValueError("no")), NO_WAIT).first()
    assert got["error"] == "ValueError: no"


def test_request_rate_is_shared_by_the_partitions():
    assert CallPolicy(requests_per_minute=200).min_interval(1) == pytest.approx(0.3)
    assert CallPolicy(requests_per_minute=200).min_interval(10) == pytest.approx(3.0)
    assert CallPolicy().min_interval(4) == 0.0


def test_prompts(col_values):
    got = col_values(
        "c string, q string, k int, d string",
        [("ctx {question}", "Who?", 2, ""), ("ctx", "Who?", 1, "2024")],
        a=P.conversation_prompt(F.col("c"), F.col("q"), F.col("k")),
        b=P.question_prompt(F.col("c"), F.col("q"), F.col("d")),
    )
    assert P.DEFAULT_TEXTS.date_instruction in got[0][0] and P.DEFAULT_TEXTS.date_instruction not in got[1][0]
    assert "ctx {question}" in got[0][0]
    assert "Question date: (not specified)" in got[0][1] and "Question date: 2024" in got[1][1]
    judged = col_values("q string, t string", [("Who?", " kind "), ("Who?", " ")], p=P.judge_prompt(F.col("q"), F.col("q"), F.col("q"), F.col("t")))
    assert "Question type:\nkind\n" in judged[0][0] and "Question type" not in judged[1][0]


def test_only_changed_predictions_are_judged_again(spark):
    rows = spark.createDataFrame([("q1", "a"), ("q2", "b"), ("q3", "c")], "question_id string, generated_answer string")
    digested = PR.with_digests(rows, "p", "m", "rubric")
    stored = digested.filter("question_id <> 'q3'").select("question_id", "judge_input_fingerprint")
    changed = rows.withColumn("generated_answer", F.when(F.col("question_id") == "q2", F.lit("x")).otherwise(F.col("generated_answer")))
    todo = PR.resume_judging(PR.with_digests(changed, "p", "m", "rubric"), stored)
    assert {r["question_id"] for r in todo.collect()} == {"q2", "q3"}
    other_rubric = PR.resume_judging(PR.with_digests(rows, "p", "m", "rubric2"), stored)
    assert other_rubric.count() == 3
