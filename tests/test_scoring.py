import math

import pytest

from recollect.operators import ablation as AB
from recollect.operators import scoring as SC
from recollect.operators import validation as V
from recollect.operators.extensions import Evaluator, Registry

META = "struct<source_unit_id:string,source_unit_ids:array<string>>"
CAND = f"array<struct<id:string,metadata:{META}>>"
DIAG = (
    "struct<diagnostics_available:boolean,raw_candidates:array<struct<record:struct<record_id:string>>>,"
    f"ranked_candidates_canonical:{CAND},final_candidates_canonical:{CAND}>"
)
SCHEMA = (
    "question_id string, generated_answer string, ground_truth_answer string, {group} string, {gold} array<string>, "
    f"cutoff_label string, retrieval struct<memories_evaluated:int,search_results:array<struct<metadata:{META}>>,recall_diagnostics:{DIAG}>"
)
CONVERSATION = SCHEMA.format(group="category_name", gold="evidence")
QUESTION = SCHEMA.format(group="question_type", gold="answer_session_ids")


def results(*sources):
    return [((s if isinstance(s, tuple) else (s, None)),) for s in sources]


def row(i, answer, gold, group, gold_ids, found, k="all", diag=None, label=None):
    shown = len(found) if k == "all" else k
    return (f"q{i}", answer, gold, group, gold_ids, label, (shown, results(*found), diag))


def overall(frame):
    return next(r.asDict() for r in frame.collect() if r["scope"] == "overall")


def by_group(frame, group):
    return next(r.asDict() for r in frame.collect() if r["scope"] == "group" and r["group"] == group)


@pytest.fixture
def question_rows(spark):
    one = [("r1", ("s-c", None))]
    return spark.createDataFrame(
        [
            row(1, "walnuts", "walnuts", "single-session-user", ["s-a"], ["s-a", "s-b"], label="native"),
            row(2, "the Lisbon visit", "the Lisbon visit", "multi-session", ["s-c"], ["s-d", "s-c"]),
            row(3, "the Lisbon visit", "the Lisbon visit", "temporal-reasoning", ["s-c"], ["s-c"], diag=(True, [], one, one)),
            row(4, "No information.", "unknown", "single-session-assistant", [], []),
        ],
        QUESTION,
    )


def test_question_scores_have_the_known_values(question_rows):
    report = SC.rigorous(question_rows, "longmemeval")
    all_rows = overall(report)
    assert all_rows["n"] == 4
    assert {m: all_rows[m] for m in SC.METRICS[:6]} == {
        "exact_match": 1.0, "token_f1": 1.0, "rouge_l": 1.0, "recall_at_k": 0.75, "precision_at_k": 0.5, "mrr": 0.625,
    }
    assert all_rows["ndcg_at_k"] == pytest.approx(0.6577324383928644, abs=1e-9)
    assert by_group(report, "multi-session")["mrr"] == 0.5
    assert by_group(report, "temporal-reasoning")["recall_at_k"] == 1.0
    assert SC.abstention_count(question_rows).first()[0] == 1
    assert SC.cutoff_label(question_rows, "question_id", 2).first()[0] == "native"


def test_question_ablation_has_the_known_values(question_rows):
    stats = AB.ablation_stats(question_rows, "longmemeval").first().asDict()
    assert (stats["total_questions"], stats["questions_with_diagnostics"], stats["questions_without_diagnostics"]) == (3, 1, 2)
    assert stats["raw_unmappable_candidates_total"] == 0
    for stage in AB.STAGES:
        assert stats[f"avg_candidates_{stage}"] == pytest.approx(5 / 3, abs=1e-9)
    final = [r for r in AB.ablation(question_rows, "longmemeval").collect() if r["stage"] == "final" and r["scope"] == "overall"]
    assert final[0]["recall_at_k"] == 1.0


def test_conversation_scores_have_the_known_values(spark):
    rows = spark.createDataFrame(
        [
            row(1, "Biscuit", "Biscuit", "multi-hop", ["T1:1"], ["T1:1", "T2:1"]),
            row(2, "mirror", "beside the hall mirror", "temporal", ["T2:1"], ["T1:1"]),
        ],
        CONVERSATION,
    )
    report = SC.rigorous(rows, "locomo")
    got = overall(report)
    assert (got["exact_match"], got["recall_at_k"], got["precision_at_k"], got["mrr"]) == (0.5, 0.5, 0.25, 0.5)
    assert by_group(report, "multi-hop")["exact_match"] == 1.0
    assert by_group(report, "temporal")["recall_at_k"] == 0.0
    assert SC.cutoff_label(rows, "question_id", 2).first()[0] == "top_2"
    assert SC.cutoff_label(rows, "question_id").first()[0] == "flat"


def test_aliases_count_once_in_union_mode_and_hide_the_list_in_first_mode(spark):
    found = [("T1:1", ["T1:1", "T1:2"]), ("T1:2", ["T1:2", "T1:3"])]
    rows = spark.createDataFrame([row(1, "Biscuit", "Biscuit", "single-hop", ["T1:1"], found)], CONVERSATION)
    got = overall(SC.rigorous(rows, "locomo"))
    assert got["ndcg_at_k"] == 1.0
    assert got["precision_at_k"] == pytest.approx(1 / 3, abs=1e-9)
    rows = spark.createDataFrame([row(1, "x", "x", "t", ["T1:1"], found)], QUESTION)
    assert overall(SC.rigorous(rows, "longmemeval"))["precision_at_k"] == 0.5


def test_cutoff_limits_scores_but_not_the_ablation(spark):
    rows = spark.createDataFrame([row(1, "x", "x", "g", ["b"], ["a", "b"], k=1)], CONVERSATION)
    assert overall(SC.rigorous(rows, "locomo"))["recall_at_k"] == 0.0
    final = [r for r in AB.ablation(rows, "locomo").collect() if r["stage"] == "final" and r["scope"] == "overall"]
    assert final[0]["recall_at_k"] == 1.0


def test_stated_zero_cutoff_is_not_a_missing_one(spark):
    rows = spark.createDataFrame(
        [row(1, "x", "x", "g", ["a"], ["a"], k=0), row(2, "x", "x", "g", ["a"], ["a"], k=None)], CONVERSATION
    )
    scored = {r["question_id"]: r["recall_at_k"] for r in SC.score_rows(rows, "locomo").collect()}
    assert scored == {"q1": 0.0, "q2": 1.0}


def test_available_but_empty_diagnostics(spark):
    rows = spark.createDataFrame([row(1, "x", "x", "g", ["a"], [], diag=(True, [], [], []))], CONVERSATION)
    stats = AB.ablation_stats(rows, "locomo").first()
    assert (stats["questions_with_diagnostics"], stats["questions_without_diagnostics"]) == (1, 0)


def test_the_two_definitions_of_unmappable_candidates(spark):
    candidates = [("r1", ("s1", None)), ("r2", ("s1", None)), ("r1", ("s9", None))]
    raw = [(("r1",),), (("r2",),), (("r3",),)]
    diag = (True, raw, candidates, [("r1", ("s1", None))])
    conv = spark.createDataFrame([row(1, "x", "x", "g", ["s1"], ["s1"], diag=diag)], CONVERSATION)
    ques = spark.createDataFrame([row(1, "x", "x", "g", ["s1"], ["s1"], diag=diag)], QUESTION)
    # r1 -> s1 (the final list wins), r2 -> s1, r3 unknown: one distinct source, two mapped records.
    assert AB.ablation_stats(conv, "locomo").first()["raw_unmappable_candidates_total"] == 2
    assert AB.ablation_stats(ques, "longmemeval").first()["raw_unmappable_candidates_total"] == 1
    assert AB.stage_rows(conv, "locomo").first()["raw_ids"] == ["s1"]


def test_scores_stay_in_bounds_and_do_not_depend_on_partitioning(spark):
    data = [
        row(i, "a b c"[: i % 6], "b c d"[: i % 5], f"g{i % 3}", [f"s{i % 4}", f"s{i % 7}"], [f"s{j}" for j in range(i % 6)])
        for i in range(60)
    ]
    frame = spark.createDataFrame(data, CONVERSATION)
    one = SC.rigorous(frame.coalesce(1), "locomo").orderBy("scope", "group").collect()
    many = SC.rigorous(frame.repartition(7), "locomo").orderBy("scope", "group").collect()
    assert one == many
    for r in SC.score_rows(frame, "locomo").collect():
        assert all(0.0 <= r[m] <= 1.0 + 1e-12 and not math.isnan(r[m]) for m in SC.METRICS)


def test_judge_score_fails_unless_all_are_judged(spark):
    rows = spark.createDataFrame([("CORRECT", 1.0), ("pass", 0.5), ("WRONG", 0.0)], "judgment string, score double")
    got = SC.judge_score(rows).first()
    assert (got["status"], got["judged_count"], got["avg_judge_score"]) == ("COMPLETED", 3, 0.5)
    assert got["judge_pass_rate"] == pytest.approx(2 / 3, abs=1e-9)
    more = rows.unionByName(spark.createDataFrame([(None, None)], rows.schema))
    assert SC.judge_score(more).first()["status"] == "FAILED"
    assert SC.judge_score(rows.limit(0)).first()["avg_judge_score"] == 0.0


def test_old_layouts_are_refused(spark):
    with pytest.raises(ValueError, match="unsupported locomo"):
        V.check_flat_rows(spark.createDataFrame([("q",)], "question string"), "locomo")
    V.check_flat_rows(spark.createDataFrame([("p",)], "prediction string"), "locomo")
    nested = spark.createDataFrame([("a", None), ("b", ("x",))], "generated_answer string, cutoff_results struct<top_1:string>")
    with pytest.raises(ValueError, match="unsupported longmemeval"):
        V.check_flat_rows(nested, "longmemeval")
    with pytest.raises(ValueError):
        V.check_flat_rows(nested.limit(0), "longmemeval")


def test_custom_evaluators_need_a_version_and_win_over_built_ins(question_rows):
    with pytest.raises(ValueError, match="evaluator_version"):
        Evaluator("mine", "", lambda df: df)
    mine = Evaluator("rigorous_report", "mine-v1", lambda df: df.groupBy().count())
    found = Registry(evaluators={"rigorous_report": mine}).evaluator("rigorous_report", "longmemeval")
    assert found.run(question_rows).first()["count"] == 4
    assert Registry().evaluator("rigorous_report", "locomo").evaluator_version == "locomo-evaluator-v2"
    with pytest.raises(KeyError):
        Registry().evaluator("nope", "locomo")
