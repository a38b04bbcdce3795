import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from recollect.operators import ledger as L
from recollect.operators import normalize as N
from recollect.operators import sampling as P
from recollect.operators import selection as S
from recollect.operators import timing as TM
from recollect.sources import datasets as SD
from recollect.sources import json_array, run_folder
from recollect.sources import runs as SR
from recollect.sources import sinks

CONVERSATIONS = [
    {
        "conversation": {
            "speaker_a": "Noor",
            "speaker_b": "Pavel",
            "session_1_date_time": "4:15 pm on 30 June, 2021",
            "session_1": [
                {"dia_id": "D1:1", "speaker": "Pavel", "text": "The train to Lviv was late."},
                {"dia_id": "D1:2", "speaker": "Noor", "text": "How late?"},
                {"dia_id": "D1:3", "speaker": "Pavel", "text": "Two hours.", "blip_caption": "an empty platform"},
            ],
            "session_3_date_time": "11:05 am on 19 August, 2021",
            "session_3": [{"dia_id": "D3:1", "speaker": "Noor", "text": "I sold the piano."}, {"dia_id": "D3:2", "speaker": "Pavel", "text": ""}],
            "session_2_date_time": "7:40 am on 02 July, 2021",
            "session_2": [{"dia_id": "D2:1", "speaker": "Pavel", "text": "\t"}],
        },
        "qa": [
            {"question": "What did Noor sell?", "answer": "a piano", "category": 4, "evidence": ["D3:1"]},
            {"question": "Where to?", "answer": "Lviv", "category": None, "evidence": None},
            {"question": "Hours of delay?", "answer": 2, "category": 3, "evidence": ["", "D1:1", "D1:3"]},
            {"question": "Who waited?", "category": 5, "evidence": ["D1:3"]},
        ],
    }
]
QUESTIONS = [
    {
        "question_id": "ask_41", "question_type": "multi-session", "question": "How many plants are there now?", "answer": "seven",
        "question_date": "2022/11/30 (Wed) 21:45", "answer_session_ids": ["w1", "w3"],
        "haystack_session_ids": ["w3", "w2", "w1"],
        "haystack_dates": ["2022/10/08 (Sat) 12:30", "2022/09/21 (Wed) 06:10", "2022/09/20 (Tue) 23:59", "2022/01/01 (Sat) 00:00"],
        "haystack_sessions": [
            [{"role": "assistant", "content": "Any news?"}, {"role": "user", "content": "Four more ferns."}],
            [{"role": "user", "content": "  "}],
            [{"role": "user", "content": "Three cacti arrived."}, {"role": "user", "content": "All alive."}, {"role": "assistant", "content": "Good."}],
        ],
    }
]


@pytest.fixture
def conversations(spark, tmp_path):
    path = tmp_path / "conversations.json"
    path.write_text(json.dumps(CONVERSATIONS, indent=1))
    return SD.read_locomo(spark, str(path), layout="array")


@pytest.fixture
def questions(spark, tmp_path):
    path = tmp_path / "questions.json"
    path.write_text(json.dumps(QUESTIONS))
    return SD.read_longmemeval(spark, str(path), layout="array")


def test_conversation_file_to_records(conversations):
    rows = N.conversation_records(conversations, "speaker").orderBy("record_pos").collect()
    assert [(r["record_pos"], r["record_id"], r["ingest_text"], r["role"]) for r in rows] == [
        (0, "D1:1", "Pavel: The train to Lviv was late.", "assistant"),
        (1, "D1:2", "Noor: How late?", "user"),
        (2, "D1:3", "Pavel: Two hours. Shared image: an empty platform.", "assistant"),
        (3, "D3:1", "Noor: I sold the piano.", "user"),
    ]
    assert {r["unit_id"] for r in rows} == {"conversation-0001"}


def test_question_selection_keeps_the_index(conversations):
    picked = S.enumerate_questions(conversations, [4, 3]).orderBy("question_idx").collect()
    assert [(r["question_idx"], r["question_id"], r["answer"], r["evidence"]) for r in picked] == [
        (0, "conv0_q0", "a piano", ["D3:1"]), (2, "conv0_q2", "2", ["D1:1", "D1:3"]),
    ]
    every = S.enumerate_questions(conversations)
    assert every.filter("category = 0").count() == 1
    assert S.select_conversations(every, ids=["conversation-0009"]).count() == 0
    assert S.select_conversations(every, conversation_ids=["conversation-0001"], categories=[5]).count() == 1


def test_question_file_is_chronological_and_cut_to_the_shortest_list(questions):
    row = N.normalize_haystack(questions).select(
        F.transform("sessions", lambda s: s["session_id"]).alias("ids"),
        F.transform("sessions", N.session_texts).alias("texts"),
        F.transform("sessions", N.session_messages).alias("messages"),
        F.transform("sessions", N.render_session).alias("shown"),
    ).first()
    assert row["ids"] == ["w1", "w2", "w3"]
    assert row["texts"] == [["Three cacti arrived. All alive.", "Good."], [], ["Any news? Four more ferns."]]
    assert [[tuple(m) for m in pair] for pair in row["messages"][2]] == [[("assistant", "Any news?"), ("user", "Four more ferns.")]]
    assert row["shown"][1:] == ["Session w2 (2022/09/21 (Wed) 06:10)", "Session w3 (2022/10/08 (Sat) 12:30)\nAssistant: Any news?\nUser: Four more ferns."]
    records = N.question_records(questions, "pair").orderBy("record_pos").collect()
    assert [r["record_id"] for r in records] == ["w1:pair:0", "w1:pair:1", "w3:pair:0"]
    assert N.question_records(questions, "message").count() == 5


def test_broken_conversations_are_refused(spark, tmp_path):
    path = tmp_path / "bad.json"
    path.write_text(json.dumps({"not": "an array"}))
    with pytest.raises(Exception, match="JSON array"):
        SD.read_locomo(spark, str(path), layout="array").collect()
    broken = json.loads(json.dumps(CONVERSATIONS))
    del broken[0]["conversation"]["session_1_date_time"]
    path.write_text(json.dumps(broken))
    with pytest.raises(Exception, match="no date for"):
        N.unpivot_sessions(SD.read_locomo(spark, str(path), layout="array")).collect()


def test_registry_and_pins(spark, tmp_path):
    assert SD.dataset_registry(spark).count() == 2
    data = tmp_path / "data"
    data.mkdir()
    (data / "a.json").write_text("[]")
    (data / "b.json").write_text("[1]")
    digest = hashlib.sha256(b"[]").hexdigest()
    entry = {"dataset_id": "a", "benchmark": "locomo", "source_url": "u", "revision": "r", "sha256": digest, "filename": "a.json", "expected_schema": "s"}
    listed = {"schema_version": 1, "datasets": [entry, {**entry, "dataset_id": "b", "filename": "b.json"}]}
    path = tmp_path / "registry.json"
    path.write_text(json.dumps(listed))
    wrong = SD.verify_pinned(spark, str(data), SD.dataset_registry(spark, str(path))).collect()
    assert [r["dataset_id"] for r in wrong] == ["b"]
    path.write_text(json.dumps({**listed, "datasets": [entry, entry]}))
    with pytest.raises(ValueError, match="duplicate"):
        SD.dataset_registry(spark, str(path))


def test_sample_is_written_in_its_nested_shape(spark, conversations, tmp_path):
    sample = P.sample_qa(S.enumerate_questions(conversations), 0.5, 7)
    kept = P.regroup_sample(conversations, sample)
    counts = P.sampling_counts(S.enumerate_questions(conversations), sample, ["question_idx"])
    sinks.write_sample(kept, P.sampling_manifest(counts, {"seed": 7}, False), str(tmp_path / "out"), "conversation_idx")
    again = SD.read_locomo(spark, str(tmp_path / "out" / "data"), layout="lines").first()
    assert len(again["qa"]) == 2 and again["conversation"]["speaker_a"] == "Noor"
    assert spark.read.json(str(tmp_path / "out" / "manifest")).first()["sample_count"] == 2


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value, indent=1))


def test_runs_and_latest_run(spark, tmp_path):
    for name, committed, mtime in (("older", 1, 1), ("newer", 2, 2)):
        put(tmp_path / name / "run-manifest.json", {"fingerprint_inputs": {"benchmark": "locomo", "framework": "f"}, "expected_item_ids": ["u"]})
        put(tmp_path / name / "run-status.json", {"state": "RUNNING", "items": {"expected": 10, "committed": committed}})
        os.utime(tmp_path / name / "run-status.json", (mtime, mtime))
    put(tmp_path / "broken" / "run-manifest.json", [1])
    put(tmp_path / "broken" / "run-status.json", {"state": "RUNNING"})
    runs = SR.read_runs(spark, str(tmp_path))
    assert {r["run_id"] for r in runs.collect()} == {"older", "newer"}
    newest = L.latest_run(runs).collect()
    assert [(r["run_id"], r["items"]["committed"]) for r in newest] == [("newer", 2)]


def test_predictions_follow_the_manifest(spark, tmp_path):
    expected = spark.createDataFrame([(0, "u2"), (1, "u1")], "position int, item_id string")
    for unit in ("u1", "u2"):
        put(tmp_path / "items" / unit / "predictions.json", {"predictions": [{"question_id": f"{unit}-a"}, {"question_id": f"{unit}-b"}]})
        put(tmp_path / "items" / unit / "prediction.json", {"question_id": unit})
    rows = SR.read_predictions(spark, str(tmp_path), "locomo", expected).orderBy("position").collect()
    assert [r["question_id"] for r in rows] == ["u2-a", "u2-b", "u1-a", "u1-b"]
    rows = SR.read_predictions(spark, str(tmp_path), "longmemeval", expected).orderBy("position").collect()
    assert [r["question_id"] for r in rows] == ["u2", "u1"]
    with pytest.raises(ValueError):
        SR.read_predictions(spark, str(tmp_path), "other", expected)


def test_timing_files_and_their_fallback(spark, tmp_path):
    def record(q, **timing):
        return {"question_id": q, "conversation_idx": 0, "pipeline_timing": timing}

    put(tmp_path / "judgments" / "timing" / "q1.json", record("q1", judge_ms=5.0, judge_scope="question"))
    evaluations = spark.createDataFrame([("q1", 0, {"qa_ms": "4"})], "question_id string, conversation_idx int, pipeline_timing map<string,string>")
    got = TM.timing_report(SR.read_timing(spark, str(tmp_path), evaluations)).collect()
    assert {r["stage"]: r["total_ms"] for r in got} == {"judge": 5.0, "qa": 4.0}
    put(tmp_path / "items" / "u1" / "timing.json", record("q1", ingestion_ms=9, ingestion_scope="conversation"))
    put(tmp_path / "items" / "u1" / "timing" / "q2.json", record("q2", ingestion_ms=-3, ingestion_scope="conversation", qa_ms=2))
    got = {r["stage"]: r for r in TM.timing_report(SR.read_timing(spark, str(tmp_path), evaluations)).collect()}
    # One conversation: the later record wins and its negative time counts as 0.
    assert (got["ingestion"]["scope"], got["ingestion"]["count"], got["ingestion"]["total_ms"]) == ("conversation", 1, 0.0)
    assert got["qa"]["total_ms"] == 2.0 and got["judge"]["count"] == 1
    assert SR.read_timing(spark, str(tmp_path / "nothing")).count() == 0


def test_artifacts(spark, tmp_path):
    put(tmp_path / "run" / "a" / "x.json", [1])
    put(tmp_path / "run" / "final" / "x.json", [1])
    rows = SR.artifact_manifest(spark, str(tmp_path / "run"))
    text = json.dumps([1], indent=1).encode()
    assert [tuple(r) for r in rows.collect()] == [("a/x.json", hashlib.sha256(text).hexdigest(), len(text))]
    seen = SR.artifact_manifest(spark, str(tmp_path / "run"))
    assert L.verify_manifest(rows, seen).count() == 0
    assert [r["problem"] for r in L.verify_manifest(rows, seen.withColumn("sha256", F.lit("0"))).collect()] == ["checksum"]


def test_large_files_are_hashed_block_by_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SD, "WHOLE_BYTES", 100)
    monkeypatch.setattr(SD, "BLOCK_BYTES", 64)
    contents = {f"f{n}": bytes(i % 251 for i in range(n)) for n in (1, 100, 101, 128, 5000)}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    got = {r["filename"]: (r["sha256"], r["bytes"]) for r in SD.file_digests(spark, str(tmp_path)).collect()}
    assert got == {name: (hashlib.sha256(data).hexdigest(), len(data)) for name, data in contents.items()}


def test_event_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"event":"run.started","timestamp":"2024-01-01T00:00:00.000Z","run_id":"r"}\n')
    row = SR.read_events(spark, str(tmp_path)).first()
    assert (row["event"], row["run_id"], row["phase"]) == ("run.started", "r", None)


def test_derived_evaluation_refuses_another_source(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", "a", "g", ["x"], None)],
        "generated_answer string, ground_truth_answer string, category_name string, evidence array<string>, retrieval "
        "struct<memories_evaluated:int,search_results:array<struct<metadata:struct<source_unit_id:string,source_unit_ids:array<string>>>>,"
        "recall_diagnostics:struct<diagnostics_available:boolean,raw_candidates:array<struct<record:struct<record_id:string>>>,"
        "ranked_candidates_canonical:array<struct<id:string,metadata:struct<source_unit_id:string,source_unit_ids:array<string>>>>,"
        "final_candidates_canonical:array<struct<id:string,metadata:struct<source_unit_id:string,source_unit_ids:array<string>>>>>>",
    )
    first = sinks.derive_evaluation(rows, "r", "locomo", str(tmp_path), "s1")
    assert not first["reused"] and sinks.derive_evaluation(rows, "r", "locomo", str(tmp_path), "s1")["reused"]
    with pytest.raises(ValueError, match="other evaluations"):
        sinks.derive_evaluation(rows, "r", "locomo", str(tmp_path), "s2")


def test_array_records_of_split_files(spark, tmp_path):
    """Borders lie anywhere, in strings with brackets, quotes and escapes too."""
    records = [{"a": i, "t": t} for i, t in enumerate(['x', '}', '{"[', '\\', '\\"}', 'é}\n"', "]" * 40, "", '\\\\"', "{" * 9])]
    records += [{"deep": [{"x": [1, {"y": "}"}]}, []], "o": {}}, {}, {"long": "} " * 300}] * 3
    files = {"pretty": json.dumps(records, indent=1), "plain": "  " + json.dumps(records), "none": "[ ]", "one": '[{"a":1}]\n'}
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("64", "1000", old):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = json_array.array_records(spark, str(tmp_path)).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        for name, text in files.items():
            mine = sorted((r.position, r.value) for r in rows if f"/{name}.json" in r.path)
            assert [json.loads(v) for _, v in mine] == json.loads(text) and [p for p, _ in mine] == list(range(len(mine)))


def test_run_folder_is_written_whole_or_not_at_all(spark, tmp_path):
    rows = [(f"items/u{i}/prediction.json", json.dumps({"question_id": f"q{i}"})) for i in range(30)] + [("empty.json", None)]
    files = spark.createDataFrame(rows, "path string, content string").repartition(4)
    run_folder.write_run_folder(files, str(tmp_path / "run"))
    expected = spark.createDataFrame([(i, f"u{i}") for i in range(30)], "position int, item_id string")
    got = SR.read_predictions(spark, str(tmp_path / "run"), "longmemeval", expected).orderBy("position").collect()
    assert [r["question_id"] for r in got] == [f"q{i}" for i in range(30)]
    assert (tmp_path / "run" / "empty.json").read_bytes() == b""
    broken = files.withColumn("content", F.when(F.col("path").contains("u7/"), F.raise_error(F.lit("no text"))).otherwise(F.col("content")))
    for frame, target in ((broken, "other"), (files, "run"), (files.withColumn("path", F.lit("../x")), "outside")):
        with pytest.raises(Exception):
            run_folder.write_run_folder(frame, str(tmp_path / target))
    assert [p.name for p in tmp_path.iterdir()] == ["run"]


def test_array_files_hold_neighbours_of_sparse_ids(spark):
    """Few files whatever the gaps between ids; positions count inside a range of ids."""
    from recollect.plans import dataset

    ids = [i << 31 for i in range(50)] + [7 + (i << 31) for i in range(0, 50, 2)] + [None]
    rows = dataset.array_places(spark.createDataFrame([(i,) for i in ids], "id long")).collect()
    assert {r["file"] for r in rows} == {0} and sorted(r["inside"] for r in rows) == list(range(len(ids)))
    assert [r["inside"] for r in rows if r["last"]] == [len(ids) - 1]
    want = {}
    for i in (i for i in ids if i is not None):
        want[i] = sum(j is not None and j // 4000 == i // 4000 and j < i for j in ids)
    assert {r["id"]: r["position"] for r in rows} == want | {None: 0}
