"""Schemas of the files that are read (DDL)."""

QA = "array<struct<question:string,answer:string,category:int,evidence:array<string>>>"
CONVERSATION = f"struct<conversation:map<string,string>,qa:{QA}>"
QUESTION = (
    "struct<question_id:string,question_type:string,question:string,answer:string,question_date:string,"
    "answer_session_ids:array<string>,haystack_session_ids:array<string>,haystack_dates:array<string>,"
    "haystack_sessions:array<array<struct<role:string,content:string>>>>"
)

METADATA = "struct<source_unit_id:string,source_unit_ids:array<string>>"
RESULT = f"struct<id:string,memory:string,score:double,created_at:string,metadata:{METADATA}>"
CANDIDATE = f"struct<id:string,metadata:{METADATA}>"
RETRIEVAL = (
    f"struct<memories_evaluated:int,search_results:array<{RESULT}>,"
    "recall_diagnostics:struct<diagnostics_available:boolean,"
    "raw_candidates:array<struct<record:struct<record_id:string>>>,"
    f"ranked_candidates_canonical:array<{CANDIDATE}>,final_candidates_canonical:array<{CANDIDATE}>>>"
)
MEMORY_USAGE = (
    "struct<framework:string,available:boolean,prompt_tokens:bigint,completion_tokens:bigint,"
    "total_tokens:bigint,calls:bigint>"
)
PREDICTION_FIELDS = (
    "schema_version int, benchmark string, framework string, question_id string, conversation_id string, "
    "conversation_idx long, question_idx int, question_type string, question string, question_date string, "
    "ground_truth_answer string, category int, category_name string, evidence array<string>, "
    "answer_session_ids array<string>, generated_answer string, prediction string, cutoff_label string, "
    "answerer_provider string, answerer_model string, answerer_usage map<string,bigint>, "
    f"memory_internal_usage {MEMORY_USAGE}, pipeline_timing map<string,string>, retrieval {RETRIEVAL}"
)
JUDGMENT_FIELDS = (
    PREDICTION_FIELDS
    + ", scientific_fingerprint string, prediction_sha256 string, judge_input_fingerprint string, "
    "judgment string, score double, reason string, judge_provider string, judge_requested_model string, "
    "judge_model string, judge_finish_reason string, judge_usage map<string,bigint>, judge_fingerprint string"
)
TIMING_FIELDS = "conversation_idx long, question_id string, pipeline_timing map<string,string>"

MANIFEST_FIELDS = (
    "schema_version int, run_id string, scientific_fingerprint string, expected_item_ids array<string>, "
    "fingerprint_inputs struct<benchmark:string,framework:string,expected_question_ids:array<string>>"
)
COUNTS = "struct<expected:bigint,committed:bigint,failed:bigint>"
STATUS_FIELDS = (
    f"run_id string, state string, phase string, items {COUNTS}, units {COUNTS}, "
    "current_activity struct<stage:string,completed:bigint,total:bigint>"
)
REGISTRY_FIELDS = (
    "dataset_id string, benchmark string, source_url string, revision string, sha256 string, "
    "filename string, expected_schema string"
)
