"""Scores, ablation, verdicts and prompts over the whole evaluation table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical as C
from ..functions import overlap as O
from ..functions import prompts as P
from ..functions import ranking as R
from ..functions import text as X
from ..functions import verdicts as V
from ..operators import ablation as AB
from ..operators import predictions as PR
from ..operators import inference as IN
from ..operators import scoring as SC
from ..operators.extensions import Evaluator, Registry
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


# --- answer text ------------------------------------------------------------------------

_DOC_TOKENS = Q.normalized_tokens("text")


@query("normalize_text", f"SELECT doc_id, array_to_string({_DOC_TOKENS}, ' ') AS normalized FROM documents")
def normalize_text(spark, d):
    return T.texts(spark, d, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("normalized"))


@query(
    "tokens",
    f"SELECT doc_id, CAST(len({_DOC_TOKENS}) AS INTEGER) AS n_tokens, "
    f"CAST(len(list_distinct({_DOC_TOKENS})) AS INTEGER) AS n_distinct FROM documents",
)
def tokens(spark, d):
    words = X.tokens(F.col("text"))
    return T.texts(spark, d, "documents").select(
        "doc_id", F.size(words).alias("n_tokens"), F.size(F.array_distinct(words)).alias("n_distinct")
    )


_ANSWER = f"WITH RECURSIVE {Q.ANSWERS}, {Q.answer_metrics()}"


@query("exact_match", f"{_ANSWER} SELECT question_id, exact_match FROM answer_metrics")
def exact_match(spark, d):
    score = X.exact_match(F.col("generated_answer"), F.col("ground_truth_answer"))
    return T.answers(spark, d).select("question_id", score.alias("exact_match"))


@query("token_f1", f"{_ANSWER} SELECT question_id, round(token_f1, 9) AS token_f1 FROM answer_metrics")
def token_f1(spark, d):
    rows = T.answers(spark, d).select(
        "question_id", O.answer_overlap(F.col("generated_answer"), F.col("ground_truth_answer"), lcs=False).alias("o")
    )
    return rows.select("question_id", F.round(O.token_f1(F.col("o")), 9).alias("token_f1"))


@query("lcs_length", f"{_ANSWER} SELECT question_id, CAST(l AS INTEGER) AS lcs FROM counts")
def lcs_length(spark, d):
    rows = T.answers(spark, d).select(
        "question_id", O.answer_overlap(F.col("generated_answer"), F.col("ground_truth_answer")).alias("o")
    )
    return rows.select("question_id", F.col("o.lcs").alias("lcs"))


@query("rouge_l", f"{_ANSWER} SELECT question_id, round(rouge_l, 9) AS rouge_l FROM answer_metrics")
def rouge_l(spark, d):
    rows = T.answers(spark, d).select(
        "question_id", O.answer_overlap(F.col("generated_answer"), F.col("ground_truth_answer")).alias("o")
    )
    return rows.select("question_id", F.round(O.rouge_l(F.col("o")), 9).alias("rouge_l"))


@query(
    "normalize_abstention",
    f"WITH {Q.ANSWERS} SELECT question_id, {Q.abstention('generated_answer')} AS prediction, "
    f"{Q.abstention('ground_truth_answer')} AS gold FROM answers",
)
def normalize_abstention(spark, d):
    return T.answers(spark, d).select(
        "question_id",
        X.normalize_abstention(F.col("generated_answer")).alias("prediction"),
        X.normalize_abstention(F.col("ground_truth_answer")).alias("gold"),
    )


# --- retrieved ids and ranking metrics --------------------------------------------------


def _ids_oracle(mode: str) -> str:
    return f"""WITH {Q.QA}{Q.CANDIDATES}, {Q.candidate_ids('ids', 'cand', 'rnk', mode, 'rnk <= k')}
SELECT question_id, string_agg(id, ',' ORDER BY pos) AS ids, CAST(count(*) AS INTEGER) AS n FROM ids GROUP BY 1"""


def _ids(spark, d, mode):
    results = F.col("retrieval.search_results")
    k = R.cutoff_k(F.col("retrieval.memories_evaluated"), results)
    ids = R.retrieved_ids(results, k, mode)
    return T.evals(spark, d).select("question_id", F.array_join(ids, ",").alias("ids"), F.size(ids).alias("n"))


@query("retrieved_ids_union", _ids_oracle("union"))
def retrieved_ids_union(spark, d):
    return _ids(spark, d, "union")


@query("retrieved_ids_first", _ids_oracle("first"))
def retrieved_ids_first(spark, d):
    return _ids(spark, d, "first")


@query(
    "cutoff_k",
    f"""WITH {Q.QA}{Q.CANDIDATES} SELECT question_id, CAST(CASE WHEN min(turn) % 3 <> 0 THEN 3 ELSE count(*) END AS INTEGER) AS k
    FROM cand GROUP BY 1""",
)
def cutoff_k(spark, d):
    k = R.cutoff_k(F.col("retrieval.memories_evaluated"), F.col("retrieval.search_results"))
    return T.evals(spark, d).select("question_id", k.alias("k"))


_RANKING = f"""WITH {Q.QA}{Q.CANDIDATES}, {Q.candidate_ids('ids', 'cand', 'rnk', 'union', 'rnk <= k')}, {Q.ranking('m', 'ids')}"""


def _metric(spark, d, name):
    results = F.col("retrieval.search_results")
    ids = R.retrieved_ids(results, R.cutoff_k(F.col("retrieval.memories_evaluated"), results), "union")
    gold = R.nonempty_ids(F.col("evidence"))
    rows = T.evals(spark, d).select("question_id", ids.alias("ids"), gold.alias("g"))
    return rows.select("question_id", F.round(R.ranking_metrics(F.col("ids"), F.col("g"))[name], 9).alias(name))


for _name in SC.RETRIEVAL_METRICS:
    query(_name, f"{_RANKING} SELECT question_id, round({_name}, 9) AS {_name} FROM m")(
        lambda spark, d, _n=_name: _metric(spark, d, _n)
    )


@query(
    "nonempty_gold_ids",
    f"""WITH {Q.QA} SELECT question_id, CASE WHEN conv_id % 6 = 5 THEN '' ELSE conv_id || ':' || turn || ',' || conv_id || ':' || (turn + 1) END AS gold FROM qa""",
)
def nonempty_gold_ids(spark, d):
    doubled = F.concat("evidence", F.array(F.lit(""), F.lit(None).cast("string")), "evidence")
    return T.evals(spark, d).select("question_id", F.array_join(R.nonempty_ids(doubled), ",").alias("gold"))


# --- reports ----------------------------------------------------------------------------


def _rigorous_oracle(mode: str, group: str, prediction: str, gold: str) -> str:
    return f"""WITH RECURSIVE {Q.ANSWERS}{Q.CANDIDATES},
shown AS (SELECT question_id, 'c' || category AS category_name, question_type, {prediction} AS p0, {gold} AS g0 FROM answers),
{Q.answer_metrics('p0', 'g0', 'shown')},
{Q.candidate_ids('ids', 'cand', 'rnk', mode, 'rnk <= k')}, {Q.ranking('rm', 'ids')},
scored AS (SELECT * FROM shown JOIN answer_metrics USING (question_id) JOIN rm USING (question_id))
{Q.means(SC.METRICS, 'scored', group)}"""


@query("rigorous_conversations", _rigorous_oracle("union", "category_name", "generated_answer", "ground_truth_answer"))
def rigorous_conversations(spark, d):
    return SC.rigorous(T.evals(spark, d), "locomo")


@query(
    "rigorous_questions",
    _rigorous_oracle("first", "question_type", Q.abstention("generated_answer"), Q.abstention("ground_truth_answer")),
)
def rigorous_questions(spark, d):
    return SC.rigorous(T.evals(spark, d), "longmemeval")


@query(
    "abstention_count",
    f"""WITH {Q.ANSWERS} SELECT count(*) FILTER ({Q.abstention('generated_answer')} = '__ABSTAIN__' OR {Q.abstention('ground_truth_answer')} = '__ABSTAIN__') AS abstention_count FROM answers""",
)
def abstention_count(spark, d):
    return SC.abstention_count(T.evals(spark, d))


@query(
    "cutoff_label",
    f"""WITH {Q.QA} SELECT coalesce(nullif(arg_min(CASE WHEN turn % 4 = 0 THEN 'native' ELSE '' END, question_id), ''), 'top_8') AS cutoff_label FROM qa""",
)
def cutoff_label(spark, d):
    return SC.cutoff_label(T.evals(spark, d), "question_id", 8)


_STAGES = """,
withgold AS (SELECT * FROM qa WHERE conv_id % 6 <> 5),
ranked_c AS (SELECT *, -rnk AS rrnk FROM cand WHERE conv_id % 6 <> 5),
"""


def _stage_ids(mode: str) -> str:
    return f"""{Q.candidate_ids('final_ids', 'ranked_c', 'rnk', mode)},
{Q.candidate_ids('back_ids', 'ranked_c', 'rrnk', mode)},
mapped AS (SELECT question_id, conv_id || ':' || t AS id, row_number() OVER (PARTITION BY question_id ORDER BY rnk) AS pos
           FROM ranked_c WHERE t % 3 <> 0),
ranked_ids AS (SELECT b.* FROM back_ids b JOIN qa USING (question_id) WHERE conv_id % 2 = 0
               UNION ALL SELECT f.* FROM final_ids f JOIN qa USING (question_id) WHERE conv_id % 2 <> 0),
raw_ids AS (SELECT m.* FROM mapped m JOIN qa USING (question_id) WHERE conv_id % 2 = 0
            UNION ALL SELECT r.* FROM ranked_ids r JOIN qa USING (question_id)
              WHERE conv_id % 2 <> 0 OR question_id NOT IN (SELECT question_id FROM mapped))"""


def _ablation_oracle(mode: str, group: str) -> str:
    return f"""WITH {Q.QA}{Q.CANDIDATES}{_STAGES}{_stage_ids(mode)},
{Q.ranking('m_raw', 'raw_ids', 'withgold')}, {Q.ranking('m_ranked', 'ranked_ids', 'withgold')}, {Q.ranking('m_final', 'final_ids', 'withgold')},
long AS (SELECT 'raw' AS stage, * FROM m_raw UNION ALL SELECT 'ranked', * FROM m_ranked UNION ALL SELECT 'final', * FROM m_final),
scored AS (SELECT long.*, 'c' || category AS category_name, question_type FROM long JOIN qa USING (question_id))
{Q.means(SC.RETRIEVAL_METRICS, 'scored', group, 'stage')}"""


@query("ablation_conversations", _ablation_oracle("union", "category_name"))
def ablation_conversations(spark, d):
    return AB.ablation(T.evals(spark, d), "locomo")


@query("ablation_questions", _ablation_oracle("first", "question_type"))
def ablation_questions(spark, d):
    return AB.ablation(T.evals(spark, d), "longmemeval")


def _stats_oracle(mode: str) -> str:
    # Sources of distinct turns are distinct here, so both definitions count the same rows.
    return f"""WITH {Q.QA}{Q.CANDIDATES}{_STAGES}{_stage_ids(mode)}
SELECT count(*) AS total_questions, count(*) FILTER (conv_id % 2 = 0) AS questions_with_diagnostics,
  count(*) FILTER (conv_id % 2 <> 0) AS questions_without_diagnostics,
  CAST((SELECT count(*) FROM ranked_c WHERE conv_id % 2 = 0 AND t % 3 = 0) AS BIGINT) AS raw_unmappable_candidates_total,
  round((SELECT count(*) FROM raw_ids) / count(*), 9) AS avg_candidates_raw,
  round((SELECT count(*) FROM ranked_ids) / count(*), 9) AS avg_candidates_ranked,
  round((SELECT count(*) FROM final_ids) / count(*), 9) AS avg_candidates_final FROM withgold"""


@query("ablation_stats_conversations", _stats_oracle("union"))
def ablation_stats_conversations(spark, d):
    return AB.ablation_stats(T.evals(spark, d), "locomo")


@query("ablation_stats_questions", _stats_oracle("first"))
def ablation_stats_questions(spark, d):
    return AB.ablation_stats(T.evals(spark, d), "longmemeval")


@query(
    "stage_ids",
    f"""WITH {Q.QA}{Q.CANDIDATES}{_STAGES}{_stage_ids('union')}
SELECT question_id, (SELECT string_agg(id, ',' ORDER BY pos) FROM raw_ids r WHERE r.question_id = w.question_id) AS raw_ids,
 (SELECT string_agg(id, ',' ORDER BY pos) FROM ranked_ids r WHERE r.question_id = w.question_id) AS ranked_ids,
 (SELECT string_agg(id, ',' ORDER BY pos) FROM final_ids r WHERE r.question_id = w.question_id) AS final_ids FROM withgold w""",
)
def stage_ids(spark, d):
    rows = AB.stage_rows(T.evals(spark, d), "locomo")
    return rows.select("question_id", *[F.array_join(f"{s}_ids", ",").alias(f"{s}_ids") for s in AB.STAGES])


@query(
    "record_sources",
    f"""WITH {Q.QA}{Q.CANDIDATES} SELECT question_id, 'r:' || conv_id || ':' || t AS record_id, conv_id || ':' || t AS source_id
    FROM cand WHERE conv_id % 2 = 0 AND t % 3 <> 0""",
)
def record_sources(spark, d):
    diag = "retrieval.recall_diagnostics"
    sources = AB.record_sources(
        F.col(f"{diag}.ranked_candidates_canonical"), F.col(f"{diag}.final_candidates_canonical")
    )
    return T.evals(spark, d).select("question_id", F.explode(sources).alias("record_id", "source_id"))


# --- judgments --------------------------------------------------------------------------

_JUDGED = """judged AS (SELECT d.doc_id, CASE WHEN toxic = 1 THEN '' WHEN quality = 1 THEN 'correct' ELSE 'Fail' END AS judgment,
  CAST(quality AS DOUBLE) AS score, lang FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def judged(spark, d):
    rows = T.table(spark, d, "labels").join(T.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    verdict = (
        F.when(F.col("toxic") == 1, F.lit("")).when(F.col("quality") == 1, F.lit("correct")).otherwise(F.lit("Fail"))
    )
    return rows.select("doc_id", verdict.alias("judgment"), F.col("quality").cast("double").alias("score"), "lang")


@query(
    "judge_score",
    f"""WITH {_JUDGED} SELECT CASE WHEN count(*) = count(*) FILTER (judgment <> '') THEN 'COMPLETED' ELSE 'FAILED' END AS status,
 count(*) FILTER (judgment <> '') AS judged_count, round(avg(score) FILTER (judgment <> ''), 9) AS avg_judge_score,
 round(count(*) FILTER (upper(judgment) IN ('CORRECT', 'PASS')) / count(*) FILTER (judgment <> ''), 9) AS judge_pass_rate FROM judged""",
)
def judge_score(spark, d):
    return SC.judge_score(judged(spark, d))


@query(
    "normalize_verdict",
    f"""WITH {_JUDGED} SELECT doc_id, CASE WHEN judgment = 'correct' THEN 'CORRECT' WHEN judgment = 'Fail' THEN 'WRONG' END AS verdict FROM judged""",
)
def normalize_verdict(spark, d):
    return judged(spark, d).select("doc_id", V.normalize_verdict(F.col("judgment")).alias("verdict"))


# Judge answers made from labelled documents: text verdicts, JSON objects and plain prose.
_REPLIES = """replies AS (SELECT l.doc_id, CASE
  WHEN quality = 1 AND toxic = 0 THEN 'Verdict: correct' || chr(10) || 'reason:  ' || text
  WHEN quality = 0 AND toxic = 0 THEN 'JUDGMENT : fail'
  WHEN quality = 1 THEN CAST(to_json({'label': ' correct ', 'reasoning': text}) AS VARCHAR)
  ELSE text END AS reply, text, quality, toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def replies(spark, d):
    rows = T.table(spark, d, "labels").join(T.table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    reply = (
        F.when(good & ~toxic, F.concat(F.lit("Verdict: correct\nreason:  "), "text"))
        .when(~good & ~toxic, F.lit("JUDGMENT : fail"))
        .when(good, F.to_json(F.struct(F.lit(" correct ").alias("label"), F.col("text").alias("reasoning"))))
        .otherwise(F.col("text"))
    )
    return rows.select("doc_id", reply.alias("reply")).withColumn("fields", V.judge_fields(F.col("reply")))


def _parse_oracle(text_fail: str) -> str:
    return f"""WITH {_REPLIES} SELECT doc_id,
 CASE WHEN quality = 1 THEN 'CORRECT' ELSE 'WRONG' END AS judgment, CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS score,
 md5(trim(CASE WHEN quality = 1 THEN text ELSE reply END, ' ' || chr(10) || chr(9))) AS reason_md5 FROM replies"""


def _parsed(spark, d, benchmark):
    parsed = V.parse_judge(F.col("reply"), F.col("fields"), benchmark)
    rows = replies(spark, d).select("doc_id", parsed.alias("v"))
    return rows.select("doc_id", "v.judgment", "v.score", F.md5("v.reason").alias("reason_md5"))


@query("parse_judge_conversations", _parse_oracle(""))
def parse_judge_conversations(spark, d):
    return _parsed(spark, d, "locomo")


@query("parse_judge_questions", _parse_oracle(""))
def parse_judge_questions(spark, d):
    return _parsed(spark, d, "longmemeval")


@query(
    "parse_judge_strict",
    f"""WITH {_REPLIES} SELECT doc_id, CASE WHEN quality = 0 AND toxic = 1 AND NOT regexp_matches(reply, '(?i)(VERDICT|JUDGMENT)\\s*:\\s*(CORRECT|WRONG|PASS|FAIL)')
 THEN 'no recognized verdict' END AS problem FROM replies""",
)
def parse_judge_strict(spark, d):
    problem = V.strict_parse_error(F.col("reply"), F.col("fields"), "longmemeval")
    return replies(spark, d).select("doc_id", problem.alias("problem"))


# --- answer targets and prompts ---------------------------------------------------------


@query(
    "gold_answer",
    f"WITH {Q.QA} SELECT question_id, CASE WHEN category = 5 THEN 'Not mentioned in the conversation' ELSE answer END AS gold FROM qa",
)
def gold_answer(spark, d):
    return T.qa(spark, d).select("question_id", X.gold_answer(F.col("category"), F.col("answer")).alias("gold"))


_CHOICE = "CASE turn % 4 WHEN 0 THEN ' (B) none ' WHEN 1 THEN 'A' WHEN 2 THEN '(a) x' ELSE question END"


@query(
    "normalize_category5",
    f"""WITH {Q.QA}, c AS (SELECT *, {_CHOICE} AS choice FROM qa) SELECT question_id, CASE WHEN category <> 5 THEN choice
 WHEN lower(trim(choice)) = 'b' OR starts_with(lower(trim(choice)), '(b)') THEN 'Not mentioned in the conversation'
 WHEN lower(trim(choice)) = 'a' OR starts_with(lower(trim(choice)), '(a)') THEN answer ELSE choice END AS answer FROM c""",
)
def normalize_category5(spark, d):
    at = F.col("turn") % 4
    choice = (
        F.when(at == 0, F.lit(" (B) none ")).when(at == 1, F.lit("A")).when(at == 2, F.lit("(a) x")).otherwise(F.col("question"))
    )
    return T.qa(spark, d).select(
        "question_id", X.normalize_generated_answer(F.col("category"), choice, F.col("answer")).alias("answer")
    )


def _sql_text(template: str, slots: dict[str, str]) -> str:
    """A prompt template as a SQL concatenation, for the oracle."""
    import re

    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        slot = piece[1:-1] if piece.startswith("{") else None
        if slot in slots:
            parts.append(f"coalesce({slots[slot]}, '')")
        elif piece:
            parts.append("'" + piece.replace("'", "''") + "'")
    return " || ".join(parts)


_TX = P.DEFAULT_TEXTS


@query(
    "answer_prompt_conversations",
    f"""WITH {Q.QA} SELECT question_id, {_sql_text(_TX.answer_conversation, {
        'instruction': f"CASE WHEN category = 2 THEN '{_TX.date_instruction}' END", 'context': 'answer', 'question': 'question'})} AS prompt FROM qa""",
)
def answer_prompt_conversations(spark, d):
    prompt = P.conversation_prompt(F.col("answer"), F.col("question"), F.col("category"))
    return T.qa(spark, d).select("question_id", prompt.alias("prompt"))


@query(
    "answer_prompt_questions",
    f"""WITH {Q.QA} SELECT question_id, {_sql_text(_TX.answer_question, {
        'context': 'answer', 'question': 'question', 'date': f"CASE WHEN turn % 2 = 0 THEN '2024/01/0' || (1 + turn % 8) ELSE '{_TX.no_date}' END"})} AS prompt FROM qa""",
)
def answer_prompt_questions(spark, d):
    date = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("2024/01/0"), (F.col("turn") % 8 + 1).cast("string")))
    return T.qa(spark, d).select(
        "question_id", P.question_prompt(F.col("answer"), F.col("question"), date).alias("prompt")
    )


@query(
    "judge_prompt",
    f"""WITH {Q.ANSWERS} SELECT question_id, {_sql_text(_TX.judge, {
        'extra': "concat_ws(chr(10), CASE WHEN turn % 2 = 0 THEN 'Question type:' || chr(10) || question_type || chr(10) END)",
        'question': 'question', 'gold': 'ground_truth_answer', 'answer': 'generated_answer'})} AS prompt FROM answers""",
)
def judge_prompt(spark, d):
    kind = F.when(F.col("turn") % 2 == 0, F.col("question_type")).otherwise(F.lit("  "))
    prompt = P.judge_prompt(
        F.col("question"), F.col("ground_truth_answer"), F.col("generated_answer"), kind, F.lit("")
    )
    return T.answers(spark, d).select("question_id", prompt.alias("prompt"))


# --- prediction rows --------------------------------------------------------------------


def prediction_inputs(spark, d):
    rows = T.evals(spark, d)
    questions = rows.select(
        "question_id", F.concat(F.lit("conversation-"), "conv_id").alias("conversation_id"),
        F.col("conv_id").alias("conversation_idx"), F.col("turn").alias("question_idx"), "question", "answer",
        "category", "evidence",
    )
    retrievals = rows.filter("turn % 5 <> 4").select(
        "question_id", F.trim("cutoff_label").alias("cutoff_label"),
        F.col("retrieval.search_results").alias("search_results"),
        F.col("retrieval.memories_evaluated").alias("memories_evaluated"),
        F.col("retrieval.recall_diagnostics").alias("recall_diagnostics"),
        F.lit(None).cast("struct<framework:string>").alias("memory_internal_usage"),
        F.lit(None).cast("map<string,string>").alias("pipeline_timing"),
        F.col("answer").alias("native_context"),
    )
    given = rows.select(
        "question_id", "generated_answer", F.lit(None).cast("string").alias("answerer_provider"),
        F.lit("m1").alias("answerer_model"), F.lit("stop").alias("answerer_finish_reason"),
        F.create_map(F.lit("total_tokens"), F.length("generated_answer")).alias("answerer_usage"),
        F.col("question").alias("prompt"),
    )
    return questions, retrievals, given


@query(
    "build_prediction",
    f"""WITH {Q.ANSWERS}{Q.CANDIDATES}, n AS (SELECT question_id, count(*) AS c FROM cand GROUP BY 1)
SELECT question_id, 2 AS schema_version, 'c1' AS framework, CASE WHEN category = 5 THEN 'Not mentioned in the conversation' ELSE answer END AS ground_truth_answer,
 CASE category WHEN 1 THEN 'multi-hop' WHEN 2 THEN 'temporal' WHEN 3 THEN 'open-domain' WHEN 4 THEN 'single-hop' ELSE 'adversarial' END AS category_name,
 generated_answer, '' AS answerer_provider, CASE WHEN turn % 4 = 0 AND turn % 5 <> 4 THEN 'native' ELSE 'top_unknown' END AS cutoff_label,
 CAST(CASE WHEN turn % 5 <> 4 THEN c ELSE 0 END AS INTEGER) AS total_results,
 CAST(CASE WHEN turn % 5 = 4 THEN 0 WHEN turn % 3 <> 0 THEN 3 ELSE c END AS INTEGER) AS memories_evaluated,
 CASE WHEN turn % 5 = 4 THEN 'no retrieval' END AS problem
FROM answers JOIN n USING (question_id)""",
)
def build_prediction(spark, d):
    rows = PR.build_conversation_predictions(*prediction_inputs(spark, d), "c1")
    return rows.select(
        "question_id", "schema_version", "framework", "ground_truth_answer", "category_name", "generated_answer",
        "answerer_provider", "cutoff_label", "retrieval.total_results", "retrieval.memories_evaluated", "problem",
    )


# Digests are of the rows as JSON with sorted keys and no blanks.
_JUDGED = ", ".join(
    f"""'{"," if i else "{"}"{c}":', coalesce(to_json({c}), 'null')"""
    for i, c in enumerate(("generated_answer", "ground_truth_answer", "question", "question_id"))
)


@query(
    "attach_judgment",
    f"""{_ANSWER}, digested AS (SELECT question_id, question, generated_answer, ground_truth_answer, sha256(concat({_JUDGED}, '}}')) AS prediction_sha256 FROM answers)
SELECT d.*, sha256(concat('{{"judge_fingerprint":"rubric","judge_provider":"provider","judge_requested_model":"model","prediction_sha256":"', prediction_sha256,
  '","question_id":', to_json(question_id), ',"schema_version":2}}')) AS judge_input_fingerprint,
 CASE exact_match WHEN 1 THEN 'CORRECT' ELSE 'WRONG' END AS judgment, exact_match AS score, '' AS reason, CAST(NULL AS VARCHAR) AS judgment_problem
FROM digested d JOIN answer_metrics USING (question_id)""",
)
def attach_judgment(spark, d):
    rows = T.answers(spark, d).select("question_id", "question", "generated_answer", "ground_truth_answer")
    digested = PR.with_digests(rows, "provider", "model", "rubric")
    same = X.exact_match(F.col("generated_answer"), F.col("ground_truth_answer"))
    verdicts = T.answers(spark, d).select(
        "question_id", F.when(same == 1.0, F.lit("pass")).otherwise(F.lit("fail")).alias("judgment"),
        same.alias("score"), F.lit(None).cast("string").alias("reason"),
    )
    return PR.attach_judgment(digested, verdicts)


@query(
    "resume_judging",
    f"""WITH {Q.ANSWERS}, now AS (SELECT question_id, sha256(generated_answer) AS h, turn FROM answers),
stored AS (SELECT question_id, CASE WHEN turn % 3 = 1 THEN 'old' ELSE h END AS h FROM now WHERE turn % 5 <> 2)
SELECT question_id FROM now WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.question_id = now.question_id AND s.h = now.h)""",
)
def resume_judging(spark, d):
    now = T.answers(spark, d).select(
        "question_id", F.sha2("generated_answer", 256).alias("judge_input_fingerprint"), "turn"
    )
    stored = now.filter("turn % 5 <> 2").withColumn(
        "judge_input_fingerprint",
        F.when(F.col("turn") % 3 == 1, F.lit("old")).otherwise(F.col("judge_input_fingerprint")),
    )
    return PR.resume_judging(now, stored).select("question_id")


@query(
    "context_text",
    """SELECT doc_id, md5(CASE WHEN lang = 'en' THEN text ELSE '{' || chr(10) || '  "memory": ' || CAST(to_json(text) AS VARCHAR) || chr(10) || '}' END) AS context_md5 FROM documents""",
)
def context_text(spark, d):
    plain = F.col("lang") == "en"
    rows = T.texts(spark, d, "documents").select(
        "doc_id", plain.alias("plain"),
        F.when(plain, F.col("text")).otherwise(F.to_json(F.struct(F.col("text").alias("memory")))).alias("context"),
    )
    return rows.select("doc_id", F.md5(C.context_text(F.col("context"), F.col("plain"))).alias("context_md5"))


# --- model calls with a deterministic client --------------------------------------------


def length_client():
    """A stand-in model: it answers with the length of the prompt."""

    def call(system: str, user: str) -> IN.Reply:
        return IN.Reply(f" {len(user)} ", "length", "stop", len(user), 1, len(user) + 1)

    return call


def hesitant_client():
    """A stand-in judge: odd prompts get no verdict until they carry the retry hint."""
    hint = P.DEFAULT_TEXTS.judge_retry

    def call(system: str, user: str) -> IN.Reply:
        asked_again = user.endswith(hint)
        size = len(user) - (len(hint) if asked_again else 0)
        clear = asked_again or size % 2 == 0
        return IN.Reply("VERDICT: CORRECT" if clear else "unsure", "hesitant", "stop", 10, 2, 12)

    return call


@query(
    "batch_infer",
    f"WITH {Q.QA} SELECT question_id, CAST(length(question) AS VARCHAR) AS response, CAST(length(question) + 1 AS BIGINT) AS total_tokens, 1 AS attempts, CAST(NULL AS VARCHAR) AS error FROM qa",
)
def batch_infer(spark, d):
    rows = T.qa(spark, d).select("question_id", F.col("question").alias("prompt"))
    answers = IN.batch_infer(rows, length_client, IN.CallPolicy())
    return answers.select("question_id", "response", F.col("usage")["total_tokens"].alias("total_tokens"), "attempts", "error")


@query(
    "judge_infer",
    f"""WITH {Q.QA} SELECT question_id, 'VERDICT: CORRECT' AS response, CAST(CASE WHEN length(question) % 2 = 0 THEN 12 ELSE 24 END AS BIGINT) AS total_tokens,
 CASE WHEN length(question) % 2 = 0 THEN 1 ELSE 2 END AS attempts, CAST(NULL AS VARCHAR) AS error FROM qa""",
)
def judge_infer(spark, d):
    rows = T.qa(spark, d).select("question_id", F.col("question").alias("prompt"))
    answers = IN.judge_infer(rows, hesitant_client, "locomo", IN.CallPolicy())
    return answers.select("question_id", "response", F.col("usage")["total_tokens"].alias("total_tokens"), "attempts", "error")


@query(
    "registered_answerer",
    f"WITH {Q.QA} SELECT question_id, CAST(length(question) AS VARCHAR) AS response, CAST(length(question) + 1 AS BIGINT) AS total_tokens, 1 AS attempts, CAST(NULL AS VARCHAR) AS error FROM qa",
)
def registered_answerer(spark, d):
    """The client that answers is chosen by name."""
    rows = T.qa(spark, d).select("question_id", F.col("question").alias("prompt"))
    answers = Registry(answerers={"length": length_client}).answer("length", rows)
    return answers.select("question_id", "response", F.col("usage")["total_tokens"].alias("total_tokens"), "attempts", "error")


@query(
    "registered_judge",
    f"""WITH {Q.QA} SELECT question_id, 'VERDICT: CORRECT' AS response, CAST(CASE WHEN length(question) % 2 = 0 THEN 12 ELSE 24 END AS BIGINT) AS total_tokens,
 CASE WHEN length(question) % 2 = 0 THEN 1 ELSE 2 END AS attempts, CAST(NULL AS VARCHAR) AS error FROM qa""",
)
def registered_judge(spark, d):
    """The client that judges is chosen by name."""
    rows = T.qa(spark, d).select("question_id", F.col("question").alias("prompt"))
    answers = Registry(judges={"hesitant": hesitant_client}).judge("hesitant", rows, "locomo")
    return answers.select("question_id", "response", F.col("usage")["total_tokens"].alias("total_tokens"), "attempts", "error")


@query(
    "custom_evaluator",
    f"WITH {Q.ANSWERS} SELECT question_type, CAST(sum(length(generated_answer)) AS BIGINT) AS answer_chars FROM answers GROUP BY 1",
)
def custom_evaluator(spark, d):
    def chars(rows):
        return rows.groupBy("question_type").agg(F.sum(F.length("generated_answer")).alias("answer_chars"))

    plugins = Registry(evaluators={"answer_length": Evaluator("answer_length", "answer-length-v1", chars)})
    return plugins.evaluator("answer_length", "longmemeval").run(T.evals(spark, d))
