"""Usage, timing, reports and the run ledger over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical as C
from ..functions.ids import padded
from ..operators import ledger as L
from ..operators import reports as RP
from ..operators import timing as TM
from ..operators import usage as U
from ..operators.extensions import Registry
from ..session import materialize, new_path
from ..sources import datasets as SD
from ..sources import run_folder
from ..sources import runs as SR
from ..sources import schemas as S
from ..sources import sinks
from . import evaluation as EV
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


# --- usage ------------------------------------------------------------------------------


def usage_rows(spark, d):
    """Documents as evaluations whose usage maps have missing, zero and full keys."""
    kind, n = F.col("doc_id") % 5, F.col("n_chars")
    words = F.size(F.split("text", " ")).cast("bigint")

    def usage(*pairs):
        return F.create_map(*[p for k, v in pairs for p in (F.lit(k), v)])

    provider = (
        F.when(kind == 1, usage(("other", n)))
        .when(kind == 2, usage(("prompt_tokens_total", n)))
        .when(kind == 3, usage(("prompt_tokens_total", n), ("completion_tokens", words), ("total_tokens", F.lit(0).cast("bigint"))))
        .when(kind == 4, usage(("prompt_tokens_total", n), ("completion_tokens", words), ("total_tokens", n + words + 1)))
    )
    memory = F.when(
        F.col("doc_id") % 4 != 0,
        F.struct(
            F.when(F.col("doc_id") % 4 == 1, F.lit(" engine ")).alias("framework"),
            F.when(F.col("doc_id") % 4 == 2, F.lit(False)).alias("available"),
            n.alias("prompt_tokens"), words.alias("completion_tokens"), (n + words).alias("total_tokens"), F.lit(2).alias("calls"),
        ),
    )
    return T.table(spark, d, "documents").select(
        "doc_id", "lang", "source",
        provider.alias("answerer_usage"), F.col("source").alias("answerer_provider"), F.lit(" m ").alias("answerer_model"),
        F.when(F.col("doc_id") % 2 == 0, provider).alias("judge_usage"), F.lit("").alias("judge_provider"), F.col("lang").alias("judge_model"),
        memory.alias("memory_internal_usage"),
    )


_USAGE = """du AS (SELECT *, CAST(len(string_split(text, ' ')) AS BIGINT) AS w, doc_id % 5 AS kind FROM documents),
pu AS (SELECT *, CASE WHEN kind >= 2 THEN n_chars ELSE 0 END AS p, CASE WHEN kind >= 3 THEN w ELSE 0 END AS c,
  CASE kind WHEN 2 THEN n_chars WHEN 3 THEN n_chars + w WHEN 4 THEN n_chars + w + 1 ELSE 0 END AS t FROM du)"""


def _role_sql(role: str, where: str, provider: str, model: str) -> str:
    def total(x: str) -> str:
        return f"CAST(coalesce(sum({x}) FILTER ({where}), 0) AS BIGINT)"

    names = "coalesce((SELECT string_agg(DISTINCT trim({0}), ',' ORDER BY trim({0})) FROM pu WHERE trim({0}) <> ''), '')"
    return f"""SELECT '{role}' AS role, count(*) FILTER (kind >= 2 AND {where}) > 0 AS available, count(*) FILTER (NOT (kind >= 2 AND {where})) = 0 AS complete,
 count(*) AS calls, count(*) FILTER (kind >= 2 AND {where}) AS reported_calls, count(*) FILTER (NOT (kind >= 2 AND {where})) AS missing_usage_calls,
 {total('p')} AS prompt_tokens, {total('c')} AS completion_tokens, {total('t')} AS total_tokens, {names.format(provider)} AS providers, {names.format(model)} AS models FROM pu"""


def _role(spark, d, role):
    row = U.usage_by_role(usage_rows(spark, d), role)
    return row.withColumns({n: F.array_join(n, ",") for n in ("providers", "models")})


@query("usage_answerer", f"WITH {_USAGE} {_role_sql('answerer', 'TRUE', 'source', chr(39) + ' m ' + chr(39))}")
def usage_answerer(spark, d):
    return _role(spark, d, "answerer")


@query("usage_judge", f"WITH {_USAGE} {_role_sql('judge', 'doc_id % 2 = 0', chr(39) * 2, 'lang')}")
def usage_judge(spark, d):
    return _role(spark, d, "judge")


_MEMORY = """mu AS (SELECT CAST(2 * count(*) FILTER (doc_id % 4 <> 0) AS BIGINT) AS calls, CAST(sum(n_chars) FILTER (doc_id % 4 <> 0) AS BIGINT) AS prompt_tokens,
 CAST(sum(w) FILTER (doc_id % 4 <> 0) AS BIGINT) AS completion_tokens, CAST(sum(n_chars + w) FILTER (doc_id % 4 <> 0) AS BIGINT) AS total_tokens FROM du)"""


@query("memory_usage", f"WITH {_USAGE}, {_MEMORY} SELECT TRUE AS available, 'engine' AS frameworks, * FROM mu")
def memory_usage(spark, d):
    return U.memory_usage(usage_rows(spark, d)).withColumn("frameworks", F.array_join("frameworks", ","))


_COMPONENTS = f"""{_USAGE}, {_MEMORY}, comp AS (
 SELECT 'answerer' AS role, count(*) AS calls, sum(p) AS prompt_tokens, sum(c) AS completion_tokens, sum(t) AS total_tokens FROM pu
 UNION ALL SELECT 'judge', count(*), sum(p) FILTER (doc_id % 2 = 0), sum(c) FILTER (doc_id % 2 = 0), sum(t) FILTER (doc_id % 2 = 0) FROM pu
 UNION ALL SELECT 'memory_internal', calls, prompt_tokens, completion_tokens, total_tokens FROM mu)"""


@query(
    "usage_totals",
    f"""WITH {_COMPONENTS} SELECT scope, {', '.join(f'CAST(sum({f}) AS BIGINT) AS {f}' for f in U.TOTAL_FIELDS)} FROM
 (SELECT 'overall' AS scope, * FROM comp UNION ALL SELECT CASE WHEN role = 'judge' THEN 'evaluation' ELSE 'benchmark' END, * FROM comp) GROUP BY 1""",
)
def usage_totals(spark, d):
    return U.usage_totals(U.usage_components(usage_rows(spark, d)))


@query(
    "tokens_long",
    f"""WITH {_COMPONENTS} SELECT role, token_type, CAST(tokens AS BIGINT) AS tokens FROM (SELECT role, prompt_tokens AS prompt, completion_tokens AS completion, total_tokens AS total FROM comp)
 UNPIVOT (tokens FOR token_type IN (prompt, completion, total))""",
)
def tokens_long(spark, d):
    return U.tokens_long(U.usage_components(usage_rows(spark, d)))


# --- timing -----------------------------------------------------------------------------

_STAGE = "CASE event_type WHEN 'signup' THEN 'ingestion' WHEN 'click' THEN 'qa' WHEN 'view' THEN 'retrieval_pipeline' WHEN 'purchase' THEN 'answer_generation' ELSE 'judge' END"


def timing_records(spark, d):
    """Events as timing records: each measures the stage of its type, some twice per identity."""
    kind = F.col("event_type")
    stage = (
        F.when(kind == "signup", F.lit("ingestion")).when(kind == "click", F.lit("qa"))
        .when(kind == "view", F.lit("retrieval_pipeline")).when(kind == "purchase", F.lit("answer_generation"))
        .otherwise(F.lit("judge"))
    )
    at = F.col("event_id") % 4
    scope = F.when(at == 0, F.lit(" Conversation ")).when(at == 1, F.lit("batch")).when(at == 2, F.lit("question"))
    timing = F.create_map(
        F.concat(stage, F.lit("_ms")), (F.col("value") - 5.0).cast("string"), F.concat(stage, F.lit("_scope")), scope
    )
    return T.table(spark, d, "events").select(
        F.col("event_id").alias("position"), F.col("user_id").alias("conversation_idx"),
        F.when(F.col("event_id") % 7 != 0, F.concat_ws("-", "user_id", F.col("event_id") % 3)).alias("question_id"),
        timing.alias("pipeline_timing"),
    )


@query(
    "timing_report",
    f"""WITH t AS (SELECT event_id, {_STAGE} AS stage, greatest(value - 5.0, 0.0) AS ms, CASE WHEN event_id % 4 = 0 THEN 'conversation' ELSE 'question' END AS scope,
  CASE WHEN event_id % 4 = 0 THEN 'conversation:' || user_id WHEN event_id % 7 <> 0 THEN 'question:' || user_id || '-' || event_id % 3 ELSE 'index:' || event_id END AS ident FROM events),
 l AS (SELECT stage, ident, arg_max(ms, event_id) AS ms FROM t GROUP BY ALL), s AS (SELECT stage, arg_max(scope, event_id) AS scope FROM t GROUP BY 1)
SELECT stage, any_value(scope) AS scope, count(*) AS count, round(sum(ms), 6) AS total_ms, round(sum(ms) / count(*), 6) AS avg_ms, min(ms) AS min_ms, max(ms) AS max_ms
 FROM l JOIN s USING (stage) GROUP BY 1""",
)
def timing_report(spark, d):
    return TM.timing_report(timing_records(spark, d))


@query(
    "execution_seconds",
    "SELECT CAST(user_id AS VARCHAR) AS run_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS forward, 0.0::DOUBLE AS backward FROM events GROUP BY 1",
)
def execution_seconds(spark, d):
    spans = T.steps(spark, d).groupBy("run_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return spans.select(
        "run_id", TM.execution_seconds(F.col("a"), F.col("b")).alias("forward"),
        TM.execution_seconds(F.col("b"), F.col("a")).alias("backward"),
    )


@query(
    "stage_seconds",
    f"WITH {Q.RUNS} SELECT run_id, 'judge' AS stage, o_totalprice / 1000.0 AS seconds FROM runs UNION ALL SELECT run_id, 'qa', committed / 1000.0::DOUBLE FROM runs",
)
def stage_seconds(spark, d):
    def one(value):
        return F.struct(value.cast("double").alias("total_ms"))

    pipeline = F.create_map(F.lit("judge"), one(F.col("o_totalprice")), F.lit("qa"), one(F.col("committed")))
    return TM.stage_seconds(T.runs(spark, d).select("run_id", pipeline.alias("pipeline")))


@query(
    "cpu_percent",
    f"WITH {Q.RUNS} SELECT run_id, CASE WHEN expected = 0 THEN 0.0 ELSE round_even(o_totalprice / expected * 100, 3) END AS cpu_percent FROM runs",
)
def cpu_percent(spark, d):
    wall = F.col("expected").cast("double")
    return T.runs(spark, d).select("run_id", TM.cpu_percent(F.col("o_totalprice"), wall).alias("cpu_percent"))


# --- reports ----------------------------------------------------------------------------


@query(
    "run_summary",
    f"""WITH {_COMPONENTS} SELECT 'run' AS run_id, (SELECT count(*) FROM documents) AS evaluated, CAST((SELECT sum(total_tokens) FROM comp) AS BIGINT) AS total_tokens,
 (SELECT count(DISTINCT CASE WHEN event_id % 4 = 0 THEN 'conversation:' || user_id WHEN event_id % 7 <> 0 THEN 'question:' || user_id || '-' || event_id % 3 ELSE 'index:' || event_id END) FROM events WHERE event_type = 'error') AS judge_count""",
)
def run_summary(spark, d):
    rows = usage_rows(spark, d)
    counts = rows.agg(F.count(F.lit(1)).alias("evaluated"))
    run = spark.createDataFrame([("run",)], "run_id string")
    summary = RP.run_summary(run, counts, U.usage_totals(U.usage_components(rows)), timing_report(spark, d))
    return summary.select(
        "run_id", "counts.evaluated", F.col("usage")["overall"]["total_tokens"].alias("total_tokens"),
        F.col("timing")["judge"]["count"].alias("judge_count"),
    )


@query(
    "committed_item_count",
    f"""WITH {Q.QA}, c AS (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'system') = 0)
SELECT CAST(count(*) AS BIGINT) AS questions, CAST(count(DISTINCT {Q.DOCUMENT_KEY}) AS BIGINT) AS units FROM qa WHERE conv_id IN (SELECT conv_id FROM c)""",
)
def committed_item_count(spark, d):
    units = T.qa(spark, d).groupBy(T.document_key().alias("unit_id")).agg(F.collect_list("question_id").alias("question_ids"))
    turns = T.turns(spark, d)
    whole = turns.groupBy("conv_id").agg(F.count_if(F.col("role") == "system").alias("n")).filter("n = 0")
    committed = turns.join(whole, "conv_id", "left_semi").select(T.document_key().alias("unit_id")).distinct()
    items = RP.committed_item_count(units, committed, True).select(F.col("committed_items").alias("questions"))
    count = RP.committed_item_count(units, committed, False)
    return items.select("questions", count.scalar().alias("units"))


@query(
    "conversation_aggregate",
    f"""WITH {Q.ANSWERS} SELECT 'c' || conv_id AS conversation_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS item_pos, question_id, md5(generated_answer) AS answer_md5 FROM answers""",
)
def conversation_aggregate(spark, d):
    rows = T.answers(spark, d).withColumn("conversation_id", F.concat(F.lit("c"), "conv_id"))
    found = RP.conversation_aggregate(
        rows, [F.col("turn")], F.floor(F.col("turn") / 1000), ["question_id", "generated_answer"]
    )
    return found.select("conversation_id", "item_pos", "question_id", F.md5("generated_answer").alias("answer_md5"))


@query(
    "evaluator_coverage",
    """SELECT printf('run-%08d', o_orderkey) AS run_id, o_orderstatus AS framework, e AS evaluator FROM orders, (SELECT unnest(['primary_judge_score', 'rigorous_report']) AS e)
 WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F' AND l_linenumber = CASE e WHEN 'primary_judge_score' THEN 1 ELSE 2 END)""",
)
def evaluator_coverage(spark, d):
    plan = RP.evaluation_plan(T.runs(spark, d), ("F",))
    name = F.when(F.col("l_linenumber") == 1, F.lit("primary_judge_score")).when(F.col("l_linenumber") == 2, F.lit("rigorous_report"))
    reports = T.table(spark, d, "lineitem").select(
        padded("run-", F.col("l_orderkey"), 8).alias("run_id"), name.alias("evaluator"),
        F.when(F.col("l_linestatus") == "F", F.lit("COMPLETED")).otherwise(F.lit("FAILED")).alias("status"),
    )
    return RP.evaluator_coverage(plan, reports).select("run_id", "framework", "evaluator")


def _overall_json():
    return F.to_json(
        F.struct(
            F.col("o_totalprice").alias("price"), F.col("committed").alias("committed"),
            (F.col("committed") > 2).alias("flag"), F.col("expected").cast("string").alias("text"),
        )
    )


_RESULTS = """SELECT run_id, CASE WHEN o_custkey % 2 = 0 THEN 'v2' ELSE 'judge' END AS evaluator, 'price' AS metric, o_totalprice AS value FROM runs
UNION ALL SELECT run_id, CASE WHEN o_custkey % 2 = 0 THEN 'v2' ELSE 'judge' END, 'committed', committed::DOUBLE FROM runs"""


@query("flatten_results", f"WITH {Q.RUNS} {_RESULTS}")
def flatten_results(spark, d):
    reports = T.runs(spark, d).select(
        "run_id", F.when(F.col("o_custkey") % 2 == 0, F.lit("v2")).alias("evaluator_version"), _overall_json().alias("overall_json")
    )
    return RP.flatten_results(reports, "judge")


# --- runs -------------------------------------------------------------------------------

_LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY benchmark, framework ORDER BY modified_at DESC, run_id) AS rn FROM runs) WHERE rn = 1)"""


@query("latest_run", f"WITH {Q.RUNS}, {_LATEST} SELECT benchmark, framework, run_id, expected, committed FROM latest")
def latest_run(spark, d):
    return L.latest_run(T.runs(spark, d)).select("benchmark", "framework", "run_id", "expected", "committed")


def _counts(expected, committed):
    return F.struct(expected.alias("expected"), committed.alias("committed"), F.lit(0).cast("bigint").alias("failed"))


def with_status(runs):
    """Runs with status fields in the shape of a status file."""
    e, c = F.col("expected"), F.col("committed")
    activity = F.struct(
        F.concat(F.lit("Stage-"), "framework").alias("stage"), (c + 1).alias("completed"), e.alias("total")
    )
    state = F.when(F.col("framework") == "F", F.lit("COMPLETED")).when(F.col("framework") == "P", F.lit("FAILED_JUDGING"))
    return runs.withColumns(
        {
            "state": state,
            "phase": F.when(F.col("framework") != "P", F.lit("LATE_WORK")),
            "items": _counts(e, c),
            "units": _counts(e * 2, c),
            "current_activity": F.when(c % 2 == 0, activity),
        }
    )


def full_runs(spark, d):
    return with_status(T.runs(spark, d))


@query(
    "list_runs",
    f"""WITH {Q.RUNS} SELECT run_id, benchmark, framework, CASE framework WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'FAILED_JUDGING' ELSE CASE WHEN committed % 2 = 0 THEN 'COMPLETED' ELSE 'CREATED' END END AS state,
 committed % 2 = 0 AS completed, epoch(CASE WHEN committed % 2 = 0 THEN modified_at + INTERVAL 2 DAY WHEN expected % 2 = 0 THEN modified_at + INTERVAL 1 DAY ELSE modified_at END)::BIGINT AS updated_at,
 CASE WHEN committed % 2 = 0 THEN committed ELSE 0 END AS artifact_count FROM runs WHERE o_custkey % 3 <> 0""",
)
def list_runs(spark, d):
    c, e, t = F.col("committed"), F.col("expected"), F.col("modified_at")
    hidden = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("."), "run_id")).otherwise(F.col("run_id"))
    rows = T.runs(spark, d).select(
        hidden.alias("run_id"), "benchmark", "framework",
        F.when(F.col("framework") == "F", F.lit("COMPLETED")).when(F.col("framework") == "P", F.lit("FAILED_JUDGING")).otherwise(F.lit("")).alias("state"),
        F.lit(None).cast("string").alias("phase"), t.alias("manifest_at"),
        F.when(e % 2 == 0, t + F.expr("INTERVAL 1 DAY")).alias("status_at"),
        F.when(c % 2 == 0, t + F.expr("INTERVAL 2 DAYS")).alias("completed_at"),
        F.when(c % 2 == 0, c).alias("verified_artifact_count"),
    )
    return L.list_runs(rows).select(
        "run_id", "benchmark", "framework", "state", "completed", F.unix_timestamp("updated_at").alias("updated_at"), "artifact_count"
    )


@query(
    "progress_ratio",
    f"WITH {Q.RUNS} SELECT run_id, CASE WHEN expected = 0 THEN 0.0 ELSE committed / expected END::DOUBLE AS ratio, least(expected, committed + 1) AS activity_done FROM runs",
)
def progress_ratio(spark, d):
    return T.runs(spark, d).select(
        "run_id", L.progress_ratio(F.col("committed"), F.col("expected")).alias("ratio"),
        L.capped_activity(F.col("committed") + 1, F.col("expected")).alias("activity_done"),
    )


@query(
    "operator_status",
    f"""WITH {Q.RUNS} SELECT run_id, CASE framework WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'FAILED_JUDGING' ELSE 'UNKNOWN' END AS state,
 CASE framework WHEN 'P' THEN 'Failed during judging' ELSE 'Late Work' END AS phase_label,
 CASE WHEN expected = 0 THEN 0.0 ELSE round_even(least(100.0, committed / expected * 100.0), 1) END::DOUBLE AS percentage,
 CASE WHEN committed % 2 <> 0 OR expected = 0 THEN 0.0 ELSE round_even(least(100.0, (committed + 1) / expected * 100.0), 1) END::DOUBLE AS activity_percentage,
 committed AS items_completed, expected * 2 AS records_total, framework = 'F' AS ready_for_verification FROM runs""",
)
def operator_status(spark, d):
    return L.operator_status(full_runs(spark, d)).select(
        "run_id", "state", "phase_label", "percentage", "activity_percentage", "items_completed", "records_total", "ready_for_verification"
    )


@query(
    "latest_attempt",
    """SELECT CAST(user_id AS VARCHAR) AS run_id, a.s AS started_at, a.i AS attempt_id FROM (SELECT user_id, max({'s': strftime(ts, '%Y-%m-%d'), 'i': 'a' || event_id}) AS a FROM events GROUP BY 1)""",
)
def latest_attempt(spark, d):
    rows = T.steps(spark, d).select(
        "run_id", F.date_format("ts", "yyyy-MM-dd").alias("started_at"), F.concat(F.lit("a"), "event_id").alias("attempt_id")
    )
    return L.latest_attempt(rows)


@query(
    "terminal_items",
    """SELECT doc_id AS run_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS position, unnest(x) AS item_id FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN string_split(text, ' ') ELSE [source, lang] END AS x FROM documents)""",
)
def terminal_items(spark, d):
    rows = T.table(spark, d, "documents").select(
        F.col("doc_id").alias("run_id"),
        F.when(F.col("doc_id") % 2 == 0, F.split("text", " ")).when(F.col("doc_id") % 4 == 1, F.array().cast("array<string>")).alias("expected_question_ids"),
        F.array("source", "lang").alias("expected_item_ids"),
    )
    return L.terminal_items(rows)


# --- artifacts and resume ---------------------------------------------------------------


def _artifacts(spark, d):
    """Documents as artifacts of runs of their source."""
    return T.table(spark, d, "documents").select(
        F.col("source").alias("run_id"), F.concat_ws("/", "lang", "doc_id").alias("path"), F.sha2("text", 256).alias("sha256"),
        F.octet_length("text").cast("bigint").alias("bytes"), "doc_id",
    )


_VERIFY = """SELECT source AS run_id, CASE WHEN doc_id % 11 = 3 THEN '../' ELSE '' END || lang || '/' || doc_id AS path,
 CASE WHEN doc_id % 11 = 3 THEN 'unsafe_path' WHEN doc_id % 13 = 1 THEN 'duplicate' WHEN doc_id % 7 = 2 THEN 'missing' WHEN doc_id % 7 = 3 THEN 'size' ELSE 'checksum' END AS problem
FROM documents WHERE doc_id % 11 = 3 OR doc_id % 13 = 1 OR doc_id % 7 IN (2, 3, 4)"""


def _listed_and_seen(spark, d):
    rows = _artifacts(spark, d)
    at = F.col("doc_id")
    listed = rows.withColumn("path", F.when(at % 11 == 3, F.concat(F.lit("../"), "path")).otherwise(F.col("path")))
    listed = listed.unionByName(listed.filter("doc_id % 13 = 1"))
    seen = rows.filter("doc_id % 7 <> 2").withColumn(
        "bytes", F.when(at % 7 == 3, F.col("bytes") + 1).otherwise(F.col("bytes"))
    ).withColumn("sha256", F.when(at % 7 == 4, F.lit("0")).otherwise(F.col("sha256")))
    return listed, seen


@query("verify_manifest", _VERIFY)
def verify_manifest(spark, d):
    return L.verify_manifest(*_listed_and_seen(spark, d), keys=("run_id",))


@query(
    "manifest_count_mismatch",
    """SELECT source AS run_id, max(doc_id) % 60 AS verified_artifact_count, count(*) AS listed FROM documents GROUP BY 1 HAVING max(doc_id) % 60 <> count(*)""",
)
def manifest_count_mismatch(spark, d):
    rows = _artifacts(spark, d)
    markers = rows.groupBy("run_id").agg((F.max("doc_id") % 60).alias("verified_artifact_count"))
    return L.manifest_count_mismatch(rows, markers)


@query("artifact_manifest")
def artifact_manifest(spark, d):
    """The parquet files of the tables as the artifacts of a run."""
    return SR.artifact_manifest(spark, d)


def _units(spark, d):
    """Line items as units of the run of their order."""
    return T.table(spark, d, "lineitem").select(
        padded("run-", F.col("l_orderkey"), 8).alias("run_id"),
        F.concat_ws("-", "l_linenumber", "l_partkey").alias("unit_id"), "l_linestatus", "l_returnflag", "l_linenumber", "l_quantity",
    )


def _unit_flags(spark, d):
    """All that line items say about their units, in one pass.

    A unit counts as committed when any of its lines is filled and not returned.
    """
    bad = "l_returnflag = 'R' and l_linestatus = 'F' and l_quantity > 45"
    flags = F.lit(L.EXPECTED) + F.when(F.col("l_quantity") > 5, L.COMMITTED).otherwise(0)
    return _units(spark, d).select("run_id", "unit_id", (flags + F.when(F.expr(bad), L.BAD).otherwise(0)).alias("flags"))


_RESUME = """u AS (SELECT DISTINCT printf('run-%08d', l_orderkey) AS run_id, l_linenumber || '-' || l_partkey AS unit_id FROM lineitem),
good AS (SELECT DISTINCT printf('run-%08d', l_orderkey) AS run_id, l_linenumber || '-' || l_partkey AS unit_id FROM lineitem WHERE l_quantity > 5
 EXCEPT SELECT printf('run-%08d', l_orderkey), l_linenumber || '-' || l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 45),
restart AS (SELECT * FROM u EXCEPT SELECT * FROM good)"""


@query("restart_units", f"WITH {_RESUME} SELECT * FROM restart")
def restart_units(spark, d):
    return L.restart_units(_unit_flags(spark, d))


def _phases(spark, d):
    """One checkpoint per phase of every order; digests break where the price says so."""
    rows = T.table(spark, d, "orders").select(
        padded("run-", F.col("o_orderkey"), 8).alias("run_id"), "o_custkey", "o_orderkey",
        F.posexplode(F.array(*[F.lit(p) for p in L.PHASES])).alias("i", "phase"),
    )
    digest = F.concat_ws(":", "run_id", F.col("i").cast("string"))
    before = F.concat_ws(":", "run_id", (F.col("i") - 1).cast("string"))
    broken = F.col("o_custkey") % 7 == F.col("i")
    return rows.select(
        "run_id", "phase", (F.col("i") + 1).alias("ordinal"),
        F.when(F.col("o_custkey") % 11 == F.col("i") + 2, F.lit("FAILED")).otherwise(F.lit("COMMITTED")).alias("status"),
        F.when(F.col("i") == 0, F.when(broken, F.lit("x"))).when(broken, F.lit("x")).otherwise(before).alias("predecessor_digest"),
        digest.alias("checkpoint_digest"), "o_orderkey",
    )


@query(
    "resume_plan",
    f"""WITH {_RESUME}, r AS (SELECT run_id, count(*) AS restart_units FROM restart GROUP BY 1), runs AS (SELECT DISTINCT run_id FROM u),
 st AS (SELECT printf('run-%08d', o_orderkey) AS run_id, i, o_custkey % 7 <> i AND o_custkey % 11 <> i + 2 AND NOT (o_orderkey % 5 = 0 AND i = 3) AS ok
   FROM orders, (SELECT unnest([0, 1, 2, 3, 4]) AS i)),
 fb AS (SELECT run_id, min(i) AS i FROM st WHERE NOT ok GROUP BY 1)
SELECT runs.run_id, CASE WHEN restart_units > 0 THEN 'RUNNING' WHEN printf('x%s', runs.run_id) NOT IN (SELECT 'x' || run_id FROM st) THEN 'JUDGING'
 ELSE coalesce(['JUDGING', 'EVALUATING', 'REPORTING', 'PUBLISHING', 'VERIFYING'][fb.i + 1], 'VERIFYING') END AS next_phase, coalesce(restart_units, 0) AS restart_units
FROM runs LEFT JOIN r ON r.run_id = runs.run_id LEFT JOIN fb ON fb.run_id = runs.run_id""",
)
def resume_plan(spark, d):
    said = _phases(spark, d)
    bad = F.when((F.col("phase") == "PUBLISHING") & (F.col("o_orderkey") % 5 == 0), L.BAD).otherwise(0)
    flags = F.when(F.col("status") == "COMMITTED", L.COMMITTED).otherwise(0) + bad
    return L.resume_plan(_unit_flags(spark, d), said.withColumn("flags", flags))


@query(
    "phase_chain",
    """SELECT printf('run-%08d', o_orderkey) AS run_id, ['JUDGING', 'EVALUATING', 'REPORTING', 'PUBLISHING', 'VERIFYING'][i + 1] AS phase
 FROM orders, (SELECT unnest([0, 1, 2, 3, 4]) AS i) WHERE o_custkey % 7 = i""",
)
def phase_chain(spark, d):
    return L.phase_chain(_phases(spark, d)).select("run_id", "phase")


# --- identity ---------------------------------------------------------------------------


@query(
    "effective_report",
    f"""WITH {Q.RUNS}, d AS (SELECT printf('run-%08d', l_orderkey) AS run_id, 'v' || l_linenumber AS v, max(l_shipdate) AS m FROM lineitem GROUP BY ALL),
 n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY m DESC, v) AS rn FROM d) WHERE rn = 1)
SELECT run_id, coalesce(n.v, 'base') AS evaluator_version, coalesce('derived ' || n.v, 'original') AS report, n.v IS NOT NULL AS is_derived FROM runs LEFT JOIN n USING (run_id)""",
)
def effective_report(spark, d):
    original = T.runs(spark, d).select("run_id", F.lit("base").alias("evaluator_version"), F.lit("original").alias("report"))
    version = F.concat(F.lit("v"), "l_linenumber")
    derived = T.table(spark, d, "lineitem").select(
        padded("run-", F.col("l_orderkey"), 8).alias("run_id"), version.alias("evaluator_version"),
        F.concat(F.lit("derived "), version).alias("report"), F.col("l_shipdate").alias("modified_at"),
    )
    return L.effective_report(original, derived)


def _identified(spark, d):
    rows = T.runs(spark, d)
    return rows.select(
        "run_id", "benchmark", "framework", "modified_at", "o_custkey",
        F.col("benchmark").alias("dataset_id"), F.lit(None).cast("string").alias("revision"),
        (F.col("o_custkey") % 2).cast("string").alias("source_sha256"), (F.col("o_custkey") % 3).cast("string").alias("materialized_sha256"),
        F.struct(F.col("expected").alias("fraction"), F.lit(7).alias("seed")).alias("sampling"),
    )


@query(
    "comparable_runs",
    f"""WITH {Q.RUNS}, {_LATEST} SELECT a.benchmark, a.run_id AS run_a, b.run_id AS run_b, a.o_custkey % 2 = b.o_custkey % 2 AND a.o_custkey % 3 = b.o_custkey % 3 AND a.expected = b.expected AS comparable
 FROM latest a JOIN latest b ON a.benchmark = b.benchmark AND a.framework = 'F' AND b.framework = 'O'""",
)
def comparable_runs(spark, d):
    newest = L.latest_run(_identified(spark, d))
    return L.comparable(newest.filter("framework = 'F'"), newest.filter("framework = 'O'"))


@query(
    "comparable_groups",
    f"""WITH {Q.RUNS} SELECT count(*) AS runs, count(DISTINCT framework) AS frameworks FROM runs GROUP BY benchmark, o_custkey % 2, o_custkey % 3, expected""",
)
def comparable_groups(spark, d):
    return L.comparable_groups(_identified(spark, d)).select("runs", "frameworks")


@query(
    "config_drift",
    """SELECT c_custkey AS config_id, sha256(c_name) AS expected, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE sha256(c_name || '!') END AS observed FROM customer WHERE c_custkey % 5 = 0 OR c_acctbal < 0""",
)
def config_drift(spark, d):
    rows = T.table(spark, d, "customer").select(F.col("c_custkey").alias("config_id"), "c_name", "c_acctbal")
    recorded = rows.select("config_id", F.sha2("c_name", 256).alias("sha256"))
    text = F.when(F.col("c_acctbal") < 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name"))
    return L.config_drift(recorded, rows.filter("config_id % 5 <> 0").select("config_id", F.sha2(text, 256).alias("sha256")))


def _fingerprint_sql(questions: str) -> str:
    return f"""sha256('{{"benchmark":"locomo","dataset":{{"name":"' || o_orderpriority || '","sha256":"' || o_custkey || '"}},"evaluation":{{}},{questions}"framework":"' || o_orderstatus
 || '","framework_config":{{"profile":"p"}},"judge_contract":{{}},"models":{{"answerer":{{"provider":"x"}},"judge":{{}}}},"schema_version":2,"selection":{{"ids":["*"]}}}}')"""


@query(
    "config_fingerprint",
    f"""SELECT o_orderkey, {_fingerprint_sql("")} AS fingerprint,
 {_fingerprint_sql("""\"expected_question_ids\":["q1","q' || o_orderkey % 2 || '"],""")} AS of_questions FROM orders""",
)
def config_fingerprint(spark, d):
    """Without and with the set of questions, of which there are two."""
    parts = F.format_string(
        '{"paths": {"out": "/tmp/%s"}, "framework": "%s", "benchmark": "locomo", "selection": {"ids": ["*"]}, '
        '"framework_config": {"profile": "p", "path": "/x"}, "models": {"answerer": {"provider": "x", "rpm": 200}}, '
        '"dataset": {"sha256": "%s", "path": "/y", "name": "%s", "revision": null}}',
        F.col("o_orderkey").cast("string"), "o_orderstatus", F.col("o_custkey").cast("string"), "o_orderpriority",
    )
    asked = F.array(F.lit("q1"), F.concat(F.lit("q"), (F.col("o_orderkey") % 2).cast("string")))
    rows = T.table(spark, d, "orders").select("o_orderkey", parts.alias("config"), asked.alias("asked"))
    config = F.col("config")
    return rows.select(
        "o_orderkey",
        L.config_fingerprint(config).alias("fingerprint"),
        L.config_fingerprint(config, expected_question_ids=F.col("asked")).alias("of_questions"),
    )


_DIGEST = """sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","text":' || CAST(to_json(text) AS VARCHAR) || '}')"""


@query("row_digest", f"SELECT doc_id, {_DIGEST} AS digest FROM documents")
def row_digest(spark, d):
    rows = T.table(spark, d, "documents").select("text", "lang", "doc_id")
    return rows.select("doc_id", C.row_digest(rows).alias("digest"))


def _level(source: str) -> str:
    return f"(SELECT p // 64 AS p, sha256(string_agg(d, chr(10) ORDER BY p)) AS d, sum(n) AS n FROM {source} GROUP BY 1)"


@query(
    "set_digest",
    f"""WITH base AS (SELECT doc_id AS p, {_DIGEST} AS d, 1 AS n FROM documents) SELECT CAST(n AS BIGINT) AS row_count, d AS set_sha256 FROM {_level(_level(_level(_level('base'))))}""",
)
def set_digest(spark, d):
    return L.set_digest(row_digest(spark, d), "digest", "doc_id", fan_in=64, levels=4)


@query(
    "redact_json",
    """SELECT c_custkey, '{"name": "' || c_name || ' token=<redacted>", "api_key": "<redacted>", "list": [{"Auth-Token": "<redacted>"}, ' || c_nationkey || ']}' AS redacted FROM customer""",
)
def redact_json(spark, d):
    document = F.format_string(
        '{"name": "%s token=abc", "api_key": {"deep": 1}, "list": [{"Auth-Token": "t"}, %s]}', "c_name", F.col("c_nationkey").cast("string")
    )
    rows = T.table(spark, d, "customer").select("c_custkey", document.alias("document"))
    return rows.select("c_custkey", C.redact_json(F.col("document")).alias("redacted"))


@query(
    "canonical_json",
    """SELECT doc_id, sha256('{"a":' || CAST(to_json(text) AS VARCHAR) || ',"b":[1,' || n_chars || ']}') AS digest FROM documents""",
)
def canonical_json(spark, d):
    document = F.concat(
        F.lit('{ "b": [1, '), F.col("n_chars").cast("string"), F.lit('],\n "a": '),
        F.get_json_object(F.to_json(F.struct(F.array("text").alias("t"))), "$"),
        F.lit("}"),
    )
    # The array around the text is taken off again: {"t":["..."]} -> "..."
    inner = F.regexp_replace(document, r'(?s)"a": \{"t":\[(.*)\]\}\}$', r'"a": $1}')
    rows = T.table(spark, d, "documents").select("doc_id", inner.alias("document"))
    return rows.select("doc_id", C.fingerprint(F.col("document")).alias("digest"))


@query("derive_evaluation", EV.ORACLES["rigorous_conversations"])
def derive_evaluation(spark, d):
    """Derive once, derive again (reused), and read the derived report back."""
    path, rows = new_path(spark, "derived"), T.evals(spark, d)
    first = sinks.derive_evaluation(rows, "run", "locomo", path, "s")
    again = sinks.derive_evaluation(rows, "run", "locomo", path, "s")
    if first["reused"] or not again["reused"]:
        raise AssertionError("a derived version must be made once and then reused")
    report = spark.read.json(f"{path}/run/{first['evaluator_version']}/rigorous_report")
    return report if "group" in report.columns else report.withColumn("group", F.lit(None).cast("string"))


# --- the long metrics table -------------------------------------------------------------


@query(
    "metrics_table",
    f"""WITH {Q.RUNS}, {_LATEST}, act AS (SELECT *, 'stage_' || lower(framework) AS stage FROM latest WHERE committed % 2 = 0),
 res AS ({_RESULTS}),
 g(benchmark, framework, metric, labels, value) AS (
 SELECT benchmark, framework, 'expected_input_records', '', expected * 2 FROM latest UNION ALL SELECT benchmark, framework, 'completed_input_records', '', committed FROM latest
 UNION ALL SELECT benchmark, framework, 'expected_evaluation_items', '', expected FROM latest UNION ALL SELECT benchmark, framework, 'completed_evaluation_items', '', committed FROM latest
 UNION ALL SELECT benchmark, framework, 'progress_ratio', '', CASE WHEN expected = 0 THEN 0 ELSE committed / expected END FROM latest
 UNION ALL SELECT benchmark, framework, 'current_activity_expected_items', 'stage=' || stage, expected FROM act
 UNION ALL SELECT benchmark, framework, 'current_activity_completed_items', 'stage=' || stage, least(expected, committed + 1) FROM act
 UNION ALL SELECT benchmark, framework, 'current_activity_progress_ratio', 'stage=' || stage, CASE WHEN expected = 0 THEN 0 ELSE least(expected, committed + 1) / expected END FROM act
 UNION ALL SELECT benchmark, framework, 'state', 'state=' || CASE framework WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'FAILED_JUDGING' ELSE 'UNKNOWN' END, 1 FROM latest
 UNION ALL SELECT benchmark, framework, 'last_update_timestamp_seconds', '', epoch(modified_at) FROM latest
 UNION ALL SELECT benchmark, framework, 'llm_tokens', 'role=' || r || ',token_type=' || t, CASE WHEN r = 'answerer' THEN CASE t WHEN 'prompt' THEN expected WHEN 'completion' THEN committed ELSE expected + committed END ELSE 0 END
   FROM latest, (SELECT unnest(['answerer', 'judge', 'memory_internal']) AS r), (SELECT unnest(['prompt', 'completion', 'total']) AS t)
 UNION ALL SELECT benchmark, framework, 'execution_seconds', '', o_totalprice FROM latest
 UNION ALL SELECT benchmark, framework, 'pipeline_duration_seconds', 'stage=judge', o_totalprice / 1000.0 FROM latest
 UNION ALL SELECT benchmark, framework, 'process_cpu_seconds', '', o_totalprice FROM latest
 UNION ALL SELECT benchmark, framework, 'average_cpu_percent', '', CASE WHEN expected = 0 THEN 0 ELSE round_even(o_totalprice / expected * 100, 3) END FROM latest
 UNION ALL SELECT benchmark, framework, 'peak_rss_bytes', '', o_custkey FROM latest
 UNION ALL SELECT benchmark, framework, 'result', 'evaluator=' || evaluator || ',metric=' || metric, value FROM latest JOIN res USING (run_id))
SELECT benchmark, framework, metric, labels, CAST(value AS DOUBLE) AS value FROM g""",
)
def metrics_table(spark, d):
    # One row per key, used by six branches: written once.
    runs = materialize(with_status(L.latest_run(T.runs(spark, d))), "latest-runs")
    keys = ["benchmark", "framework"]
    components = runs.select(
        *keys, F.lit("answerer").alias("role"), F.col("expected").alias("prompt_tokens"),
        F.col("committed").alias("completion_tokens"), (F.col("expected") + F.col("committed")).alias("total_tokens"),
    )
    pipeline = F.create_map(F.lit("judge"), F.struct(F.col("o_totalprice").alias("total_ms")))
    version = F.when(F.col("o_custkey") % 2 == 0, F.lit("v2"))
    percent = TM.cpu_percent(F.col("o_totalprice"), F.col("expected").cast("double"))
    rows = sinks.metrics_table(
        runs,
        U.tokens_long(components, keys),
        runs.select(*keys, F.col("o_totalprice").alias("seconds")),
        TM.stage_seconds(runs.select(*keys, pipeline.alias("pipeline"))),
        runs.select(*keys, F.col("o_totalprice").alias("cpu_seconds"), percent.alias("cpu_percent"), F.col("o_custkey").alias("peak_rss_bytes")),
        RP.flatten_results(runs.select(*keys, version.alias("evaluator_version"), _overall_json().alias("overall_json")), "judge"),
    )
    entries = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return rows.withColumn("labels", F.array_join(entries, ","))


# --- run folders ------------------------------------------------------------------------


def _run_folder(spark, d, *files):
    """Write (path, document) expressions of every supplier as files of a run folder."""
    path = new_path(spark, "run-folder")
    rows = T.table(spark, d, "supplier")
    each = F.explode(F.array(*[F.struct(F.expr(p).alias("path"), F.expr(c).alias("content")) for p, c in files]))
    written = rows.select(each.alias("file")).select("file.*").filter("path is not null")
    run_folder.write_run_folder(written, path)
    return path


@query(
    "read_predictions",
    """SELECT 's' || s_suppkey || '-' || i AS question_id, s_suppkey AS unit_position, CAST(i AS INTEGER) AS in_unit, s_nationkey AS category, s_name AS generated_answer
 FROM supplier, (SELECT unnest([0, 1]) AS i) WHERE s_suppkey % 5 <> 0""",
)
def read_predictions(spark, d):
    """Two predictions per supplier in a file of its own; the manifest leaves some suppliers out."""
    one = "named_struct('question_id', concat('s', s_suppkey, '-{0}'), 'category', s_nationkey, 'generated_answer', s_name)"
    both = f"to_json(named_struct('predictions', array({one.format(0)}, {one.format(1)})))"
    path = _run_folder(spark, d, ("concat('items/s', s_suppkey, '/predictions.json')", both))
    expected = T.table(spark, d, "supplier").filter("s_suppkey % 5 <> 0").select(
        F.col("s_suppkey").alias("position"), F.concat(F.lit("s"), "s_suppkey").alias("item_id")
    )
    rows = SR.read_predictions(spark, path, "locomo", expected)
    return rows.select("question_id", "position.*", "category", "generated_answer")


@query(
    "registered_reader",
    "SELECT 's' || s_suppkey AS question_id, s_name AS generated_answer FROM supplier",
)
def registered_reader(spark, d):
    """A reader of one's own, chosen by name: predictions as JSON lines."""
    path = new_path(spark, "prediction-lines")
    rows = T.table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("question_id"), "s_name")
    rows.withColumnRenamed("s_name", "generated_answer").write.json(path)
    plugins = Registry(prediction_readers={"lines": lambda p: spark.read.schema(S.PREDICTION_FIELDS).json(p)})
    return plugins.read_predictions("lines", path).select("question_id", "generated_answer")


@query(
    "write_reports",
    """SELECT 'by_nation' AS report, CAST(c_nationkey AS VARCHAR) AS key, count(*) AS n FROM customer GROUP BY c_nationkey
 UNION ALL SELECT 'by_segment', c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment""",
)
def write_reports(spark, d):
    """Two reports, written under their names and read back."""
    path = new_path(spark, "reports")
    rows = T.table(spark, d, "customer")
    keys = {"by_nation": F.col("c_nationkey").cast("string"), "by_segment": F.col("c_mktsegment")}
    sinks.write_reports({n: rows.groupBy(k.alias("key")).agg(F.count(F.lit(1)).alias("n")) for n, k in keys.items()}, path)
    read = [spark.read.schema("key string, n long").json(f"{path}/{n}").select(F.lit(n).alias("report"), "key", "n") for n in keys]
    return read[0].unionByName(read[1])


@query(
    "read_timing",
    """SELECT 's' || s_suppkey AS question_id, s_nationkey AS conversation_idx, CASE s_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS part,
 CAST(s_suppkey * 3 AS VARCHAR) AS qa_ms FROM supplier""",
)
def read_timing(spark, d):
    """Timing files in the three places where a run keeps them."""
    content = (
        "to_json(named_struct('question_id', concat('s', s_suppkey), 'conversation_idx', s_nationkey,"
        " 'pipeline_timing', map('qa_ms', cast(s_suppkey * 3 as string))))"
    )
    place = (
        "case s_suppkey % 3 when 0 then concat('items/s', s_suppkey, '/timing.json') when 1 then"
        " concat('items/s', s_suppkey, '/timing/a.json') else concat('judgments/timing/', s_suppkey, '.json') end"
    )
    rows = SR.read_timing(spark, _run_folder(spark, d, (place, content)))
    return rows.select("question_id", "conversation_idx", "position.part", F.col("pipeline_timing")["qa_ms"].alias("qa_ms"))


@query(
    "read_runs",
    """SELECT 'r' || s_suppkey AS run_id, CASE WHEN s_nationkey % 2 = 0 THEN 'b' || s_nationkey ELSE 'unknown' END AS benchmark, 'RUNNING' AS state, s_suppkey AS committed
 FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0""",
)
def read_runs(spark, d):
    """A run folder per supplier; some have an unreadable manifest, some no status."""
    manifest = (
        "case when s_suppkey % 7 = 0 then '[1' else to_json(named_struct('fingerprint_inputs',"
        " named_struct('framework', 'f', 'benchmark', if(s_nationkey % 2 = 0, concat('b', s_nationkey), null)))) end"
    )
    status = "to_json(named_struct('state', 'RUNNING', 'items', named_struct('expected', 9, 'committed', s_suppkey)))"
    path = _run_folder(
        spark, d, ("concat('r', s_suppkey, '/run-manifest.json')", manifest),
        ("if(s_suppkey % 11 = 0, null, concat('r', s_suppkey, '/run-status.json'))", status),
    )
    return SR.read_runs(spark, path).select("run_id", "benchmark", "state", F.col("items.committed").alias("committed"))


@query(
    "file_digests",
    "SELECT 'items/s' || s_suppkey || '/name.txt' AS path, sha256(s_name) AS sha256, CAST(strlen(s_name) AS BIGINT) AS bytes FROM supplier",
)
def file_digests(spark, d):
    """The artifacts of a run folder; its final copies are left out."""
    path = _run_folder(spark, d, ("concat('items/s', s_suppkey, '/name.txt')", "s_name"), ("concat('final/', s_suppkey)", "s_name"))
    return SR.artifact_manifest(spark, path)


@query(
    "dataset_registry",
    """SELECT 'd' || s_suppkey AS dataset_id, s_name AS source_url, CASE WHEN s_suppkey % 3 <> 0 THEN sha256(s_name) ELSE '' END AS sha256,
 s_suppkey || '.json' AS filename, s_suppkey % 3 <> 0 AS pinned FROM supplier""",
)
def dataset_registry(spark, d):
    """A registry of several files, one for each nation's suppliers; some sources have no pin."""
    path = new_path(spark, "registry")
    pin = F.when(F.col("s_suppkey") % 3 != 0, F.sha2("s_name", 256)).otherwise(F.lit(""))
    entry = F.struct(
        F.concat(F.lit("d"), "s_suppkey").alias("dataset_id"), F.col("s_name").alias("source_url"), pin.alias("sha256"),
        F.concat("s_suppkey", F.lit(".json")).alias("filename"),
    )
    listed = T.table(spark, d, "supplier").groupBy("s_nationkey").agg(F.to_json(F.collect_list(entry)).alias("datasets"))
    document = F.concat(F.lit('{"schema_version":1,"datasets":'), "datasets", F.lit("}"))
    name = F.concat("s_nationkey", F.lit("/registry.json"))
    run_folder.write_run_folder(listed.select(name.alias("path"), document.alias("content")), path)
    rows = SD.dataset_registry(spark, f"{path}/*")
    return rows.select("dataset_id", "source_url", "sha256", "filename", "pinned")


@query(
    "verify_pinned",
    "SELECT 'd' || s_suppkey AS dataset_id, s_suppkey || '.json' AS filename, sha256(s_name) AS sha256 FROM supplier WHERE s_suppkey % 5 = 0 AND s_suppkey % 3 <> 0",
)
def verify_pinned(spark, d):
    """Every supplier is a source; some pins are of other bytes, some sources have no pin."""
    path = _run_folder(spark, d, ("concat(s_suppkey, '.json')", "s_name"))
    pins = T.table(spark, d, "supplier").select(
        F.concat(F.lit("d"), "s_suppkey").alias("dataset_id"),
        F.concat("s_suppkey", F.lit(".json")).alias("filename"),
        F.sha2(F.when(F.col("s_suppkey") % 5 == 0, F.lit("other")).otherwise(F.col("s_name")), 256).alias("sha256"),
        (F.col("s_suppkey") % 3 != 0).alias("pinned"),
    )
    return SD.verify_pinned(spark, path, pins).select("dataset_id", "filename", "sha256")
