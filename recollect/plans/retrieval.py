"""Retrieval, provenance and usage over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import padded
from ..operators import retrieval as R
from ..operators import usage as U
from ..operators.extensions import Registry
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


# --- search -----------------------------------------------------------------------------


def _sides(spark, d):
    """Every vector is a record and a query of its own unit."""
    rows = T.vectors(spark, d)
    queries = rows.withColumnRenamed("vec_key", "query_id")
    records = rows.withColumnRenamed("vec_key", "record_id")
    return queries, records


_SCORED = f"""{Q.VECTORS},
scored AS (SELECT q.unit_id, q.vec_key AS query_id, r.vec_key AS record_id, round(list_cosine_similarity(q.e, r.e), 9) AS score
  FROM vectors q JOIN vectors r ON q.unit_id = r.unit_id)"""


def _top(source: str, k: int) -> str:
    return f"""SELECT unit_id, query_id, record_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY unit_id, query_id ORDER BY score DESC, record_id) AS INTEGER) AS rank FROM {source}) WHERE rank <= {k}"""


@query("vector_topk", f"WITH {_SCORED} {_top('scored', 10)}")
def vector_topk(spark, d):
    return R.vector_topk(*_sides(spark, d), k=10)


@query("vector_topk_blocks", f"WITH {_SCORED} {_top('scored', 8)}")
def vector_topk_blocks(spark, d):
    """The same search with units cut into many small blocks."""
    return R.vector_topk(*_sides(spark, d), k=8, block_rows=16)


@query("distance_filter", f"WITH {_SCORED}, t AS ({_top('scored', 10)}) SELECT * FROM t WHERE round(1.0 - score, 9) <= 0.85 AND rank <= 5")
def distance_filter(spark, d):
    return R.distance_filter(vector_topk(spark, d), R.DISTANCE_THRESHOLD["longmemeval"], limit=5)


@query("registered_retriever", f"WITH {_SCORED}, t AS ({_top('scored', 8)}) SELECT * FROM t WHERE round(1.0 - score, 9) <= 0.7")
def registered_retriever(spark, d):
    settings = {"k": R.TOP_K["locomo"], "threshold": R.DISTANCE_THRESHOLD["locomo"]}
    return Registry().retriever("vector", settings).retrieve(*_sides(spark, d))


_TEXTS = f"""tx AS (SELECT CAST(doc_id // 100 AS VARCHAR) AS unit_id, printf('v%08d', doc_id) AS vec_key, list_distinct({Q.normalized_tokens('text')}) AS w FROM documents),
words AS (SELECT unit_id, vec_key, unnest(w) AS w FROM tx),
lex AS (SELECT q.unit_id, q.vec_key AS query_id, r.vec_key AS record_id, round(count(*) / any_value(len(t.w)), 9) AS score
  FROM words q JOIN words r ON r.unit_id = q.unit_id AND r.w = q.w JOIN tx t ON t.vec_key = q.vec_key GROUP BY 1, 2, 3)"""


def _texts(spark, d):
    """Every document is a record and a query of its unit, which follows from its id alone."""
    rows = T.table(spark, d, "documents").select(
        F.floor(F.col("doc_id") / 100).cast("string").alias("unit_id"), padded("v", F.col("doc_id"), 8).alias("vec_key"), "text"
    )
    return rows.withColumnRenamed("vec_key", "query_id"), rows.withColumnRenamed("vec_key", "record_id")


@query("lexical_topk", f"WITH {_TEXTS} {_top('lex', 10)}")
def lexical_topk(spark, d):
    return R.lexical_topk(*_texts(spark, d), k=10)


@query(
    "multi_channel",
    f"""WITH {_SCORED}, {_TEXTS}, a AS ({_top('scored', 16)}), b AS ({_top('lex', 16)}),
 m AS (SELECT unit_id, query_id, record_id, max(score) AS score, string_agg(ch, ',' ORDER BY ch) AS channels
   FROM (SELECT *, 'raw_semantic' AS ch FROM a UNION ALL SELECT *, 'raw_lexical' FROM b) GROUP BY 1, 2, 3)
SELECT query_id, record_id, score, channels, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY unit_id, query_id ORDER BY score DESC, record_id) AS INTEGER) AS rank FROM m) WHERE rank <= 8""",
)
def multi_channel(spark, d):
    """All vectors in one channel and all texts in the other; a record needs only one of them."""
    k = R.PREFETCH_K["locomo"]
    channels = {"raw_semantic": R.vector_topk(*_sides(spark, d), k), "raw_lexical": R.lexical_topk(*_texts(spark, d), k)}
    found = R.multi_channel(channels, R.TOP_K["locomo"])
    return found.select("query_id", "record_id", "score", F.array_join("channels", ",").alias("channels"), "rank")


# --- search results ---------------------------------------------------------------------


def _raw_results(spark, d):
    """Documents as the results of queries of 20 results each, with gaps to be defaulted."""
    metadata = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("benchmark", "junk", "session_id", "question_id")]),
        F.array(F.col("lang"), F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.lit(None).cast("string")),
    )
    return T.table(spark, d, "documents").select(
        F.floor(F.col("doc_id") / 20).alias("query_id"),
        F.col("doc_id").alias("pos"),
        F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("memory"),
        F.when(F.col("doc_id") % 5 != 0, F.col("n_chars") % 7).alias("score"),
        F.col("source").alias("id"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise(F.lit("2024")).alias("created_at"),
        F.lit(None).cast("string").alias("updated_at"),
        F.when(F.col("doc_id") % 4 != 3, metadata).otherwise(F.create_map(F.lit("junk"), F.lit("x"))).alias("metadata"),
    )


@query(
    "normalize_search",
    """WITH r AS (SELECT doc_id // 20 AS query_id, doc_id AS pos, CASE WHEN doc_id % 3 <> 0 THEN text ELSE '' END AS memory,
  CASE WHEN doc_id % 5 <> 0 THEN n_chars % 7 ELSE 0 END::DOUBLE AS score, CASE WHEN doc_id % 2 <> 0 THEN '2024' END AS created_at,
  CASE WHEN doc_id % 4 = 3 THEN NULL WHEN doc_id % 2 = 0 THEN 'benchmark=' || lang || ',session_id=' || source ELSE 'benchmark=' || lang END AS metadata FROM documents)
SELECT query_id, pos, md5(memory) AS memory_md5, score, created_at, metadata, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS INTEGER) AS rank FROM r""",
)
def normalize_search(spark, d):
    rows = R.normalize_search(_raw_results(spark, d))
    entries = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return rows.select(
        "query_id", "pos", F.md5("memory").alias("memory_md5"), "score", "created_at",
        F.array_join(entries, ",").alias("metadata"), "rank",
    )


@query(
    "minimal_metadata",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END::INTEGER AS n_keys FROM documents""",
)
def minimal_metadata(spark, d):
    return _raw_results(spark, d).select(
        F.col("pos").alias("doc_id"), F.size(R.minimal_metadata(F.col("metadata"))).alias("n_keys")
    ).withColumn("n_keys", F.when(F.col("n_keys") >= 0, F.col("n_keys")))


@query(
    "extract_surface",
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END::INTEGER AS n_results, CASE WHEN doc_id % 4 < 2 THEN md5(text) END AS first_md5 FROM documents",
)
def extract_surface(spark, d):
    at = F.col("doc_id") % 4
    one = F.struct(F.col("text").alias("memory"))
    raw = (
        F.when(at == 0, F.to_json(F.struct(F.array(one).alias("results"))))
        .when(at == 1, F.to_json(F.array(one, one)))
        .when(at == 2, F.lit('{"other": 1}'))
    )
    rows = T.table(spark, d, "documents").select(
        "doc_id", R.extract_surface(raw, "struct<memory:string>").alias("s")
    )
    return rows.select("doc_id", F.size("s").alias("n_results"), F.md5(F.get("s", F.lit(0))["memory"]).alias("first_md5"))


# --- evidence ---------------------------------------------------------------------------


def _rid(turn):
    return F.concat(F.lit("r:"), T.turn_id(F.col("conv_id"), turn))


def records(spark, d):
    turn, own = F.col("turn"), T.turn_id(F.col("conv_id"), F.col("turn"))
    return T.turns(spark, d).select(
        F.col("conv_id").cast("string").alias("unit_id"),
        _rid(turn).alias("record_id"),
        F.when(turn % 5 != 4, own).alias("source_unit_id"),
        F.when(turn % 2 == 0, F.array(own, F.concat(F.lit(" c"), F.col("conv_id").cast("string")))).alias("source_unit_ids"),
        F.lit("session").alias("source_unit_type"),
        F.col("text"),
        F.concat(F.lit("t"), turn.cast("string")).alias("created_at"),
    )


def evidence(spark, d):
    turn = F.col("turn")
    return T.qa(spark, d).select(
        F.col("conv_id").cast("string").alias("unit_id"),
        F.col("question_id").alias("query_id"),
        F.concat(F.lit("e:"), "question_id").alias("evidence_id"),
        F.when(F.col("category") <= 2, F.lit("raw_turn")).otherwise(F.lit("card")).alias("evidence_type"),
        F.when(turn % 4 == 2, F.lit("")).otherwise(_rid(turn + 1)).alias("source_record_id"),
        F.array(_rid(turn), F.concat(F.lit(" "), _rid(turn + 1)), F.lit(""), _rid(turn - 1)).alias("support_record_ids"),
        F.when(F.col("category") == 1, F.lit(0.75)).alias("answerability"),
        F.when(F.col("category") <= 3, F.lit(0.5)).alias("semantic_score"),
        F.when(F.col("category") == 4, F.lit(0.25)).alias("symbolic_score"),
        F.lit(None).cast("double").alias("temporal_score"),
        F.when(turn % 2 == 0, F.array(F.lit("raw_lexical"), F.lit("raw_lexical"))).alias("channels"),
        F.lit("S").alias("subject"),
        F.when(turn % 4 != 0, F.lit("likes")).alias("predicate"),
        F.col("question").alias("object"),
        "turn",
        "category",
    )


_EVIDENCE = Q.QA + """,
rec AS (SELECT CAST(conv_id AS VARCHAR) AS unit_id, conv_id, turn, 'r:' || conv_id || ':' || turn AS record_id, text,
  CASE WHEN turn % 2 = 0 THEN [conv_id || ':' || turn, 'c' || conv_id] WHEN turn % 5 <> 4 THEN [conv_id || ':' || turn] ELSE [] END AS units FROM conversations),
ev AS (SELECT *, CASE WHEN turn % 4 = 2 THEN CASE WHEN category <= 2 THEN 'e:' || question_id ELSE '' END ELSE 'r:' || conv_id || ':' || (turn + 1) END AS src FROM qa),
sup0 AS (SELECT question_id, conv_id, 0 AS o, src AS rid FROM ev UNION ALL SELECT question_id, conv_id, 1, 'r:' || conv_id || ':' || turn FROM ev
  UNION ALL SELECT question_id, conv_id, 2, 'r:' || conv_id || ':' || (turn + 1) FROM ev UNION ALL SELECT question_id, conv_id, 4, 'r:' || conv_id || ':' || (turn - 1) FROM ev),
sup AS (SELECT question_id, conv_id, rid, min(o) AS o FROM sup0 WHERE rid <> '' GROUP BY ALL),
un0 AS (SELECT sup.question_id, o, unnest(units) AS u, generate_subscripts(units, 1) AS i FROM sup JOIN rec ON rec.record_id = sup.rid),
un AS (SELECT question_id, u, min(o * 10 + i) AS o FROM un0 GROUP BY ALL)
"""


@query(
    "support_record_ids",
    f"WITH {_EVIDENCE} SELECT question_id AS query_id, string_agg(rid, ',' ORDER BY o) AS ids FROM sup GROUP BY 1",
)
def support_record_ids(spark, d):
    rows = evidence(spark, d)
    source = F.when(
        (F.col("evidence_type") == "raw_turn") & (F.col("source_record_id") == ""), F.col("evidence_id")
    ).otherwise(F.col("source_record_id"))
    ids = R.support_record_ids(source, F.col("support_record_ids"))
    return rows.select("query_id", F.array_join(ids, ",").alias("ids"))


@query(
    "source_units_for_records",
    f"WITH {_EVIDENCE} SELECT ev.question_id AS query_id, coalesce(string_agg(u, ',' ORDER BY o), '') AS units FROM ev LEFT JOIN un ON un.question_id = ev.question_id GROUP BY 1",
)
def source_units_for_records(spark, d):
    rows = evidence(spark, d).withColumn(
        "support_record_ids", R.support_record_ids(F.col("source_record_id"), F.col("support_record_ids"))
    )
    found = R.source_units_for_records(rows, records(spark, d))
    return found.select("query_id", F.array_join("source_unit_ids", ",").alias("units"))


@query(
    "canonical_results",
    f"""WITH {_EVIDENCE}, look AS (SELECT ev.*, CASE WHEN src <> '' THEN src ELSE 'r:' || conv_id || ':' || turn END AS lk FROM ev),
u AS (SELECT question_id, string_agg(u, ',' ORDER BY o) AS units, count(*) AS n, arg_min(u, o) AS first_unit FROM un GROUP BY 1)
SELECT l.question_id AS query_id, CASE WHEN category <= 2 THEN src ELSE 'e:' || l.question_id END AS id,
 md5(CASE WHEN category <= 2 THEN coalesce(rec.text, '') ELSE coalesce(nullif(trim(rec.text, ' ' || chr(10)), ''), 'S ' || CASE WHEN l.turn % 4 <> 0 THEN 'likes ' ELSE '' END || question) END) AS memory_md5,
 CASE WHEN category = 1 THEN 0.75 WHEN category <= 3 THEN 0.5 WHEN category = 4 THEN 0.25 ELSE 0.0 END::DOUBLE AS score,
 CASE WHEN rec.turn IS NOT NULL THEN 't' || rec.turn END AS created_at, first_unit AS source_unit_id, coalesce(u.units, '') AS source_unit_ids,
 CASE WHEN n = 1 AND rec.turn IS NOT NULL THEN first_unit END AS session_id, CASE WHEN l.turn % 2 = 0 THEN 'raw_lexical' END AS channels
FROM look l LEFT JOIN rec ON rec.record_id = l.lk LEFT JOIN u ON u.question_id = l.question_id""",
)
def canonical_results(spark, d):
    rows = R.canonical_results(evidence(spark, d), records(spark, d))
    return rows.select(
        "query_id", "id", F.md5("memory").alias("memory_md5"), "score", "created_at", "metadata.source_unit_id",
        F.array_join("metadata.source_unit_ids", ",").alias("source_unit_ids"), "metadata.session_id",
        F.array_join("metadata.channels", ",").alias("channels"),
    )


@query(
    "primary_record",
    f"""WITH {Q.QA} SELECT question_id AS query_id, CASE WHEN turn % 4 = 2 THEN 'r:' || conv_id || ':' || turn ELSE 'r:' || conv_id || ':' || (turn + 1) END AS record_id FROM qa""",
)
def primary_record(spark, d):
    pair = F.array(F.struct(_rid(F.col("turn")).alias("record_id")), F.struct(_rid(F.col("turn") + 1).alias("record_id")))
    source = F.when(F.col("turn") % 4 == 2, F.lit("")).otherwise(_rid(F.col("turn") + 1))
    rows = T.qa(spark, d).select(F.col("question_id").alias("query_id"), R.primary_record(pair, source).alias("r"))
    return rows.select("query_id", "r.record_id")


@query(
    "candidate_score",
    f"WITH {Q.QA} SELECT question_id AS query_id, CASE WHEN category = 1 THEN 0.75 WHEN category <= 3 THEN 0.5 WHEN category = 4 THEN 0.25 ELSE 0.0 END::DOUBLE AS score FROM qa",
)
def candidate_score(spark, d):
    names = ("answerability", "semantic_score", "symbolic_score", "temporal_score")
    return evidence(spark, d).select("query_id", R.candidate_score(*[F.col(n) for n in names]).alias("score"))


@query(
    "evidence_text",
    f"""WITH {Q.QA} SELECT question_id AS query_id, md5(CASE WHEN turn % 3 = 0 THEN 'S ' || CASE WHEN turn % 4 <> 0 THEN 'likes ' ELSE '' END || question ELSE trim(answer, ' ' || chr(10)) END) AS text_md5 FROM qa""",
)
def evidence_text(spark, d):
    text = F.when(F.col("turn") % 3 == 0, F.lit(" \n")).otherwise(F.col("answer"))
    verb = F.when(F.col("turn") % 4 != 0, F.lit("likes"))
    value = R.evidence_text(text, F.lit("S"), verb, F.col("question"))
    return T.qa(spark, d).select(F.col("question_id").alias("query_id"), F.md5(value).alias("text_md5"))


# --- contexts ---------------------------------------------------------------------------

_CONTEXT = f"""WITH {Q.QA}, ctx AS (SELECT question_id, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE '{R.RECALLED_HEADER}' || chr(10) || answer || chr(10) || question || chr(10) || chr(10) END
 || '{R.ACTIVE_HEADER}' || chr(10) || question AS context FROM qa)"""


def contexts(spark, d):
    texts = F.when(F.col("turn") % 3 == 0, F.array(F.lit(" "), F.lit(""))).otherwise(F.array("answer", "question"))
    active = F.concat(F.lit(R.ACTIVE_HEADER + "\n"), "question")
    return T.qa(spark, d).select("question_id", "turn", R.render_context(texts, active).alias("context"))


@query("render_context", f"{_CONTEXT} SELECT question_id, md5(context) AS context_md5 FROM ctx")
def render_context(spark, d):
    return contexts(spark, d).select("question_id", F.md5("context").alias("context_md5"))


@query(
    "inspect_context",
    f"""{_CONTEXT} SELECT question_id, turn % 3 <> 0 AS recalled, turn % 5 <> 2 AS active, CASE WHEN turn % 5 = 2 THEN 'missing active header' END AS error FROM ctx""",
)
def inspect_context(spark, d):
    text = F.when(F.col("turn") % 5 == 2, F.replace("context", F.lit(R.ACTIVE_HEADER), F.lit(""))).otherwise(F.col("context"))
    rows = contexts(spark, d).select("question_id", R.inspect_context(text).alias("i"))
    return rows.select("question_id", "i.*")


# --- barriers and usage -----------------------------------------------------------------


@query(
    "ingest_barrier",
    """SELECT CAST(conv_id AS VARCHAR) AS unit_id, count(*) AS ingested_count, count(*) FILTER (role <> 'system') AS stored_count FROM conversations GROUP BY 1 HAVING count(*) <> count(*) FILTER (role <> 'system')""",
)
def ingest_barrier(spark, d):
    rows = T.turns(spark, d).withColumn("unit_id", F.col("conv_id").cast("string"))
    return R.ingest_barrier(rows, rows.filter("role <> 'system'"))


@query(
    "min_count_check",
    """SELECT source || '/' || lang AS unit, count(*) AS item_count FROM documents GROUP BY 1 HAVING count(*) < 9""",
)
def min_count_check(spark, d):
    rows = T.table(spark, d, "documents").select(F.concat_ws("/", "source", "lang").alias("unit"))
    return R.below_minimum(rows, "unit", 9, rows)


_TOTALS = """tot AS (SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS prompt_tokens, count(*) AS completion_tokens, CAST(sum(length(text)) + count(*) AS BIGINT) AS total_tokens, max(turn) AS calls FROM conversations GROUP BY 1)"""


def _totals(spark, d):
    return T.turns(spark, d).groupBy(F.col("conv_id").cast("string").alias("unit_id")).agg(
        F.sum(F.length("text")).alias("prompt_tokens"), F.count(F.lit(1)).alias("completion_tokens"),
        (F.sum(F.length("text")) + F.count(F.lit(1))).alias("total_tokens"), F.max("turn").alias("calls"),
    )


def _shares(spark, d):
    items = T.qa(spark, d).select(F.col("conv_id").cast("string").alias("unit_id"), "question_id", "turn")
    return R.apportion_usage(items, _totals(spark, d), [F.col("turn")], F.floor(F.col("turn") / 1000))


_SHARES = f"""{Q.QA}, {_TOTALS}, sh AS (SELECT question_id, {', '.join(
    f"CAST(t.{f} // n + CASE WHEN p < t.{f} % n THEN 1 ELSE 0 END AS BIGINT) AS {f}" for f in R.USAGE_FIELDS)}
 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM qa) q JOIN tot t ON t.conv_id = q.conv_id)"""


@query("apportion_usage", f"WITH {_SHARES} SELECT * FROM sh")
def apportion_usage(spark, d):
    return _shares(spark, d).select("question_id", *R.USAGE_FIELDS)


@query(
    "question_usage",
    f"""WITH {_SHARES} SELECT question_id, 'm' AS framework, TRUE AS available, prompt_tokens + CASE WHEN turn % 2 = 0 THEN 5 ELSE 0 END AS prompt_tokens, completion_tokens,
 total_tokens + CASE WHEN turn % 2 = 0 THEN 5 ELSE 0 END AS total_tokens, calls + CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS calls FROM sh JOIN qa USING (question_id)""",
)
def question_usage(spark, d):
    share = F.struct(F.lit(None).cast("string").alias("framework"), F.lit(True).alias("available"), *R.USAGE_FIELDS)
    five = F.struct(
        F.lit("m").alias("framework"), F.lit(False).alias("available"), F.lit(5).alias("prompt_tokens"),
        F.lit(0).alias("completion_tokens"), F.lit(5).alias("total_tokens"), F.lit(1).alias("calls"),
    )
    zero = F.struct(
        F.lit("m").alias("framework"), F.lit(None).cast("boolean").alias("available"),
        *[F.lit(0).alias(f) for f in R.USAGE_FIELDS],
    )
    delta = F.when(F.col("turn") % 2 == 0, five).otherwise(zero)
    rows = _shares(spark, d).select("question_id", U.add_usage(share, delta).alias("u"))
    return rows.select("question_id", "u.*")


@query(
    "usage_delta",
    f"""WITH {Q.STEPS}, c AS (SELECT run_id, event_id, ts, CAST(round(value * 100) AS BIGINT) AS total_tokens FROM steps)
SELECT run_id, event_id, greatest(0, total_tokens - coalesce(lag(total_tokens) OVER (PARTITION BY run_id ORDER BY ts, event_id), 0)) AS total_tokens_delta FROM c""",
)
def usage_delta(spark, d):
    rows = T.steps(spark, d).select("run_id", "event_id", "ts", F.round(F.col("value") * 100).cast("bigint").alias("total_tokens"))
    delta = U.usage_delta(rows, ["run_id"], [F.col("ts"), F.col("event_id")], fields=("total_tokens",))
    return delta.select("run_id", "event_id", "total_tokens_delta")
