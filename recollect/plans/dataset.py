"""Dataset reading, validation, selection, sampling and normalisation over whole tables.

The nested datasets are made from ``conversations``: a conversation document holds up to
64 turns in sessions of 3, so no document grows without bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..functions import dates as D
from ..functions import ids as I
from ..functions import text as X
from ..operators import normalize as N
from ..operators import sampling as P
from ..operators import selection as S
from ..operators import validation as V
from ..operators.ordered import ordered_position
from ..sources import datasets as SD
from ..sources import sinks
from ..session import materialize, new_path
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


# --- nested datasets --------------------------------------------------------------------

SESSION_TURNS = 3
FILE_DOCUMENTS = 4000
_MONTHS = ("January", "February", "March")


def _session_turns(spark, d):
    """Turns with the document, session and date they belong to."""
    turn, conv = F.col("turn"), F.col("conv_id")
    session = F.floor(turn / SESSION_TURNS)
    month = F.element_at(F.array(*[F.lit(m) for m in _MONTHS]), (session % 3 + 1).cast("int"))
    date = F.format_string(
        "%d:%02d %s on %02d %s, 2023", conv % 12 + 1, turn * 0 + session * 7 % 60,
        F.when(conv % 2 == 0, F.lit("am")).otherwise(F.lit("pm")), (conv * 5 + session * 11) % 28 + 1, month,
    )
    return T.turns(spark, d).select(
        "conv_id",
        "turn",
        T.document_key().alias("conversation_idx"),
        session.alias("session"),
        date.alias("date"),
        F.concat_ws(":", F.concat(F.lit("D"), session.cast("string")), turn.cast("string")).alias("dia_id"),
        F.col("role").alias("speaker"),
        "text",
        F.when(turn % 4 < 2, F.concat(F.lit(" photo "), turn.cast("string"))).alias("query"),
        F.when(turn % 2 == 0, F.concat(F.lit("a scene "), turn.cast("string"))).alias("blip_caption"),
    )


_SESSION_SQL = f"""st AS (
  SELECT conv_id, turn, {Q.DOCUMENT_KEY} AS conversation_idx, turn // 3 AS session, turn % 3 AS turn_pos,
         'D' || (turn // 3) || ':' || turn AS dia_id, role AS speaker, text,
         CASE WHEN turn % 4 < 2 THEN 'photo ' || turn ELSE '' END AS q, CASE WHEN turn % 2 = 0 THEN 'a scene ' || turn ELSE '' END AS cap,
         make_timestamp(2023, CAST((turn // 3) % 3 + 1 AS INTEGER), CAST((conv_id * 5 + (turn // 3) * 11) % 28 + 1 AS INTEGER),
           CAST((conv_id % 12 + 1) % 12 + CASE WHEN conv_id % 2 = 0 THEN 0 ELSE 12 END AS INTEGER), CAST((turn // 3) * 7 % 60 AS INTEGER), 0.0) AS ts
  FROM conversations)"""
_IMAGE = """CASE WHEN q <> '' AND cap <> '' THEN '{p}: query ' || q || '. The image shows ' || cap || '.'
 WHEN q <> '' THEN '{p}: query ' || q || '.' WHEN cap <> '' THEN '{p}: ' || cap || '.' ELSE '' END"""
_PLAIN = f"concat_ws(' ', nullif(trim(text, ' ' || chr(10)), ''), nullif({_IMAGE.format(p='Image')}, ''))"
_SPOKEN = f"speaker || ': ' || concat_ws(' ', nullif(trim(text, ' ' || chr(10)), ''), nullif({_IMAGE.format(p='Shared image')}, ''))"


def conversation_documents(spark, d):
    """(conversation_idx, conversation map, qa array) in the shape of the published file."""
    rows = _session_turns(spark, d)
    turn = F.struct("turn", F.struct("dia_id", "speaker", "text", "query", "blip_caption").alias("t"))
    sessions = rows.groupBy("conversation_idx", "session", "date").agg(F.array_sort(F.collect_list(turn)).alias("ts"))
    number = (F.col("session") + 1).cast("string")
    entries = sessions.select(
        "conversation_idx",
        F.struct(
            "session",
            F.concat(F.lit("session_"), number).alias("key"),
            F.to_json(F.transform("ts", lambda x: x["t"])).alias("turns"),
            "date",
        ).alias("s"),
    )
    listed = entries.groupBy("conversation_idx").agg(F.array_sort(F.collect_list("s")).alias("ss"))

    def pairs(s: Column) -> Column:
        return F.array(
            F.struct(F.concat(s["key"], F.lit("_date_time")).alias("key"), s["date"].alias("value")),
            F.struct(s["key"].alias("key"), s["turns"].alias("value")),
        )

    head = F.array(
        F.struct(F.lit("speaker_a").alias("key"), F.lit("user").alias("value")),
        F.struct(F.lit("speaker_b").alias("key"), F.lit("assistant").alias("value")),
    )
    docs = listed.select(
        "conversation_idx", F.map_from_entries(F.concat(head, F.flatten(F.transform("ss", pairs)))).alias("conversation")
    )
    asked = T.qa(spark, d).select(
        T.document_key().alias("conversation_idx"),
        F.struct(
            "turn",
            F.struct(
                "question", "answer", F.when(F.col("category") < 5, F.col("category")).alias("category"),
                F.array(T.turn_id(F.col("conv_id"), F.col("turn")), F.lit("")).alias("evidence"),
            ).alias("q"),
        ).alias("q"),
    )
    qa = asked.groupBy("conversation_idx").agg(F.array_sort(F.collect_list("q")).alias("qs"))
    listed = F.transform("qs", lambda x: x["q"])
    return docs.join(qa, "conversation_idx", "left").select(
        "conversation_idx", "conversation", F.coalesce(listed, F.array()).alias("qa")
    )


_QUESTIONS_SQL = f"""dq AS (
  SELECT {Q.DOCUMENT_KEY} AS conversation_idx,
         row_number() OVER (PARTITION BY {Q.DOCUMENT_KEY} ORDER BY turn) - 1 AS question_idx,
         question, answer, CAST(CASE WHEN category < 5 THEN category ELSE 0 END AS INTEGER) AS category, conv_id, turn
  FROM qa)"""


@query(
    "read_conversation_dataset",
    f"""WITH {Q.QA}, {_QUESTIONS_SQL}, {_SESSION_SQL}, k AS (SELECT conversation_idx, 2 + 2 * count(DISTINCT session) AS n FROM st GROUP BY 1)
SELECT k.conversation_idx, CAST(any_value(n) AS INTEGER) AS n_keys, CAST(count(dq.question) AS INTEGER) AS n_questions FROM k LEFT JOIN dq USING (conversation_idx) GROUP BY 1""",
)
def read_conversation_dataset(spark, d):
    """Write the documents as JSON lines and read them with the dataset reader."""
    path = new_path(spark, "conversation-dataset")
    conversation_documents(spark, d).write.json(path)
    rows = SD.read_locomo(spark, path, layout="lines")
    return rows.select(
        F.col("conversation_idx").cast("bigint").alias("conversation_idx"),
        F.size("conversation").alias("n_keys"), F.size("qa").alias("n_questions"),
    )


def array_places(ids: DataFrame) -> DataFrame:
    """(id, file, inside, last, position): each id's file of ``FILE_DOCUMENTS`` neighbours, its place there and the place
    among the ids of its range, written once."""
    ranges = Window.partitionBy(F.expr(f"id div {FILE_DOCUMENTS}")).orderBy("id")
    placed = ordered_position(ids.withColumn("position", F.row_number().over(ranges) - 1), [], [F.col("id")], out="__at")
    placed = placed.withColumns({"file": F.expr(f"__at div {FILE_DOCUMENTS}"), "inside": F.col("__at") % FILE_DOCUMENTS})
    last = F.lead("inside").over(Window.partitionBy("file").orderBy("inside")).isNull()
    return materialize(placed.select("id", "file", "inside", last.alias("last"), "position"), "array-places")


@query(
    "read_array_dataset",
    f"""WITH {Q.QA}, {_QUESTIONS_SQL}, {_SESSION_SQL}, k AS (SELECT conversation_idx, 2 + 2 * count(DISTINCT session) AS n FROM st GROUP BY 1)
SELECT row_number() OVER (PARTITION BY k.conversation_idx // 4000 ORDER BY k.conversation_idx) - 1 AS position, CAST(any_value(n) AS INTEGER) AS n_keys,
 CAST(count(dq.question) AS INTEGER) AS n_questions FROM k LEFT JOIN dq USING (conversation_idx) GROUP BY k.conversation_idx""",
)
def read_array_dataset(spark, d):
    """Write the documents as files of one JSON array each, by ranges of ids, and read them with the dataset reader.

    Ids are sparse, as no two conversations share any, so a file holds neighbouring documents
    and not a fixed range; positions are told by the range.
    """
    path = new_path(spark, "array-dataset")
    places = array_places(T.turns(spark, d).select(T.document_key().alias("id")).distinct())
    documents = conversation_documents(spark, d)
    text = documents.select("conversation_idx", F.to_json(F.struct(*documents.columns)).alias("value"))
    text = text.join(places, F.col("conversation_idx").eqNullSafe(F.col("id")))
    opened = F.when(F.col("inside") == 0, F.lit("[\n")).otherwise(F.lit(", "))
    closed = F.when(F.col("last"), F.lit("\n]")).otherwise(F.lit(""))
    value = F.concat(opened, "value", closed)
    text.select("file", "inside", value.alias("value")).repartition("file").sortWithinPartitions("file", "inside").select(
        "file", "value"
    ).write.partitionBy("file").text(path)
    rows = SD.read_locomo(spark, f"{path}/file=*", layout="array", source="source")
    rows = rows.select(
        F.regexp_extract("source", r"/file=(\d+)/[^/]*$", 1).cast("long").alias("file"),
        F.col("conversation_idx").cast("bigint").alias("inside"),
        F.size("conversation").alias("n_keys"), F.size("qa").alias("n_questions"),
    )
    position = F.col("position").cast("bigint").alias("position")
    return rows.join(places, ["file", "inside"]).select(position, "n_keys", "n_questions")


@query(
    "enumerate_questions",
    f"""WITH {Q.QA}, {_QUESTIONS_SQL} SELECT 'conv' || conversation_idx || '_q' || question_idx AS question_id,
 printf('conversation-%04d', conversation_idx + 1) AS conversation_id, question, category, conv_id || ':' || turn AS evidence FROM dq""",
)
def enumerate_questions(spark, d):
    rows = S.enumerate_questions(conversation_documents(spark, d))
    return rows.select(
        "question_id", "conversation_id", "question", "category", F.array_join("evidence", ",").alias("evidence")
    )


@query(
    "filter_categories",
    f"""WITH {Q.QA}, {_QUESTIONS_SQL} SELECT 'conv' || conversation_idx || '_q' || question_idx AS question_id, category FROM dq WHERE category IN (0, 2)""",
)
def filter_categories(spark, d):
    return S.enumerate_questions(conversation_documents(spark, d), [2, 0]).select("question_id", "category")


@query(
    "select_conversations",
    f"""WITH {Q.QA}, {_QUESTIONS_SQL}, asked AS (SELECT DISTINCT printf('conversation-%04d', conversation_idx + 1) AS cid FROM dq WHERE category = 1)
SELECT printf('conversation-%04d', conversation_idx + 1) AS conversation_id, question_idx, category FROM dq
WHERE category IN (1, 3) AND printf('conversation-%04d', conversation_idx + 1) IN (SELECT cid FROM asked)""",
)
def select_conversations(spark, d):
    questions = S.enumerate_questions(conversation_documents(spark, d))
    wanted = questions.filter("category = 1").select("conversation_id")
    kept = S.select_conversations(questions, ids=wanted, categories=[1, 3])
    return kept.select("conversation_id", F.col("question_idx").cast("bigint").alias("question_idx"), "category")


# --- question dataset -------------------------------------------------------------------

_BAD_DATE = "someday"


def question_documents(spark, d):
    """One question per conversation document; its haystack is the document's sessions."""
    rows = _session_turns(spark, d)
    conv, session = F.col("conv_id"), F.col("session")
    raw = F.format_string(
        "2023/%02d/%02d (Mon) %02d:30", session % 3 + 1, (conv * 5 + session * 11) % 28 + 1, conv % 24
    )
    raw = F.when((conv + session) % 5 == 4, F.lit(_BAD_DATE)).otherwise(raw)
    message = F.struct("turn", F.struct(_messy_role().alias("role"), F.col("text").alias("content")).alias("m"))
    sessions = rows.withColumn("raw", raw).groupBy("conversation_idx", "conv_id", "session", "raw").agg(
        F.array_sort(F.collect_list(message)).alias("ms")
    )
    one = F.struct("session", "raw", F.transform("ms", lambda x: x["m"]).alias("turns"))
    docs = sessions.select("conversation_idx", "conv_id", one.alias("s")).groupBy("conversation_idx", "conv_id").agg(
        F.array_sort(F.collect_list("s")).alias("ss")
    )
    key = F.col("conversation_idx").cast("string")
    return docs.select(
        F.concat(F.lit("q"), key).alias("question_id"),
        F.transform("ss", lambda s: F.concat(F.lit("s"), s["session"].cast("string"))).alias("haystack_session_ids"),
        F.transform("ss", lambda s: s["raw"]).alias("haystack_dates"),
        F.transform("ss", lambda s: s["turns"]).alias("haystack_sessions"),
    )


def _messy_role() -> Column:
    at = F.col("turn") % 4
    return (
        F.when(at == 0, F.col("speaker"))
        .when(at == 1, F.concat(F.lit(" "), F.upper("speaker")))
        .when(at == 2, F.concat("speaker", F.lit("_bot")))
        .otherwise(F.lit(" "))
    )


_HAYSTACK_SQL = f"""h AS (
  SELECT 'q' || {Q.DOCUMENT_KEY} AS question_id, 's' || (turn // 3) AS session_id, turn // 3 AS session, turn, turn % 3 AS pos,
         trim(text, ' ' || chr(10)) AS content, text,
         CASE turn % 4 WHEN 0 THEN role WHEN 1 THEN role WHEN 2 THEN role || '_bot' ELSE 'unknown' END AS role,
         CASE turn % 4 WHEN 3 THEN 'Unknown' ELSE upper(role[1]) || role[2:] || CASE WHEN turn % 4 = 2 THEN ' Bot' ELSE '' END END AS label,
         CASE WHEN (conv_id + turn // 3) % 5 = 4 THEN NULL ELSE epoch(make_timestamp(2023, CAST((turn // 3) % 3 + 1 AS INTEGER),
           CAST((conv_id * 5 + (turn // 3) * 11) % 28 + 1 AS INTEGER), CAST(conv_id % 24 AS INTEGER), 30, 0.0))::BIGINT END AS ts
  FROM conversations),
ses AS (SELECT question_id, session, any_value(session_id) AS session_id, any_value(ts) AS ts,
          row_number() OVER (PARTITION BY question_id ORDER BY (any_value(ts) IS NULL)::INTEGER, coalesce(any_value(ts), 0), session) AS spos
        FROM h GROUP BY 1, 2)"""


@query(
    "read_question_dataset",
    f"""WITH {_HAYSTACK_SQL} SELECT question_id, CAST(count(DISTINCT session) AS INTEGER) AS n_sessions, CAST(count(*) AS INTEGER) AS n_turns FROM h GROUP BY 1""",
)
def read_question_dataset(spark, d):
    path = new_path(spark, "question-dataset")
    question_documents(spark, d).write.json(path)
    rows = SD.read_longmemeval(spark, path, layout="lines")
    return rows.select(
        "question_id", F.size("haystack_sessions").alias("n_sessions"),
        F.size(F.flatten("haystack_sessions")).alias("n_turns"),
    )


@query(
    "sort_sessions",
    f"WITH {_HAYSTACK_SQL} SELECT question_id, string_agg(session_id, ',' ORDER BY spos) AS session_ids FROM ses GROUP BY 1",
)
def sort_sessions(spark, d):
    ordered = N.sort_sessions(F.col("haystack_session_ids"), F.col("haystack_dates"), F.col("haystack_sessions"))
    return question_documents(spark, d).select(
        "question_id", F.array_join(F.transform(ordered, lambda s: s["session_id"]), ",").alias("session_ids")
    )


@query(
    "pair_turns",
    f"""WITH {_HAYSTACK_SQL} SELECT question_id, session_id, CAST(pos // 2 AS INTEGER) AS pair_index, CAST(count(*) AS INTEGER) AS n_turns,
 md5(string_agg(text, '|' ORDER BY pos)) AS text_md5 FROM h GROUP BY ALL""",
)
def pair_turns(spark, d):
    rows = question_documents(spark, d).select(
        "question_id", F.explode(F.arrays_zip(F.col("haystack_session_ids").alias("i"), F.col("haystack_sessions").alias("s"))).alias("z")
    )
    pairs = rows.select("question_id", F.col("z.i").alias("session_id"), F.posexplode(N.pair_turns(F.col("z.s"))).alias("pair_index", "p"))
    text = F.array_join(F.transform("p", lambda t: t["content"]), "|")
    return pairs.select("question_id", "session_id", "pair_index", F.size("p").alias("n_turns"), F.md5(text).alias("text_md5"))


@query(
    "normalize_role",
    "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN role WHEN 1 THEN role WHEN 2 THEN role || '_bot' ELSE 'unknown' END AS role, "
    "CASE turn % 4 WHEN 3 THEN 'Unknown' ELSE upper(role[1]) || role[2:] || CASE WHEN turn % 4 = 2 THEN ' Bot' ELSE '' END END AS speaker_label FROM conversations",
)
def normalize_role(spark, d):
    rows = T.turns(spark, d).withColumn("speaker", F.col("role")).withColumn("messy", _messy_role())
    return rows.select(
        "conv_id", "turn", X.normalize_role(F.col("messy")).alias("role"), X.speaker_label(F.col("messy")).alias("speaker_label")
    )


@query(
    "normalize_turn",
    f"WITH {_SESSION_SQL} SELECT conversation_idx, dia_id, speaker, trim(text, ' ' || chr(10)) AS text, q AS query, cap AS caption FROM st",
)
def normalize_turn(spark, d):
    turns = N.conversation_turns(N.unpivot_sessions(conversation_documents(spark, d)))
    docs = turns.select("conversation_idx", "dia_id", "speaker", "text", "query", "caption")
    return docs


@query(
    "normalize_haystack",
    f"""WITH {_HAYSTACK_SQL} SELECT h.question_id, h.session_id, CAST(spos - 1 AS INTEGER) AS session_pos, CAST(pos // 2 AS INTEGER) AS pair_index, h.ts AS session_timestamp,
 md5(string_agg(role || '|' || label || '|' || content, '#' ORDER BY pos)) AS turns_md5 FROM h JOIN ses ON ses.question_id = h.question_id AND ses.session = h.session GROUP BY ALL""",
)
def normalize_haystack(spark, d):
    rows = N.normalize_haystack(question_documents(spark, d))
    sessions = rows.select("question_id", F.posexplode("sessions").alias("session_pos", "s"))
    pairs = sessions.select("question_id", "session_pos", "s", F.explode("s.pairs").alias("p"))
    turn = F.transform("p.turns", lambda t: F.concat_ws("|", t["role"], t["speaker_label"], t["content"]))
    return pairs.select(
        "question_id", F.col("s.session_id").alias("session_id"), "session_pos", F.col("p.pair_index").alias("pair_index"),
        F.col("s.session_timestamp").alias("session_timestamp"), F.md5(F.array_join(turn, "#")).alias("turns_md5"),
    )


@query(
    "pair_text",
    f"""WITH {_HAYSTACK_SQL} SELECT question_id, session_id, CAST(pos // 2 AS INTEGER) AS pair_index,
 trim(string_agg(content, ' ' ORDER BY pos) FILTER (content <> ''), ' ') AS text FROM h GROUP BY ALL""",
)
def pair_text(spark, d):
    return _pairs(spark, d).select("question_id", "session_id", "pair_index", N.pair_text(F.col("turns")).alias("text"))


def _pairs(spark, d):
    rows = N.normalize_haystack(question_documents(spark, d)).select("question_id", F.explode("sessions").alias("s"))
    return rows.select("question_id", F.col("s.session_id").alias("session_id"), F.explode("s.pairs").alias("p")).select(
        "question_id", "session_id", "p.pair_index", "p.turns"
    )


@query(
    "pair_messages",
    f"""WITH {_HAYSTACK_SQL} SELECT question_id, session_id, CAST(pos // 2 AS INTEGER) AS pair_index, CAST(row_number() OVER (PARTITION BY question_id, session_id, pos // 2 ORDER BY pos) - 1 AS INTEGER) AS message_pos,
 role, content FROM h WHERE content <> ''""",
)
def pair_messages(spark, d):
    rows = _pairs(spark, d).select(
        "question_id", "session_id", "pair_index", F.posexplode(N.pair_messages(F.col("turns"))).alias("message_pos", "m")
    )
    return rows.select("question_id", "session_id", "pair_index", "message_pos", "m.role", "m.content")


@query(
    "render_session",
    f"""WITH {_HAYSTACK_SQL}, r AS (SELECT h.question_id, h.session_id, h.session,
  coalesce(chr(10) || string_agg(label || ': ' || content, chr(10) ORDER BY pos) FILTER (content <> ''), '') AS body, any_value(h.ts) AS ts FROM h GROUP BY ALL)
SELECT question_id, session_id, 'Session ' || session_id || ' (' || CASE WHEN ts IS NULL THEN '{_BAD_DATE}'
 ELSE strftime(make_timestamp(ts * 1000000), '%Y/%m/%d (Mon) %H:%M') END || ')' || body AS text FROM r""",
)
def render_session(spark, d):
    rows = N.normalize_haystack(question_documents(spark, d)).select("question_id", F.explode("sessions").alias("s"))
    return rows.select("question_id", F.col("s.session_id").alias("session_id"), N.render_session(F.col("s")).alias("text"))


# --- turns to records -------------------------------------------------------------------


@query(
    "unpivot_sessions",
    f"""WITH {_SESSION_SQL} SELECT conversation_idx, 'session_' || (session + 1) AS session_key, epoch(any_value(ts)) AS session_ts, CAST(count(*) AS INTEGER) AS n_turns FROM st GROUP BY conversation_idx, session""",
)
def unpivot_sessions(spark, d):
    rows = N.unpivot_sessions(conversation_documents(spark, d))
    return rows.select("conversation_idx", "session_key", "session_ts", F.size("turns").alias("n_turns"))


def _serialized(spark, d, value: Column, name: str):
    return _session_turns(spark, d).select("conv_id", "turn", value.alias(name))


@query("image_text", f"WITH {_SESSION_SQL} SELECT conv_id, turn, {_IMAGE.format(p='Image')} AS image FROM st")
def image_text(spark, d):
    return _serialized(spark, d, X.image_text(F.col("query"), F.col("blip_caption"), "Image"), "image")


@query("serialize_turn_plain", f"WITH {_SESSION_SQL} SELECT conv_id, turn, {_PLAIN} AS text FROM st")
def serialize_turn_plain(spark, d):
    return _serialized(spark, d, X.serialize_turn_plain(F.col("text"), F.col("query"), F.col("blip_caption")), "text")


@query("serialize_turn_speaker", f"WITH {_SESSION_SQL} SELECT conv_id, turn, {_SPOKEN} AS text FROM st")
def serialize_turn_speaker(spark, d):
    value = X.serialize_turn_speaker(F.col("speaker"), F.col("text"), F.col("query"), F.col("blip_caption"))
    return _serialized(spark, d, value, "text")


@query(
    "speaker_role",
    f"WITH {_SESSION_SQL} SELECT conv_id, turn, CASE WHEN speaker = 'user' THEN 'user' ELSE 'assistant' END AS role FROM st",
)
def speaker_role(spark, d):
    return _serialized(spark, d, X.speaker_role(F.col("speaker"), F.lit("user")), "role")


@query(
    "conversation_records",
    f"""WITH {_SESSION_SQL}, r AS (SELECT *, {_PLAIN} AS ingest_text, {_SPOKEN} AS shown FROM st)
SELECT printf('conversation-%04d', conversation_idx + 1) AS unit_id, dia_id AS record_id, ingest_text, shown AS text, epoch(ts) AS session_ts,
 row_number() OVER (PARTITION BY conversation_idx ORDER BY ts, session, turn_pos) - 1 AS record_pos FROM r WHERE ingest_text <> ''""",
)
def conversation_records(spark, d):
    rows = N.conversation_records(conversation_documents(spark, d), "plain")
    return rows.select("unit_id", "record_id", "ingest_text", "text", "session_ts", "record_pos")


@query(
    "question_records_message",
    f"""WITH {_HAYSTACK_SQL} SELECT h.question_id AS unit_id, h.session_id AS source_unit_id, h.session_id || ':turn:' || pos AS record_id, text,
 row_number() OVER (PARTITION BY h.question_id ORDER BY spos, pos) - 1 AS record_pos
 FROM h JOIN ses ON ses.question_id = h.question_id AND ses.session = h.session WHERE content <> ''""",
)
def question_records_message(spark, d):
    rows = N.question_records(question_documents(spark, d), "message")
    return rows.select("unit_id", "source_unit_id", "record_id", "text", "record_pos")


@query(
    "question_records_pair",
    f"""WITH {_HAYSTACK_SQL}, p AS (SELECT h.question_id, h.session_id, spos, pos // 2 AS pair, string_agg(label || ': ' || content, chr(10) ORDER BY pos) AS text
  FROM h JOIN ses ON ses.question_id = h.question_id AND ses.session = h.session WHERE content <> '' GROUP BY ALL)
SELECT question_id AS unit_id, session_id || ':pair:' || pair AS record_id, text, row_number() OVER (PARTITION BY question_id ORDER BY spos, pair) - 1 AS record_pos FROM p""",
)
def question_records_pair(spark, d):
    rows = N.question_records(question_documents(spark, d), "pair")
    return rows.select("unit_id", "record_id", "text", "record_pos")


@query(
    "drop_blank_text",
    f"SELECT doc_id FROM documents WHERE trim(regexp_replace(text, '[A-Za-z]', '', 'g'), ' ' || chr(10)) <> ''",
)
def drop_blank_text(spark, d):
    rows = T.table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[A-Za-z]", "").alias("text"))
    return S.drop_blank_text(rows).select("doc_id")


# --- dates and ids ----------------------------------------------------------------------

_WRITTEN = """w AS (SELECT event_id, date_trunc('minute', ts) AS m, date_trunc('day', ts) AS dd, event_id % 4 AS style FROM events)"""


def _written(spark, d, question: bool):
    ts, style = F.col("ts"), F.col("event_id") % 4
    if question:
        text = F.when(style == 3, F.lit("not a date")).otherwise(F.date_format(ts, "yyyy/MM/dd '('EEE')' HH:mm"))
    else:
        text = (
            F.when(style == 0, F.lower(F.date_format(ts, "h:mm a 'on' dd MMMM, yyyy")))
            .when(style == 1, F.date_format(ts, "h:mma 'on' d MMMM, yyyy"))
            .when(style == 2, F.date_format(ts, " d MMMM, yyyy "))
            .otherwise(F.lit("not a date"))
        )
    return T.table(spark, d, "events").select("event_id", text.alias("written"))


@query(
    "parse_conversation_date",
    f"WITH {_WRITTEN} SELECT event_id, CASE style WHEN 3 THEN NULL WHEN 2 THEN epoch(dd) ELSE epoch(m) END::DOUBLE AS epoch FROM w",
)
def parse_conversation_date(spark, d):
    return _written(spark, d, False).select("event_id", D.conversation_epoch(F.col("written")).alias("epoch"))


@query(
    "parse_question_date",
    f"WITH {_WRITTEN} SELECT event_id, CASE style WHEN 3 THEN NULL ELSE CAST(epoch(m) AS BIGINT) END AS epoch FROM w",
)
def parse_question_date(spark, d):
    return _written(spark, d, True).select("event_id", D.question_epoch(F.col("written")).alias("epoch"))


@query(
    "human_date",
    f"WITH {_WRITTEN} SELECT event_id, CASE style WHEN 3 THEN 'not a date' ELSE strftime(m, '%A, %B %d, %Y') END AS shown FROM w",
)
def human_date(spark, d):
    return _written(spark, d, True).select("event_id", D.human_date(F.col("written")).alias("shown"))


@query(
    "created_at",
    "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS created_at FROM events",
)
def created_at(spark, d):
    return T.table(spark, d, "events").select("event_id", D.created_at(F.unix_timestamp("ts")).alias("created_at"))


@query(
    "positional_ids",
    f"WITH {Q.QA} SELECT conv_id, turn, printf('conversation-%04d', conv_id + 1) AS conversation_id, 'conv' || conv_id || '_q' || turn AS question_id, 's' || conv_id || ':pair:' || turn AS pair_id FROM qa",
)
def positional_ids(spark, d):
    conv, turn = F.col("conv_id"), F.col("turn")
    return T.qa(spark, d).select(
        "conv_id", "turn", I.conversation_id(conv).alias("conversation_id"), I.question_id(conv, turn).alias("question_id"),
        I.pair_record_id(F.concat(F.lit("s"), conv.cast("string")), turn).alias("pair_id"),
    )


@query(
    "category_name",
    f"""WITH {Q.QA} SELECT question_id, CASE category + turn % 3 WHEN 1 THEN 'multi-hop' WHEN 2 THEN 'temporal' WHEN 3 THEN 'open-domain' WHEN 4 THEN 'single-hop'
 WHEN 5 THEN 'adversarial' ELSE 'category-' || (category + turn % 3) END AS name FROM qa""",
)
def category_name(spark, d):
    return T.qa(spark, d).select("question_id", X.category_name(F.col("category") + F.col("turn") % 3).alias("name"))


@query("short_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS short FROM documents")
def short_hash(spark, d):
    return T.table(spark, d, "documents").select("doc_id", I.short_hash(F.col("text")).alias("short"))


@query("is_abstention", f"WITH {Q.QA} SELECT question_id, ends_with(question_id, '_abs') AS is_abstention FROM qa")
def is_abstention(spark, d):
    return T.qa(spark, d).select("question_id", X.is_abstention_id(F.col("question_id")).alias("is_abstention"))


# --- selection of question records ------------------------------------------------------


@query(
    "filter_by_ids",
    f"WITH {Q.QA} SELECT question_id, question_type FROM qa WHERE question_id IN (SELECT 'conv' || doc_id || '_q0' FROM documents)",
)
def filter_by_ids(spark, d):
    wanted = T.table(spark, d, "documents").select(F.concat(F.lit("conv"), "doc_id", F.lit("_q0")).alias("question_id"))
    return S.filter_by_ids(T.qa(spark, d), wanted).select("question_id", "question_type")


@query(
    "missing_ids",
    f"WITH {Q.QA} SELECT 'conv' || doc_id || '_q0' AS question_id FROM documents WHERE 'conv' || doc_id || '_q0' NOT IN (SELECT question_id FROM qa)",
)
def missing_ids(spark, d):
    wanted = T.table(spark, d, "documents").select(F.concat(F.lit("conv"), "doc_id", F.lit("_q0")).alias("question_id"))
    return S.missing_ids(wanted, T.qa(spark, d))


_PER_TYPE = """row_number() OVER (PARTITION BY question_type ORDER BY sha256('42:' || question_id), question_id)"""


@query(
    "sample_per_type",
    f"WITH {Q.QA} SELECT question_id, question_type FROM (SELECT *, {_PER_TYPE} AS r FROM qa) WHERE r <= 5",
)
def sample_per_type(spark, d):
    return P.sample_per_type(T.qa(spark, d)).select("question_id", "question_type")


@query(
    "select_questions",
    f"WITH {Q.QA} SELECT question_id, question_type FROM (SELECT *, {_PER_TYPE} AS r FROM qa WHERE question_type IN ('multi-session', 'knowledge-update')) WHERE r <= 3",
)
def select_questions(spark, d):
    kept = S.select_questions(T.qa(spark, d), types=["multi-session", "knowledge-update"], per_type=3)
    return kept.select("question_id", "question_type")


# --- sampling ---------------------------------------------------------------------------


def _size_sql(fraction: float, rounding: str, n: str = "n") -> str:
    raw = f"{n} * {fraction}::DOUBLE"
    value = {"ceil": f"ceil({raw})", "floor": f"floor({raw})", "round": f"floor({raw} + 0.5)"}[rounding]
    return f"CAST(least({n}, greatest(1, {value})) AS BIGINT)"


@query(
    "sample_size",
    f"SELECT source, lang, n, {_size_sql(0.05, 'ceil')} AS up, {_size_sql(0.05, 'floor')} AS down, {_size_sql(0.05, 'round')} AS nearest FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)",
)
def sample_size(spark, d):
    rows = T.table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = {"up": "ceil", "down": "floor", "nearest": "round"}
    return rows.select("source", "lang", "n", *[P.sample_size(F.col("n"), 0.05, r).alias(k) for k, r in sizes.items()])


def _hash_sql(source: str, ids: str, key: str, stratum: str, fraction: float, seed: int, rounding: str = "ceil") -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {stratum} ORDER BY sha256('{seed}:' || {key}), {ids}) AS r,
 count(*) OVER (PARTITION BY {stratum}) AS n FROM {source}) WHERE r <= {_size_sql(fraction, rounding)}"""


@query(
    "sample_qa",
    f"WITH {Q.QA}, {_QUESTIONS_SQL}, s AS ({_hash_sql('dq', 'conversation_idx, question_idx', "conversation_idx || ':' || question_idx", 'category', 0.2, 7)}) SELECT conversation_idx, question_idx, category FROM s",
)
def sample_qa(spark, d):
    questions = S.enumerate_questions(conversation_documents(spark, d))
    kept = P.sample_qa(questions, 0.2, 7, "ceil", "category")
    return kept.select("conversation_idx", F.col("question_idx").cast("bigint").alias("question_idx"), "category")


@query(
    "sample_conversations",
    f"WITH u AS (SELECT DISTINCT conv_id AS conversation_idx FROM conversations), s AS ({_hash_sql('u', 'conversation_idx', 'conversation_idx', '1', 0.3, 42, 'floor')}) SELECT conversation_idx FROM s",
)
def sample_conversations(spark, d):
    units = T.turns(spark, d).select(F.col("conv_id").alias("conversation_idx")).distinct()
    return P.sample_conversations(units, 0.3, 42, "floor")


@query(
    "sample_records",
    f"""WITH q AS (SELECT o_orderkey AS question_pos, 'o' || o_orderkey AS question_id, o_orderpriority AS question_type FROM orders),
 s AS ({_hash_sql('q', 'question_id, question_pos', "question_id || ':' || question_pos", 'question_type', 0.01, 11, 'round')}) SELECT question_id, question_type FROM s""",
)
def sample_records(spark, d):
    rows = T.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("question_pos"), F.concat(F.lit("o"), "o_orderkey").alias("question_id"),
        F.col("o_orderpriority").alias("question_type"),
    )
    return P.sample_records(rows, 0.01, 11, "round", "question_type").select("question_id", "question_type")


def _lineitem_sample(spark, d):
    rows = T.table(spark, d, "lineitem").withColumn(
        "line_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    )
    rows = rows.select("line_id", "l_returnflag").distinct()
    return rows, P.stratified_sample(rows, ["line_id"], 0.05, 3, "ceil", F.col("l_returnflag"))


@query(
    "sampling_counts",
    f"SELECT source AS stratum, count(*) AS population_count, {_size_sql(0.1, 'ceil', 'count(*)')} AS sample_count FROM documents GROUP BY 1",
)
def sampling_counts(spark, d):
    rows = T.table(spark, d, "documents").select("doc_id", "source")
    sample = P.stratified_sample(rows, ["doc_id"], 0.1, 3, "ceil", F.col("source"))
    return P.sampling_counts(rows, sample, ["doc_id"], F.col("source"))


@query(
    "sampling_manifest",
    f"""WITH g AS (SELECT source, count(*) AS n, {_size_sql(0.1, 'ceil', 'count(*)')} AS k FROM documents GROUP BY 1)
SELECT 0.1::DOUBLE AS fraction, 3 AS seed, 'ceil' AS rounding, 'document' AS unit, CAST(sum(n) AS BIGINT) AS population_count, CAST(sum(k) AS BIGINT) AS sample_count,
 string_agg(source || '=' || n, ',' ORDER BY source) AS population_by_group, string_agg(source || '=' || k, ',' ORDER BY source) AS sample_by_group FROM g""",
)
def sampling_manifest(spark, d):
    spec = {"fraction": 0.1, "seed": 3, "rounding": "ceil", "unit": "document"}
    row = P.sampling_manifest(sampling_counts(spark, d), spec, True)

    def shown(name: str) -> Column:
        entries = F.transform(F.map_entries(name), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
        return F.array_join(entries, ",").alias(name)

    return row.select(*spec, "population_count", "sample_count", shown("population_by_group"), shown("sample_by_group"))


@query(
    "regroup_sample",
    f"""WITH {Q.QA}, {_QUESTIONS_SQL}, s AS ({_hash_sql('dq', 'conversation_idx, question_idx', "conversation_idx || ':' || question_idx", '1', 0.5, 7)})
SELECT conversation_idx, CAST(count(*) AS INTEGER) AS n_questions, md5(string_agg(question, '|' ORDER BY question_idx)) AS questions_md5 FROM s GROUP BY 1""",
)
def regroup_sample(spark, d):
    docs = conversation_documents(spark, d)
    kept = P.regroup_sample(docs, P.sample_qa(S.enumerate_questions(docs), 0.5, 7))
    text = F.array_join(F.transform("qa", lambda q: q["question"]), "|")
    return kept.select("conversation_idx", F.size("qa").alias("n_questions"), F.md5(text).alias("questions_md5"))


@query(
    "write_sample",
    f"""WITH {Q.QA}, {_QUESTIONS_SQL}, s AS ({_hash_sql('dq', 'conversation_idx, question_idx', "conversation_idx || ':' || question_idx", '1', 0.25, 9)})
SELECT conversation_idx, CAST(count(*) AS INTEGER) AS n_questions, (SELECT count(*) FROM s) AS sample_count FROM s GROUP BY 1""",
)
def write_sample(spark, d):
    """Write a sampled dataset with its manifest and read both back."""
    docs, path = conversation_documents(spark, d), new_path(spark, "sample")
    questions = S.enumerate_questions(docs)
    sample = P.sample_qa(questions, 0.25, 9)
    counts = P.sampling_counts(questions, sample, ["question_id"])
    sinks.write_sample(P.regroup_sample(docs, sample), P.sampling_manifest(counts, {"seed": 9}, False), path, "conversation_idx")
    manifest = spark.read.json(f"{path}/manifest").select("sample_count")
    rows = SD.read_locomo(spark, f"{path}/data", layout="lines")
    return rows.select(
        F.col("conversation_idx").cast("bigint").alias("conversation_idx"), F.size("qa").alias("n_questions"),
        manifest.scalar().alias("sample_count"),
    )


@query(
    "conversation_counts",
    f"WITH {Q.QA}, {_QUESTIONS_SQL} SELECT count(DISTINCT conversation_idx) AS conversation_count, count(*) AS question_count FROM dq",
)
def conversation_counts(spark, d):
    return P.conversation_counts(S.enumerate_questions(conversation_documents(spark, d)))


@query(
    "sample_key",
    """SELECT doc_id, substr(sha256('{"registry_id":"' || source || '","sampling":{"fraction":0.5,"seed":' || doc_id || '}}'), 1, 24) AS sample_key FROM documents""",
)
def sample_key(spark, d):
    spec = F.to_json(
        F.struct(
            F.struct(F.col("doc_id").alias("seed"), F.lit(0.5).alias("fraction")).alias("sampling"),
            F.col("source").alias("registry_id"),
        )
    )
    rows = T.table(spark, d, "documents").select("doc_id", spec.alias("spec"))
    return rows.select("doc_id", P.sample_key(F.col("spec")).alias("sample_key"))


# --- validation -------------------------------------------------------------------------


@query(
    "check_required",
    """SELECT doc_id, concat_ws(',', CASE WHEN n_chars % 2 = 0 THEN 'question' END, CASE WHEN lang = 'fr' THEN 'answer' END) AS missing
 FROM documents WHERE n_chars % 2 = 0 OR lang = 'fr'""",
)
def check_required(spark, d):
    parts = {k: F.lit("x") for k in V.QUESTION_KEYS}
    parts["question"] = F.when(F.col("n_chars") % 2 != 0, F.col("text"))
    parts["answer"] = F.when(F.col("lang") != "fr", F.col("lang"))
    kept = {k: v for k, v in parts.items() if k != "question_type"}
    body = F.to_json(F.struct(*[v.alias(k) for k, v in kept.items()]))
    # A key that is there with a null value is not missing.
    document = F.concat(F.lit('{"question_type":null,'), F.substr(body, F.lit(2)))
    rows = T.table(spark, d, "documents").select("doc_id", document.alias("value"))
    return V.check_required(rows, "value").select("doc_id", F.array_join("missing", ",").alias("missing"))


@query(
    "check_conversation_structure",
    "SELECT doc_id, CASE WHEN lang = 'de' THEN 'conversation is not an object' ELSE 'qa is not a list' END AS problem FROM documents WHERE lang IN ('de', 'fr')",
)
def check_conversation_structure(spark, d):
    text = F.to_json(F.struct("text"))
    conversation = F.when(F.col("lang") == "de", F.lit("[1]")).otherwise(text)
    listed = F.when(F.col("lang") == "fr", text).otherwise(F.lit("[]"))
    value = F.concat(F.lit('{"conversation": '), conversation, F.lit(', "qa": '), listed, F.lit("}"))
    rows = T.table(spark, d, "documents").select("doc_id", value.alias("value"))
    return V.check_conversation_structure(rows, "value").select("doc_id", "problem")


_NESTED = "CASE WHEN category = 2 THEN 'nested layout' WHEN generated_answer = question THEN 'no answer' END"


@query(
    "check_flat_rows",
    f"WITH {Q.ANSWERS} SELECT question_id, {_NESTED} AS problem FROM answers WHERE {_NESTED} IS NOT NULL",
)
def check_flat_rows(spark, d):
    """Answers that only repeat the question are taken away, rows of one category are nested."""
    rows = T.answers(spark, d).withColumns({
        "generated_answer": F.when(F.col("generated_answer") != F.col("question"), F.col("generated_answer")),
        "cutoff_results": F.when(F.col("category") == 2, F.struct(F.col("answer").alias("top_1"))),
    })
    return V.flat_row_problems(rows, "locomo").select("question_id", "problem")


@query(
    "check_complete",
    f"""WITH {Q.QA}, e AS (SELECT question_id || CASE WHEN (conv_id + turn) % 11 = 3 THEN '_other' ELSE '' END AS question_id, conv_id * 1000000 + turn AS position FROM qa),
p0 AS (SELECT question_id, conv_id * 1000000 + turn + CASE WHEN conv_id % 10 = 3 THEN 1 ELSE 0 END AS position, CASE WHEN conv_id % 8 = 1 THEN 1 ELSE 2 END AS v FROM qa),
p AS (SELECT * FROM p0 UNION ALL SELECT * FROM p0 WHERE position % 7 = 0),
g AS (SELECT question_id, count(*) AS times, min(position) AS seen_at, bool_or(v <> 2) AS old FROM p GROUP BY 1),
b AS (SELECT coalesce(g.question_id, e.question_id) AS question_id, times, seen_at, old, e.position AS want FROM g FULL JOIN e ON g.question_id = e.question_id)
SELECT question_id, 'schema_version' AS problem FROM b WHERE old UNION ALL SELECT question_id, 'duplicate' FROM b WHERE times > 1
UNION ALL SELECT question_id, 'missing' FROM b WHERE times IS NULL UNION ALL SELECT question_id, 'unexpected' FROM b WHERE want IS NULL
UNION ALL SELECT question_id, 'order' FROM b WHERE seen_at <> want""",
)
def check_complete(spark, d):
    conv, turn = F.col("conv_id"), F.col("turn")
    rows = T.qa(spark, d)
    # Some expected questions have no prediction, and as many predictions nobody expects.
    renamed = F.concat("question_id", F.when((conv + turn) % 11 == 3, F.lit("_other")).otherwise(F.lit("")))
    expected = rows.select(renamed.alias("question_id"), (conv * 1_000_000 + turn).alias("position"))
    once = rows.select(
        "question_id",
        (conv * 1_000_000 + turn + F.when(conv % 10 == 3, 1).otherwise(0)).alias("position"),
        F.when(conv % 8 == 1, 1).otherwise(2).alias("schema_version"),
    )
    twice = once.unionByName(once.filter("position % 7 = 0"))
    return V.check_complete(twice, expected)


_JUDGMENT_RULES = """WITH j AS (SELECT l.doc_id, quality, toxic, lang, source FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
SELECT CAST(doc_id AS VARCHAR) AS question_id, broken FROM (SELECT doc_id, concat_ws(',', CASE WHEN toxic = 1 THEN 'schema_version' END,
 CASE WHEN lang <> 'en' THEN 'judge_provider' END, CASE WHEN source = 'src1' THEN 'judge_model' END,
 CASE WHEN quality = 0 THEN 'judgment' END, CASE WHEN lang = 'fr' THEN 'score' END) AS broken FROM j) WHERE broken <> ''"""


@query("check_judgments", _JUDGMENT_RULES)
def check_judgments(spark, d):
    rows = T.table(spark, d, "labels").join(T.table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    judgments = rows.select(
        F.col("doc_id").cast("string").alias("question_id"),
        (2 - F.col("toxic")).alias("schema_version"),
        F.lit("f").alias("scientific_fingerprint"),
        F.col("lang").alias("judge_provider"),
        F.lit("m").alias("judge_requested_model"),
        F.lit("r").alias("judge_fingerprint"),
        F.when(F.col("source") != "src1", F.col("source")).otherwise(F.lit("  ")).alias("judge_model"),
        F.when(F.col("quality") == 1, F.lit(" pass ")).otherwise(F.lit("maybe")).alias("judgment"),
        F.when(F.col("lang") == "fr", F.lit("high")).otherwise(F.lit("0.5")).alias("score"),
    )
    expected = {
        "scientific_fingerprint": "f", "judge_provider": "en", "judge_requested_model": "m", "judge_fingerprint": "r",
    }
    broken = V.check_judgments(judgments, expected)
    return broken.select("question_id", F.array_join("broken", ",").alias("broken"))


@query(
    "check_unique_combination",
    """WITH c AS (SELECT c_mktsegment || c_nationkey AS benchmark, CAST(c_custkey % 97 AS VARCHAR) AS framework, CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS VARCHAR) AS dg FROM customer)
SELECT benchmark, framework, 'duplicate config' AS problem, count(*) AS configs FROM c GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT benchmark, NULL, 'several datasets', count(*) FROM c GROUP BY 1 HAVING count(DISTINCT dg) > 1""",
)
def check_unique_combination(spark, d):
    configs = T.table(spark, d, "customer").select(
        F.concat("c_mktsegment", "c_nationkey").alias("benchmark"),
        (F.col("c_custkey") % 97).cast("string").alias("framework"),
        F.when(F.col("c_acctbal") < 0, F.lit("1")).otherwise(F.lit("0")).alias("dataset_digest"),
    )
    return V.check_unique_combination(configs)


_STATE = "CASE event_type WHEN 'signup' THEN 'PREFLIGHT' WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'JUDGING' WHEN 'purchase' THEN 'EVALUATING' ELSE 'FAILED_RUNNING' END"


def states(spark, d):
    kind = F.col("event_type")
    state = (
        F.when(kind == "signup", F.lit("PREFLIGHT")).when(kind == "click", F.lit("RUNNING"))
        .when(kind == "view", F.lit("JUDGING")).when(kind == "purchase", F.lit("EVALUATING"))
        .otherwise(F.lit("FAILED_RUNNING"))
    )
    return T.steps(spark, d).select("run_id", "event_id", "ts", state.alias("state"))


@query(
    "check_transitions",
    f"""WITH s AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id, {_STATE} AS state, lag({_STATE}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
SELECT run_id, event_id, previous, state FROM s WHERE previous IS NOT NULL AND (previous || '>' || state) NOT IN
 ('PREFLIGHT>RUNNING', 'PREFLIGHT>JUDGING', 'PREFLIGHT>EVALUATING', 'RUNNING>JUDGING', 'RUNNING>FAILED_RUNNING', 'JUDGING>EVALUATING')""",
)
def check_transitions(spark, d):
    broken = V.check_transitions(states(spark, d), "run_id", [F.col("ts"), F.col("event_id")])
    return broken.select("run_id", "event_id", "previous", "state")


@query(
    "check_expected_unique",
    "SELECT doc_id FROM documents WHERE len(list_distinct(string_split(text, ' '))) < len(string_split(text, ' '))",
)
def check_expected_unique(spark, d):
    rows = T.table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("expected_item_ids"))
    return V.check_expected_unique(rows).select("doc_id")


@query(
    "secret_paths",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'auth.api_key,nodes[0].db_password' WHEN c_mktsegment = 'MACHINERY' THEN 'nodes[0].db_password' ELSE '' END AS paths FROM customer""",
)
def secret_paths(spark, d):
    segment = F.col("c_mktsegment")
    document = F.to_json(
        F.struct(
            F.col("c_name").alias("name"),
            F.struct(F.when(segment == "BUILDING", F.lit("k")).alias("api_key"), F.lit(1).alias("retries")).alias("auth"),
            F.array(F.struct(F.when(segment.isin("BUILDING", "MACHINERY"), F.lit("p")).alias("db_password"))).alias("nodes"),
        )
    )
    return T.table(spark, d, "customer").select("c_custkey", F.array_join(C.secret_paths(document), ",").alias("paths"))


def _redact_sql(value: str) -> str:
    for marker in C.SECRET_TEXT_MARKERS:
        value = f"regexp_replace({value}, '^(.*?{marker})[^ ]*(.*)$', '\\1<redacted>\\2', 'is')"
    return value


@query(
    "redact_text",
    f"""SELECT doc_id, md5({_redact_sql("text || CASE WHEN lang = 'en' THEN ' token=a and token=b API_KEY=c end' ELSE ' token=a' END")}) AS redacted FROM documents""",
)
def redact_text(spark, d):
    tail = F.when(F.col("lang") == "en", F.lit(" token=a and token=b API_KEY=c end")).otherwise(F.lit(" token=a"))
    rows = T.table(spark, d, "documents")
    return rows.select("doc_id", F.md5(C.redact_text(F.concat("text", tail))).alias("redacted"))
