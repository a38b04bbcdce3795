"""From nested datasets to ordered sessions, pairs, turns and memory records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import ids as I
from ..functions import text as X
from .ordered import ordered_position

TURN = "struct<dia_id:string,speaker:string,text:string,query:string,blip_caption:string>"
# Rows of one unit are ranked in slices of this many turns.
TURN_SLICE = 4096


# --- conversation dataset ---------------------------------------------------------------


def unpivot_sessions(conversations: DataFrame, strict: bool = True) -> DataFrame:
    """One row per ``session_*`` key of the conversation map, with its date and turns."""
    pair = F.posexplode(F.map_entries("conversation")).alias("session_pos", "entry")
    rows = conversations.select("*", pair).select(
        *[c for c in conversations.columns if c not in ("conversation", "qa")],
        "session_pos",
        F.col("entry.key").alias("session_key"),
        F.col("entry.value").alias("__turns"),
        F.try_element_at("conversation", F.concat(F.col("entry.key"), F.lit("_date_time"))).alias("__date"),
        F.try_element_at("conversation", F.lit("speaker_a")).alias("speaker_a"),
    )
    key = F.col("session_key")
    is_session = F.startswith(key, F.lit("session_")) & ~F.endswith(key, F.lit("_date_time"))
    turns = F.from_json("__turns", f"array<{TURN}>")
    is_list = F.startswith(F.ltrim(F.coalesce("__turns", F.lit(""))), F.lit("["))
    dated = X.blank_to_empty(F.col("__date"))
    if strict:
        # Guarded by the key, since a filter gives no promise about what is evaluated first.
        turns = F.when(is_list | ~is_session, turns).otherwise(
            F.raise_error(F.concat(F.lit("not a list: "), key)).cast(f"array<{TURN}>")
        )
        dated = F.when((dated != "") | ~is_session, dated).otherwise(
            F.raise_error(F.concat(F.lit("no date for "), key)).cast("string")
        )
    rows = rows.filter(is_session)
    rows = rows.withColumn("turns", turns).withColumn("session_date_raw", dated)
    when = F.when(is_session, D.conversation_epoch(F.col("session_date_raw"), strict))
    return rows.withColumn("session_ts", when).drop("__turns", "__date")


def conversation_turns(sessions: DataFrame) -> DataFrame:
    """One row per turn of :func:`unpivot_sessions`, fields trimmed and named."""
    rows = sessions.select(
        *[c for c in sessions.columns if c != "turns"], F.posexplode("turns").alias("turn_pos", "turn")
    )
    return rows.select(
        *[c for c in rows.columns if c != "turn"],
        *[X.blank_to_empty(F.col(f"turn.{c}")).alias(c) for c in ("dia_id", "speaker", "text", "query")],
        X.blank_to_empty(F.col("turn.blip_caption")).alias("caption"),
        F.coalesce("turn.text", F.lit("")).alias("raw_text"),
    )


# --- question dataset -------------------------------------------------------------------


def sort_sessions(ids: Column, dates: Column, sessions: Column) -> Column:
    """Zip three arrays to the shortest and order by date; undated sessions come last."""
    n = F.least(F.size(ids), F.size(dates), F.size(sessions))

    def session(i: Column) -> Column:
        raw = F.get(dates, i)
        ts = D.question_epoch(raw)
        return F.struct(
            ts.isNull().alias("undated"),
            F.coalesce(ts, F.lit(0)).alias("sort_ts"),
            raw.alias("session_date_raw"),
            i.alias("original_pos"),
            F.get(ids, i).alias("session_id"),
            ts.alias("session_timestamp"),
            F.get(sessions, i).alias("turns"),
        )

    every = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), session)
    return F.array_sort(F.slice(every, F.lit(1), F.greatest(n, F.lit(0))))


def pair_turns(turns: Column) -> Column:
    """Consecutive chunks of two; the last chunk may hold one turn."""
    n = F.size(turns)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(2))
    chunks = F.transform(starts, lambda i: F.slice(turns, i, F.lit(2)))
    return F.filter(chunks, lambda c: F.size(c) > 0)


def normalize_turn(turn: Column) -> Column:
    return F.struct(
        X.normalize_role(turn["role"]).alias("role"),
        X.speaker_label(turn["role"]).alias("speaker_label"),
        X.blank_to_empty(turn["content"]).alias("content"),
    )


def normalize_haystack(questions: DataFrame) -> DataFrame:
    """Add ``sessions``: chronological sessions with numbered, normalised pairs."""
    ordered = sort_sessions(
        F.col("haystack_session_ids"), F.col("haystack_dates"), F.col("haystack_sessions")
    )

    def session(s: Column) -> Column:
        pairs = F.transform(
            pair_turns(s["turns"]),
            lambda p, i: F.struct(i.alias("pair_index"), F.transform(p, normalize_turn).alias("turns")),
        )
        return F.struct(
            F.lit("session").alias("source_unit_type"),
            s["session_id"].alias("source_unit_id"),
            s["session_id"].alias("session_id"),
            s["session_date_raw"].alias("session_date_raw"),
            s["session_timestamp"].alias("session_timestamp"),
            pairs.alias("pairs"),
        )

    return questions.withColumn("__o", ordered).withColumn("sessions", F.transform("__o", session)).drop("__o")


def pair_text(turns: Column) -> Column:
    """Non-empty contents joined by a blank."""
    contents = F.filter(F.transform(turns, lambda t: t["content"]), lambda c: c != "")
    return X.py_strip(F.array_join(contents, " "))


def pair_messages(turns: Column) -> Column:
    kept = F.filter(turns, lambda t: t["content"] != "")
    return F.transform(kept, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))


def render_pair(turns: Column) -> Column:
    kept = F.filter(turns, lambda t: t["content"] != "")
    return F.array_join(F.transform(kept, lambda t: F.concat(t["speaker_label"], F.lit(": "), t["content"])), "\n")


def session_texts(session: Column) -> Column:
    texts = F.transform(session["pairs"], lambda p: pair_text(p["turns"]))
    return F.filter(texts, lambda t: t != "")


def session_messages(session: Column) -> Column:
    found = F.transform(session["pairs"], lambda p: pair_messages(p["turns"]))
    return F.filter(found, lambda m: F.size(m) > 0)


def render_session(session: Column) -> Column:
    blocks = F.filter(F.transform(session["pairs"], lambda p: render_pair(p["turns"])), lambda b: b != "")
    header = F.concat(
        F.lit("Session "), session["session_id"], F.lit(" ("), session["session_date_raw"], F.lit(")")
    )
    return F.when(F.size(blocks) == 0, header).otherwise(
        F.concat(header, F.lit("\n"), F.array_join(blocks, "\n"))
    )


# --- memory records ---------------------------------------------------------------------


def conversation_records(conversations: DataFrame, style: str = "plain", strict: bool = True) -> DataFrame:
    """The ordered ingest table of conversations, one row per non-blank turn.

    ``style='plain'`` ingests the bare text; ``style='speaker'`` ingests ``Name: text``.
    """
    turns = conversation_turns(unpivot_sessions(conversations, strict))
    spoken = X.serialize_turn_speaker(F.col("speaker"), F.col("text"), F.col("query"), F.col("caption"))
    plain = X.serialize_turn_plain(F.col("text"), F.col("query"), F.col("caption"))
    # Both texts are empty where all three parts are; counting the rows of slices builds no texts.
    rows = turns.filter("text <> '' or query <> '' or caption <> ''").select(
        F.lit("locomo").alias("benchmark"),
        I.conversation_id(F.col("conversation_idx")).alias("unit_id"),
        "conversation_idx",
        F.col("dia_id").alias("record_id"),
        F.lit("dia").alias("source_unit_type"),
        F.col("dia_id").alias("source_unit_id"),
        F.array("dia_id").alias("source_unit_ids"),
        "session_key",
        "session_pos",
        "turn_pos",
        "session_date_raw",
        "session_ts",
        "speaker",
        X.speaker_role(F.col("speaker"), F.col("speaker_a")).alias("role"),
        spoken.alias("text"),
        (plain if style == "plain" else spoken).alias("ingest_text"),
        "raw_text",
        "query",
        F.col("caption").alias("blip_caption"),
    )
    return number_records(rows)


def number_records(rows: DataFrame) -> DataFrame:
    """Add ``record_pos``: order inside a unit by (date, session position, turn position)."""
    slice_no = F.floor(F.col("turn_pos") / TURN_SLICE)
    bucket = F.struct(F.coalesce("session_ts", F.lit(float("inf"))), "session_pos", slice_no)
    return ordered_position(rows, ["unit_id"], [F.col("turn_pos")], bucket, "record_pos")


def question_records(questions: DataFrame, granularity: str = "message") -> DataFrame:
    """The ordered ingest table of question haystacks.

    ``message`` keeps every non-blank message as written; ``pair`` renders normalised pairs.
    """
    if granularity == "pair":
        rows = _pair_records(questions)
    elif granularity == "message":
        rows = _message_records(questions)
    else:
        raise ValueError(f"granularity must be 'message' or 'pair', not {granularity!r}")
    return number_records(rows)


def _session_columns(session: str) -> list[Column]:
    return [
        F.lit("longmemeval").alias("benchmark"),
        F.col("question_id").alias("unit_id"),
        F.lit("session").alias("source_unit_type"),
        F.col(f"{session}.session_id").alias("source_unit_id"),
        F.array(f"{session}.session_id").alias("source_unit_ids"),
        F.col(f"{session}.session_id").alias("session_id"),
        F.col(f"{session}.session_date_raw").alias("session_date_raw"),
        F.col(f"{session}.session_timestamp").alias("session_timestamp"),
        F.col(f"{session}.session_timestamp").cast("double").alias("session_ts"),
        F.col("session_pos"),
    ]


def _pair_records(questions: DataFrame) -> DataFrame:
    sessions = normalize_haystack(questions).select(
        "question_id", F.posexplode("sessions").alias("session_pos", "s")
    )
    pairs = sessions.select("*", F.explode("s.pairs").alias("p"))
    return pairs.select(
        *_session_columns("s"),
        F.col("p.pair_index").alias("turn_pos"),
        I.pair_record_id(F.col("s.session_id"), F.col("p.pair_index")).alias("record_id"),
        render_pair(F.col("p.turns")).alias("text"),
        pair_messages(F.col("p.turns")).alias("messages"),
    ).filter(F.size("messages") > 0)


def _message_records(questions: DataFrame) -> DataFrame:
    ordered = sort_sessions(
        F.col("haystack_session_ids"), F.col("haystack_dates"), F.col("haystack_sessions")
    )
    sessions = questions.select("question_id", F.posexplode(ordered).alias("session_pos", "s"))
    turns = sessions.select("*", F.posexplode("s.turns").alias("turn_pos", "t"))
    rows = turns.select(
        *_session_columns("s"),
        "turn_pos",
        F.concat_ws(":", "s.session_id", F.lit("turn"), F.col("turn_pos")).alias("record_id"),
        F.coalesce("t.role", F.lit("")).alias("role"),
        F.coalesce("t.content", F.lit("")).alias("text"),
    )
    return rows.filter(~X.is_blank(F.col("text")))
