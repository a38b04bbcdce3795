"""Memory-evaluation tables made from the driver's parquet tables.

Every view reads its whole source. The same views are written as SQL in the oracle
modules, so both engines start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import padded
from ..operators.sampling import QUESTION_TYPES

OFFSETS = (1, -1, 0, 2, 3)
DOCUMENT_TURNS = 64
DOCUMENTS = 1 << 31  # that one conversation can be cut into, so that keys of two never meet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows carry long texts."""
    return table(spark, sf_dir, name)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, text)."""
    return table(spark, sf_dir, "conversations")


def turn_id(conv: Column, turn: Column) -> Column:
    return F.concat_ws(":", conv.cast("string"), turn.cast("string"))


def document_key() -> Column:
    """A number of its own for each stretch of ``DOCUMENT_TURNS`` turns of a conversation."""
    return F.col("conv_id") * DOCUMENTS + F.floor(F.col("turn") / DOCUMENT_TURNS)


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn is a question, the assistant turn after it is its gold answer."""
    user = texts(spark, sf_dir, "conversations").filter("role = 'user'")
    asked = user.select("conv_id", "turn", F.col("text").alias("question"))
    answered = turns(spark, sf_dir).filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    mix = F.col("conv_id") + F.col("turn")
    return asked.join(answered, ["conv_id", "turn"]).select(
        "conv_id",
        "turn",
        F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit("_q"), F.col("turn").cast("string"),
                 F.when(mix % 5 == 4, F.lit("_abs")).otherwise(F.lit(""))).alias("question_id"),
        "question",
        "answer",
        (mix % 5 + 1).cast("int").alias("category"),
        F.element_at(F.array(*[F.lit(t) for t in QUESTION_TYPES]), (mix % 6 + 1).cast("int")).alias("question_type"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qa`` with a generated answer of one of four kinds and a gold text."""
    rows = qa(spark, sf_dir)
    kind = (F.col("conv_id") + 2 * F.col("turn")) % 4
    generated = (
        F.when(kind == 0, F.col("answer"))
        .when(kind == 1, F.col("question"))
        .when(kind == 2, F.concat(F.lit("The  "), F.replace("answer", F.lit("."), F.lit("!!"))))
        .otherwise(F.lit("I don't know."))
    )
    gold = F.when(F.col("conv_id") % 7 == 0, F.lit("Unknown")).otherwise(F.col("answer"))
    return rows.withColumns({"generated_answer": generated, "ground_truth_answer": gold})


def _candidates() -> Column:
    """Neighbouring turns of the question in an order given by a hash."""
    near = F.filter(
        F.array(*[F.lit(o).cast("bigint") for o in OFFSETS]),
        lambda o: (F.col("turn") + o >= 0) & (F.col("turn") + o < F.col("n_turns")),
    )
    keyed = F.transform(
        near,
        lambda o: F.struct(
            F.md5(F.concat_ws(":", "question_id", o.cast("string"))).alias("h"), (F.col("turn") + o).alias("t")
        ),
    )
    return F.array_sort(keyed)


def _metadata(t: Column) -> Column:
    conv = F.col("conv_id")
    return F.struct(
        F.when(t % 3 != 0, turn_id(conv, t)).alias("source_unit_id"),
        F.array(turn_id(conv, t), turn_id(conv, t + 1)).alias("source_unit_ids"),
    )


def _record_id(t: Column) -> Column:
    return F.concat(F.lit("r:"), turn_id(F.col("conv_id"), t))


def evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows of both datasets' layouts, with results and stage diagnostics.

    Gold ids are the question turn and the answer turn; they are empty for every sixth
    conversation. Every other conversation has stage diagnostics.
    """
    rows = answers(spark, sf_dir)
    lengths = turns(spark, sf_dir).groupBy("conv_id").agg((F.max("turn") + 1).alias("n_turns"))
    rows = rows.join(lengths, "conv_id").withColumn("__c", _candidates())
    gold = F.when(F.col("conv_id") % 6 == 5, F.array().cast("array<string>")).otherwise(
        F.array(turn_id(F.col("conv_id"), F.col("turn")), turn_id(F.col("conv_id"), F.col("turn") + 1))
    )
    with_diagnostics = F.col("conv_id") % 2 == 0
    ranked = F.transform("__c", lambda c: F.struct(_record_id(c["t"]).alias("id"), _metadata(c["t"]).alias("metadata")))
    raw = F.transform("__c", lambda c: F.struct(F.struct(_record_id(c["t"]).alias("record_id")).alias("record")))
    results = F.transform(
        "__c",
        lambda c, i: F.struct(
            _record_id(c["t"]).alias("id"),
            F.lit("").alias("memory"),
            (1.0 / (i + 1)).alias("score"),
            _metadata(c["t"]).alias("metadata"),
        ),
    )
    diagnostics = F.struct(
        with_diagnostics.alias("diagnostics_available"),
        F.when(with_diagnostics, raw).alias("raw_candidates"),
        F.when(with_diagnostics, F.reverse(ranked)).alias("ranked_candidates_canonical"),
        F.when(with_diagnostics, ranked).alias("final_candidates_canonical"),
    )
    category_name = F.concat(F.lit("c"), F.col("category").cast("string"))
    return rows.select(
        "conv_id",
        "turn",
        "question_id",
        "question",
        "answer",
        "category",
        category_name.alias("category_name"),
        "question_type",
        "generated_answer",
        "ground_truth_answer",
        gold.alias("evidence"),
        gold.alias("answer_session_ids"),
        F.when(F.col("turn") % 4 == 0, F.lit(" native ")).alias("cutoff_label"),
        F.struct(
            F.when(F.col("turn") % 3 != 0, F.lit(3)).alias("memories_evaluated"),
            results.alias("search_results"),
            diagnostics.alias("recall_diagnostics"),
        ).alias("retrieval"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings in units of 100 neighbouring ids."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        F.floor(F.col("vec_id") / 100).cast("string").alias("unit_id"),
        padded("v", F.col("vec_id"), 8).alias("vec_key"),
        "embedding",
        "label",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs; line items are their work items, committed when the line is final."""
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("expected"), F.count_if(F.col("l_linestatus") == "F").alias("committed")
    )
    return orders.join(lines, "o_orderkey", "left").select(
        padded("run-", F.col("o_orderkey"), 8).alias("run_id"),
        F.col("o_orderpriority").alias("benchmark"),
        F.col("o_orderstatus").alias("framework"),
        F.col("o_orderdate").alias("modified_at"),
        F.coalesce("expected", F.lit(0)).alias("expected"),
        F.coalesce("committed", F.lit(0)).alias("committed"),
        "o_orderkey",
        "o_custkey",
        "o_totalprice",
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps of a run (one run per user)."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"), "event_id", "ts", "event_type", "value", "props"
    )
