"""Per-unit retrieval and the provenance of what was retrieved.

Vector search is exact. A unit that fits into one block is scored as one matrix in one task;
bigger units are searched through pivots (``vector_index``). Lexical search counts shared terms
of a unit that fits into one block in one task, and joins bigger units on terms. No task holds
more than two blocks.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import nonempty_ids, trimmed_ids
from ..functions.text import blank_to_empty, py_strip, tokens
from ..session import materialize
from .ordered import scan
from .vector_index import SCORE_DIGITS, best, cosines, matrix, pivot_topk

# Result counts, distance limits and prefetch sizes per benchmark.
TOP_K = {"locomo": 8, "longmemeval": 10}
DISTANCE_THRESHOLD = {"locomo": 0.70, "longmemeval": 0.85}
PREFETCH_K = {"locomo": 16, "longmemeval": 64}
METADATA_KEYS = (
    "benchmark",
    "conversation_idx",
    "question_id",
    "source_unit_type",
    "source_unit_id",
    "source_unit_ids",
    "session_id",
    "session_date_raw",
)
RECALLED_HEADER = "=== LONG-TERM MEMORY (RECALLED) ==="
ACTIVE_HEADER = "=== ACTIVE CONVERSATION ==="

BLOCK_ROWS = 2048
POSTING_ROWS = 4096
TERM_ROWS = 1024  # rows of a side whose terms are matched in one task
TERM_BYTES = 16 << 20  # and the bytes of their texts
TERM_SLAB = 4096  # distinct terms matched at a time
HITS = "unit_id string, query_id string, record_id string, shared long, size int"


# --- exact search -----------------------------------------------------------------------


def _best_in_unit(k: int):
    def run(queries: pd.DataFrame, records: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or records.empty:
            names = np.array([], dtype=object)
            return pd.DataFrame({"unit_id": names, "query_id": names, "record_id": names, "score": np.array([])})
        ids, scores = best(cosines(matrix(queries["v"]), matrix(records["v"])), records["id"].to_numpy(), k)
        return pd.DataFrame(
            {
                "unit_id": np.repeat(queries["unit_id"].to_numpy(), ids.shape[1]),
                "query_id": np.repeat(queries["id"].to_numpy(), ids.shape[1]),
                "record_id": ids.ravel(),
                "score": scores.ravel(),
            }
        )

    return run


def _big_units(queries: DataFrame, records: DataFrame, block_rows: int) -> DataFrame:
    """(unit_id, queries, records): row counts of the units that need more than one block on a side.

    Written once, so that its real size decides whether it is broadcast.
    """
    both = records.groupBy("unit_id").agg(F.count(F.lit(1)).alias("records")).join(
        queries.groupBy("unit_id").agg(F.count(F.lit(1)).alias("queries")), "unit_id"
    )
    return materialize(both.filter((F.col("records") > block_rows) | (F.col("queries") > block_rows)), "big-units")


def vector_topk(
    queries: DataFrame, records: DataFrame, k: int, vector: str = "embedding", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Best ``k`` records of the query's own unit by (cosine desc, record_id), with ``rank``.

    ``queries``: (unit_id, query_id, vector); ``records``: (unit_id, record_id, vector). Ids
    are strings. A vector without length scores 0 with every other.
    """
    value = F.col(vector).cast("array<double>").alias("v")
    left = queries.select("unit_id", F.col("query_id").alias("id"), value)
    right = records.select("unit_id", F.col("record_id").alias("id"), value)
    # Both sides may come from one table; new column ids keep the cogroup unambiguous.
    right = right.toDF(*right.columns)
    big = _big_units(left, right, block_rows)
    units = big.select("unit_id")
    found = (
        left.join(units, "unit_id", "left_anti").groupBy("unit_id")
        .cogroup(right.join(units, "unit_id", "left_anti").groupBy("unit_id"))
        .applyInPandas(_best_in_unit(k), "unit_id string, query_id string, record_id string, score double")
    )
    if not big.isEmpty():
        found = found.unionByName(pivot_topk(left, right, big, k, block_rows))
    return top_by_score(found, k)


def top_by_score(scored: DataFrame, k: int) -> DataFrame:
    """Add ``rank`` (1-based) and keep the best ``k`` of each query."""
    order = Window.partitionBy("unit_id", "query_id").orderBy(F.desc("score"), "record_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def numbered_terms(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """(number, unit_id, row_id, terms) of each row, written once: its distinct tokens and a number of its own."""
    words = F.array_distinct(tokens(F.col(text)))
    return materialize(rows.select(F.monotonically_increasing_id().alias("number"), "unit_id", row_id, words.alias("terms")), "terms")


def _best_by_terms(k: int):
    """The best records of each query row of one unit: (unit_id, query_id, record_id, shared, size)."""

    def codes(rows: pa.Table, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # A row for each distinct term of a row: its number, and that of the row.
        terms = rows["terms"].combine_chunks()
        sizes = np.diff(np.asarray(terms.offsets))
        at = pc.fill_null(pc.index_in(terms.flatten(), known), -1)
        return np.asarray(at).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)

    def run(queries: pa.Table, records: pa.Table) -> pa.Table:
        records = records.take(pc.sort_indices(records["id"], null_placement="at_start"))
        n, m = queries.num_rows, records.num_rows
        shared = np.zeros((n, m), np.float32)  # whole numbers, far below 2**24
        if n and m:
            known = pc.unique(queries["terms"].combine_chunks().flatten())
            sides = [(*codes(side, known), side.num_rows) for side in (queries, records)]
            for low in range(0, len(known), TERM_SLAB):
                slabs = []
                for term, row, rows in sides:
                    here = (term >= low) & (term < low + TERM_SLAB)
                    slab = np.zeros((rows, min(TERM_SLAB, len(known) - low)), np.float32)
                    slab[row[here], term[here] - low] = 1
                    slabs.append(slab)
                shared += slabs[0] @ slabs[1].T
        # Records stand by id, so a stable order breaks ties.
        best_first = np.argsort(-shared, axis=1, kind="stable")[:, :k]
        counts = np.take_along_axis(shared, best_first, 1)
        q, at = np.nonzero(counts)
        chosen = queries.take(pa.array(q))
        return pa.table(
            {
                "unit_id": chosen["unit_id"],
                "query_id": chosen["id"],
                "record_id": records["id"].take(pa.array(best_first[q, at])),
                "shared": pa.array(counts[q, at].astype(np.int64)),
                "size": pc.list_value_length(chosen["terms"]),
            }
        )

    return run


def _term_heavy(queries: DataFrame, records: DataFrame, text: str, rows: int) -> DataFrame:
    """(unit_id) of the units that have too many rows or too long texts on a side for one task, written once."""
    many = F.count(F.lit(1)) > rows
    long = F.sum(F.octet_length(text)) > TERM_BYTES
    sides = [side.groupBy("unit_id").agg((many | F.coalesce(long, F.lit(False))).alias("big")) for side in (queries, records)]
    return materialize(sides[0].unionByName(sides[1]).filter("big").select("unit_id").distinct(), "big-units")


def _joined_hits(queries: DataFrame, records: DataFrame, text: str, slice_rows: int) -> DataFrame:
    """Hits of all pairs with a term in common, through an inverted index of the units."""
    with ThreadPoolExecutor(2) as both:  # two jobs at once
        asked, held = both.map(numbered_terms, (queries, records), ("query_id", "record_id"), (text, text))
    posted = held.select("unit_id", F.col("number").alias("r"), F.explode("terms").alias("term"))
    hot = posted.groupBy("unit_id", "term").agg(F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias("slices"))
    hot = materialize(hot.filter("slices > 1"), "hot-terms")
    slices = F.coalesce("slices", F.lit(1))
    at = ["unit_id", "term"]
    left = asked.select("unit_id", F.col("number").alias("q"), F.explode("terms").alias("term")).join(hot, at, "left")
    left = left.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("slices")
    right = posted.join(hot, at, "left").withColumn("slice", F.pmod(F.xxhash64("r"), slices).cast("int")).drop("slices")
    # Pairs are counted by their numbers; names follow for the pairs alone.
    hits = left.join(right, [*at, "slice"]).groupBy("q", "r").agg(F.count(F.lit(1)).alias("shared"))
    return hits.join(
        asked.select(F.col("number").alias("q"), "unit_id", "query_id", F.size("terms").alias("size")), "q"
    ).join(held.select(F.col("number").alias("r"), "record_id"), "r").select("unit_id", "query_id", "record_id", "shared", "size")


def lexical_topk(
    queries: DataFrame, records: DataFrame, k: int, text: str = "text", slice_rows: int = POSTING_ROWS, block_rows: int = TERM_ROWS
) -> DataFrame:
    """Best ``k`` records by the share of the query's distinct tokens that they hold, then by id.

    A unit with at most ``block_rows`` rows and ``TERM_BYTES`` of text on each side is matched in
    one task, as a product of term incidences, so its pairs are never shuffled. Bigger units go
    through an inverted index: records are posted under (unit, term), queries join on their
    terms, and the hits of a pair are counted. The postings of a term with more than
    ``slice_rows`` records are cut into slices, to each of which its queries go, so a common
    term is spread over tasks. Records without a token of the query never match.
    """
    big = _term_heavy(queries, records, text, block_rows)
    words = F.array_distinct(tokens(F.col(text))).alias("terms")
    # Both sides may come from one table; new column ids keep the cogroup unambiguous.
    sides = [
        side.filter("unit_id is not null").select(F.col("unit_id").cast("string"), F.col(name).cast("string").alias("id"), words)
        for side, name in ((queries, "query_id"), (records, "record_id"))
    ]
    sides[1] = sides[1].toDF(*sides[1].columns)
    left, right = (side.join(big, "unit_id", "left_anti").groupBy("unit_id") for side in sides)
    found = left.cogroup(right).applyInArrow(_best_by_terms(k), HITS)
    if not big.isEmpty():
        heavy = [side.join(big, "unit_id", "left_semi") for side in (queries, records)]
        found = found.unionByName(_joined_hits(*heavy, text, slice_rows))
    score = F.round(F.col("shared") / F.col("size"), SCORE_DIGITS)
    return top_by_score(found.select("unit_id", "query_id", "record_id", score.alias("score")), k)


def distance_filter(scored: DataFrame, threshold: float, limit: int | None = None) -> DataFrame:
    """Keep results within a cosine distance; optionally only the first ``limit`` ranks."""
    near = scored.filter(F.round(1.0 - F.col("score"), SCORE_DIGITS) <= threshold)
    return near if limit is None else near.filter(F.col("rank") <= limit)


def multi_channel(channels: dict[str, DataFrame], k: int) -> DataFrame:
    """Merge per-channel top lists: best score per record, the channels that found it, top k."""
    tagged = None
    for name, frame in channels.items():
        rows = frame.select("unit_id", "query_id", "record_id", "score", F.lit(name).alias("channel"))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    merged = tagged.groupBy("unit_id", "query_id", "record_id").agg(
        F.max("score").alias("score"), F.array_sort(F.collect_set("channel")).alias("channels")
    )
    return top_by_score(merged, k)


# --- search results ---------------------------------------------------------------------


def extract_surface(raw_json: Column, item_type: str) -> Column:
    """The list inside ``{"results": [...]}``, or the list itself; null gives an empty list."""
    text = blank_to_empty(raw_json)
    listed = F.from_json(text, f"array<{item_type}>")
    inside = F.get_json_object(text, "$.results")
    empty = F.array().cast(f"array<{item_type}>")
    is_object = F.startswith(text, F.lit("{"))
    value = F.when(is_object, inside).otherwise(text)
    missing = value.isNull() | (value == "") | (value == "null")
    problem = F.raise_error(F.lit("the search surface must be a list of results")).cast(f"array<{item_type}>")
    parsed = F.when(is_object, F.from_json(inside, f"array<{item_type}>")).otherwise(listed)
    return F.when(missing, empty).when(F.startswith(value, F.lit("[")), parsed).otherwise(problem)


def minimal_metadata(metadata: Column) -> Column:
    """The known keys of a map with their non-null values; null when none is left."""
    kept = F.map_filter(metadata, lambda k, v: k.isin(*METADATA_KEYS) & v.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def normalize_search(results: DataFrame) -> DataFrame:
    """Defaults for missing fields, and ``rank`` by score with ties in original order.

    In: (query_id, pos, memory, score, id, created_at, updated_at, metadata map).
    """
    def truthy(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name)).alias(name)

    rows = results.select(
        "query_id",
        "pos",
        F.coalesce("memory", F.lit("")).alias("memory"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
        F.coalesce("id", F.lit("")).alias("id"),
        truthy("created_at"),
        truthy("updated_at"),
        minimal_metadata(F.col("metadata")).alias("metadata"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    return rows.withColumn("rank", F.row_number().over(order))


# --- provenance of structured evidence --------------------------------------------------


def support_record_ids(source_record_id: Column, support_ids: Column) -> Column:
    """The source record first, then its supports; trimmed, distinct, first-seen order."""
    head = F.array(F.coalesce(source_record_id, F.lit("")))
    return trimmed_ids(F.concat(head, F.coalesce(support_ids, F.array().cast("array<string>"))))


def record_source_units(source_unit_ids: Column, source_unit_id: Column) -> Column:
    """Source units of one record: the list if there is one, else the single id."""
    single = F.when(F.coalesce(source_unit_id, F.lit("")) != "", F.array(source_unit_id)).otherwise(
        F.array().cast("array<string>")
    )
    return F.coalesce(source_unit_ids, single)


def source_units_for_records(evidence: DataFrame, records: DataFrame) -> DataFrame:
    """Add ``source_unit_ids``: units of all support records, in order and distinct.

    In: ``evidence`` (unit_id, evidence_id, support_record_ids), ``records`` (unit_id,
    record_id, source_unit_id, source_unit_ids). The list gathered per evidence row is as
    long as that row's own support list.
    """
    asked = evidence.select(
        "unit_id", "evidence_id", F.posexplode("support_record_ids").alias("__at", "record_id")
    )
    units = records.select(
        "unit_id",
        "record_id",
        record_source_units(F.col("source_unit_ids"), F.col("source_unit_id")).alias("__units"),
    )
    found = (
        asked.join(units, ["unit_id", "record_id"])
        .groupBy("unit_id", "evidence_id")
        .agg(F.array_sort(F.collect_list(F.struct("__at", "__units"))).alias("__u"))
    )
    flat = trimmed_ids(F.flatten(F.transform("__u", lambda u: u["__units"])))
    joined = evidence.join(found.select("unit_id", "evidence_id", flat.alias("__flat")), ["unit_id", "evidence_id"], "left")
    return joined.withColumn("source_unit_ids", F.coalesce("__flat", F.array().cast("array<string>"))).drop("__flat")


def primary_record(support_records: Column, source_record_id: Column) -> Column:
    """The support record that is the source, else the first one, else null."""
    same = F.filter(support_records, lambda r: r["record_id"] == source_record_id)
    return F.coalesce(F.get(same, F.lit(0)), F.get(support_records, F.lit(0)))


def candidate_score(answerability: Column, semantic: Column, symbolic: Column, temporal: Column) -> Column:
    return F.coalesce(answerability, semantic, symbolic, temporal, F.lit(0.0)).cast("double")


def evidence_text(record_text: Column, subject: Column, predicate: Column, object_: Column) -> Column:
    """The record text, else the stated fact as ``subject predicate object``."""
    text = blank_to_empty(record_text)
    parts = [F.when(p != "", p) for p in (subject, predicate, object_)]
    return F.when(text != "", text).otherwise(py_strip(F.concat_ws(" ", *parts)))


def canonical_results(evidence: DataFrame, records: DataFrame) -> DataFrame:
    """Evidence rows as search results with the metadata of the record they come from.

    In: ``evidence`` (unit_id, query_id, evidence_id, evidence_type, source_record_id,
    support_record_ids, answerability, semantic_score, symbolic_score, temporal_score,
    channels, subject, predicate, object); ``records`` as above plus (text, created_at,
    source_unit_type). A raw turn shows its record; a card shows its primary support
    record or, without text, its fact.
    """
    raw = F.col("evidence_type") == "raw_turn"
    base = evidence.withColumn(
        "source_record_id",
        F.when(
            raw, F.coalesce(F.nullif("source_record_id", F.lit("")), F.col("evidence_id"))
        ).otherwise(F.coalesce("source_record_id", F.lit(""))),
    )
    base = base.withColumn(
        "support_record_ids", support_record_ids(F.col("source_record_id"), F.col("support_record_ids"))
    )
    base = source_units_for_records(base, records)
    # Metadata comes from the source record, else from the first support record.
    base = base.withColumn(
        "__lookup",
        F.coalesce(F.nullif("source_record_id", F.lit("")), F.get("support_record_ids", F.lit(0)), F.lit("")),
    )
    shown = records.select(
        F.col("unit_id"),
        F.col("record_id").alias("__lookup"),
        F.col("text").alias("__text"),
        F.col("created_at"),
        F.col("source_unit_type"),
    )
    joined = base.join(shown, ["unit_id", "__lookup"], "left")
    card_text = evidence_text(F.col("__text"), F.col("subject"), F.col("predicate"), F.col("object"))
    first_unit = F.get("source_unit_ids", F.lit(0))
    only_one = (F.size("source_unit_ids") == 1) & (F.col("source_unit_type") == "session")
    return joined.select(
        "unit_id",
        "query_id",
        F.when(raw, F.coalesce("__text", F.lit(""))).otherwise(card_text).alias("memory"),
        candidate_score(
            F.col("answerability"), F.col("semantic_score"), F.col("symbolic_score"), F.col("temporal_score")
        ).alias("score"),
        F.when(raw, F.col("source_record_id")).otherwise(F.col("evidence_id")).alias("id"),
        "created_at",
        F.struct(
            "evidence_type",
            F.when(~raw, F.col("evidence_id")).alias("card_id"),
            "source_record_id",
            F.col("support_record_ids").alias("source_record_ids"),
            "support_record_ids",
            F.when(F.size("channels") > 0, trimmed_ids(F.col("channels"))).alias("channels"),
            first_unit.alias("source_unit_id"),
            "source_unit_ids",
            "source_unit_type",
            F.when(only_one, first_unit).alias("session_id"),
        ).alias("metadata"),
    )


# --- contexts ---------------------------------------------------------------------------


def render_context(evidence_texts: Column, active_block: Column) -> Column:
    """Recalled header and body when there is a body, a blank line, then the active block."""
    body = F.array_join(evidence_texts, "\n")
    recalled = F.concat(F.lit(RECALLED_HEADER + "\n"), body, F.lit("\n\n"))
    return F.concat(F.when(blank_to_empty(body) != "", recalled).otherwise(F.lit("")), active_block)


def inspect_context(text: Column) -> Column:
    """Struct (recalled, active, error): which headers are there and what is wrong."""
    recalled_at = F.instr(text, RECALLED_HEADER)
    active_at = F.instr(text, ACTIVE_HEADER)
    error = F.when(active_at == 0, F.lit("missing active header")).when(
        recalled_at > active_at, F.lit("recalled after active")
    )
    return F.struct(
        (recalled_at > 0).alias("recalled"), (active_at > 0).alias("active"), error.alias("error")
    )


# --- ingestion checks and usage shares --------------------------------------------------


def ingest_barrier(ingested: DataFrame, stored: DataFrame) -> DataFrame:
    """Units whose ingested count differs from active + archived. Both frames: one row per item."""
    a = ingested.groupBy("unit_id").agg(F.count(F.lit(1)).alias("ingested_count"))
    b = stored.groupBy("unit_id").agg(F.count(F.lit(1)).alias("stored_count"))
    both = a.join(b, "unit_id", "full").select(
        "unit_id",
        F.coalesce("ingested_count", F.lit(0)).alias("ingested_count"),
        F.coalesce("stored_count", F.lit(0)).alias("stored_count"),
    )
    return both.filter("ingested_count <> stored_count")


def below_minimum(items: DataFrame, by: str, minimum: int, expected: DataFrame | None = None) -> DataFrame:
    """Collections with fewer than ``minimum`` items, including expected ones with none."""
    counts = items.groupBy(by).agg(F.count(F.lit(1)).alias("item_count"))
    if expected is not None:
        counts = expected.select(by).distinct().join(counts, by, "left")
    return counts.select(by, F.coalesce("item_count", F.lit(0)).alias("item_count")).filter(
        F.col("item_count") < minimum
    )


USAGE_FIELDS = ("prompt_tokens", "completion_tokens", "total_tokens", "calls")


def apportion_usage(
    items: DataFrame, totals: DataFrame, order: list[Column], bucket: Column, fields: tuple[str, ...] = USAGE_FIELDS
) -> DataFrame:
    """Split each unit's totals over its items; the first ``remainder`` items get one more.

    Shares are whole numbers that sum to the total. Items of a unit without totals keep null
    shares; ``unapportioned`` lists the units that have only one of the two.
    """
    given = totals.select("unit_id", *[F.col(f).alias(f"__{f}") for f in fields])
    placed = scan(items, ["unit_id"], order, bucket, position="__pos", total="__items").join(given, "unit_id", "left")
    shares = [
        (
            F.expr(f"`__{f}` div __items")
            + F.when(F.col("__pos") < F.col(f"__{f}") % F.col("__items"), 1).otherwise(0)
        ).cast("bigint").alias(f)
        for f in fields
    ]
    return placed.select(*items.columns, *shares)


def unapportioned(items: DataFrame, totals: DataFrame) -> DataFrame:
    """(unit_id, problem) of units with items but no totals, or with totals but no items."""
    both = items.select("unit_id").distinct().withColumn("__i", F.lit(True)).join(
        totals.select("unit_id").distinct().withColumn("__t", F.lit(True)), "unit_id", "full"
    )
    problem = F.when(F.col("__t").isNull(), F.lit("no totals")).when(F.col("__i").isNull(), F.lit("no items"))
    return both.select("unit_id", problem.alias("problem")).filter("problem is not null")
