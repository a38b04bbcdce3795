"""Retrieval metrics per stage: raw candidates, ranked candidates, final results.

Rows without gold ids are left out here, and final ids use all results, with no cutoff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranking as R
from .scoring import MEAN_DIGITS, RETRIEVAL_METRICS, gold_id_column, group_column, mean_by_scope, rules_for

STAGES = ("raw", "ranked", "final")
_DIAG = "retrieval.recall_diagnostics"


def record_sources(ranked: Column, final: Column) -> Column:
    """Map record id -> source id from ranked, then final candidates; later entries win."""
    everything = F.concat(*[F.coalesce(c, F.array()) for c in (ranked, final)])
    usable = F.filter(
        everything,
        lambda c: (F.coalesce(c["id"], F.lit("")) != "")
        & (F.coalesce(c["metadata"]["source_unit_id"], F.lit("")) != ""),
    )
    pairs = F.transform(usable, lambda c: F.struct(c["id"].alias("k"), c["metadata"]["source_unit_id"].alias("v")))
    ids = F.transform(usable, lambda c: c["id"])
    # Keep an entry only where the same id does not come again.
    last = F.filter(
        pairs,
        lambda p, i: ~F.array_contains(F.slice(ids, i + 2, F.size(ids)), p["k"]),
    )
    return F.map_from_entries(last)


def raw_record_ids(raw: Column) -> Column:
    return F.transform(raw, lambda c: F.coalesce(c["record"]["record_id"], F.lit("")))


def _mapped(raw_ids: Column, sources: Column) -> Column:
    return F.filter(F.transform(raw_ids, lambda r: F.try_element_at(sources, r)), lambda s: s.isNotNull())


def stage_rows(evaluations: DataFrame, benchmark: str) -> DataFrame:
    """Rows with gold ids plus ``raw_ids``, ``ranked_ids``, ``final_ids`` and the flags for the statistics."""
    rules = rules_for(benchmark)
    empty = F.array().cast("array<string>")
    ranked_list = F.col(f"{_DIAG}.ranked_candidates_canonical")
    raw_list = F.col(f"{_DIAG}.raw_candidates")
    rows = evaluations.withColumns(
        {"group": group_column(evaluations, rules), "__gold": gold_id_column(rules)}
    ).filter(F.size("__gold") > 0)
    rows = rows.withColumns(
        {
            "final_ids": R.candidate_source_ids(F.col("retrieval.search_results"), rules.alias_mode),
            "__ranked": R.candidate_source_ids(ranked_list, rules.alias_mode),
            "__raw_records": F.coalesce(raw_record_ids(raw_list), empty),
            "__sources": record_sources(ranked_list, F.col(f"{_DIAG}.final_candidates_canonical")),
            "has_diagnostics": F.coalesce(F.col(f"{_DIAG}.diagnostics_available"), F.lit(False))
            | (F.coalesce(F.size(ranked_list), F.lit(0)) > 0)
            | (F.coalesce(F.size(raw_list), F.lit(0)) > 0),
        }
    )
    rows = rows.withColumn("__raw_hits", _mapped(F.col("__raw_records"), F.col("__sources")))
    rows = rows.withColumn("__raw", R.nonempty_ids(F.col("__raw_hits")))
    known = F.col("has_diagnostics")
    # Conversation rows count repeated sources as unmappable, question rows do not.
    found = F.size("__raw") if rules.alias_mode == "union" else F.size("__raw_hits")
    return rows.withColumns(
        {
            "ranked_ids": F.when(known, F.col("__ranked")).otherwise(F.col("final_ids")),
            "raw_ids": F.when(~known, F.col("final_ids"))
            .when(F.size("__raw") > 0, F.col("__raw"))
            .otherwise(F.col("__ranked")),
            "raw_unmappable": F.when(known, F.size("__raw_records") - found).otherwise(F.lit(0)),
        }
    )


def ablation(evaluations: DataFrame, benchmark: str) -> DataFrame:
    """Mean retrieval metrics per stage, overall and by group."""
    rows = stage_rows(evaluations, benchmark).select(
        "group",
        F.col("__gold"),
        F.explode(
            F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"{s}_ids").alias("ids")) for s in STAGES])
        ).alias("s"),
    )
    scored = rows.select("group", F.col("s.stage").alias("stage"), F.col("s.ids").alias("ids"), "__gold")
    scored = scored.withColumns(R.ranking_metrics(F.col("ids"), F.col("__gold")))
    return mean_by_scope(scored, ["stage"], "group", RETRIEVAL_METRICS)


def ablation_stats(evaluations: DataFrame, benchmark: str) -> DataFrame:
    """Question counts, unmappable raw candidates and mean candidate counts, as one row."""
    rows = stage_rows(evaluations, benchmark)
    means = [
        F.coalesce(F.round(F.avg(F.size(f"{s}_ids")), MEAN_DIGITS), F.lit(0.0)).alias(f"avg_candidates_{s}")
        for s in STAGES
    ]
    return rows.agg(
        F.count(F.lit(1)).alias("total_questions"),
        F.count_if("has_diagnostics").alias("questions_with_diagnostics"),
        F.count_if(~F.col("has_diagnostics")).alias("questions_without_diagnostics"),
        F.coalesce(F.sum("raw_unmappable"), F.lit(0)).cast("bigint").alias("raw_unmappable_candidates_total"),
        *means,
    )
