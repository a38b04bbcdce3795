"""Answer and retrieval scores per row, averaged overall and by group."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import overlap as O
from ..functions import ranking as R
from ..functions import text as X

RETRIEVAL_METRICS = ("recall_at_k", "precision_at_k", "mrr", "ndcg_at_k")
METRICS = ("exact_match", "token_f1", "rouge_l", *RETRIEVAL_METRICS)
# The mean is shown with this many digits so that summation order cannot show through.
MEAN_DIGITS = 9


@dataclass(frozen=True)
class Rules:
    """How one benchmark names its columns and reads its candidate lists."""

    benchmark: str
    predictions: tuple[str, ...]
    golds: tuple[str, ...]
    groups: tuple[str, ...]
    gold_ids: str
    alias_mode: str
    abstention: bool
    evaluator_version: str


RULES = {
    "locomo": Rules(
        benchmark="locomo",
        predictions=("generated_answer", "prediction"),
        golds=("ground_truth_answer", "ground_truth"),
        groups=("category_name", "category"),
        gold_ids="evidence",
        alias_mode="union",
        abstention=False,
        evaluator_version="locomo-evaluator-v2",
    ),
    "longmemeval": Rules(
        benchmark="longmemeval",
        predictions=("generated_answer",),
        golds=("ground_truth_answer",),
        groups=("question_type",),
        gold_ids="answer_session_ids",
        alias_mode="first",
        abstention=True,
        evaluator_version="longmemeval-evaluator-v1",
    ),
}


def rules_for(benchmark: str) -> Rules:
    if benchmark not in RULES:
        raise ValueError(f"unsupported benchmark: {benchmark!r}")
    return RULES[benchmark]


def _first_of(df: DataFrame, names: tuple[str, ...], default: str) -> Column:
    present = [F.col(n).cast("string") for n in names if n in df.columns]
    return F.coalesce(*present, F.lit(default))


def group_column(df: DataFrame, rules: Rules) -> Column:
    return _first_of(df, rules.groups, "unknown")


def gold_id_column(rules: Rules) -> Column:
    return R.nonempty_ids(F.col(rules.gold_ids))


def score_rows(evaluations: DataFrame, benchmark: str) -> DataFrame:
    """Add ``group``, ``abstained`` and the seven metrics to every evaluation row.

    Rows without gold ids stay in and score 0 on retrieval.
    """
    rules = rules_for(benchmark)
    prediction = _first_of(evaluations, rules.predictions, "")
    gold = _first_of(evaluations, rules.golds, "")
    if rules.abstention:
        prediction, gold = X.normalize_abstention(prediction), X.normalize_abstention(gold)
    results = F.col("retrieval.search_results")
    k = R.cutoff_k(F.col("retrieval.memories_evaluated"), results)
    rows = evaluations.withColumns(
        {
            "group": group_column(evaluations, rules),
            "__p": prediction,
            "__g": gold,
            "__ids": R.retrieved_ids(results, k, rules.alias_mode),
            "__gold": gold_id_column(rules),
        }
    )
    rows = rows.withColumns({"__pn": X.normalize_text(F.col("__p")), "__gn": X.normalize_text(F.col("__g"))})
    rows = rows.withColumn("__o", O.normalized_overlap(F.col("__pn"), F.col("__gn")))
    token = F.lit(X.ABSTAIN_TOKEN)
    scores = {
        "abstained": (F.col("__p") == token) | (F.col("__g") == token),
        "exact_match": (F.col("__pn") == F.col("__gn")).cast("double"),
        "token_f1": O.token_f1(F.col("__o")),
        "rouge_l": O.rouge_l(F.col("__o")),
        **R.ranking_metrics(F.col("__ids"), F.col("__gold")),
    }
    return rows.withColumns(scores).drop("__p", "__g", "__pn", "__gn", "__ids", "__gold", "__o")


def mean_by_scope(rows: DataFrame, keys: list[str], group: str, metrics: tuple[str, ...]) -> DataFrame:
    """Means per (keys, group) and per keys: columns ``scope``, ``group``, ``n`` and the metrics.

    The rows are summed once by group; the overall mean is made from those few sums.
    """
    sums = [F.sum(m).alias(m) for m in metrics]
    by_group = rows.groupBy(*keys, F.col(group).alias("group")).agg(F.count(F.lit(1)).alias("n"), *sums)
    both = by_group.groupingSets([[F.col(k) for k in keys], [*[F.col(k) for k in keys], F.col("group")]], *keys, "group")
    totals = both.agg(
        F.grouping("group").alias("__all"), F.sum("n").cast("bigint").alias("n"), *sums
    )
    means = [F.round(F.col(m) / F.col("n"), MEAN_DIGITS).alias(m) for m in metrics]
    scope = F.when(F.col("__all") == 1, F.lit("overall")).otherwise(F.lit("group")).alias("scope")
    return totals.select(*keys, scope, "group", "n", *means)


def rigorous(evaluations: DataFrame, benchmark: str) -> DataFrame:
    """Mean of the seven metrics, overall and by group."""
    return mean_by_scope(score_rows(evaluations, benchmark), [], "group", METRICS)


def abstention_count(evaluations: DataFrame, benchmark: str = "longmemeval") -> DataFrame:
    """How many rows abstain in the prediction or in the gold answer."""
    rules = rules_for(benchmark)
    token = F.lit(X.ABSTAIN_TOKEN)
    p = X.normalize_abstention(_first_of(evaluations, rules.predictions, ""))
    g = X.normalize_abstention(_first_of(evaluations, rules.golds, ""))
    return evaluations.agg(F.count_if((p == token) | (g == token)).alias("abstention_count"))


def cutoff_label(evaluations: DataFrame, position: str, top_k: int | None = None) -> DataFrame:
    """The label of the first row, else ``top_<k>``, else ``flat``."""
    label = X.blank_to_empty(F.col("cutoff_label"))
    default = F.lit(f"top_{int(top_k)}" if top_k is not None else "flat")
    first = F.min_by(label, F.col(position))
    return evaluations.agg(F.coalesce(F.nullif(first, F.lit("")), default).alias("cutoff_label"))


def judge_score(evaluations: DataFrame) -> DataFrame:
    """Judged rows, mean score, pass rate; COMPLETED only when every row is judged."""
    judged = F.coalesce("judgment", F.lit("")) != ""
    passed = F.upper("judgment").isin("CORRECT", "PASS")
    row = evaluations.agg(
        F.count(F.lit(1)).alias("__n"),
        F.count_if(judged).alias("judged_count"),
        F.sum(F.when(judged, F.coalesce(F.col("score").cast("double"), F.lit(0.0)))).alias("__sum"),
        F.count_if(passed).alias("__pass"),
    )
    count = F.col("judged_count")

    def ratio(value: str) -> Column:
        return F.when(count > 0, F.round(F.col(value) / count, MEAN_DIGITS)).otherwise(F.lit(0.0))

    return row.select(
        F.when(count == F.col("__n"), F.lit("COMPLETED")).otherwise(F.lit("FAILED")).alias("status"),
        "judged_count",
        ratio("__sum").alias("avg_judge_score"),
        ratio("__pass").alias("judge_pass_rate"),
    )
