"""Deterministic stratified sampling.

A stratum is ordered by SHA-256 of (seed, id), and the first rows of that order are the
sample. Counts per (stratum, hash prefix) decide whole prefixes at once, so only the one
prefix in which the cut falls is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json
from ..session import materialize

ROUNDINGS = ("ceil", "floor", "round")
PREFIX_CHARS = 3
# The question types that are sampled when none are named.
QUESTION_TYPES = (
    "temporal-reasoning",
    "multi-session",
    "knowledge-update",
    "single-session-user",
    "single-session-assistant",
    "single-session-preference",
)


def sample_size(population: Column, fraction: float, rounding: str = "ceil") -> Column:
    """Rounded share, at least 1 and at most the population; 0 for no population."""
    if rounding not in ROUNDINGS:
        raise ValueError(f"rounding must be one of {ROUNDINGS}, not {rounding!r}")
    raw = population.cast("double") * F.lit(float(fraction))
    value = {"ceil": F.ceil(raw), "floor": F.floor(raw), "round": F.floor(raw + 0.5)}[rounding]
    wanted = F.least(population.cast("bigint"), F.greatest(F.lit(1).cast("bigint"), value.cast("bigint")))
    return F.when(population <= 0, F.lit(0).cast("bigint")).otherwise(wanted)


def _draw_key(seed: int, id_columns: list[str]) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in id_columns]), 256)


def _stratum_text(stratum: Column) -> Column:
    """Strata are texts; rows without one form a stratum of their own."""
    return F.coalesce(stratum.cast("string"), F.lit("None"))


def hash_sample(
    df: DataFrame,
    id_columns: list[str],
    stratum: Column,
    size: Column,
    seed: int,
    prefix_chars: int = PREFIX_CHARS,
) -> DataFrame:
    """The first ``size`` rows of every stratum in hash order.

    ``size`` is an expression over the column ``population`` (rows in the stratum).
    """
    keyed = df.withColumn("__s", _stratum_text(stratum)).withColumn("__h", _draw_key(seed, id_columns))
    keyed = keyed.withColumn("__p", F.substring("__h", 1, prefix_chars))
    prefixes = keyed.groupBy("__s", "__p").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("__s").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    # Written once: both branches read it, and its real size decides whether it is broadcast.
    cuts = materialize(
        prefixes.withColumn("population", F.sum("__n").over(Window.partitionBy("__s")))
        .withColumn("__left", size - F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        .filter("__left > 0")
        .select("__s", "__p", "__n", "__left"),
        "sample-cuts",
    )
    drawn = keyed.join(cuts, ["__s", "__p"])
    whole = drawn.filter("__n <= __left")
    order = Window.partitionBy("__s", "__p").orderBy("__h", *id_columns)
    edge = drawn.filter("__n > __left").withColumn("__r", F.row_number().over(order)).filter("__r <= __left")
    return whole.select(*df.columns).unionByName(edge.select(*df.columns))


def stratified_sample(
    df: DataFrame,
    id_columns: list[str],
    fraction: float,
    seed: int = 42,
    rounding: str = "ceil",
    stratum: Column | None = None,
) -> DataFrame:
    """Rows of the sample. ``id_columns`` are unique."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be greater than 0 and at most 1")
    by = F.lit("all") if stratum is None else stratum
    size = sample_size(F.col("population"), fraction, rounding)
    return hash_sample(df, id_columns, by, size, seed)


def sample_qa(
    questions: DataFrame, fraction: float, seed: int = 42, rounding: str = "ceil",
    stratify_by: str | None = None,
) -> DataFrame:
    """Sample questions of conversations, optionally within each category."""
    if stratify_by not in (None, "category"):
        raise ValueError("questions of conversations can only be stratified by 'category'")
    stratum = F.coalesce(F.col("category").cast("int"), F.lit(0)).cast("string") if stratify_by else None
    return stratified_sample(
        questions, ["conversation_idx", "question_idx"], fraction, seed, rounding, stratum
    )


def sample_conversations(
    conversations: DataFrame, fraction: float, seed: int = 42, rounding: str = "ceil"
) -> DataFrame:
    """Sample whole conversations (no strata)."""
    return stratified_sample(conversations, ["conversation_idx"], fraction, seed, rounding, None)


def sample_records(
    questions: DataFrame, fraction: float, seed: int = 42, rounding: str = "ceil",
    stratify_by: str | None = None,
) -> DataFrame:
    """Sample question records, optionally within each question type."""
    if stratify_by not in (None, "question_type"):
        raise ValueError("question records can only be stratified by 'question_type'")
    stratum = F.coalesce(F.col("question_type"), F.lit("unknown")) if stratify_by else None
    return stratified_sample(
        questions, ["question_id", "question_pos"], fraction, seed, rounding, stratum
    )


def sample_per_type(
    questions: DataFrame,
    per_type: int = 5,
    seed: int = 42,
    types: list[str] | tuple[str, ...] | None = None,
) -> DataFrame:
    """Up to ``per_type`` questions of each type; order the result by ``question_id``.

    The rank limit is a constant, so Spark keeps ``per_type`` rows per type in every
    task before the shuffle and a hot type stays small.
    """
    kept = questions.filter(F.col("question_type").isin(*(types or QUESTION_TYPES)))
    order = Window.partitionBy("question_type").orderBy(_draw_key(seed, ["question_id"]), "question_id")
    return (
        kept.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= per_type).drop("__r")
    )


def sampling_counts(
    population: DataFrame, sample: DataFrame, id_columns: list[str], stratum: Column | None = None
) -> DataFrame:
    """Rows per stratum before and after: (stratum, population_count, sample_count)."""
    by = (F.lit("all") if stratum is None else _stratum_text(stratum)).alias("stratum")
    before = population.groupBy(by).agg(F.count(F.lit(1)).alias("population_count"))
    after = sample.groupBy(by).agg(F.count(F.lit(1)).alias("sample_count"))
    return before.join(after, "stratum", "left").select(
        "stratum", "population_count", F.coalesce("sample_count", F.lit(0)).alias("sample_count")
    )


def sampling_manifest(counts: DataFrame, spec: dict, with_groups: bool) -> DataFrame:
    """One row describing a sample: the spec, the totals and, if asked, maps by stratum."""

    def by_group(value: str) -> Column:
        pairs = F.array_sort(F.collect_list(F.struct("stratum", value)))
        return F.map_from_entries(pairs).alias(value.replace("_count", "_by_group"))

    totals = [F.sum(c).cast("bigint").alias(c) for c in ("population_count", "sample_count")]
    groups = [by_group("population_count"), by_group("sample_count")] if with_groups else []
    fixed = [F.lit(v).alias(k) for k, v in spec.items()]
    row = counts.agg(*totals, *groups)
    return row.select(*fixed, *row.columns)


def conversation_counts(questions: DataFrame) -> DataFrame:
    """Conversations and questions of a population or of a sample, as one row."""
    return questions.agg(
        F.countDistinct("conversation_idx").alias("conversation_count"),
        F.count(F.lit(1)).alias("question_count"),
    )


def regroup_sample(conversations: DataFrame, sample: DataFrame) -> DataFrame:
    """The nested dataset with only the sampled questions, in their original order.

    The positions gathered per conversation can never outnumber the ``qa`` array of that
    one input row.
    """
    chosen = sample.groupBy("conversation_idx").agg(F.collect_set("question_idx").alias("__keep"))
    joined = conversations.join(chosen, "conversation_idx")
    kept = F.filter("qa", lambda _, i: F.array_contains("__keep", i))
    return joined.withColumn("qa", kept).drop("__keep")


def sample_key(spec_json: Column) -> Column:
    """First 24 hex digits of the digest of a canonical dataset + sampling spec."""
    return F.substring(F.sha2(canonical_json(spec_json), 256), 1, 24)
