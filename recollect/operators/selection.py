"""Choosing conversations, questions and turns. Dataset order is a column, never row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions.ranking import nonempty_ids
from ..functions.text import is_blank
from .sampling import sample_per_type

WILDCARD = "*"
# Ids given in code travel in the plan up to this many; more come as a joined frame.


def category_number(category: Column) -> Column:
    return F.coalesce(category.cast("int"), F.lit(0))


def enumerate_questions(conversations: DataFrame, categories: list[int] | None = None) -> DataFrame:
    """One row per question of a nested conversation frame; ``question_idx`` is kept."""
    rows = conversations.select(
        "conversation_idx",
        I.conversation_id(F.col("conversation_idx")).alias("conversation_id"),
        F.posexplode("qa").alias("question_idx", "qa_item"),
    )
    rows = rows.select(
        "conversation_idx",
        "conversation_id",
        "question_idx",
        I.question_id(F.col("conversation_idx"), F.col("question_idx")).alias("question_id"),
        F.col("qa_item.question").alias("question"),
        F.col("qa_item.answer").alias("answer"),
        category_number(F.col("qa_item.category")).alias("category"),
        nonempty_ids(F.col("qa_item.evidence")).alias("evidence"),
    )
    return filter_categories(rows, categories)


def filter_categories(questions: DataFrame, categories: list[int] | None = None) -> DataFrame:
    """No list, or an empty one, keeps everything."""
    if not categories:
        return questions
    return questions.filter(category_number(F.col("category")).isin(*categories))


def _keep_ids(df: DataFrame, column: str, wanted) -> DataFrame:
    if isinstance(wanted, DataFrame):
        listed = wanted.select(F.col(wanted.columns[0]).alias(column)).distinct()
        return df.join(listed, column, "left_semi")
    values = list(dict.fromkeys(wanted))
    listed = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return df.join(listed, column, "left_semi")


def filter_by_ids(questions: DataFrame, ids, column: str = "question_id") -> DataFrame:
    """Keep the listed ids (a list or a one-column frame)."""
    return _keep_ids(questions, column, ids)


def missing_ids(requested: DataFrame, data: DataFrame, column: str = "question_id") -> DataFrame:
    """Requested ids that the data does not hold."""
    return requested.select(column).distinct().join(data.select(column), column, "left_anti")


def select_conversations(
    questions: DataFrame,
    ids=(WILDCARD,),
    categories: list[int] | None = None,
    conversation_ids=None,
) -> DataFrame:
    """Questions of the chosen conversations, one row per question.

    The result of :func:`enumerate_questions` goes in; conversations that keep no
    question disappear by themselves. Order by (``conversation_idx``, ``question_idx``).
    """
    kept = questions
    if isinstance(ids, DataFrame) or list(ids) != [WILDCARD]:
        kept = _keep_ids(kept, "conversation_id", ids)
    if conversation_ids is not None and (isinstance(conversation_ids, DataFrame) or len(conversation_ids)):
        kept = _keep_ids(kept, "conversation_id", conversation_ids)
    return filter_categories(kept, categories)


def select_questions(
    questions: DataFrame,
    ids=(WILDCARD,),
    types: list[str] | None = None,
    per_type: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Listed ids bypass the other filters; else type filter, then per-type sampling."""
    if isinstance(ids, DataFrame) or list(ids) != [WILDCARD]:
        return filter_by_ids(questions, ids)
    kept = questions.filter(F.col("question_type").isin(*types)) if types else questions
    if per_type is None:
        return kept
    return sample_per_type(kept, per_type, seed, types)


def drop_blank_text(df: DataFrame, column: str = "text") -> DataFrame:
    return df.filter(~is_blank(F.col(column)))
