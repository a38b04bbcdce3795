"""Prompt columns. The wording is ours and configurable; the slots are what matters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_empty


@dataclass(frozen=True)
class PromptTexts:
    answer_conversation: str = (
        "Answer the question from the conversation memory below. Be brief and reuse its wording."
        "\n{instruction}\n\nMemory:\n{context}\n\nQuestion: {question}\nShort answer:"
    )
    date_instruction: str = (
        "If the question asks for a time, turn relative expressions into absolute dates "
        "using the dates in the memory."
    )
    answer_question: str = (
        "Answer the question from the memory below. Say that you do not know if it is not there."
        "\n\nMemory:\n{context}\n\nQuestion date: {date}\nQuestion: {question}\nAnswer:"
    )
    no_date: str = "(not specified)"
    judge_system: str = "You grade answers about remembered conversations. Reply with JSON only."
    judge: str = (
        "Decide whether the generated answer is CORRECT or WRONG.\n\n{extra}\n\n"
        "Question: {question}\nGold answer: {gold}\nGenerated answer: {answer}\n\n"
        'Reply with JSON holding "reasoning" and "label" (CORRECT or WRONG).'
    )
    judge_retry: str = (
        '\n\nThe last reply could not be read. Reply with one JSON object holding "reasoning" and '
        '"label" (CORRECT or WRONG).'
    )


DEFAULT_TEXTS = PromptTexts()


def fill(template: str, slots: dict[str, Column]) -> Column:
    """Put columns into ``{slot}`` places; slot values are never read as templates."""
    parts: list[Column] = []
    rest = template
    while rest:
        at = min(((rest.find("{" + s + "}"), s) for s in slots if "{" + s + "}" in rest), default=None)
        if at is None:
            parts.append(F.lit(rest))
            break
        position, slot = at
        if position:
            parts.append(F.lit(rest[:position]))
        parts.append(F.coalesce(slots[slot].cast("string"), F.lit("")))
        rest = rest[position + len(slot) + 2 :]
    return F.concat(*parts)


def conversation_prompt(
    context: Column, question: Column, category: Column, texts: PromptTexts = DEFAULT_TEXTS
) -> Column:
    """Category 2 (temporal) questions get the extra date instruction."""
    instruction = F.when(category == 2, F.lit(texts.date_instruction)).otherwise(F.lit(""))
    return fill(
        texts.answer_conversation, {"instruction": instruction, "context": context, "question": question}
    )


def question_prompt(
    context: Column, question: Column, date: Column, texts: PromptTexts = DEFAULT_TEXTS
) -> Column:
    shown = F.when(F.coalesce(date, F.lit("")) == "", F.lit(texts.no_date)).otherwise(date)
    return fill(texts.answer_question, {"context": context, "question": question, "date": shown})


def judge_prompt(
    question: Column,
    gold: Column,
    answer: Column,
    question_type: Column | None = None,
    question_date: Column | None = None,
    texts: PromptTexts = DEFAULT_TEXTS,
) -> Column:
    """The type and date blocks appear only when they are not blank."""
    blocks = []
    for title, value in (("Question type:", question_type), ("Question date:", question_date)):
        if value is not None:
            shown = blank_to_empty(value)
            blocks.append(F.when(shown != "", F.concat(F.lit(title + "\n"), shown, F.lit("\n"))))
    extra = F.concat_ws("\n", *blocks) if blocks else F.lit("")
    return fill(texts.judge, {"extra": extra, "question": question, "gold": gold, "answer": answer})
