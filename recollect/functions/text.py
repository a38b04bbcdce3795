"""Text columns: whitespace handling, answer normalisation, labels, abstention."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the evaluated metric definition.
ABSTAIN_TOKEN = "__ABSTAIN__"
ABSTAIN_PHRASES = (
    "i don't know",
    "i do not know",
    "idk",
    "not mentioned",
    "unknown",
    "not specified",
    "n/a",
    "none",
    "no information",
    "cannot be determined",
    "can't be determined",
    "not enough information",
)
CATEGORY_NAMES = {
    1: "multi-hop",
    2: "temporal",
    3: "open-domain",
    4: "single-hop",
    5: "adversarial",
}
NO_INFORMATION_ANSWER = "Not mentioned in the conversation"

# Unicode whitespace plus the four ASCII separators that Python also strips.
_SPACE = r"[\s\x1c-\x1f]"


def py_strip(value: Column) -> Column:
    """Remove leading and trailing Unicode whitespace (``trim`` removes blanks only)."""
    return F.regexp_replace(value, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def blank_to_empty(value: Column) -> Column:
    """Null-safe stripped text."""
    return py_strip(F.coalesce(value.cast("string"), F.lit("")))


def is_blank(value: Column) -> Column:
    return F.length(blank_to_empty(value)) == 0


def normalize_text(value: Column) -> Column:
    """Lower-case, drop ASCII punctuation, drop articles, squeeze whitespace."""
    # A class is matched faster here than ``translate`` maps 32 characters.
    bare = F.regexp_replace(F.lower(value), r"\p{Punct}+", "")
    # Two passes: a repeated group would recurse once per repetition and overflow on long runs.
    no_articles = F.regexp_replace(bare, r"(?U)\b(?:an?|the)\b", " ")
    return F.trim(F.regexp_replace(no_articles, rf"(?U){_SPACE}+", " "))


def tokens(value: Column) -> Column:
    return F.filter(F.split(normalize_text(value), " "), lambda t: t != "")


def exact_match(prediction: Column, gold: Column) -> Column:
    return (normalize_text(prediction) == normalize_text(gold)).cast("double")


def normalize_abstention(value: Column) -> Column:
    """The abstention token for a known phrase, else the text unchanged."""
    tail = F.regexp_replace(F.lower(py_strip(value)), r"[\p{Punct}]+$", "")
    return F.when(py_strip(tail).isin(*ABSTAIN_PHRASES), F.lit(ABSTAIN_TOKEN)).otherwise(value)


def is_abstention_id(question_id: Column) -> Column:
    return F.endswith(question_id, F.lit("_abs"))


def normalize_role(role: Column) -> Column:
    cleaned = F.lower(blank_to_empty(role))
    return F.when(cleaned == "", F.lit("unknown")).otherwise(cleaned)


def title_case(value: Column) -> Column:
    """Upper-case every letter that does not follow a letter (unlike ``initcap``)."""
    chars = F.split(F.lower(value), "")
    return F.array_join(
        F.transform(
            chars,
            lambda c, i: F.when(
                (i == 0) | ~F.element_at(chars, F.greatest(i, F.lit(1))).rlike(r"\p{L}"), F.upper(c)
            ).otherwise(c),
        ),
        "",
    )


def speaker_label(role: Column) -> Column:
    normalized = normalize_role(role)
    return (
        F.when(normalized == "user", F.lit("User"))
        .when(normalized == "assistant", F.lit("Assistant"))
        .otherwise(title_case(F.replace(normalized, F.lit("_"), F.lit(" "))))
    )


def speaker_role(speaker: Column, speaker_a: Column) -> Column:
    same = F.coalesce(speaker, F.lit("")) == F.coalesce(speaker_a, F.lit(""))
    return F.when(same, F.lit("user")).otherwise(F.lit("assistant"))


def category_name(category: Column) -> Column:
    named = F.lit(None).cast("string")
    for number, name in reversed(CATEGORY_NAMES.items()):
        named = F.when(category == number, F.lit(name)).otherwise(named)
    return F.coalesce(named, F.concat(F.lit("category-"), category.cast("string")))


def gold_answer(category: Column, answer: Column) -> Column:
    """Category 5 questions have no answer in the conversation."""
    return F.when(category == 5, F.lit(NO_INFORMATION_ANSWER)).otherwise(answer)


def normalize_category5(prediction: Column, answer: Column) -> Column:
    """Read an ``(a)`` / ``(b)`` choice as the answer it stands for."""
    choice = F.lower(py_strip(prediction))
    picked_b = (choice == "b") | F.startswith(choice, F.lit("(b)"))
    picked_a = (choice == "a") | F.startswith(choice, F.lit("(a)"))
    return (
        F.when(picked_b, F.lit(NO_INFORMATION_ANSWER))
        .when(picked_a, F.coalesce(answer, F.lit("")))
        .otherwise(prediction)
    )


def normalize_generated_answer(category: Column, prediction: Column, answer: Column) -> Column:
    return F.when(category == 5, normalize_category5(prediction, answer)).otherwise(prediction)


def image_text(query: Column, caption: Column, prefix: str) -> Column:
    q, c = blank_to_empty(query), blank_to_empty(caption)
    head = F.lit(prefix + ": ")
    return (
        F.when((q != "") & (c != ""), F.concat(head, F.lit("query "), q, F.lit(". The image shows "), c, F.lit(".")))
        .when(q != "", F.concat(head, F.lit("query "), q, F.lit(".")))
        .when(c != "", F.concat(head, c, F.lit(".")))
        .otherwise(F.lit(""))
    )


def _empty_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def serialize_turn_plain(text: Column, query: Column, caption: Column) -> Column:
    return F.concat_ws(
        " ", _empty_to_null(blank_to_empty(text)), _empty_to_null(image_text(query, caption, "Image"))
    )


def serialize_turn_speaker(speaker: Column, text: Column, query: Column, caption: Column) -> Column:
    content = F.concat_ws(
        " ", _empty_to_null(blank_to_empty(text)), _empty_to_null(image_text(query, caption, "Shared image"))
    )
    name = blank_to_empty(speaker)
    return F.when((content != "") & (name != ""), F.concat(name, F.lit(": "), content)).otherwise(content)


def bounded_label(value: Column) -> Column:
    """A metric label of at most 48 letters, digits or underscores, else ``other``."""
    label = F.replace(F.lower(F.coalesce(value.cast("string"), F.lit(""))), F.lit("-"), F.lit("_"))
    ok = F.length(label).between(1, 48) & label.rlike(r"^[\p{L}\p{N}_]+$")
    return F.when(ok, label).otherwise(F.lit("other"))


def one_of(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))
