import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recollect.functions import dates as D
from recollect.functions import ids as I
from recollect.functions import text as X
from recollect.functions.overlap import lcs_length


def plain_normal(text):
    kept = "".join(c for c in text.lower() if c not in string.punctuation)
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", kept).split())


SAMPLES = [
    "The  cat, an (old) one!", "", "  a ", "ça va bien", "the—end", "A b\tc\nd", "can't__stop", "the, a; AN.", "Été the é", "x\x1cy",
]


def test_normalize_text_matches_the_definition(col_values):
    rows = col_values("t string", [(s,) for s in SAMPLES], n=X.normalize_text(F.col("t")))
    assert [r[0] for r in rows] == [plain_normal(s) for s in SAMPLES]


def test_very_long_runs_are_normalised_whole(col_values):
    texts = ["the " * 50_000 + "end", " " * 200_000 + "x", "!" * 200_000 + "y", "word " * 50_000]
    rows = col_values("t string", [(t,) for t in texts], n=X.normalize_text(F.col("t")))
    assert [r[0] for r in rows] == ["end", "x", "y", ("word " * 50_000).strip()]


def test_tokens_of_nothing_is_empty(col_values):
    assert col_values("t string", [("the a",), ("b the b",)], n=X.tokens(F.col("t"))) == [([],), (["b", "b"],)]


def test_py_strip_removes_unicode_space(col_values):
    assert col_values("t string", [("  x  \n",), ("\x1dy\x1e",)], n=X.py_strip(F.col("t"))) == [("x",), ("y",)]


@pytest.mark.parametrize(
    "text, abstains",
    [("I don't know.", True), (" N/A!! ", True), ("unknown", True), ("Not mentioned", True), ("unknown city", False), ("none of them", False)],
)
def test_abstention_phrases(col_values, text, abstains):
    found = col_values("t string", [(text,)], n=X.normalize_abstention(F.col("t")))[0][0]
    assert found == (X.ABSTAIN_TOKEN if abstains else text)


def test_categories_and_adversarial_targets(col_values):
    names = col_values("c int", [(c,) for c in (1, 2, 3, 4, 5, 9)], n=X.category_name(F.col("c")))
    assert [n[0] for n in names] == ["multi-hop", "temporal", "open-domain", "single-hop", "adversarial", "category-9"]
    assert col_values("c int, a string", [(5, "secret"), (1, "secret")], g=X.gold_answer(F.col("c"), F.col("a"))) == [
        (X.NO_INFORMATION_ANSWER,), ("secret",),
    ]
    rows = [(5, "(b)", "s"), (5, " B ", "s"), (5, "(A) x", "s"), (5, "other", "s"), (4, "(b)", "s")]
    got = col_values("c int, p string, a string", rows, n=X.normalize_generated_answer(F.col("c"), F.col("p"), F.col("a")))
    assert [g[0] for g in got] == [X.NO_INFORMATION_ANSWER, X.NO_INFORMATION_ANSWER, "s", "other", "(b)"]


def test_turn_serialisation(col_values):
    turn = [("Nora", "I hung the lamp.", "desk lamp", "a green lamp"), ("", " ", "", "a dog"), ("Bob", "", "", "")]
    cols = (F.col("t"), F.col("q"), F.col("c"))
    got = col_values(
        "s string, t string, q string, c string", turn, plain=X.serialize_turn_plain(*cols), spoken=X.serialize_turn_speaker(F.col("s"), *cols)
    )
    assert got == [
        ("I hung the lamp. Image: query desk lamp. The image shows a green lamp.",
         "Nora: I hung the lamp. Shared image: query desk lamp. The image shows a green lamp."),
        ("Image: a dog.", "Shared image: a dog."),
        ("", ""),
    ]


def test_speaker_labels(col_values):
    roles = ["user", " ASSISTANT ", "tool_user", None, "o'neil x2y"]
    got = col_values("r string", [(r,) for r in roles], role=X.normalize_role(F.col("r")), label=X.speaker_label(F.col("r")))
    assert got == [
        ("user", "User"), ("assistant", "Assistant"), ("tool_user", "Tool User"), ("unknown", "Unknown"), ("o'neil x2y", "O'Neil X2Y"),
    ]


def test_bounded_label(col_values):
    got = col_values("t string", [("Stage-One",), ("",), ("a b",), ("x" * 49,), ("été",)], n=X.bounded_label(F.col("t")))
    assert [g[0] for g in got] == ["stage_one", "other", "other", "other", "été"]


def test_dates(col_values):
    texts = ["9:00 am on 01 January, 2024", "11:30pm on 5 may, 2023", "7 March, 2022", "soon", "12:05 AM on 2 June, 2023"]
    got = col_values("t string", [(t,) for t in texts], n=D.conversation_epoch(F.col("t")))
    assert [g[0] for g in got] == [1704099600.0, 1683329400.0, 1646611200.0, None, 1685664300.0]
    texts = ["2023/05/01 (Mon) 21:05", "2023/5/1 9:05", "bad", None]
    got = col_values("t string", [(t,) for t in texts], e=D.question_epoch(F.col("t")), h=D.human_date(F.col("t")))
    assert got == [
        (1682975100, "Monday, May 01, 2023"), (1682931900, "Monday, May 01, 2023"), (None, "bad"), (None, None),
    ]
    assert col_values("t bigint", [(1682975100,)], n=D.created_at(F.col("t"))) == [("2023-05-01T21:05:00+00:00",)]


def test_unparsable_date_can_be_an_error(spark):
    frame = spark.createDataFrame([("soon",)], "t string").select(D.conversation_epoch(F.col("t"), strict=True))
    with pytest.raises(Exception, match="unsupported conversation date"):
        frame.collect()


def test_ids(col_values):
    got = col_values("c bigint, q int", [(0, 3), (12345, 0)], a=I.conversation_id(F.col("c")), b=I.question_id(F.col("c"), F.col("q")))
    assert got == [("conversation-0001", "conv0_q3"), ("conversation-12346", "conv12345_q0")]


def table_lcs(a, b):
    rows = [[0] * (len(b) + 1)]
    for x in a:
        last, row = rows[-1], [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        rows.append(row)
    return rows[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=90), st.lists(st.sampled_from("abcd"), max_size=90))
def test_lcs_matches_the_full_table(a, b):
    assert lcs_length(a, b) == table_lcs(a, b)
