"""Small tables with the awkward cases that every operator must take."""

import random

import pytest

WORDS = ["alpha", "Beta", "gamma", "delta", "Épsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "straße", "nu"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", str(rng.randrange(900))]) for _ in range(n))


@pytest.fixture(scope="session")
def awkward_rows():
    """Null and empty texts, white space, long texts, exact and near copies, ties, repeats of passages."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    shared = prose(2, 40)
    texts = [
        base, None, "", " \t\n\r\x0b\x0c ", "one", "one two three", base, " ".join(near), prose(3, 3000),
        f"{prose(4, 30)} {shared} {prose(5, 30)}", f"{prose(6, 25)}\n{shared}\t{prose(7, 10)}", "x " * 400, "a" * 1500,
        "ONE", "one two three", shared, "\u00a0odd\u2003spaces\u0085here \x00 nul", "é" * 333, prose(8, 90) + " " + prose(8, 90),
        f"{prose(9, 50)} <|endoftext|> {prose(10, 5)}", "日本語 テキスト 123 ４５６", "!!! ### $$$ %%% | |", prose(11, 19), prose(11, 20),
    ]
    texts += [base.replace("alpha", "alpha ", 1)] * 3
    return [(10 * i - 40, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    """The rows in several partitions, with a column whose name operators use themselves."""
    frame = spark.createDataFrame(awkward_rows, DOCS).repartition(3)
    return frame.selectExpr("*", "lang as score", "source as n", "lang as key", "lang as uid", "lang as component_id")


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def unnamed(spark):
    """Null and repeated ids, repeated rows."""
    rows = [(None, prose(20, 60)), (None, prose(20, 60)), (7, prose(21, 60)), (7, prose(21, 60)), (7, prose(20, 60)), (8, None), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")
