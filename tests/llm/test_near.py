"""Near-duplicate classes and containment against brute force."""

import random

import pytest

from recollect.llm import components, decontaminate, near_dedup

from .conftest import prose


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_components(rows, percent):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {(i, len(s), find(i)) for i, s in sets}


def changed(text, edits, seed):
    rng = random.Random(seed)
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def families():
    """Chains and groups of copies with few to many edits, of short and long texts."""
    rows, i = [], 0
    for f, n in enumerate([6, 9, 12, 20, 40, 80, 150, 400, 1200]):
        base = prose(100 + f, n)
        for k in range(14):
            base = changed(base, 1, 31 * f + k) if k % 2 else base
            rows.append((i, changed(base, k % 4, 7 * f + k)))
            i += 1
    rows += [(1000 + k, changed(prose(999, 60), k % 3, k)) for k in range(60)]
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_classes_equal_brute_force(spark, families, awkward_rows, percent, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rows = families + [(-5000 + r[0], r[1]) for r in awkward_rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = near_dedup.near_duplicates(docs, percent).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_components(rows, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


@pytest.mark.parametrize("percent, words", [(80, 8), (85, 10), (80, 38), (80, 51), (80, 56)])
def test_short_pairs_equal_brute_force(spark, percent, words):
    rows, common = [], [f"common{j}" for j in range(6)]
    for k in range(700 if words < 20 else 60):
        text = [f"w{k}x{j}" for j in range(words)]
        if words > 20 and k % 2:
            text[:6] = common
        extra = 1 if words < 20 else 1 + k % 9
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join([*text, *(f"more{k}x{j}" for j in range(extra))]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_dedup.near_duplicates(docs, percent).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_components(rows, percent)


def test_unlike_texts_that_meet_go_no_further(spark, monkeypatch):
    compare, met_rows = near_dedup.candidate_pairs, []

    def counted(met, threshold, best_only):
        met_rows.append(met.count())
        return compare(met, threshold, best_only)

    monkeypatch.setattr(near_dedup, "candidate_pairs", counted)
    shared = [f"shared{j}" for j in range(120)]
    rows = [(k, " ".join([*shared, *(f"own{k}x{j}" for j in range(100))])) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert all(r.kept for r in near_dedup.near_duplicates(docs).collect())
    assert met_rows[0] > 0 and met_rows[1] == 0


def test_a_bucket_sends_rows_in_proportion_to_its_documents(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    compare, sent = near_dedup.candidate_pairs, []

    def counted(met, threshold, best_only):
        out = compare(met, threshold, best_only)
        if best_only:
            sent.append((met.count(), out.count()))
        return out

    monkeypatch.setattr(near_dedup, "candidate_pairs", counted)
    rows = [(k, changed(prose(41, 300), 5, k)) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_dedup.near_duplicates(docs, 85).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_components(rows, 85)
    assert 0 < sent[0][1] <= 2 * sent[0][0]


def test_rows_without_own_ids(spark, unnamed, awkward, empty_docs):
    got = near_dedup.near_duplicates(unnamed).collect()
    assert len(got) == unnamed.count()
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    kept = near_dedup.keep_one(unnamed)
    assert kept.columns == unnamed.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [7, 7, 8]
    assert near_dedup.near_duplicates(empty_docs).count() == 0 and near_dedup.keep_one(empty_docs).count() == 0
    assert near_dedup.keep_one(awkward).columns == awkward.columns


def test_rows_that_share_an_id_keep_the_links_of_each_text(spark):
    base, other, third = prose(31, 200), prose(32, 210), prose(33, 220)
    rows = [(7, base, "a"), (7, other, "b"), (8, changed(other, 1, 1), "c"), (9, changed(base, 1, 2), "d"), (10, third, "e"), (10, third, "f")]
    for seed in range(2):
        docs = spark.createDataFrame(rows[seed:] + rows[:seed], "doc_id long, text string, uid string").repartition(3)
        got = near_dedup.near_duplicates(docs, 80).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(7, 7), (7, 7), (8, 7), (9, 7), (10, 10), (10, 10)]
        kept = near_dedup.keep_one(docs, 80)
        assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted([rows[0], rows[1], rows[4]])


def test_words_that_cancel_in_a_polynomial_link_nothing(spark):
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{one} x y z u"), (2, one.translate(str.maketrans("ab", "ba")) + " x y z u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.kept for r in near_dedup.near_duplicates(docs).collect()] == [True, True]
    items = spark.createDataFrame(rows[:1], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.contained_items(docs, items).collect()] == [1]


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (None, 3), (300, 301), (301, 300)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {(i, 0) for i in range(1, 41)} | {(i, 100) for i in range(101, 140)} | {(301, 300)}
    assert {tuple(r) for r in got} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT", 3)
    edges = [(i, i + 1) for i in range(6)] + [(100, i) for i in range(101, 110)] + [(i, 300) for i in range(290, 300)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {(i, 0) for i in range(1, 7)} | {(i, 100) for i in range(101, 110)} | {(i, 290) for i in range(291, 301)}
    assert {tuple(r) for r in got} == want


def test_a_round_of_stars_takes_three_shuffles(spark, monkeypatch):
    stage, shuffles = components.stage, []

    def staged(df, name, by=None):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return stage(df, name, by)

    monkeypatch.setattr(components, "stage", staged)
    got = components.components(spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")).collect()
    assert {tuple(r) for r in got} == {(2, 1), (3, 1), (4, 1)}
    assert len(shuffles) > 1 and max(shuffles) <= 3


def brute_contained(docs, items):
    out = []
    for item_id, text in items:
        size = min(5, len((text or "").split()))
        mine = shingles(text, size) if size else set()
        for doc_id, body in docs:
            w = (body or "").encode().lower().split()
            theirs = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
            if mine and len(mine & theirs) * 5 >= 4 * len(mine):
                out.append((doc_id, item_id, len(mine), len(mine & theirs)))
    return sorted(out, key=repr)


def test_containment_equals_brute_force(spark):
    texts = [prose(500 + i, 30) for i in range(12)]
    items = list(enumerate(texts)) + [(100, None), (101, ""), (102, "only three words"), (103, texts[0]), (0, texts[1]), (None, texts[2])]
    docs = [(i, f"{prose(600 + i, 200 * (i % 5))} {changed(t, i % 4, i)} {prose(700 + i, 50)}") for i, t in enumerate(texts)]
    docs += [(50, None), (51, ""), (52, "Only  three\nWORDS"), (3, texts[0]), (None, texts[4].upper())]
    docs_frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items_frame = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contained_items(docs_frame, items_frame).collect()
    assert sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got), key=repr) == brute_contained(docs, items)
    bad = {r.doc_id for r in got}
    left = decontaminate.drop_contaminated(docs_frame, items_frame).collect()
    assert sorted(map(repr, map(tuple, left))) == sorted(repr(d) for d in docs if d[0] not in bad)


def test_containment_of_empty_tables(spark, empty_docs, awkward):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained_items(awkward, none).count() == 0
    assert decontaminate.contained_items(empty_docs, spark.createDataFrame([(1, "a b c d e f")], none.schema)).count() == 0
    assert decontaminate.drop_contaminated(awkward, none).count() == awkward.count()


@pytest.mark.parametrize("n", [1, 2, 5, 6, 7, 26, 100, 1000])
def test_sketch_cannot_be_missed(n):
    for threshold in (0.8, 0.85, 1.0):
        assert decontaminate.sketch_size(n, threshold) >= n - decontaminate.needed(n, threshold) + 1
