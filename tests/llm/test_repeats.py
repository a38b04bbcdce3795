"""Repeated words and bytes against brute force."""

import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recollect.llm import substring_dedup, suffix_dedup
from recollect.llm.common import Rolling, WordRolling, bitmap, from_planes, from_rising, planes, rising, set_in, word_bounds, word_values

from .conftest import prose


def ordered(rows):
    """The documented order: by id with nulls first, then by text with nulls first."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))


def brute(rows, width, split):
    seen, out = set(), []
    for doc_id, text in ordered(rows):
        items = split((text or "").encode())
        gone = [False] * len(items)
        for i in range(len(items) - width + 1):
            window = tuple(items[i : i + width])
            if window in seen:
                gone[i : i + width] = [True] * width
            seen.add(window)
        spans = [i for i in range(len(items)) if gone[i] and (i == 0 or not gone[i - 1])]
        out.append((doc_id, len(items), sum(gone), len(spans), [x for x, g in zip(items, gone) if not g]))
    return sorted(map(repr, out))


@pytest.mark.parametrize("width", [20, 3])
def test_words_equal_brute_force(awkward, awkward_rows, width):
    got = substring_dedup.remove_repeats(awkward, width).collect()
    plain = [(r.doc_id, r.n_words, r.n_removed, len(r.spans), r.kept.encode().split()) for r in got]
    assert sorted(map(repr, plain)) == brute([r[:2] for r in awkward_rows], width, bytes.split)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


@pytest.mark.parametrize("width", [100, 32])
def test_bytes_equal_brute_force(awkward, awkward_rows, width):
    got = suffix_dedup.remove_repeats(awkward, width).collect()
    plain = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), list(r.kept)) for r in got]
    assert sorted(map(repr, plain)) == brute([r[:2] for r in awkward_rows], width, list)


def test_hot_line_in_different_surroundings(spark, monkeypatch):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    line, longer = word(70), word(130)
    rows = [(i, f"{word(60)} {line if i % 3 else longer} {word(60)}") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(suffix_dedup, "HOT", 4)
    got = suffix_dedup.remove_repeats(docs, 100).collect()
    assert sorted(repr((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), list(r.kept))) for r in got) == brute(rows, 100, list)


def lines_in_surroundings(rng, n):
    """Texts around one line that some of them repeat at once, others not."""
    word = lambda k: "".join(rng.choice(list("abcdefgh"), k))
    line, tail = word(int(rng.integers(30, 76))), word(90)
    kinds = [f"{line}{line}{tail}", f"{word(60)}{line}{tail}", f"{word(60)}{line}{line}{word(60)}", f"{word(20)}{line}{line}{line}{tail}{word(9)}"]
    return [kinds[k] if k < 4 else f"{word(50)}{line * int(rng.integers(1, 4))}{tail[: int(rng.integers(30, 90))]}{word(50)}" for k in range(n)]


def assert_bytes_equal_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffix_dedup.remove_repeats(docs, 100).collect()
    assert sorted(repr((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), list(r.kept))) for r in got) == brute(rows, 100, list)


def test_line_repeated_at_once_in_one_document_only(spark):
    rng = np.random.default_rng(11)
    texts = [t for _ in range(40) for t in lines_in_surroundings(rng, 2)]
    assert_bytes_equal_brute_force(spark, list(enumerate(texts)))


def test_hot_line_that_some_documents_repeat_at_once(spark, monkeypatch):
    rng = np.random.default_rng(12)
    monkeypatch.setattr(suffix_dedup, "HOT", 4)
    assert_bytes_equal_brute_force(spark, list(enumerate(t for _ in range(3) for t in lines_in_surroundings(rng, 40))))


def test_null_and_repeated_ids(unnamed, empty_docs):
    rows = [tuple(r) for r in unnamed.collect()]
    got = substring_dedup.remove_repeats(unnamed, 20).collect()
    plain = [(r.doc_id, r.n_words, r.n_removed, len(r.spans), r.kept.encode().split()) for r in got]
    assert sorted(map(repr, plain)) == brute(rows, 20, bytes.split)
    got = suffix_dedup.remove_repeats(unnamed, 100).collect()
    assert sorted(repr((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), list(r.kept))) for r in got) == brute(rows, 100, list)
    assert substring_dedup.remove_repeats(empty_docs).count() == suffix_dedup.remove_repeats(empty_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=90), min_size=1, max_size=12))
def test_merged_intervals_are_equal_prefixes(parts):
    texts = [np.frombuffer((p + "\xff").encode("latin-1"), np.uint8) for p in parts]
    width = 36
    place, interval = suffix_dedup.merged_intervals(texts, width)
    ring = {}
    at = 0
    for t in texts:
        for i in range(len(t)):
            ring[at + i] = bytes(t[(i + j) % len(t)] for j in range(width))
        at += len(t)
    assert sorted(place) == list(range(at))
    rows = [ring[p] for p in place]
    assert rows == sorted(rows)
    assert [i for i in interval] == list(np.cumsum([0, *[a != b for a, b in zip(rows, rows[1:])]]))


@given(st.lists(st.integers(0, 2**64 - 1), max_size=40))
def test_planes_round_trip(values):
    a = np.array(values, np.uint64)
    assert (from_planes(planes(a), len(a)) == a).all()
    assert (from_rising(rising(np.sort(a)), len(a)) == np.sort(a)).all()


@given(st.binary(min_size=1, max_size=200))
def test_rolling_hash_depends_on_the_bytes_alone(data):
    r = Rolling(3)
    twice = np.frombuffer(b"xyz" + data + b"q" + data, np.uint8)
    p, n = r.prefix(twice), len(data)
    a, b = r.ranges(p, np.array([3, 4 + n]), np.array([3 + n, 4 + 2 * n]))
    assert a == b


def thue_morse(n):
    """The sequence of length 2**n over a and b, and its complement."""
    t = "a"
    for _ in range(n):
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [6, 7, 10, 11])
def test_words_that_cancel_in_a_polynomial_differ(spark, n):
    one, other = thue_morse(n)
    rest = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{other} {rest}")], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(docs, 20).collect()] == [0, 0]
    data, starts, ends = word_bounds([one.encode(), other.encode()])
    assert len(set(word_values(data, starts, ends, 1).tolist())) == 2


def test_sequences_of_words_that_cancel_differ():
    one, other = (list(t.encode()) for t in thue_morse(4))
    words = [bytes([c]) for c in one], [bytes([c]) for c in other]
    rolling = WordRolling(11)
    assert rolling.runs(rolling.prefix(*word_bounds(words[0])), 16) != rolling.runs(rolling.prefix(*word_bounds(words[1])), 16)


@given(st.lists(st.binary(min_size=1, max_size=90).filter(lambda w: b" " not in w), min_size=1, max_size=8))
def test_word_values_depend_on_the_word_alone(words):
    values = word_values(*word_bounds(words), 5).tolist()
    assert values == [word_values(*word_bounds([w]), 5).tolist()[0] for w in words]
    assert len(set(values)) == len(set(words))


def test_bytes_of_a_chunk_do_not_grow_with_the_buckets():
    def sent(buckets):
        chunk = substring_dedup.Chunk(20, buckets, 8, 4)
        for uid in range(60):
            chunk.add(uid * 1000, prose(uid, 400))
        rows = list(chunk.rows(0))
        return sum(len(x) for r in rows for x in r if isinstance(x, bytes)), sum(r[3] for r in rows)

    (few, n), (many, same) = sent(32), sent(4096)
    assert n == same and many <= few + 24 * n


ARROW = "spark.sql.execution.arrow.pyspark.enabled"


@pytest.mark.parametrize("arrow", ["false", "true"])
def test_words_of_a_bitmap_are_no_python_objects_in_the_driver(spark, arrow):
    n, bits = 400_000, 1 << 23
    hashes = spark.range(n).selectExpr("xxhash64(id) as hash")
    before = spark.conf.get(ARROW)
    spark.conf.set(ARROW, arrow)
    try:
        tracemalloc.start()
        got = bitmap(hashes, bits)
        peak = tracemalloc.get_traced_memory()[1]
        none = bitmap(hashes.filter("hash is null"), bits)
    finally:
        tracemalloc.stop()
        spark.conf.set(ARROW, before)
    values = np.array(hashes.toPandas()["hash"]).view(np.uint64)
    wanted = np.zeros(bits, bool)
    wanted[(values >> np.uint64(64 - 23)).astype(np.int64)] = True
    assert (np.unpackbits(got.view(np.uint8), bitorder="little") == wanted).all()
    assert set_in(got, values).all() and not none.any()
    assert peak < 32 * len(got)
