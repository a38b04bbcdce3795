"""Phrase counts and scores against counting phrase by phrase."""

import random
import re
from collections import Counter

import pytest

from recollect.llm import collocations

from .conftest import DOCS


def brute(rows, least, most=2000):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + m]) for m in range(1, 5) for i in range(len(words) - m + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for (lang, *words), a in found.items():
        cuts = []
        for k in range(1, len(words)):
            left, right = f[(lang, *words[:k])], f[(lang, *words[k:])]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        held = any(
            p[0] == lang and len(p) - 1 > len(words) and 100 * b >= 80 * a
            and any(list(p[i : i + len(words)]) == words for i in range(1, len(p)))
            for p, b in found.items()
        )
        if not held:
            score, _, left, right = min(cuts)
            out.append((lang, " ".join(words), a, left, right, n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks = Counter()
    ranked = []
    for lang, *rest in out:
        ranks[lang] += 1
        ranked.append((lang, ranks[lang], *rest))
    return [r for r in ranked if r[1] <= most]


def same(docs, rows, least, most=2000):
    got = sorted(tuple(r) for r in collocations.collocations(docs, least, most).collect())
    assert got == sorted(brute(rows, least, most))
    return got


def chatter(seed, n, words=14):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["Über", "a.b", "x,", " ", "of", "of", "the", "the"]
    return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", "!", "\n", "\t", "\x0b "]) for _ in range(n))


@pytest.fixture(scope="module")
def talk():
    rows = [(i, chatter(i, 60 + 40 * (i % 5)), ["en", "de", None, "und"][i % 4], "s", 1) for i in range(40)]
    return rows + [(99, "New York City hall is " * 12, "en", "s", 1)] * 2


def test_phrases_equal_brute_force(spark, talk):
    assert same(spark.createDataFrame(talk, DOCS).repartition(3), talk, 4)
    same(spark.createDataFrame(talk, DOCS).repartition(2), talk, 3, most=7)


def test_bursts_spills_and_hot_prefixes_change_nothing(spark, talk, monkeypatch):
    for name, value in {"BURST": 3, "ENTRIES": 40, "SEGMENT": 50, "ID_BITS": 6, "HOT_SHARE": 4000, "LEAST_PARTS": 5}.items():
        monkeypatch.setattr(collocations, name, value)
    words = [(i, chatter(i, 200, words=8), "en", "s", 1) for i in range(6)]
    same(spark.createDataFrame(words, DOCS).repartition(2), words, 3)
    assert len({w for r in words for w in r[1].split()}) + 50 > 2**6  # the numbers run out and start again


def test_trie_keeps_counts_when_containers_burst(monkeypatch):
    monkeypatch.setattr(collocations, "BURST", 10)
    trie, want = collocations.HatTrie(), Counter()
    ids = trie.numbered([b"a", b"b", b"c", b"d", b"e"], collocations.word_hashes([b"a", b"b", b"c", b"d", b"e"])).tolist()
    for i in range(400):
        a, b, c = (ids[(i * k) % 5] for k in (1, 2, 3)) if i % 2 else (ids[i % 3], ids[i % 4], ids[i % 5])
        trie.add("en", a, [b << collocations.ID_BITS | c], [i], 2)
        want[b" ".join(trie.words[x] for x in (a, b, c))] += i
    assert any(isinstance(n, collocations._Node) for n in trie.root.values()) and trie.entries == len(want)
    words = trie.words
    for _, rows, counts in trie.spilled(True):
        assert want == {b" ".join(words[i] for i in row): c for row, c in zip(rows.tolist(), counts.tolist())}
    assert not trie.root and not trie.entries


def test_awkward_rows(spark, awkward, awkward_rows):
    same(awkward, awkward_rows, 2)


def test_no_phrases(spark, empty_docs):
    assert collocations.collocations(empty_docs).collect() == []
    nothing = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", None, None), (3, "one", "en", None, None)], DOCS)
    assert collocations.collocations(nothing).collect() == []
