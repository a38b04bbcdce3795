"""The manifest against a tree built row by row."""

import hashlib
import zlib

import pytest

from recollect.llm import manifest

from .conftest import DOCS


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, change=lambda t: t):
    doc_id, text, lang, source, n_chars = r
    return H(*map(framed, (doc_id, source, lang, n_chars, None if text is None else change(text))))


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(nodes):
    """The root and each node's list of (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for path, p in zip(paths, at):
            run = runs[p // 8]
            path.append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        nodes, at = [H(*run) for run in runs], [p // 8 for p in at]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]])
    root, crown = tree([trees[g][0] for g in order])
    out = []
    for g, above in zip(order, crown):
        for r, path in zip(groups[g], trees[g][1]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            folded = leaf(r, lowered) if bad else leaf(r)
            for left, right in path + above:
                folded = H(left, folded, right)
            proof = H(*[x for p in path + above for x in p])
            out.append((r[0], leaf(r), trees[g][0], root, proof, folded, folded == root))
    return out


def same(frame, rows):
    got = [tuple(r) for r in frame.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 600])
def test_heights(spark, n):
    rows = [(i * 7 - 3, f"Text {i}", "en", None, i) for i in range(n)]
    same(manifest.manifest(spark.createDataFrame(rows, DOCS).repartition(5)), rows)


def test_many_rounds_and_groups(spark, monkeypatch):
    rows = [(i, f"T {i % 11}", f"l{i % 13}" if i % 3 else "big", "s", i) for i in range(700)]
    monkeypatch.setattr(manifest, "DIGITS", 1)
    monkeypatch.setattr(manifest, "BLOCK", 8)
    same(manifest.manifest(spark.createDataFrame(rows, DOCS).repartition(3)), rows)


def test_awkward_rows(spark, awkward, awkward_rows):
    same(manifest.manifest(awkward), awkward_rows)


def test_null_and_repeated_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (3, "A", None, "s", 1), (3, "B", None, "s", 1),
            (3, "B", None, "s", 1), (9, "", "", "", 0), (12, "Äb", "é", "s", -5), (15, "B" * 100_000, "z", "s", 1)]
    same(manifest.manifest(spark.createDataFrame(rows, DOCS).repartition(4)), rows)


def test_tampering_shows(spark, awkward, awkward_rows):
    touched = {r[0] for r in awkward_rows if zlib.crc32(str(r[0]).encode()) % 3 == 0 and lowered(r[1] or "") != (r[1] or "")}
    rows = manifest.manifest(awkward).collect()
    assert touched and {r.doc_id for r in rows if not r.verified} == touched


def test_empty_table(empty_docs):
    assert manifest.manifest(empty_docs).collect() == []
