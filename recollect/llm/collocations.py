"""Phrases whose words keep company, from exact counts of all runs of one to four words.

Counting is done by HAT-tries. A task numbers the words that it meets and keeps a shallow
trie by word id under each language; its leaves are hash containers of the rest of the
phrase, which burst into a node by the next word once they are large. When the task holds
too many entries it spills whole subtrees, the largest first, as sorted runs. Runs go to the
partition of their prefix, where they are merged. Prefixes that are frequent everywhere are
dealt by the whole phrase instead, so no partition gets a hot prefix.

A phrase is only as frequent as its parts. So words are counted first, then pairs of
frequent words, then runs of three and four words whose pairs are frequent. Tasks know the
frequent parts by a bitmap of bounded size: a full one only lets more phrases be counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, bitmap_bits, by_bytes, from_planes, mixed, planes, set_in, stage, text_size, word_bounds, word_values

LONGEST = 4
SEED = 11
BREAK = b"\xff"  # never part of UTF-8
PIECE_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"\n" * 10)
PART_BYTES = 4 << 20  # of text for each merge partition
LEAST_PARTS = 256
BURST = 4096  # entries of a container
ENTRIES = 1_000_000  # of a task's trie
ID_BITS = 21
SEGMENT = 1 << 19  # words counted at a time
HOT_SHARE = 4  # a prefix with more than a part's share by this divisor is dealt by whole phrases
SCALE = 2_000_000
SALTS = 64
RUNS = "part int, lang string, run binary, counts binary, n long"
FOUND = "lang string, phrase string, f long, hash long"
EXACT = "decimal(20,0)"


def piece_words(texts: list[bytes]) -> list[bytes]:
    """Words of all texts, A-Z lower-cased, with ``BREAK`` where no phrase may cross."""
    # bytes.split() also cuts at 0x0A-0x0D, which have become breaks before.
    return b"\n".join(texts).lower().translate(PIECE_ENDS).replace(b"\n", b" " + BREAK + b" ").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return word_values(*word_bounds(words), SEED)


def start_hash(lang: str) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(lang.encode(), SEED))


def next_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from those of its beginning and its last word."""
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + word)


def phrase_hashes(lang: str, phrases: list[bytes]) -> np.ndarray:
    words = [p.split(b" ") for p in phrases]
    values = word_hashes([w for ws in words for w in ws])
    size = np.array([len(ws) for ws in words], np.int64)
    first = np.cumsum(size) - size
    h = np.full(len(phrases), start_hash(lang))
    for j in range(size.max(initial=0)):
        longer = np.flatnonzero(size > j)
        h[longer] = next_hash(h[longer], values[first[longer] + j])
    return h


class HatTrie:
    """Counts of phrases: nodes by word id above, hash containers of packed ids below."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.hashes: list[int] = []
        self.root: dict = {}  # (lang, first word, further words) -> container or _Node
        self.entries = 0

    def numbered(self, words: list[bytes], hashes: np.ndarray) -> np.ndarray:
        out = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            at = self.ids.get(w)
            if at is None:
                at = self.ids[w] = len(self.words)
                self.words.append(w)
                self.hashes.append(hashes[i])
            out[i] = at
        return out

    def add(self, lang: str, first: int, rests: list[int], counts: list[int], depth: int) -> None:
        """Counts of phrases that begin with ``first`` (-1: nothing); a rest packs ``depth`` further ids."""
        key = (lang, first, depth)
        node = self.root.get(key)
        if node is None:
            node = self.root[key] = {}
        if isinstance(node, _Node):
            self.entries += node.add(rests, counts)
            return
        before = len(node)
        for r, c in zip(rests, counts):
            node[r] = node.get(r, 0) + c
        self.entries += len(node) - before
        if len(node) > BURST and depth > 1:
            self.root[key] = _Node(depth, node)

    def full(self) -> bool:
        return self.entries > ENTRIES or self.numbers_full()

    def numbers_full(self) -> bool:
        """No room for the distinct words of another segment."""
        return len(self.words) > (1 << ID_BITS) - SEGMENT - LONGEST

    def spilled(self, everything: bool) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """Subtrees, the largest first, as (lang, word ids of each phrase, counts) by lang and length."""
        everything = everything or self.numbers_full()
        held: dict[tuple[str, int], tuple[list, list, list, list]] = {}
        for key in sorted(self.root, key=lambda k: -len(self.root[k])):
            if not everything and self.entries <= ENTRIES // 2:
                break
            node = self.root.pop(key)
            self.entries -= len(node)
            lang, first, depth = key
            firsts, sizes, rests, counts = held.setdefault((lang, depth if first >= 0 else 0), ([], [], [], []))
            firsts.append(first)
            sizes.append(len(node))
            rests += node.keys()
            counts += node.values()
        for (lang, depth), (firsts, sizes, rests, counts) in held.items():
            packed = np.array(rests, np.int64)
            ids = np.empty((len(packed), depth + 1), np.int64)
            ids[:, 0] = np.repeat(firsts, sizes) if depth else packed
            for j in range(depth, 0, -1):
                ids[:, j] = packed & ((1 << ID_BITS) - 1)
                packed >>= ID_BITS
            yield lang, ids, np.array(counts, np.int64)

    def renumber(self) -> None:
        """Start with new numbers once all subtrees are spilled."""
        if not self.root:
            self.ids, self.words, self.hashes = {}, [], []


class _Node:
    """A burst container: containers by the next word id."""

    def __init__(self, depth: int, container: dict[int, int]) -> None:
        self.shift = ID_BITS * (depth - 1)
        self.below: dict[int, dict[int, int]] = {}
        self.size = 0
        self.add(list(container), list(container.values()))

    def add(self, rests: list[int], counts: list[int]) -> int:
        below, shift, new = self.below, self.shift, 0
        for r, c in zip(rests, counts):
            container = below.setdefault(r >> shift, {})
            if r in container:
                container[r] += c
            else:
                container[r] = c
                new += 1
        self.size += new
        return new

    def __len__(self) -> int:
        return self.size

    def keys(self) -> Iterator[int]:
        return (r for c in self.below.values() for r in c)

    def values(self) -> Iterator[int]:
        return (n for c in self.below.values() for n in c.values())


def segments(words: list[bytes]) -> Iterator[list[bytes]]:
    """``SEGMENT`` words at a time, with the words that the last phrases need after them."""
    for a in range(0, len(words), SEGMENT):
        yield words[a : a + SEGMENT + LONGEST - 1]


def _count_segment(
    trie: HatTrie, lang: str, words: list[bytes], lengths: range, known: np.ndarray | None, allowed: np.ndarray | None
) -> None:
    """Add the phrases of the given lengths that begin in the segment, of ``known`` words and ``allowed`` parts."""
    codes, distinct = pd.factorize(np.array([BREAK, *words], dtype=object))  # so the break is number 0
    distinct = distinct[1:]
    values = word_hashes(list(distinct))
    if lengths[0] == 1:
        found = np.bincount(codes[: SEGMENT + 1], minlength=len(distinct) + 1)[1:]
        seen = np.flatnonzero(found)
        numbers = trie.numbered(list(distinct[seen]), values[seen])
        trie.add(lang, -1, numbers.tolist(), found[seen].tolist(), 1)
        return
    use = np.flatnonzero(set_in(known, next_hash(np.full(len(values), start_hash(lang)), values)))
    numbers = np.full(len(distinct), -1)
    numbers[use] = trie.numbered(list(distinct[use]), values[use])
    ids = np.concatenate([[-1], numbers])[codes]
    hashes = np.concatenate([np.zeros(1, np.uint64), values])[codes]
    part = lengths[0] - 1  # words in the parts that must be allowed
    n = len(ids) - part + 1
    if n <= 0:
        return
    inside = np.ones(n, bool)
    h = np.full(n, start_hash(lang))
    for j in range(part):
        inside &= ids[j : j + n] >= 0
        h = next_hash(h, hashes[j : j + n])
    inside &= set_in(allowed, h)
    for length in lengths:
        steps = length - part  # parts after the first
        m = n - steps
        if m <= 0:
            return
        fits = inside[:m].copy()
        for j in range(1, steps + 1):
            fits &= inside[j : j + m]
        at = np.flatnonzero(fits)
        at = at[at <= SEGMENT]
        rest = np.zeros(len(at), np.int64)
        for j in range(1, length):
            rest = rest << ID_BITS | ids[at + j]
        rows = pd.DataFrame({"first": ids[at], "rest": rest}).groupby(["first", "rest"], sort=True).size()
        first, rest = (rows.index.get_level_values(k).to_numpy() for k in (0, 1))
        cuts = np.flatnonzero(np.diff(first, prepend=-1, append=-1))
        rests, counts = rest.tolist(), rows.to_list()
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            trie.add(lang, int(first[a]), rests[a:b], counts[a:b], length - 1)


def _parts(lang: str, ids: np.ndarray, hashes: np.ndarray, parts: int, hot: np.ndarray | None) -> np.ndarray:
    """The partition of each phrase: that of its prefix, or its own where the prefix is hot."""
    # The prefix is the first word of a pair and the first two words of longer phrases.
    width = min(2, max(1, ids.shape[1] - 1))
    prefix = np.full(len(ids), start_hash(lang))
    for j in range(width):
        prefix = next_hash(prefix, hashes[ids[:, j]])
    if hot is not None:
        whole = prefix
        for j in range(width, ids.shape[1]):
            whole = next_hash(whole, hashes[ids[:, j]])
        prefix = np.where(set_in(hot, prefix), whole, prefix)
    return (mixed(prefix) % np.uint64(parts)).astype(np.int64)


def _runs(trie: HatTrie, parts: int, hot: np.ndarray | None, everything: bool) -> Iterator[pa.RecordBatch]:
    """Spilled subtrees as sorted runs, one for each partition, language and length of phrases."""
    import zstandard

    compressor = zstandard.ZstdCompressor(level=3)
    words, hashes = trie.words, np.array(trie.hashes, np.uint64)
    for lang, ids, counts in trie.spilled(everything):
        part = _parts(lang, ids, hashes, parts, hot)
        columns = [[words[i] for i in ids[:, j].tolist()] for j in range(ids.shape[1])]
        phrases = columns[0] if len(columns) == 1 else list(map(b" ".join, zip(*columns)))
        order = np.array(sorted(range(len(phrases)), key=phrases.__getitem__), np.int64)
        order = order[np.argsort(part[order], kind="stable")]
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1)).tolist()
        ordered, counts = [phrases[i] for i in order.tolist()], counts[order]
        for at in range(0, len(cuts) - 1, 256):
            some = list(zip(cuts[at : at + 256], cuts[at + 1 : at + 257]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(part[order[a]]) for a, _ in some], pa.int32()),
                    pa.array([lang] * len(some), pa.string()),
                    pa.array([compressor.compress(b"\n".join(ordered[a:b])) for a, b in some], pa.binary()),
                    pa.array([planes(counts[a:b]) for a, b in some], pa.binary()),
                    pa.array([b - a for a, b in some], pa.int64()),
                ],
                ["part", "lang", "run", "counts", "n"],
            )
    trie.renumber()


def _merged(least: int, totals: bool):
    """Merge the sorted runs of one partition; phrases with ``least`` occurrences, and totals under null."""

    def merge(runs: pa.Table) -> pa.Table:
        import zstandard

        decompress = zstandard.ZstdDecompressor().decompress
        out: tuple[list, ...] = ([], [], [], [])
        by_lang: dict[str, list] = {}
        for lang, run, counts, n in zip(*(runs[c].to_pylist() for c in ("lang", "run", "counts", "n"))):
            by_lang.setdefault(lang, []).append((decompress(run).split(b"\n"), from_planes(counts, n).astype(np.int64)))
        for lang, sorted_runs in by_lang.items():
            phrases = [p for run, _ in sorted_runs for p in run]
            counts = np.concatenate([c for _, c in sorted_runs])
            # Timsort takes the runs as they are and merges them.
            order = sorted(range(len(phrases)), key=phrases.__getitem__)
            phrases = [phrases[i] for i in order]
            new = np.flatnonzero([True, *map(bytes.__ne__, phrases[1:], phrases[:-1])])
            sums = np.add.reduceat(counts[order], new)
            kept = sums >= least
            chosen = [phrases[i] for i in new[kept].tolist()]
            rows = [
                [lang] * len(chosen), [p.decode(errors="replace") for p in chosen], sums[kept].tolist(),
                phrase_hashes(lang, chosen).view(np.int64).tolist(),
            ]
            if totals:
                rows = [rows[0] + [lang], rows[1] + [None], rows[2] + [int(sums.sum())], rows[3] + [0]]
            for column, values in zip(out, rows):
                column += values
        types = [pa.string(), pa.string(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["lang", "phrase", "f", "hash"])

    return merge


def _counted(docs: DataFrame, lengths: range, least: int, parts: int, known=None, allowed=None, hot=None) -> DataFrame:
    """(lang, phrase, f, hash) of phrases of the given lengths that occur ``least`` times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = HatTrie()
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by_lang: dict[str, list] = {}
            for lang, text in zip(langs, texts):
                by_lang.setdefault(lang, []).append(text)
            for lang, mine in by_lang.items():
                for words in segments(piece_words(mine)):
                    _count_segment(trie, lang, words, lengths, known, allowed)
                    if trie.full():
                        yield from _runs(trie, parts, hot, False)
        yield from _runs(trie, parts, hot, True)

    runs = by_bytes(docs).mapInArrow(count, RUNS)
    merged = runs.groupBy("part").applyInArrow(_merged(least, lengths[0] == 1), FOUND)
    return stage(merged, f"phrases{lengths[0]}")


def _bits(frame: DataFrame) -> np.ndarray:
    return bitmap(frame, bitmap_bits(32 * frame.count()))


def phrase_counts(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of one to four words with ``least`` occurrences, and (lang, n)."""
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    parts = max(LEAST_PARTS, text_size(docs) // PART_BYTES)
    words = _counted(rows, range(1, 2), least, parts)
    totals = words.filter("phrase is null").groupBy("lang").agg(F.sum("f").cast("long").alias("n"))
    words = words.filter("phrase is not null")
    share = (totals.agg(F.sum("n")).first()[0] or 0) // (HOT_SHARE * parts)
    known = _bits(words)
    pairs = _counted(rows, range(2, 3), least, parts, known, known, _bits(words.filter(F.col("f") > share)))
    longer = _counted(rows, range(3, LONGEST + 1), least, parts, known, _bits(pairs), _bits(pairs.filter(F.col("f") > share)))
    return words.unionByName(pairs).unionByName(longer).drop("hash"), totals


def collocations(docs: DataFrame, least: int = 30, most: int = 2000, cover: int = 80) -> DataFrame:
    """The ``most`` best phrases of two to four words of each lang: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` counts the phrase (``least`` at least), ``l`` and ``r`` the two parts at its worst
    cut, ``n`` all words of the lang; the score is ``floor(SCALE * a / (l + r))``. A phrase is
    left out where a longer one that holds it has ``cover`` percent of its occurrences.
    Ties go to the more frequent, then to the smaller phrase by bytes.

    Needs ``text`` and ``lang``; other columns are ignored, whatever their names. Null texts
    and empty ones have no words, a null lang counts as ``und``; each repeated row counts. An
    empty table, or one without frequent phrases, gives no rows.
    """
    counts, totals = phrase_counts(docs, least)
    split = counts.withColumn("words", F.split("phrase", " ", -1)).withColumn("size", F.size("words"))
    known = counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    phrases = split.filter("size > 1").withColumnRenamed("f", "a")
    sides = phrases.select("lang", "phrase", "a", "words", "size", F.explode(F.expr("sequence(1, size - 1)")).alias("k")).select(
        "lang",
        "phrase",
        "a",
        "k",
        F.explode(
            F.expr(
                "array(named_struct('left', true, 'part', array_join(slice(words, 1, k), ' ')),"
                " named_struct('left', false, 'part', array_join(slice(words, k + 1, size - k), ' ')))"
            )
        ).alias("side"),
    )
    cuts = (
        sides.select("lang", "phrase", "a", "k", "side.left", "side.part")
        .join(known, ["lang", "part"])
        .groupBy("lang", "phrase", "a", "k")
        .agg(F.max(F.expr("if(left, part_f, null)")).alias("l"), F.max(F.expr("if(left, null, part_f)")).alias("r"))
    )
    score = F.expr(f"cast(cast(a as {EXACT}) * {SCALE} div (cast(l as {EXACT}) + r) as bigint)")
    worst = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = phrases.filter("size > 2").select(
        "lang",
        F.explode(
            F.expr(
                "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i ->"
                " array_join(slice(words, i, m), ' '))))"
            )
        ).alias("phrase"),
        "a",
    )
    longest = inner.groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    free = worst.join(longest, ["lang", "phrase"], "left").filter(
        F.expr(f"within is null or cast(within as {EXACT}) * 100 < cast(a as {EXACT}) * {cover}")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = free.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("salt", F.hash("phrase") % SALTS)
    # First the best of each salt, so that no task ranks a whole lang.
    for by in (["lang", "salt"], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= most)
    return rows.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
