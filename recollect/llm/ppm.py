"""Language-model scores by prediction by partial matching over byte contexts.

A text is its words (A-Z lower-cased) with single spaces between them, then an end symbol.
The trie of contexts is a table: counts of (``order`` bytes of context, symbol) give the
counts of all shorter contexts. A symbol not seen in a context is coded by an escape
(method D: each distinct symbol gives half a count to it) and then by the next shorter
context, without the symbols that the longer one knows (exclusion), down to all
symbols alike. The model is pretrained: a text's score is a sum over its positions of a
value that only depends on (context, symbol), so tasks exchange tables, never positions.

Texts are cut into chunks of about ``CHUNK_BYTES``. A chunk counts its distinct (context,
symbol) pairs and words; these are summed over chunks by hash buckets, the values are computed in groups that
share the last two context bytes (all longer contexts of a pair lie in its group; contexts
of at most one byte have at most 258 x 258 counts and go to all tasks), and each chunk gets
back the values of its own pairs.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, from_planes, from_rising, grouped_batches, mixed, packed, planes, rising, stage, text_bytes, text_size

CHUNK_BYTES = 32 << 20
MERGE = 8  # pieces whose counts are held before they are merged
BUCKET_BYTES = 24 << 20
GROUP_KEYS = 200_000
PIECE = 1 << 20  # positions coded at a time
BITS, END, SYMBOLS = 9, 257, 257  # symbols 1-256 are bytes, 257 is the end; 0 only pads contexts
MASK = (1 << BITS) - 1


def normal_words(text: str | None) -> list[bytes]:
    return text_bytes(text).lower().split()


def coded(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, symbol) of every position, packed in 64 bits, and each text's first position."""
    pad, end = np.zeros(order, np.uint64), np.array([END], np.uint64)
    parts = [x for t in texts for x in (pad, np.frombuffer(t, np.uint8).astype(np.uint64) + np.uint64(1), end)]
    symbols = np.concatenate(parts) if parts else pad
    n = len(symbols) - order
    packed = np.zeros(max(n, 0), np.uint64)
    for j in range(order + 1):
        packed = (packed << np.uint64(BITS)) | symbols[j : j + n]
    positions = packed[symbols[order:] != 0] if n > 0 else packed
    return positions, np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1].astype(np.int64)


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``PIECE`` bytes."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= PIECE:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def chunk_counts(texts: list[bytes], learned: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct packed pairs, sorted, with their counts in the texts that are learned from."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0)
    held = [(keys, counts)]
    pieces = list(_pieces(texts))
    for i, (a, b) in enumerate(pieces):
        positions, _ = coded(texts[a:b], order)
        codes, found = pd.factorize(positions)
        weight = np.repeat(learned[a:b].astype(np.float64), [len(t) + 1 for t in texts[a:b]])
        held.append((found, np.bincount(codes, weight, len(found))))
        if len(held) > MERGE or i == len(pieces) - 1:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([c for _, c in held]), len(keys))
            held = [(keys, counts)]
    return keys, counts.astype(np.int64)


def chunk_sums(texts: list[bytes], keys: np.ndarray, values: np.ndarray, order: int) -> np.ndarray:
    """Each text's sum of the values of its positions; ``keys`` are sorted."""
    sums = []
    for a, b in _pieces(texts):
        positions, first = coded(texts[a:b], order)
        codes, found = pd.factorize(positions)
        sums.append(np.add.reduceat(values[np.searchsorted(keys, found)][codes], first))
    return np.concatenate(sums) if sums else np.zeros(0)


class Low:
    """Counts of symbols after at most one byte of context: (257 + 1) x 258 numbers at most."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.one = np.zeros((SYMBOLS + 1, SYMBOLS + 1), np.int64)
        low = rows["low"].to_numpy(np.int64)
        self.one[low >> BITS, low & MASK] = rows["n"].to_numpy(np.int64)
        self.none = self.one.sum(0)


def _levels(keys: np.ndarray, counts: np.ndarray, low: Low, order: int):
    """For context lengths ``order`` to 0: keys with counts, sorted, and each one's context totals."""
    for k in range(order, -1, -1):
        if k >= 2:
            short = keys & np.uint64((1 << BITS * (k + 1)) - 1)
            found, at = np.unique(short, return_inverse=True)
            n = np.bincount(at, counts, len(found)).astype(np.int64)
        elif k == 1:
            found = np.flatnonzero(low.one.ravel())
            n = low.one.ravel()[found]
            found = ((found // (SYMBOLS + 1)) << BITS | found % (SYMBOLS + 1)).astype(np.uint64)
        else:
            found = np.flatnonzero(low.none).astype(np.uint64)
            n = low.none[found.astype(np.int64)]
        yield k, found[n > 0], n[n > 0]


def log_values(keys: np.ndarray, counts: np.ndarray, low: Low, order: int) -> np.ndarray:
    """log10 of the probability of each key's symbol after its context.

    ``keys`` hold all keys of the corpus that share their last two context bytes with one of
    them; ``counts`` may be 0.
    """
    n = len(keys)
    value, open_ = np.zeros(n), np.ones(n, bool)
    above: tuple[np.ndarray, np.ndarray] | None = None  # known keys one level up, and their contexts
    for k, known, count in _levels(keys, counts, low, order):
        width = np.uint64((1 << BITS * (k + 1)) - 1)
        contexts, first = np.unique(known >> np.uint64(BITS), return_index=True)
        if len(contexts):
            total = np.add.reduceat(count, first).astype(np.float64)
            kinds = np.diff(np.append(first, len(known))).astype(np.float64)
        else:
            total = kinds = np.zeros(0)
        mine = (keys & width) >> np.uint64(BITS)
        at = np.minimum(np.searchsorted(contexts, mine), max(len(contexts) - 1, 0))
        seen = contexts[at] == mine if len(contexts) else np.zeros(n, bool)
        t, d = np.zeros(n), np.zeros(n)
        t[seen], d[seen] = total[at[seen]], kinds[at[seen]]
        if above is not None and len(above[0]):
            # what the longer context knows is excluded here
            upper, upper_contexts = above
            below = count[np.searchsorted(known, upper & width)]
            owner = upper >> np.uint64(BITS)
            start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            gone = np.add.reduceat(below, start).astype(np.float64)
            gone_kinds = np.diff(np.append(start, len(owner))).astype(np.float64)
            full = keys & np.uint64((1 << BITS * (k + 2)) - 1)
            j = np.minimum(np.searchsorted(upper_contexts, full >> np.uint64(BITS)), len(upper_contexts) - 1)
            hit = upper_contexts[j] == full >> np.uint64(BITS)
            t[hit] -= gone[j[hit]]
            d[hit] -= gone_kinds[j[hit]]
        j = np.minimum(np.searchsorted(known, keys & width), max(len(known) - 1, 0))
        has = known[j] == keys & width if len(known) else np.zeros(n, bool)
        c = np.where(has, count[j] if len(known) else 0, 0)
        coded_here, escaped = open_ & has, open_ & ~has & (d > 0)
        value[coded_here] += np.log10((c[coded_here] - 0.5) / t[coded_here])
        value[escaped] += np.log10(0.5 * d[escaped] / t[escaped])
        open_ &= ~has
        above = (known, contexts)
    unseen = SYMBOLS - int((low.none > 0).sum())
    value[open_] -= math.log10(max(unseen, 1))
    return value


DOCUMENTS, PAIRS, WORDS = 0, 1, 2
CHUNKED = pa.schema(
    [("kind", pa.int32()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())),
     ("items", pa.binary()), ("counts", pa.binary())]
)
CHUNKED_DDL = "kind int, bucket long, chunk long, n long, ids array<long>, items binary, counts binary"
ANSWER = pa.schema([("to_chunk", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("items", pa.binary()), ("told", pa.binary())])
ANSWER_DDL = "to_chunk long, kind int, n long, items binary, told binary"


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _chunks(docs: DataFrame, learn: str, order: int, chunk_bytes: int, buckets: int) -> DataFrame:
    """Rows of chunks: the documents in one, pairs and words with counts in one for each bucket of their hashes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        chunk, size = TaskContext.get().partitionId() << 24, 0
        ids: list = []
        learned: list[bool] = []
        texts: list[bytes] = []
        words: Counter = Counter()  # counts in the texts that are learned from

        def flush() -> Iterator[pa.RecordBatch]:
            body = zstandard.ZstdCompressor(level=3).compress(b"\n".join(texts))
            yield _rows([(DOCUMENTS, -1, chunk, len(ids), ids, body, bytes(learned))], CHUNKED)
            keys, counts = chunk_counts(texts, np.array(learned), order)
            at = bucket_of(keys, buckets)
            by = np.argsort(at, kind="stable")
            cuts = np.searchsorted(at[by], np.arange(buckets + 1))
            for b in range(buckets):
                me = by[cuts[b] : cuts[b + 1]]
                if len(me):
                    yield _rows([(PAIRS, b, chunk, len(me), None, rising(keys[me]), planes(counts[me]))], CHUNKED)
            parts: list[list[bytes]] = [[] for _ in range(buckets)]
            for w in words:
                parts[zlib.crc32(w) % buckets].append(w)
            for b, part in enumerate(parts):
                if part:
                    amounts = np.fromiter(map(words.__getitem__, part), np.int64, len(part))
                    yield _rows([(WORDS, b, chunk, len(part), None, b" ".join(part), planes(amounts))], CHUNKED)

        for batch in batches:
            for doc_id, use, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = normal_words(text.as_py())
                if use:
                    words.update(found)
                else:
                    words.update(dict.fromkeys(found, 0))
                ids.append(doc_id)
                learned.append(use)
                texts.append(b" ".join(found))
                size += len(texts[-1]) + 1
                if size >= chunk_bytes:
                    yield from flush()
                    chunk, size = chunk + 1, 0
                    ids, learned, texts, words = [], [], [], Counter()
        if ids:
            yield from flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.expr(learn), F.lit(True)).alias("learned"), "text")
    return by_bytes(rows).mapInArrow(cut, CHUNKED_DDL)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys) % np.uint64(buckets)).astype(np.int64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, key, n) of all chunks' pairs."""
    for table in grouped_batches(batches, ["bucket"]):
        keys, counts = _pairs(table)
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, np.concatenate(counts).astype(np.float64), len(found)).astype(np.int64)
        bucket = np.full(len(found), table["bucket"][0].as_py())
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(found.view(np.int64)), pa.array(n)], ["bucket", "key", "n"])


def _pairs(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    sizes = table["n"].to_pylist()
    return (
        [from_rising(x, n) for x, n in zip(table["items"].to_pylist(), sizes)],
        [from_planes(x, n).astype(np.int64) for x, n in zip(table["counts"].to_pylist(), sizes)],
    )


def _words_told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's words with their counts in all chunks, and a row (to_chunk -1) with the bucket's kinds and tokens."""
    for table in grouped_batches(batches, ["bucket"]):
        total: Counter = Counter()
        for row in range(table.num_rows):
            names = table["items"][row].as_py().split(b" ")
            for w, c in zip(names, from_planes(table["counts"][row].as_py(), len(names)).tolist()):
                total[w] += c
        for row in range(table.num_rows):
            items = table["items"][row].as_py()
            names = items.split(b" ")
            counts = np.fromiter(map(total.__getitem__, names), np.int64, len(names))
            yield _rows([(table["chunk"][row].as_py(), WORDS, len(names), items, planes(counts))], ANSWER)
        known = [c for c in total.values() if c]
        yield _rows([(-1, WORDS, len(known), None, sum(known).to_bytes(8, "little"))], ANSWER)


def score(docs: DataFrame, learn: str, order: int = 5, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, learned, n_tokens, n_known, train_tokens, base_score, score) of each row.

    ``learn`` is an SQL condition on ``docs``: the model learns from rows where it is true or
    null. ``score`` is log10 of the model's probability of the text, ``base_score`` that of
    independent tokens (words and one end) with one added to each count. A null text is
    empty: its end is its only token. Rows are scored each on its own, whatever their ids.
    """
    buckets = max(32, text_size(docs) // BUCKET_BYTES)
    chunks = stage(_chunks(docs, learn, order, chunk_bytes, buckets), "chunks", by="kind")
    dealt = lambda kind: (
        chunks.filter(F.col("kind") == kind).select("bucket", "chunk", "n", "items", "counts").repartition(buckets, "bucket")
    )

    pairs = by_bytes(dealt(PAIRS).sortWithinPartitions("bucket"))
    sums = stage(pairs.mapInArrow(_summed, "bucket long, key long, n long"), "counts")
    low = Low(
        sums.filter("n > 0").groupBy(F.expr(f"key & {(1 << 2 * BITS) - 1}").alias("low")).agg(F.sum("n").alias("n")).toPandas()
    )
    groups = max(16, sums.count() // GROUP_KEYS)

    def valued(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        values = log_values(np.asarray(table["key"]).view(np.uint64), np.asarray(table["n"]), low, order)
        return pa.table({"of": table["bucket"], "key": table["key"], "value": pa.array(values)})

    last_two = F.expr(f"pmod(xxhash64(shiftright(key, {BITS}) & {(1 << 2 * BITS) - 1}), {groups})")
    values = sums.withColumn("part", last_two).groupBy("part").applyInArrow(valued, "of long, key long, value double")

    def told(blobs: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("key")
        keys, value = np.asarray(known["key"]).view(np.uint64), np.asarray(known["value"])
        rows = []
        for chunk, n, items in zip(*(blobs[c].to_pylist() for c in ("chunk", "n", "items"))):
            found = value[np.searchsorted(keys, from_rising(items, n))]
            rows.append((chunk, PAIRS, n, items, packed(found)))
        return pa.Table.from_batches([_rows(rows, ANSWER)])

    pairs_told = dealt(PAIRS).groupBy("bucket").cogroup(values.groupBy("of")).applyInArrow(told, ANSWER_DDL)
    words = by_bytes(dealt(WORDS).sortWithinPartitions("bucket")).mapInArrow(_words_told, ANSWER_DDL)
    words = stage(words, "words")
    totals = words.filter("to_chunk = -1").select("n", "told").toPandas()
    documents = chunks.filter(F.col("kind") == DOCUMENTS).select("chunk", "ids", "items", "counts")
    ends = documents.select(F.length(F.regexp_replace(F.hex("counts"), "0", "")).alias("n")).agg(F.sum("n")).first()[0] or 0
    tokens = sum(int.from_bytes(x, "little") for x in totals["told"])
    train_tokens, kinds = tokens + ends, int(totals["n"].sum()) + (ends > 0)
    scale = math.log10(train_tokens + kinds + 1)

    def scored(rows: pa.Table, answers: pa.Table) -> pa.Table:
        import zstandard

        logs: dict[bytes, float] = {}
        keys, values_ = [np.zeros(0, np.uint64)], [np.zeros(0)]
        for kind, n, items, said in zip(*(answers[c] for c in ("kind", "n", "items", "told"))):
            if kind.as_py() == WORDS:
                counts = from_planes(said.as_py(), n.as_py()).astype(np.float64)
                logs.update(zip(items.as_py().split(b" "), np.log10(counts + 1).tolist()))
            else:
                keys.append(from_rising(items.as_py(), n.as_py()))
                values_.append(np.frombuffer(said.as_py(), np.float64))
        key, value = np.concatenate(keys), np.concatenate(values_)
        by_key = np.argsort(key)
        key, value = key[by_key], value[by_key]
        out: dict[str, list] = {c: [] for c in SCORED.names}
        for ids, items, learned in zip(*(rows[c] for c in ("ids", "items", "counts"))):
            texts = zstandard.ZstdDecompressor().decompress(items.as_py()).split(b"\n")
            out["doc_id"] += ids.as_py()
            out["learned"] += map(bool, learned.as_py())
            out["score"].append(chunk_sums(texts, key, value, order))
            for t in texts:
                found = list(map(logs.__getitem__, t.split()))
                out["n_tokens"].append(len(found) + 1)
                out["n_known"].append(len(found) - found.count(0.0) + (ends > 0))
                out["base_score"].append(math.fsum(found) + math.log10(ends + 1) - scale * (len(found) + 1))
        out["score"] = np.concatenate([np.zeros(0), *out["score"]])
        return pa.table([pa.array(out[f.name], f.type) for f in SCORED], schema=SCORED)

    answers = pairs_told.unionByName(words.filter("to_chunk >= 0"))
    result = documents.groupBy("chunk").cogroup(answers.groupBy("to_chunk")).applyInArrow(
        scored, "doc_id long, learned boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return result.withColumn("train_tokens", F.lit(train_tokens).cast("long"))


SCORED = pa.schema(
    [("doc_id", pa.int64()), ("learned", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
     ("base_score", pa.float64()), ("score", pa.float64())]
)
