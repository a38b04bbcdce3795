"""Repeated passages: Rabin-Karp hashes of every window of words, counted in Spark.

A task hashes all windows of ``width`` consecutive words of a chunk of documents. Windows
that a chunk has more than once are judged there; of each distinct window the first goes on,
by hash range, to the task that sees this window of all chunks. Hashes travel sorted and as
differences, about ten bytes a window in all, and a window that is everywhere travels once a
chunk, so no key grows hot. Windows that start earlier elsewhere go back to the shard of
their document, where they merge into maximal removal intervals.

A window is known by ``64 + 32`` bits of two hashes (by ``64 + 64`` with ``check_bytes=8``):
100 TB of text hold some 2 * 10**13 windows, of which any two unequal ones agree with a
chance of 0.3 percent (of 10**-12).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    WordRolling, by_bytes, from_planes, from_rising, grouped_batches, packed, planes, power_of_two, rising, shard_of, shipped,
    text_bytes, text_size, unshipped, with_uid, word_bounds,
)

CHUNK_BYTES = 16 << 20
BUCKET_WINDOWS = 2_000_000
SHARD_BYTES = 8 << 20
SEEDS = (11, 12)
SENT = pa.schema(
    [("bucket", pa.int64()), ("chunk", pa.int64()), ("shard", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary()),
     ("checks", pa.binary()), ("at", pa.binary()), ("uids", pa.binary()), ("firsts", pa.binary())]
)
SENT_DDL = "bucket long, chunk long, shard long, n long, hashes binary, checks binary, at binary, uids binary, firsts binary"


def by_shard(uid: np.ndarray, start: np.ndarray, shards: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(shard, n, uids, starts) of the windows to remove."""
    shard = shard_of(uid, shards)
    order = np.lexsort((start, uid, shard))
    uid, start, shard = uid[order], start[order], shard[order]
    cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:]):
        low = np.diff(uid[a:b].view(np.uint64), prepend=np.uint64(0))
        yield int(shard[a]), int(b - a), planes(low), planes(start[a:b])


def from_shard(n: int, uids: bytes, starts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(from_planes(uids, n), dtype=np.uint64).view(np.int64), from_planes(starts, n).astype(np.int64)


class Chunk:
    """Windows of some documents, in the order of (uid, start)."""

    def __init__(self, width: int, buckets: int, shards: int, check_bytes: int) -> None:
        self.width, self.buckets, self.shards, self.check_bytes = width, buckets, shards, check_bytes
        self.rolling = [WordRolling(s) for s in SEEDS]
        self.docs: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, uid: int, text: str | None) -> None:
        words = text_bytes(text).split()
        if len(words) >= self.width:
            bounds = word_bounds(words)
            hashes, checks = (r.runs(r.prefix(*bounds), self.width) for r in self.rolling)
            self.docs.append((uid, hashes, checks.astype(f"<u{self.check_bytes}")))
            self.size += len(bounds[0])

    def rows(self, chunk: int) -> Iterator[tuple]:
        if not self.docs:
            return
        docs, self.docs, self.size = sorted(self.docs, key=lambda d: d[0]), [], 0
        uids = np.array([d[0] for d in docs], np.int64)
        sizes = np.array([len(d[1]) for d in docs])
        firsts = np.cumsum(sizes) - sizes
        hashes, checks = np.concatenate([d[1] for d in docs]), np.concatenate([d[2] for d in docs])
        order = np.argsort(hashes, kind="stable")
        h, c = hashes[order], checks[order]
        if ((h[1:] == h[:-1]) & (c[1:] != c[:-1])).any():
            order = np.lexsort((np.arange(len(hashes)), checks, hashes))
            h, c = hashes[order], checks[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
        repeated = order[~new]
        doc = np.searchsorted(firsts, repeated, side="right") - 1
        for shard, n, of, at in by_shard(uids[doc], repeated - firsts[doc], self.shards):
            yield (shard % self.buckets, chunk, shard, n, None, None, at, of, None)
        h, c, at = h[new], c[new], order[new]
        bucket = (h >> np.uint64(64 - (self.buckets.bit_length() - 1))).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        keys = uids.view(np.uint64) ^ np.uint64(1 << 63)
        doc = np.searchsorted(firsts, at, side="right") - 1
        for a, b in zip(cuts[:-1], cuts[1:]):
            # Only the documents of these windows, so a chunk's bytes have a bound for any number of buckets.
            used = np.unique(doc[a:b])
            starts = len(used).to_bytes(8, "little") + rising(firsts[used])
            yield (int(bucket[a]), chunk, -1, int(b - a), rising(h[a:b]), packed(c[a:b]), planes(at[a:b]), rising(keys[used]), starts)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(SENT)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SENT)], schema=SENT)


def repeated_starts(docs: DataFrame, width: int, buckets: int, shards: int, check_bytes: int) -> DataFrame:
    """(shard, n, uids, starts) of all windows whose words start earlier elsewhere."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        chunk = Chunk(width, buckets, shards, check_bytes)
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                chunk.add(uid, text.as_py())
                if chunk.size >= CHUNK_BYTES:
                    for row in chunk.rows(number):
                        yield _batch([row])
                    number += 1
        for row in chunk.rows(number):
            yield _batch([row])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_batches(batches, ["bucket"]):
            hashes, checks, uids, starts = [], [], [], []
            for r in table.to_pylist():
                if r["shard"] >= 0:
                    yield _removals([(r["shard"], r["n"], r["uids"], r["at"])])
                    continue
                n_docs = int.from_bytes(r["firsts"][:8], "little")
                known = (from_rising(r["uids"], n_docs) ^ np.uint64(1 << 63)).view(np.int64)
                first = from_rising(r["firsts"][8:], n_docs).astype(np.int64)
                at = from_planes(r["at"], r["n"]).astype(np.int64)
                doc = np.searchsorted(first, at, side="right") - 1
                hashes.append(from_rising(r["hashes"], r["n"]))
                checks.append(np.frombuffer(r["checks"], f"<u{check_bytes}"))
                uids.append(known[doc])
                starts.append((at - first[doc]).astype(np.uint32))
            if len(hashes) < 2:
                continue
            h, c, uid, start = map(np.concatenate, (hashes, checks, uids, starts))
            order = np.argsort(h)
            same = h[order[1:]] == h[order[:-1]]
            order = order[np.append(same, False) | np.concatenate([[False], same])]
            h, c, uid, start = h[order], c[order], uid[order], start[order]
            order = np.lexsort((start, uid, c, h))
            h, c, uid, start = h[order], c[order], uid[order], start[order]
            later = np.zeros(len(h), bool)
            later[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
            yield _removals(list(by_shard(uid[later], start[later].astype(np.int64), shards)))

    sent = by_bytes(docs.select("uid", "text")).mapInArrow(windows, SENT_DDL)
    dealt = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(judged, "shard long, n long, uids binary, starts binary")


def _removals(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["shard", "n", "uids", "starts"])


def runs(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true."""
    change = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return change[::2], change[1::2]


def covered_by(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in an interval."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + lengths, n), -1)
    return np.cumsum(change[:n]) > 0


def remove_repeats(docs: DataFrame, width: int = 20, check_bytes: int = 4) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) of each row of ``docs`` (doc_id, text).

    ``spans`` are the maximal removed intervals in words (start, end), ``kept`` the other
    words joined by one space. A word is removed if a window of ``width`` words that covers
    it has the same words as one that starts earlier: in a smaller doc_id, or in the same
    document. Null and empty texts have no words. Null ids come before all others; rows that
    share an id are ordered by their text, and a later one is judged like a later document.
    Other columns are not carried; an empty table gives no rows.
    """
    docs = with_uid(docs)
    size = text_size(docs)
    buckets = power_of_two(size / 6 / BUCKET_WINDOWS, 32)
    shards = max(32, size // SHARD_BYTES)
    found = repeated_starts(docs, width, buckets, shards, check_bytes)

    def cut(rows: pa.Table, removed: pa.Table) -> pa.Table:
        pairs = [from_shard(*r) for r in zip(*(removed[c].to_pylist() for c in ("n", "uids", "starts")))]
        uid = np.concatenate([np.zeros(0, np.int64), *[p[0] for p in pairs]])
        start = np.concatenate([np.zeros(0, np.int64), *[p[1] for p in pairs]])
        order = np.argsort(uid, kind="stable")
        uid, start = uid[order], start[order]
        out: list[list] = [[], [], [], [], []]
        for me, doc_id, data in unshipped(rows):
            words = data.split()
            a, b = np.searchsorted(uid, [me, me + 1])
            spans = []
            if b > a:
                gone = covered_by(start[a:b], width, len(words))
                spans = [{"start": s, "end": e} for s, e in zip(*(x.tolist() for x in runs(gone)))]
                kept, at = [], 0
                for span in spans:
                    kept += words[at : span["start"]]
                    at = span["end"]
                kept += words[at:]
            else:
                kept = words
            out[0].append(doc_id)
            out[1].append(len(words))
            out[2].append(len(words) - len(kept))
            out[3].append(spans)
            out[4].append(b" ".join(kept).decode("utf-8", "replace"))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
        names = ["doc_id", "n_words", "n_removed", "spans", "kept"]
        return pa.table([pa.array(c, t) for c, t in zip(out, types)], names=names)

    to_shard = found.select(F.col("shard").alias("to_shard"), "n", "uids", "starts")
    texts, gone = shipped(docs, shards).repartition(shards, "shard"), to_shard.repartition(shards, "to_shard")
    return texts.groupBy("shard").cogroup(gone.groupBy("to_shard")).applyInArrow(
        cut, "doc_id long, n_words long, n_removed long, spans array<struct<start long, end long>>, kept string"
    )
