"""Repeated byte strings by merged Burrows-Wheeler transforms.

Every string of ``width`` bytes has a minimizer: the least hash of its ``SEED_BYTES``-byte
substrings. Neighbouring strings whose first minimizer is at the same place form one record,
about 140 bytes for 40 strings. Equal strings lie in records of equal minimizer, as far from
its place, and so no two strings of one record are equal. So

1. records are counted by minimizer. A record whose bytes start earlier elsewhere is removed
   as a whole. Of unequal records with one minimizer, those stay open that agree in the bytes
   before it or after it, half a string long: any equal strings cover one of the two;
2. open records (picked in the scan by a bounded bitmap) meet by minimizer.
   Each task cuts them into shards, sorts each shard's suffixes and merges the shards'
   transforms by interleave refinement: in every round the rows of the merged transform are
   dealt by the bytes before them, which sorts them by that many bytes more, until rows are
   sorted by ``width`` bytes. No suffix is sorted again. Rows whose common prefix with their
   neighbour reaches ``width`` form the repeated intervals, and in each all but the earliest
   string are removed.

Minimizers with very many records are dealt by a longer piece that their strings share, so
that a common line does not bring all of its surroundings into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    Rolling, bitmap, bitmap_bits, by_bytes, from_planes, from_rising, grouped_batches, mixed, packed, planes, power_of_two, rising,
    set_in, shard_of, shipped, stage, text_bytes, text_size, unshipped, with_uid,
)
from .substring_dedup import covered_by, runs

SEED_BYTES = 24
STEP = 8  # bytes that a round of the refinement adds
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 24 << 20
SHARD_BYTES = 8 << 20
MERGE_BYTES = 60_000  # of records merged at a time; whole minimizers stay together
MERGE_SHARDS = 8
HOT = 64  # unequal records of a minimizer from which it is dealt by longer pieces
PIECE_STRINGS = 10
END = 0xFF  # in no UTF-8 text
SEED = 21
SENT = pa.schema(
    [("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("whole", pa.binary()),
     ("at", pa.binary()), ("uids", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary()),
     ("sides", pa.binary()), ("bytes", pa.binary()), ("shard", pa.int64())]
)
SENT_DDL = ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'long'}" for f in SENT)
FOUND = pa.schema(
    [("shard", pa.int64()), ("n", pa.int64()), ("uids", pa.binary()), ("starts", pa.binary()), ("counts", pa.binary()),
     ("open", pa.list_(pa.int64())), ("hot", pa.list_(pa.int64()))]
)
FOUND_DDL = "shard long, n long, uids binary, starts binary, counts binary, open array<long>, hot array<long>"


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """The minimum of each ``span`` neighbours, from minima to the left and right of block borders."""
    n = len(values)
    blocks = -(-n // span)
    rows = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    rows[:n] = values
    rows = rows.reshape(blocks, span)
    before = np.minimum.accumulate(rows, 1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[: n - span + 1], before[span - 1 : n])


def record_id(key: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return mixed(key ^ mixed(whole))


class Records:
    """Records of one document: minimizer, hash of the bytes, start, count of strings, place of the minimizer.

    ``sides`` are 16-bit hashes of the half strings before and after the minimizer, 0 where
    the document ends before.
    """

    def __init__(self, rolling: Rolling, data: np.ndarray, width: int) -> None:
        n, span = len(data), width - SEED_BYTES + 1
        self.prefix = rolling.prefix(data)
        at = np.arange(n - SEED_BYTES + 1)
        hashes = rolling.ranges(self.prefix, at, at + SEED_BYTES)
        least = _least(hashes, span)
        # a string that starts with its minimizer is the last one of that place
        self.start = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (hashes[: len(least) - 1] == least[:-1])]))
        self.count = np.diff(np.append(self.start, len(least)))
        own = least[self.start]
        self.key = mixed(own)  # least hashes are small ones; keys spread over all buckets
        self.whole = rolling.ranges(self.prefix, self.start, self.start + self.count + width - 1)
        # a place is a minimizer if the largest of the minima around it is its own hash
        edge = np.zeros(span - 1, np.uint64)
        seeds = np.flatnonzero(~_least(~np.concatenate([edge, least, edge]), span) == hashes)
        order = np.lexsort((seeds, hashes[seeds]))
        seeds = seeds[order]
        value = hashes[seeds]
        # the first place of the minimizer from the record's start on
        new = np.concatenate([[True], value[1:] != value[:-1]])
        ranked = (np.cumsum(new) - 1) * n + seeds
        self.seed = seeds[np.searchsorted(ranked, np.searchsorted(value[new], own) * n + self.start)]
        half = (width - SEED_BYTES + 1) // 2
        self.sides = np.zeros((len(self.key), 2), np.uint16)
        for side, at in enumerate((self.seed - half, self.seed + SEED_BYTES)):
            fits = np.flatnonzero((at >= 0) & (at + half <= n))
            hashed = rolling.ranges(self.prefix, at[fits], at[fits] + half)
            self.sides[fits, side] = (hashed >> np.uint64(49)).astype(np.uint16) + np.uint16(1)

    def pieces(self, rolling: Rolling, use: np.ndarray, hot: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
        """(key, whole, start, count) of the records in ``use``, those in ``hot`` cut into runs that share a longer piece."""
        cut = use & hot
        keep = use & ~cut
        parts = [[self.key[keep], self.whole[keep], self.start[keep], self.count[keep]]]
        if not cut.any():
            return tuple(parts[0])
        seed, first, end = self.seed[cut], self.start[cut], (self.start + self.count)[cut]
        for low in range(0, width - SEED_BYTES + 1, PIECE_STRINGS):
            a, b = np.maximum(first, seed - low - PIECE_STRINGS + 1), np.minimum(end, seed - low + 1)
            use = a < b
            a, b, at = a[use], b[use], seed[use] - low
            left, right = np.maximum(at, 0), np.minimum(at - PIECE_STRINGS + 1 + width, len(self.prefix) - 1)
            key = mixed(rolling.ranges(self.prefix, left, right) ^ mixed(np.full(1, low + 1, np.uint64)))
            parts.append([key, rolling.ranges(self.prefix, a, b + width - 1), a, b - a])
        return tuple(np.concatenate(c) for c in zip(*parts))


def by_shard(uid: np.ndarray, start: np.ndarray, count: np.ndarray, shards: int) -> Iterator[tuple]:
    """Rows of ``FOUND`` with the strings to remove: ``count`` neighbours from ``start``."""
    shard = shard_of(uid, shards)
    order = np.lexsort((start, uid, shard))
    uid, start, count, shard = uid[order], start[order], count[order], shard[order]
    cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:]):
        ids = np.diff(uid[a:b].view(np.uint64), prepend=np.uint64(0))
        yield int(shard[a]), int(b - a), planes(ids), planes(start[a:b]), planes(count[a:b])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class Chunk:
    """Records of some documents on their way to the buckets of their keys."""

    def __init__(self, width: int, buckets: int, shards: int, open_: np.ndarray | None, hot: np.ndarray | None) -> None:
        self.width, self.buckets, self.shards, self.open, self.hot = width, buckets, shards, open_, hot
        self.rolling = Rolling(SEED)
        self.docs: list[tuple] = []
        self.size = 0

    def add(self, uid: int, text: str | None) -> None:
        data = text_bytes(text)
        self.size += len(data)
        if len(data) < self.width:
            return
        found = Records(self.rolling, np.frombuffer(data, np.uint8), self.width)
        if self.open is None:
            self.docs.append((uid, None, found.key, found.whole, found.start, found.count, found.sides))
        elif (use := set_in(self.open, record_id(found.key, found.whole))).any():
            parts = found.pieces(self.rolling, use, set_in(self.hot, found.key), self.width)
            self.docs.append((uid, data, *parts, np.zeros((len(parts[0]), 2), np.uint16)))

    def rows(self, chunk: int) -> Iterator[tuple]:
        docs, self.docs, self.size = sorted(self.docs, key=lambda d: d[0]), [], 0
        if not docs:
            return
        uids = np.array([d[0] for d in docs], np.int64)
        doc = np.repeat(np.arange(len(docs)), [len(d[2]) for d in docs])
        key, whole, start, count, sides = (np.concatenate([d[i] for d in docs]) for i in range(2, 7))
        order = np.lexsort((start, doc, whole, key))
        k, w = key[order], whole[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (w[1:] != w[:-1])]) if len(k) else np.zeros(0, bool)
        later = order[~new]
        for shard, n, ids, at, counts in by_shard(uids[doc[later]], start[later], count[later], self.shards):
            yield (shard % self.buckets, chunk, n, None, None, at, ids, None, counts, None, None, shard)
        order = order[new]
        bucket = (key[order] >> np.uint64(64 - (self.buckets.bit_length() - 1))).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        known = planes(np.diff(uids.view(np.uint64), prepend=np.uint64(0)))
        names = len(uids).to_bytes(8, "little") + known
        for a, b in zip(cuts[:-1], cuts[1:]):
            me = order[a:b]
            data = None
            if self.open is not None:
                data = b"".join(docs[d][1][s : s + c + self.width - 1] for d, s, c in zip(doc[me], start[me], count[me]))
            yield (int(bucket[a]), chunk, int(b - a), rising(key[me]), packed(whole[me]), planes(start[me]), names, planes(doc[me]),
                   planes(count[me]), packed(sides[me]), data, -1)


class Bucket:
    """All records that came to a bucket, sorted by (key, bytes, uid, start)."""

    def __init__(self, rows: list[dict], width: int) -> None:
        parts: list[list[np.ndarray]] = []
        self.data = b"".join(r["bytes"] or b"" for r in rows)
        for r in rows:
            n, docs = r["n"], int.from_bytes(r["uids"][:8], "little")
            uids = np.cumsum(from_planes(r["uids"][8:], docs), dtype=np.uint64).view(np.int64)
            parts.append([
                from_rising(r["keys"], n), np.frombuffer(r["whole"], np.uint64), uids[from_planes(r["docs"], n).astype(np.int64)],
                from_planes(r["at"], n).astype(np.int64), from_planes(r["counts"], n).astype(np.int64),
                np.frombuffer(r["sides"], np.uint16).reshape(-1, 2),
            ])
        key, whole, uid, start, count, sides = (np.concatenate(c) for c in zip(*parts))
        length = count + width - 1
        offset = np.cumsum(length) - length
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        order = order[np.append(same, False) | np.concatenate([[False], same])]
        order = order[np.lexsort((start[order], uid[order], whole[order], key[order]))]
        self.key, self.whole, self.uid, self.start, self.count, self.sides, self.offset = (
            x[order] for x in (key, whole, uid, start, count, sides, offset)
        )
        whole = self.whole
        new_key = np.concatenate([[True], self.key[1:] != self.key[:-1]]) if len(order) else np.zeros(0, bool)
        self.first = new_key.copy()
        self.first[1:] |= whole[1:] != whole[:-1]
        self.group = np.cumsum(new_key) - 1

    def open_keys(self) -> np.ndarray:
        """Group numbers with unequal records."""
        return np.flatnonzero(np.bincount(self.group[self.first]) > 1)

    def open_records(self) -> np.ndarray:
        """Of the first of equal records, those with a side in common with another of their minimizer."""
        first = np.flatnonzero(self.first)
        found = []
        for side in self.sides.T:
            rows = first[side[first] > 0]
            rows = rows[np.lexsort((side[rows], self.group[rows]))]
            same = (self.group[rows[1:]] == self.group[rows[:-1]]) & (side[rows[1:]] == side[rows[:-1]])
            found.append(rows[np.append(same, False) | np.concatenate([[False], same])] if len(rows) else rows)
        return np.unique(np.concatenate(found))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The places of ``text``, taken as a ring, sorted by at least 128 bytes."""
    n = len(text)
    at = np.arange(n)
    rank = np.zeros(n, np.uint64)
    for j in range(8):
        rank = (rank << np.uint64(8)) | text[(at + j) % n]
    rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
    for h in (8, 16, 32, 64):
        rank = np.unique(rank * np.uint64(n) + rank[(at + h) % n], return_inverse=True)[1].astype(np.uint64)
    return np.argsort(rank, kind="stable")


def _before(text: np.ndarray, step: int) -> np.ndarray:
    """The ``step`` bytes before each place of the ring, as a number."""
    n, value = len(text), np.zeros(len(text), np.uint64)
    at = np.arange(n)
    for j in range(step, 0, -1):
        value = (value << np.uint64(8)) | text[(at - j) % n]
    return value


def _small(values: np.ndarray) -> np.ndarray:
    ranks = np.unique(values, return_inverse=True)[1]
    return ranks.astype(np.uint16) if len(values) <= 1 << 16 else ranks


def merged_intervals(texts: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges the transforms of ``texts`` (rings that hold ``END``) until rows are sorted by ``width`` bytes (at most 128).

    Returns the rows' places in the concatenated texts and their interval numbers: rows of
    one interval have their first ``width`` bytes in common.
    """
    offsets = np.cumsum([0, *map(len, texts)])
    orders = [suffix_order(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)).astype(np.uint16), list(map(len, texts)))
    interval = np.zeros(len(owner), np.int64)
    columns: dict[int, np.ndarray] = {}
    steps = [width % STEP] * (width % STEP > 0) + [STEP] * (width // STEP)
    for step in steps:
        if step not in columns:
            columns[step] = _small(np.concatenate([_before(t, step)[o] for t, o in zip(texts, orders)]))
        rows = np.argsort(owner, kind="stable")  # where each text's next row stands in the merged order
        symbol = np.empty_like(columns[step])
        symbol[rows] = columns[step]
        dealt = np.argsort(symbol, kind="stable")
        owner, symbol, interval = owner[dealt], symbol[dealt], interval[dealt]
        new = np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])])
        interval = np.cumsum(new) - 1
    rows = np.argsort(owner, kind="stable")
    place = np.empty(len(rows), np.int64)
    place[rows] = np.concatenate([o + a for o, a in zip(orders, offsets)])
    return place, interval


def later_strings(parts: list[bytes], uid: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(uid, start) of the strings in ``parts`` that an earlier one among them equals."""
    shards = max(1, min(MERGE_SHARDS, len(parts)))
    cuts = np.linspace(0, len(parts), shards + 1).astype(int)
    end = bytes([END])
    texts = [np.frombuffer(end.join([*parts[a:b], b""]), np.uint8) for a, b in zip(cuts[:-1], cuts[1:])]
    place, interval = merged_intervals(texts, width)
    length = np.array([len(p) for p in parts])
    first = np.cumsum(length + 1) - length - 1
    part = np.searchsorted(first, place, side="right") - 1
    offset = place - first[part]
    inside = offset + width <= length[part]  # other rows run over an end
    part, offset, interval = part[inside], offset[inside], interval[inside]
    who, when = uid[part], start[part] + offset
    order = np.lexsort((when, who, interval))
    who, when, interval = who[order], when[order], interval[order]
    head = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]])) if len(who) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(who)))
    later = (who != np.repeat(who[head], size)) | (when != np.repeat(when[head], size))
    return who[later], when[later]


def _neighbours(uid: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring starts as (uid, start, count)."""
    if not len(uid):
        return uid, start, start
    order = np.lexsort((start, uid))
    uid, start = uid[order], start[order]
    new = np.flatnonzero(np.concatenate([[True], (uid[1:] != uid[:-1]) | (start[1:] > start[:-1] + 1)]))
    last = np.append(new[1:], len(uid)) - 1
    return uid[new], start[new], start[last] - start[new] + 1


def _merge_bucket(bucket: Bucket, rolling: Rolling, width: int) -> tuple[np.ndarray, np.ndarray]:
    use = np.flatnonzero(bucket.first & np.isin(bucket.group, bucket.open_keys()))
    uids, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if not len(use):
        return uids[0], starts[0]
    strings = [bucket.data[o : o + c + width - 1] for o, c in zip(bucket.offset[use], bucket.count[use])]
    keep = np.flatnonzero(_with_repeats(rolling, strings, bucket.group[use], width))
    # whole minimizers, about MERGE_BYTES at a time
    size = np.cumsum([len(strings[i]) for i in keep])
    last = np.flatnonzero(np.diff(bucket.group[use[keep]], append=-1))
    ends = last[np.unique(size[last] // MERGE_BYTES, return_index=True)[1]] + 1 if len(last) else last
    for a, b in zip([0, *ends], [*ends, len(keep)]):
        mine = use[keep[a:b]]
        if len(mine):
            found = later_strings([strings[i] for i in keep[a:b]], bucket.uid[mine], bucket.start[mine], width)
            uids.append(found[0])
            starts.append(found[1])
    return np.concatenate(uids), np.concatenate(starts)


def _with_repeats(rolling: Rolling, strings: list[bytes], groups: np.ndarray, width: int) -> np.ndarray:
    """Which strings have a window that occurs again in their group; equal windows have equal hashes, so none is lost."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    length = np.array([len(s) for s in strings])
    part = np.repeat(np.arange(len(strings)), length - width + 1)
    first = np.cumsum(length) - length
    windows = length - width + 1
    at = np.arange(len(part)) - np.repeat(np.cumsum(windows) - windows, windows) + first[part]
    hashes = rolling.ranges(rolling.prefix(data), at, at + width) ^ mixed(groups + 1)[part]
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    keep = np.zeros(len(strings), bool)
    keep[part[order[np.append(same, False) | np.concatenate([[False], same])]]] = True
    return keep


def _dealt(docs: DataFrame, width: int, buckets: int, shards: int, open_=None, hot=None) -> DataFrame:
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        chunk = Chunk(width, buckets, shards, open_, hot)
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                chunk.add(uid, text.as_py())
                if chunk.size >= CHUNK_BYTES:
                    for row in chunk.rows(number):
                        yield _table([row], SENT)
                    number += 1
        for row in chunk.rows(number):
            yield _table([row], SENT)

    sent = by_bytes(docs.select("uid", "text")).mapInArrow(records, SENT_DDL)
    return by_bytes(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket"))


def repeated_strings(docs: DataFrame, width: int, buckets: int, shards: int) -> DataFrame:
    """(shard, n, uids, starts, counts) of all strings that start earlier elsewhere."""

    def passed_on(rows: list[dict]) -> list[tuple]:
        return [(r["shard"], r["n"], r["uids"], r["at"], r["counts"], None, None) for r in rows if r["shard"] >= 0]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_batches(batches, ["bucket"]):
            rows = table.to_pylist()
            out, rows = passed_on(rows), [r for r in rows if r["shard"] < 0]
            if rows:
                bucket = Bucket(rows, width)
                later = ~bucket.first
                out += [(*x, None, None) for x in by_shard(bucket.uid[later], bucket.start[later], bucket.count[later], shards)]
                open_ = bucket.open_records()
                groups, kinds = np.unique(bucket.group[open_], return_counts=True)
                heads = bucket.key[np.flatnonzero(np.diff(bucket.group, prepend=-1))].view(np.int64)
                ids = record_id(bucket.key[open_], bucket.whole[open_]).view(np.int64)
                out.append((-1, 0, None, None, None, ids.tolist(), heads[groups[kinds > HOT]].tolist()))
            yield _table(out, FOUND)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(SEED)
        for table in grouped_batches(batches, ["bucket"]):
            rows = table.to_pylist()
            out, rows = passed_on(rows), [r for r in rows if r["shard"] < 0]
            if rows:
                bucket = Bucket(rows, width)
                later = ~bucket.first
                out += [(*x, None, None) for x in by_shard(bucket.uid[later], bucket.start[later], bucket.count[later], shards)]
                out += [(*x, None, None) for x in by_shard(*_neighbours(*_merge_bucket(bucket, rolling, width)), shards)]
            yield _table(out, FOUND)

    first = stage(_dealt(docs, width, buckets, shards).mapInArrow(counted, FOUND_DDL), "records")
    open_keys = first.select(F.explode("open").alias("hash"))
    bits = bitmap_bits(8 * open_keys.count())
    open_, hot = bitmap(open_keys, bits), bitmap(first.select(F.explode("hot").alias("hash")), bits)
    second = _dealt(docs, width, buckets, shards, open_, hot).mapInArrow(merged, FOUND_DDL)
    return first.filter("shard >= 0").unionByName(second).select("shard", "n", "uids", "starts", "counts")


def remove_repeats(docs: DataFrame, width: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of each row of ``docs`` (doc_id, text).

    ``spans`` are the maximal removed runs of bytes (start, end), ``kept`` the other bytes. A
    byte of the UTF-8 text is removed if a string of ``width`` bytes (32 to 128) that covers
    it starts earlier too: in a smaller doc_id, or in the same document; such strings may
    overlap. Null and empty texts have no bytes. Null ids come before all others; rows that
    share an id are ordered by their text, and a later one is judged like a later document.
    Other columns are not carried; an empty table gives no rows.
    """
    if not SEED_BYTES + 8 <= width <= 128:
        raise ValueError("width is from 32 to 128 bytes")
    docs = with_uid(docs)
    size = text_size(docs)
    buckets = power_of_two(size / BUCKET_BYTES, 32)
    shards = max(32, size // SHARD_BYTES)
    found = repeated_strings(docs, width, buckets, shards)

    def cut(rows: pa.Table, removed: pa.Table) -> pa.Table:
        sets = [(np.zeros(0, np.int64),) * 3]
        for n, ids, at, counts in zip(*(removed[c].to_pylist() for c in ("n", "uids", "starts", "counts"))):
            uid = np.cumsum(from_planes(ids, n), dtype=np.uint64).view(np.int64)
            sets.append((uid, from_planes(at, n).astype(np.int64), from_planes(counts, n).astype(np.int64)))
        uid, start, count = (np.concatenate(c) for c in zip(*sets))
        order = np.argsort(uid, kind="stable")
        uid, start, count = uid[order], start[order], count[order]
        out: list[list] = [[], [], [], [], []]
        for me, doc_id, data in unshipped(rows):
            a, b = np.searchsorted(uid, [me, me + 1])
            spans, kept = [], data
            if b > a:
                gone = covered_by(start[a:b], count[a:b] + width - 1, len(data))
                spans = [{"start": s, "end": e} for s, e in zip(*(x.tolist() for x in runs(gone)))]
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            out[0].append(doc_id)
            out[1].append(len(data))
            out[2].append(len(data) - len(kept))
            out[3].append(spans)
            out[4].append(kept)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
        return pa.table([pa.array(c, t) for c, t in zip(out, types)], names=names)

    to_shard = found.select(F.col("shard").alias("to_shard"), "n", "uids", "starts", "counts")
    return shipped(docs, shards).groupBy("shard").cogroup(to_shard.groupBy("to_shard")).applyInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start long, end long>>, kept binary"
    )
