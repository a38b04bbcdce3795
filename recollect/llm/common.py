"""Shared pieces: words, rolling hashes over bytes, staged tables.

Words are runs of bytes other than space and 0x09-0x0D. ``bytes.split()`` cuts exactly
there, and ``bytes.lower()`` changes A-Z alone, so texts are handled as UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path

SPACE = 32
LONG_WORD = 64  # bytes; words above are hashed one by one
BATCH_BYTES = 8 << 20
MIN_BITS, MAX_BITS = 1 << 20, 1 << 27  # of a bitmap sent to all tasks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder (in a folder per value of ``by``) and read back; lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_bytes(df: DataFrame) -> DataFrame:
    """``df``, whose Arrow batches to Python hold so many bytes at most (or one row)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def text_bytes(value: str | None) -> bytes:
    return (value or "").encode("utf-8", "surrogatepass")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Polynomial (Rabin-Karp) hashes of short byte ranges, modulo 2**64.

    Every byte value stands for a random odd coefficient. Ranges must be shorter than 1,024
    bytes: some strings of that length (the Thue-Morse sequence over two byte values and its
    complement) agree whatever the coefficients, and of 128 bytes such strings keep some 28 bits.
    """

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.coefficients = rng.integers(1 << 62, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1 << 60, 1 << 62)) * 8 + 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self._powers = self._inverses = np.ones(1, np.uint64)

    @staticmethod
    def _grown(have: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(have) < n:
            step = np.uint64(pow(base, len(have), 1 << 64))
            have = np.concatenate([have, have * step])
        return have

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums of ``data`` (uint8), one longer than the data."""
        return self.sums(self.coefficients[data])

    def sums(self, values: np.ndarray) -> np.ndarray:
        self._powers = self._grown(self._powers, self.base, len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self._powers[: len(values)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of ``data[start:end]`` for each pair of positions."""
        self._inverses = self._grown(self._inverses, self.inverse, len(prefix))
        length = (end - start).astype(np.uint64)
        return mixed((prefix[end] - prefix[start]) * self._inverses[start] + length)


def word_bounds(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words joined by single spaces, with each word's start and end."""
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.append(np.flatnonzero(data == SPACE), len(data)) if words else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if words else ends
    return data, starts, ends


def word_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each word: eight bytes at a time, each scrambled with what came before."""
    import xxhash

    size = ends - starts
    h = mixed(size.astype(np.uint64) + mixed(np.full(1, seed + 1, np.uint64)))
    padded = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8)
    short = np.flatnonzero(size <= LONG_WORD)
    at = 0
    while len(short):
        left = size[short] - at
        block = padded[starts[short] + at].view("<u8").ravel()
        block = block & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64)))
        h[short] = mixed((h[short] ^ block) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(at + 1))
        at += 8
        short = short[left > 8]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return h


class WordRolling:
    """Rabin-Karp hashes of runs of words, modulo 2**64 over the words' 64-bit values.

    Words are scrambled before they enter the polynomial, so no choice of bytes cancels in it.
    Runs that differ by the order of words lose some bits: up to 14 of 64 for 16 words and
    five for five words.
    """

    def __init__(self, seed: int) -> None:
        self.rolling, self.seed = Rolling(seed), seed

    def prefix(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.rolling.sums(word_values(data, starts, ends, self.seed))

    def runs(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """The hash of each run of ``width`` words."""
        start = np.arange(max(len(prefix) - width, 0))
        return self.rolling.ranges(prefix, start, start + width)


def shingle_hashes(rolling: WordRolling, words: list[bytes], size: int = 5) -> np.ndarray:
    """Distinct hashes of all runs of ``size`` words, sorted; a shorter text is one run."""
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(rolling.runs(rolling.prefix(*word_bounds(words)), min(size, len(words))))


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def grouped_batches(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups, from batches sorted by ``keys`` (integers, no nulls).

    The last group of a batch waits for the next batch, so a group never breaks; what is
    held at once is one batch and one group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        changed = np.zeros(batch.num_rows, bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        if held:
            last = held[-1]
            changed[0] = any(c[0] != last.column(k)[last.num_rows - 1].as_py() for k, c in zip(keys, columns))
        cuts = np.flatnonzero(changed)
        if not len(cuts):
            held.append(batch)
            continue
        first, final = int(cuts[0]), int(cuts[-1])
        if held or first:
            yield pa.Table.from_batches([*held, batch.slice(0, first)] if first else held)
        if final > first:
            yield pa.Table.from_batches([batch.slice(first, final - first)])
        held = [batch.slice(final)]
    if held:
        yield pa.Table.from_batches(held)


def text_size(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts; it sizes partitions and never changes a result."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def bitmap_bits(wanted: int) -> int:
    """A power of two within the bounds; a smaller bitmap only passes more."""
    return min(MAX_BITS, max(MIN_BITS, 1 << int(wanted).bit_length()))


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """Packed bits at the top bits of the hashes; at most ``bits / 32`` words come to the driver, eight bytes each.

    They come as Arrow batches whatever the session's settings: as rows, each word would be a
    Python object of some hundred bytes, and a full bitmap has four million.
    """
    at = F.shiftrightunsigned("hash", 64 - (bits.bit_length() - 1))
    words = (
        hashes.select(at.alias("at"))
        .groupBy(F.expr("cast(at div 32 as int)").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1, cast(at % 32 as int))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(bits // 32, np.uint32)
    for batch in words.to_batches():
        out[np.asarray(batch.column("word"))] = np.asarray(batch.column("bits")).view(np.uint32)
    return out


def set_in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - (len(bits) * 32).bit_length() + 1)
    return (bits[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


def unique_ids(docs: DataFrame) -> bool:
    """Whether each row of ``docs`` has a ``doc_id`` of its own."""
    rows = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n"))
    return rows.filter("n > 1 or doc_id is null").isEmpty()


def with_uid(docs: DataFrame, *others: str) -> DataFrame:
    """(uid, doc_id, text, *others): ``uid`` is unique and ordered as (doc_id, text, *others), null ids first.

    It is the id itself where ids are unique and not null; else rows are sorted and numbered.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c) for c in others]
    )
    if unique_ids(docs):
        return rows.select(F.col("doc_id").alias("uid"), "doc_id", "text", *others)
    ordered = rows.orderBy(*[F.asc_nulls_first(c) for c in ("doc_id", "text", *others)])
    return stage(ordered.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text", *others), "numbered")


P1, P2 = 2147483647, 1000000007


def shard_of(uid: np.ndarray, shards: int) -> np.ndarray:
    """A scrambled ``uid`` modulo ``shards``."""
    return uid % P1 * 2654435 % P2 % shards


def planes(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, without the planes that are all zero; they compress well."""
    rows = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    used = int(np.flatnonzero(rows.any(0)).max(initial=-1)) + 1
    return rows[:, : max(used, 1)].T.tobytes()


def from_planes(data: bytes, n: int) -> np.ndarray:
    rows = np.zeros((n, 8), np.uint8)
    if n:
        part = np.frombuffer(data, np.uint8).reshape(-1, n)
        rows[:, : len(part)] = part.T
    return rows.view("<u8").ravel().astype(np.uint64)


def rising(values: np.ndarray) -> bytes:
    """Sorted unsigned integers by their differences."""
    values = values.astype(np.uint64)
    return planes(np.diff(values, prepend=np.uint64(0)))


def from_rising(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(from_planes(data, n), dtype=np.uint64)


def power_of_two(n: float, least: int) -> int:
    return max(least, 1 << max(0, int(n) - 1).bit_length())


SHIPPED = "shard long, uids array<long>, ids array<long>, lengths array<long>, body binary"


def shipped(docs: DataFrame, shards: int) -> DataFrame:
    """Texts of ``docs`` (uid, doc_id, text) on their way to their shards, compressed together by batch and shard."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            uids = np.asarray(batch.column(0)).astype(np.int64)
            shard = shard_of(uids, shards)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
            for a, b in zip(cuts[:-1], cuts[1:]):
                me = order[a:b]
                texts = [text_bytes(batch.column(2)[int(i)].as_py()) for i in me]
                columns = [
                    pa.array([int(shard[me[0]])], pa.int64()),
                    pa.array([uids[me]], pa.list_(pa.int64())),
                    pa.array([batch.column(1).take(pa.array(me)).to_pylist()], pa.list_(pa.int64())),
                    pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                    pa.array([compressor.compress(b"".join(texts))], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "uids", "ids", "lengths", "body"])

    return by_bytes(docs.select("uid", "doc_id", "text")).mapInArrow(pack, SHIPPED)


def unshipped(table: pa.Table) -> Iterator[tuple[int, int | None, bytes]]:
    """(uid, doc_id, text) of the rows of ``shipped``; a null text is empty."""
    import zstandard

    for uids, ids, lengths, body in zip(*(table[c] for c in ("uids", "ids", "lengths", "body"))):
        data, at = zstandard.ZstdDecompressor().decompress(body.as_py()), 0
        for uid, doc_id, n in zip(uids.as_py(), ids.as_py(), lengths.as_py()):
            yield uid, doc_id, data[at : at + n]
            at += n
