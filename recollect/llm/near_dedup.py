"""Near-duplicate classes by HyperMinHash.

A document's distinct five-word shingles are hashed into ``REGISTERS`` buckets; a register
keeps the smallest hash of its bucket as leading-zero count plus mantissa bits. Bands of
registers give the buckets in which documents meet (within a size class, as documents that
differ much in size can't be alike). Into a bucket goes one bit of each register, by which
most pairs of unlike documents part; what passes is filtered by a bound and by the
collision-corrected estimate of the similarity, and verified on its full shingle sets.
Short documents fill few bands, so they meet by the shingles of least hash instead, as many
as an alike one must share one of; no pair of two short documents is missed.

No bucket is read whole by a task and no bucket sends out all of its pairs:

* copies with equal sets are one document from the start (a digest of the set);
* large buckets are cut into blocks, and a task compares a pair of blocks;
* the first round takes a part of the buckets, each block by itself, and sends only each
  document's best partner; these pairs are verified and form components;
* the second round takes all buckets that hold several components, and there pairs across
  components. A component sends its best partner of a block, at most two rows for each document
  of a bucket, whatever its size; again pairs are verified and components grow;
* the third round takes only buckets of which the second kept a pair back, where they still hold
  several components, and sends all pairs across components that pass by their registers.
  So a link is left out only where its documents are connected anyway.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    WordRolling, bitmap, bitmap_bits, by_bytes, grouped_batches, mixed, packed, set_in, shingle_hashes, stage, text_bytes,
    unique_ids, with_uid,
)
from .components import components

REGISTERS = 256
BANDS, ROWS = 32, 5  # a pair of large sets at 0.85 shares no band once in 10**8 pairs, at 0.8 once in 3 * 10**5
SHORT = 48  # shingles up to which sets meet by single ones
BLOCK = 1024  # documents of a bucket that a task compares with as many others
NEAR = 16  # groups up to this size are compared all at once
LEAD = 4  # one of so many buckets is in the first round
CLASS_RATIO = 2.0
DEVIATIONS = 5.5  # of the estimate, below the threshold, at which a pair is let go
SEED = 7


def registers(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Wide (6 + 10 bits, for bands) and narrow (4 + 4 bits, for estimates) registers; 0 is empty.

    ``hashes`` are sorted, so the first of each bucket is its smallest.
    """
    bucket = (hashes >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    value = (hashes[first] & np.uint64((1 << 56) - 1)) >> np.uint64(3)
    zeros = 53 - np.frexp(value.astype(np.float64))[1].astype(np.int64)
    mantissa = ((value << (zeros + 1).astype(np.uint64)) & np.uint64((1 << 53) - 1)) >> np.uint64(43)
    wide, narrow = np.zeros(REGISTERS, np.uint16), np.zeros(REGISTERS, np.uint8)
    wide[bucket[first]] = zeros * 1024 + mantissa.astype(np.int64) + 1
    narrow[bucket[first]] = np.minimum(zeros, 14) * 16 + (mantissa >> np.uint64(6)).astype(np.int64) + 1
    return wide, narrow


# Two unequal minima of equally filled buckets agree in a narrow register with the chance
# that their zero counts agree (1/3) times that of four mantissa bits.
COLLISION = 1 / 3 / 16


def size_class(n: np.ndarray | int) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / math.log(CLASS_RATIO) + 1e-9).astype(np.int64)


def one_bits(narrow: np.ndarray) -> bytes:
    """The last mantissa bit of each narrow register, 0 where it is empty; unequal registers differ in it by half."""
    return packed(np.packbits((narrow != 0) & (narrow - np.uint8(1) & np.uint8(1) != 0)))


def band_keys(wide: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """Keys of (size class, band, its registers) for bands that aren't empty."""
    bands = wide[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    full = np.flatnonzero(bands.any(1))
    key = full.astype(np.uint64) + np.uint64(1)
    for column in bands[full].T:
        key = mixed(key * np.uint64(65537) + column)
    size = int(size_class(n))
    classes = [size, size - 1] if size and threshold * n < CLASS_RATIO**size + 1 else [size]
    return np.concatenate([mixed(key ^ mixed(np.full(1, c + 1, np.uint64))) for c in classes])


def prefix_keys(hashes: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the least of a short set's sorted ``hashes``: of two alike sets, both hold their least common one."""
    n = len(hashes)
    return mixed(~hashes[: n + 1 - -(-percent * n // 100)]) if 0 < n <= SHORT else np.zeros(0, np.uint64)


def signatures(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, n, digest, registers, bits, keys) of each row; ``n`` is 0 for a text without words.

    Short sets have band keys only if a set that isn't short can be alike.
    """
    percent = round(threshold * 100)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = WordRolling(SEED)
        for batch in batches:
            sizes, digests, narrows, bits, keys = [], [], [], [], []
            for text in batch.column(1):
                hashes = shingle_hashes(rolling, text_bytes(text.as_py()).lower().split())
                wide, narrow = registers(hashes)
                sizes.append(len(hashes))
                digests.append(hashlib.blake2b(packed(hashes), digest_size=16).digest())
                narrows.append(packed(narrow))
                bits.append(one_bits(narrow))
                key = band_keys(wide, len(hashes), threshold)
                if 100 * len(hashes) < percent * (SHORT + 1):
                    key = key[:0]
                keys.append(np.concatenate([key, prefix_keys(hashes, percent)]).view(np.int64))
            offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(narrows, pa.binary()),
                 pa.array(bits, pa.binary()), flat],
                ["doc_id", "n", "digest", "registers", "bits", "keys"],
            )

    rows = by_bytes(docs.select(F.col("doc_id").cast("long"), "text"))
    return rows.mapInArrow(sign, "doc_id long, n long, digest binary, registers binary, bits binary, keys array<long>")


class Judge:
    """Which pairs of bits and of register rows may reach the threshold, and their estimate."""

    def __init__(self, threshold: float) -> None:
        self.t = threshold

    def sizes_fit(self, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        return np.minimum(na, nb) >= self.t * np.maximum(na, nb) - 1e-9

    def most_bits(self, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """The most bits in which alike sets differ: each is at least one shingle that is in one set alone.

        Of large sets fewer do: about as many as a Poisson variable of this mean, which is
        above this limit less than once in 10**9 pairs.
        """
        apart = (na + nb) * (1 - self.t) / (1 + self.t) + 1e-9
        mean = REGISTERS * -np.expm1(-(na + nb) / (1 + self.t) / REGISTERS) * (1 - self.t) / 2
        return np.minimum(apart, mean + 6 * np.sqrt(mean) + 6)

    def estimate(self, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """For broadcastable rows: the corrected estimate, or -1 where the pair can't be alike."""
        same = (a == b) & (a != 0)
        filled = ((a != 0) | (b != 0)).sum(-1)
        agree = same.sum(-1)
        # each register that differs is at least one shingle that is in one set alone
        possible = (filled - agree) <= (na + nb) * (1 - self.t) / (1 + self.t) + 1e-9
        possible &= self.sizes_fit(na, nb)
        share = (agree / np.maximum(filled, 1) - COLLISION) / (1 - COLLISION)
        low = self.t - DEVIATIONS * np.sqrt(self.t * (1 - self.t) / np.maximum(filled, 1))
        fine = (share >= low) | (np.maximum(na, nb) <= SHORT)
        return np.where(possible & fine, np.maximum(share, 0.0), -1.0)


def _pairs_in(table: pa.Table, judge: Judge) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, the first below the second, and differing bits of the passing pairs of whole groups sorted by key and block pair.

    The last array is the group of each row.
    """
    key, bi, bj = (np.asarray(table[c]) for c in ("key", "bi", "bj"))
    block, comp, n = (np.asarray(table[c]) for c in ("block", "comp", "n"))
    bits = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint64).reshape(len(key), -1)
    start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])]))
    end = np.append(start[1:], len(key))
    group = np.repeat(np.arange(len(start)), end - start)
    small = (end - start <= NEAR)[group]
    left, right, apart = [], [], []

    def tried(i: np.ndarray, j: np.ndarray) -> None:
        # a pair of one block is compared where that block meets itself
        use = (comp[i] != comp[j]) & ((block[i] != block[j]) | (bi[i] == bj[i])) & judge.sizes_fit(n[i], n[j])
        i, j = i[use], j[use]
        differ = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
        fine = differ <= judge.most_bits(n[i], n[j])
        left.append(i[fine])
        right.append(j[fine])
        apart.append(differ[fine])

    for step in range(1, NEAR):
        i = np.flatnonzero(small[:-step] & (group[:-step] == group[step:])) if len(group) > step else np.zeros(0, np.int64)
        if not len(i):
            break
        tried(i, i + step)
    for s, e in zip(start, end):
        if e - s > NEAR:
            for i in range(s, e - 1):
                tried(np.full(e - i - 1, i), np.arange(i + 1, e))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right]), np.concatenate([none, *apart]), group


def _best(table: pa.Table, i: np.ndarray, j: np.ndarray, differ: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which pairs are the best of a component, by bits, in their group.

    A document is tried as the component's end in its own block and against one other, dealt
    by its id, so the pairs of a bucket are at most twice its documents.
    """
    doc, comp, block, blocks = (np.asarray(table[c]) for c in ("doc_id", "comp", "block", "blocks"))
    who, whom, value = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([differ, differ])
    step = 1 + (mixed(doc.astype(np.int64).view(np.uint64)) % np.maximum(blocks - 1, 1).astype(np.uint64)).astype(np.int64)
    may = np.flatnonzero((block[who] == block[whom]) | ((block[who] + step[who]) % blocks[who] == block[whom]))
    who, whom, value = who[may], whom[may], value[may]
    order = np.lexsort((doc[who], doc[whom], value, comp[who], group[who]))
    mine, where = comp[who[order]], group[who[order]]
    first = np.ones(len(order), bool)
    first[1:] = (mine[1:] != mine[:-1]) | (where[1:] != where[:-1])
    named = np.zeros(len(i), bool)
    named[may[order[first]] % len(i)] = True
    return named


def _confirmed(table: pa.Table, judge: Judge, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows that pass by their registers and whose least common key is that of their group."""
    key, n = np.asarray(table["key"]), np.asarray(table["n"])
    regs = np.frombuffer(b"".join(table["registers"].to_pylist()), np.uint8).reshape(-1, REGISTERS)
    lists = table["keys"].combine_chunks()
    sizes = np.diff(np.asarray(lists.offsets))
    keys, held = np.zeros((len(key), max(sizes)), np.int64), np.arange(max(sizes)) < sizes[:, None]
    keys[held] = np.asarray(lists.flatten())
    left, right = [], []
    for at in range(0, len(i), 1 << 14):
        x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
        passed = judge.estimate(regs[x], n[x], regs[y], n[y]) >= 0
        x, y = x[passed], y[passed]
        mine, common = keys[x], np.zeros((len(x), keys.shape[1]), bool)
        for column in range(keys.shape[1]):
            common |= (mine == keys[y, column, None]) & held[y, column, None]
        least = np.where(common & held[x], mine, np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max) == key[x]
        left.append(x[least])
        right.append(y[least])
    return np.concatenate(left), np.concatenate(right)


def _compared(rows: DataFrame, threshold: float, best_only: bool) -> DataFrame:
    """``candidate_pairs`` of rows that have been dealt to pairs of blocks, ``bi`` and ``bj``."""
    judge = Judge(threshold)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_batches(batches, ["key", "bi", "bj"]):
            table = table.combine_chunks()
            i, j, differ, group = _pairs_in(table, judge)
            doc, back = np.asarray(table["doc_id"]), np.zeros(0, np.int64)
            if best_only and len(i):
                named = _best(table, i, j, differ, group)
                back = np.unique(np.asarray(table["key"])[i[~named]])
                i, j = i[named], j[named]
            elif len(i):
                i, j = _confirmed(table, judge, i, j)
            a, b = np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])
            pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0)
            here = np.arange(len(pairs) + len(back)) < len(pairs)
            ends = [pa.array(np.concatenate([pairs[:, c], back]), mask=~here) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*ends, pa.array(np.concatenate([pairs[:, 0], back]), mask=here)], ["a", "b", "key"]
            )

    sorted_rows = by_bytes(rows.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "block"))
    return sorted_rows.mapInArrow(compare, "a long, b long, key long")


def leading_pairs(met: DataFrame, threshold: float) -> DataFrame:
    """``candidate_pairs`` with ``best_only`` inside the blocks of each bucket, to which it deals documents anew."""
    block = F.expr("pmod(xxhash64(doc_id, key), blocks)").cast("long")
    rows = met.select("key", block.alias("bi"), block.alias("bj"), block.alias("block"), "blocks", "doc_id", "comp", "n", "bits")
    return _compared(rows, threshold, True)


def candidate_pairs(met: DataFrame, threshold: float, best_only: bool) -> DataFrame:
    """(a, b, key) of ``met`` (key, blocks, doc_id, comp, n, bits): pairs a < b that may be alike, without a key.

    With ``best_only`` each component names only its best partner by bits in each pair of blocks;
    a bucket that keeps pairs back comes as its key alone, and rows may repeat. Else rows have
    ``registers`` and ``keys`` too: a pair must pass by its registers and comes from the least
    of its common keys only.
    """
    more = [] if best_only else ["registers", "keys"]
    block = F.expr("pmod(xxhash64(doc_id), blocks)")
    rows = met.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    rows = rows.select(
        "key", F.least("block", "other").cast("long").alias("bi"), F.greatest("block", "other").cast("long").alias("bj"),
        F.col("block").cast("long").alias("block"), "blocks", "doc_id", "comp", "n", "bits", *more,
    )
    return _compared(rows, threshold, best_only)


def ids_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def bitmap_of(ids: DataFrame) -> np.ndarray:
    """A bounded bitmap of ``ids`` (id), which picks at least their rows in a scan."""
    hashed = ids.select(F.xxhash64("id").alias("hash"))
    return bitmap(hashed, bitmap_bits(64 * hashed.count()))


def estimated(pairs: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose registers in ``signed`` let them reach the threshold."""
    judge, wanted = Judge(threshold), bitmap_of(ids_of(pairs))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use = set_in(wanted, np.asarray(batch.column(0)).astype(np.int64).view(np.uint64))
            yield batch.select([1, 2, 3]).filter(pa.array(use))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (np.asarray(batch.column(c)) for c in ("n_a", "n_b"))
            of = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS)
            use = judge.estimate(of("registers_a"), na, of("registers_b"), nb) >= 0
            yield batch.select(["a", "b"]).filter(pa.array(use))

    rows = signed.select(F.xxhash64("doc_id").alias("hash"), "doc_id", "n", "registers")
    some = by_bytes(rows).mapInArrow(picked, "doc_id long, n long, registers binary")
    of = lambda side: some.select(*[F.col(c).alias(f"{c}_{side}" if c != "doc_id" else side) for c in some.columns])
    return by_bytes(pairs.join(of("a"), "a").join(of("b"), "b")).mapInArrow(judged, "a long, b long")


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, shingles) of at least the documents in ``ids`` (id); the ids of ``docs`` are unique and not null."""
    wanted = bitmap_of(ids)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = WordRolling(SEED)
        for batch in batches:
            use = np.flatnonzero(set_in(wanted, np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)))
            found = [shingle_hashes(rolling, text_bytes(batch.column(2)[int(i)].as_py()).lower().split()) for i in use]
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(use)), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "shingles"]
            )

    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("hash"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return by_bytes(rows).mapInArrow(sets, "doc_id long, shingles array<long>")


def verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs with ``100 * intersection >= percent * union`` of their full shingle sets."""
    sets = stage(shingle_sets(docs, ids_of(pairs)), "shingles")
    of = lambda side: sets.select(F.col("doc_id").alias(side), F.col("shingles").alias(f"set_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    counted = both.select("a", "b", (F.size("set_a") + F.size("set_b")).alias("total"), shared.alias("shared"))
    return counted.filter(f"100L * shared >= {percent}L * (total - shared)").select("a", "b")


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, component) of those ``found`` and of more links."""
    if links.isEmpty():
        return found
    return stage(components(found.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(links)), "components")


def classes_of(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, component) of each row of ``docs`` (doc_id, text), whose ids are unique and not null."""
    threshold = percent / 100
    signed = stage(signatures(docs, threshold), "signatures")
    sets = signed.select("doc_id", "n", "digest")
    classes = stage(sets.filter("n > 0").groupBy("n", "digest").agg(F.min("doc_id").alias("rep")), "classes")
    copies = sets.join(classes, ["n", "digest"]).filter("doc_id <> rep").select("doc_id")
    bands = signed.select("doc_id", "keys").join(copies, "doc_id", "left_anti").select("doc_id", F.explode("keys").alias("key"))
    blocks = F.ceil(F.count("*") / BLOCK).alias("blocks")
    shared = bands.groupBy("key").agg(blocks, F.count("*").alias("size")).filter("size > 1")
    met = stage(bands.join(shared, "key"), "buckets")
    light = signed.select("doc_id", "n", "bits")

    def placed(rows: DataFrame, found: DataFrame) -> DataFrame:
        """``rows`` with the component of their document."""
        named = rows.join(found.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
        return named.withColumn("comp", F.coalesce("component", "doc_id")).drop("component")

    def confirmed(pairs: DataFrame) -> DataFrame:
        return stage(verified(stage(estimated(pairs, signed, threshold), "estimated"), docs, percent), "verified")

    leading = met.filter(f"pmod(key, {LEAD}) = 0").join(light, "doc_id").withColumn("comp", F.col("doc_id"))
    led = stage(leading_pairs(leading, threshold).filter("key is null").select("a", "b").distinct(), "pairs")
    found = stage(components(confirmed(led)), "components")

    ends = [F.min("comp").alias("low"), F.max("comp").alias("high")]
    joint = placed(met.filter(f"size > {NEAR}"), found).groupBy("key").agg(*ends).filter("low = high").select("key")
    apart = met.drop("size").join(stage(joint, "joint"), "key", "left_anti").join(placed(light, found), "doc_id")
    looked = stage(candidate_pairs(apart, threshold, True), "looked")
    tried = stage(looked.filter("key is null").select("a", "b").distinct().join(led, ["a", "b"], "left_anti"), "pairs")
    found = joined(found, confirmed(tried))

    back = stage(looked.filter("key is not null").select("key").distinct(), "back")
    named = stage(placed(met.select("key", "doc_id").join(back, "key", "left_semi"), found), "named")
    open_keys = stage(named.groupBy("key").agg(*ends, blocks).filter("low < high").select("key", "blocks"), "open")
    across = named.join(open_keys, "key").join(signed.drop("digest"), "doc_id")
    more = candidate_pairs(across, threshold, False).select("a", "b").distinct()
    more = more.join(led.unionByName(tried), ["a", "b"], "left_anti")
    found = joined(found, stage(verified(stage(more, "pairs"), docs, percent), "verified"))

    ends = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left")
    ends = ends.select("n", "digest", F.coalesce("component", "rep").alias("component"))
    result = sets.join(ends, ["n", "digest"], "left")
    return result.select("doc_id", "n", F.coalesce("component", "doc_id").alias("component"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text).

    Documents whose sets of five-word shingles (A-Z lower-cased; a shorter text is one
    shingle) have at least ``percent`` of their union in common are linked, and
    ``component_id`` is the smallest id that links reach. Texts that are null or have no
    words have an empty set and are alone. Rows with a null id are alone too, with a null
    ``component_id``, and kept. Rows that share an id are documents of their own, each with
    the links of its text. Other columns are not carried; an empty table gives no rows.
    """
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id", F.expr("coalesce(doc_id = component_id, true)").alias("kept")]
    if unique_ids(docs):
        return classes_of(docs, percent).withColumnRenamed("component", "component_id").select(*columns)
    rows = with_uid(docs)
    named, ids = rows.filter("doc_id is not null"), rows.select("uid", "doc_id")
    found = (
        classes_of(named.select(F.col("uid").alias("doc_id"), "text"), percent)
        .withColumnRenamed("doc_id", "uid")
        .join(ids, "uid")
        .join(ids.select(F.col("uid").alias("component"), F.col("doc_id").alias("component_id")), "component")
    )
    alone = signatures(rows.filter("doc_id is null"), percent / 100).withColumn("component_id", F.col("doc_id"))
    return found.select(*columns).unionByName(alone.select(*columns))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each class: the first by id, then by text and by the whole row.

    Rows without an id stay. Rows that share an id are documents of their own, of which equal
    ones are one class, so what stays does not depend on the run.
    """
    if unique_ids(docs):
        gone = near_duplicates(docs, percent).filter("not kept").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("__row"))
    rows = with_uid(whole, "__row")
    classes = classes_of(rows.filter("doc_id is not null").select(F.col("uid").alias("doc_id"), "text"), percent)
    gone = classes.filter("doc_id <> component").select(F.col("doc_id").alias("uid"))
    return rows.join(gone, "uid", "left_anti").select("__row.*")
