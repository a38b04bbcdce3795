"""URL verdicts from host and path rules, by cascades of Bloom filters.

Each list of rule keys (``host`` + path prefix) has a cascade. Level 1 encodes the listed
keys, level 2 those keys of the corpus that pass level 1 without being listed, level 3 the
listed keys that pass level 2, and so on until a level passes nothing wrongly. As every key
that the corpus can ask is in the universe the levels were built on, walking the levels
answers membership exactly, without a join.

Size: level 1 takes about ``1.44 * log2(universe / listed)`` bits per listed key and the
others together a few bits more (the false positives of level 1 are kept below the number
of listed keys). So the literal in the plan is bounded by the list alone; its size is
checked, and a list beyond ``max_filter_bytes`` is answered by an equi-join instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KINDS = ("allow", "block")
MASK = 0x7FFFFFFF


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def candidate_keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """All keys that could fit: host suffixes of so many labels, path prefixes of such lengths."""
    keys = [
        F.when(F.length(path) >= n, F.concat(F.substring_index(host, ".", -k), F.substring(path, 1, n)))
        for k in labels
        for n in lengths
    ]
    return F.array_distinct(F.array_compact(F.array(*keys))) if keys else F.array().cast("array<string>")


class Level:
    """One Bloom filter as a literal array of 64-bit words."""

    def __init__(self, seed: int, bits: int, hashes: int) -> None:
        self.seed, self.bits, self.hashes = seed, bits, hashes
        self.words: Column | None = None

    def positions(self, key: Column) -> list[Column]:
        a = F.xxhash64(key, F.lit(2 * self.seed)).bitwiseAND(F.lit(MASK))
        b = F.xxhash64(key, F.lit(2 * self.seed + 1)).bitwiseAND(F.lit(MASK))
        return [(a + i * b) % self.bits for i in range(self.hashes)]

    def encode(self, keys: DataFrame) -> None:
        """Sets the bits of ``keys.key``; at most ``bits / 64`` words come to the driver."""
        at = F.explode(F.array(*self.positions(F.col("key")))).alias("at")
        bit = F.expr("shiftleft(1L, cast(at % 64 as int))")
        rows = keys.select(at).groupBy((F.expr("at div 64")).alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
        words = [0] * (self.bits // 64 + 1)
        for r in rows:
            words[r["word"]] = r["bits"]
        self.words = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")

    def passes(self, key: Column) -> Column:
        test = None
        for at in self.positions(key):
            word = F.get(self.words, F.call_function("shiftright", at, F.lit(6)).cast("int"))
            hit = F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
            test = hit if test is None else test & hit
        return test


def _level(seed: int, n: int, rate: float) -> Level:
    rate = min(max(rate, 1e-15), 0.5)
    bits = max(64, math.ceil(1.44 * n * math.log2(1 / rate)))
    return Level(seed, bits, max(1, round(math.log2(1 / rate))))


class Cascade:
    """Exact membership of ``listed`` among the keys of ``universe``."""

    def __init__(self, listed: DataFrame, universe: DataFrame, listed_count: int, universe_count: int, seed: int) -> None:
        self.levels: list[Level] = []
        if not listed_count:
            return
        inside, n = listed.select("key"), listed_count
        rate = math.sqrt(0.5) * n / max(universe_count, n)
        outside = None
        while n:
            level = _level(seed + len(self.levels), n, rate)
            encoded_listed = len(self.levels) % 2 == 0
            level.encode(inside if encoded_listed else outside)
            self.levels.append(level)
            passing = level.passes(F.col("key"))
            if outside is None:
                outside = universe.filter(passing).distinct().join(listed.select("key"), "key", "left_anti")
                outside = wrong = stage(outside, "cascade")
            elif encoded_listed:
                outside = wrong = stage(outside.filter(passing), "cascade")
            else:
                inside = wrong = stage(inside.filter(passing), "cascade")
            n, rate = wrong.count(), 0.5

    def holds(self, key: Column) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            answer = F.when(self.levels[i].passes(key), answer).otherwise(F.lit(i % 2 == 1))
        return answer


def _bits_needed(listed: int, universe: int) -> float:
    return listed * (1.44 * math.log2(max(2.0, 1.42 * max(universe, 1) / max(listed, 1))) + 5) if listed else 0


def judge(
    pages: DataFrame,
    rules: DataFrame,
    default: str = "allow",
    url: str = "url",
    max_filter_bytes: int = 8 << 20,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block). A rule fits its host
    and all subdomains where the url's path starts with the rule's; the longest (host and
    path together, then the longer host) wins, else ``rule`` is null and ``verdict`` is
    ``default``. A null url or one without ``://`` has an empty host and path. Rows are
    never lost or merged, whatever their ids. A rule with nulls, or whose path is neither
    empty nor begins with ``/``, fits nothing; of rules with equal host and path and both
    verdicts, block counts. Columns of ``pages`` with the names added here are replaced.
    """
    host, path = F.col("host"), F.col("path")
    known = (
        rules.filter("host is not null and path is not null and verdict in ('allow', 'block')")
        .filter((path == "") | path.startswith("/"))
        .groupBy(F.translate(host, UPPER, LOWER).alias("host"), "path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("key", F.concat(host, path))
    )
    known = stage(known, "rules")
    shape = known.agg(
        F.sort_array(F.collect_set(F.size(F.split("host", r"\.", -1)))).alias("labels"),
        F.sort_array(F.collect_set(F.length("path"))).alias("lengths"),
        F.count_if(F.col("verdict") == "allow").alias("allow"),
        F.count_if(F.col("verdict") == "block").alias("block"),
    ).first()
    parted = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    keys = candidate_keys(host, path, shape["labels"], shape["lengths"])
    universe = parted.select(F.explode(keys).alias("key"))
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    if sum(_bits_needed(shape[k], size) for k in KINDS) > 8 * max_filter_bytes:
        return _judge_by_join(parted, known, keys, default)
    lists = {
        kind: Cascade(known.filter(F.col("verdict") == kind), universe, shape[kind], size, 100 * i)
        for i, kind in enumerate(KINDS)
    }
    kind = lambda k: F.when(lists["block"].holds(k), F.lit("block")).when(lists["allow"].holds(k), F.lit("allow"))
    fitting = F.filter(F.transform(keys, lambda k: _ranked(k, kind(k))), lambda x: x["verdict"].isNotNull())
    return _with_best(parted, F.array_max(fitting), default)


def _ranked(key: Column, verdict: Column) -> Column:
    """A struct whose largest value is the longest rule, then the one with the longer host."""
    host = F.length(F.substring_index(key, "/", 1))
    return F.struct(F.length(key).alias("n"), host.alias("h"), key.alias("key"), verdict.alias("verdict"))


def _with_best(parted: DataFrame, best: Column, default: str) -> DataFrame:
    return (
        parted.withColumn("best", best)
        .withColumns({"rule": F.col("best.key"), "verdict": F.coalesce(F.col("best.verdict"), F.lit(default))})
        .drop("best")
    )


def _judge_by_join(parted: DataFrame, known: DataFrame, keys: Column, default: str) -> DataFrame:
    """The way for lists too long to send to every task."""
    distinct = parted.select("host", "path").distinct()
    fits = (
        distinct.select("host", "path", F.explode(keys).alias("key"))
        .join(known.select("key", "verdict"), "key")
        .groupBy("host", "path")
        .agg(F.max(_ranked(F.col("key"), F.col("verdict"))).alias("best"))
    )
    joined = parted.join(fits, ["host", "path"], "left")
    return _with_best(joined, F.col("best"), default).select(*parted.columns, "rule", "verdict")


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")
