"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage


HOT = 100_000  # links of a node that one task may read
SALTS = 64  # parts in which a node's links are dealt where a node has more


def _ended(edges: DataFrame) -> DataFrame:
    """The links of each node, ``a``, with the node at their other end, ``b``."""
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _both_stars(edges: DataFrame) -> DataFrame:
    """The large and the small star in three shuffles; a task reads all links of a node."""
    low = F.least("a", F.min("b").over(Window.partitionBy("a")))
    large = _ended(edges).withColumn("low", low).filter("b > a").select(F.col("low").alias("a"), "b")
    small = large.withColumn("low", F.min("a").over(Window.partitionBy("b")))
    ends = small.select("low", F.explode(F.array("a", "b")).alias("b"))
    return ends.filter("b <> low").select(F.col("low").alias("a"), "b").distinct()


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Links each neighbour of a node (larger ones, or all smaller ones with the node) to its smallest.

    The links of a node are dealt by (node, salt of the neighbour), so that a node with very
    many is spread; only one row per part meets at the node.
    """
    both = _ended(edges)
    if not larger:
        both = both.filter("b < a")
    both = both.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    parts = both.groupBy("a", "salt").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    least = parts.select("a", "salt", F.min("low").over(Window.partitionBy("a")).alias("m"))
    linked = both.join(least, ["a", "salt"]).select("a", "b", "m")
    own = least.select("a", F.col("a").alias("b"), "m").distinct()
    out = linked.filter("b > a") if larger else linked.unionByName(own)
    return (
        out.filter("b <> m")
        .select(F.least("b", "m").alias("a"), F.greatest("b", "m").alias("b"))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every linked node: the smallest id reachable. ``edges`` has long a, b.

    Self links and nulls count for nothing; an empty table has no components. Links are
    rewritten in the shared folder each round until they no longer change.
    """
    links = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links, before = stage(links, "links"), None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not now[0] or now == before:
            return links.select(F.col("b").alias("id"), F.col("a").alias("component"))
        hot = now[0] > HOT and not _ended(links).groupBy("a").count().filter(F.col("count") > HOT).isEmpty()
        links, before = stage(_stars(_stars(links, True), False) if hot else _both_stars(links), "links"), now
