"""A Merkle manifest of a dataset with a proof for every row.

A row's leaf is a digest of its fields. Rows are ranked inside their group; the rank's
digits (base 8) are columns. A block holds ``8 ** DIGITS`` consecutive nodes of a group, so
its size is bounded: inside a block the digit columns are grouped away one after another,
each time nesting the child structs and hashing them. Block roots are the nodes of the next
round, until every group has one block; the roots of the groups form a last tree of their
own. On the way back each block meets the path of its root (union and grouping on the
block, one row each), and transform and explode hand the siblings down to the leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

WIDTH = 8
DIGITS = 3
BLOCK = WIDTH**DIGITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_PATH = "cast(array() as array<struct<left: string, right: string>>)"


def digest(parts: list[Column]) -> Column:
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return digest([framed(f) for f in fields])


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rank`` of each row inside ``grp`` by ``order``, and ``levels``, the height of the group's tree.

    Rows are sorted by range; only a count per range and group is summed over ranges.
    """
    by = [F.asc_nulls_first(c) for c in ("grp", *order)]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = stage(
        ordered.withColumn("at", F.monotonically_increasing_id()).withColumn("slice", F.shiftright("at", 33)), "ranked"
    )
    slices = placed.groupBy("grp", "slice").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    whole = Window.partitionBy("grp")
    total = F.sum("n").over(whole)
    earlier = F.coalesce(F.sum("n").over(whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    height = F.when(total == 1, 0).otherwise(F.length(F.conv((total - 1).cast("string"), 10, WIDTH)))
    # One row per slice and group (slices + groups rows at most); Spark sees its size as a table.
    starts = stage(slices.select("grp", "slice", (earlier - F.col("first")).alias("shift"), height.alias("levels")), "slices")
    found = placed.join(starts, ["grp", "slice"])
    return found.withColumn("rank", F.col("at") + F.col("shift")).drop("at", "slice", "shift")


def _rolled(nodes: DataFrame) -> DataFrame:
    """(grp, levels, block, hash, children): the nodes of each block nested by the digits of their rank."""
    digits = [F.expr(f"cast(rank div {WIDTH**k} % {WIDTH} as int)").alias(f"d{k}") for k in range(DIGITS)]
    block = F.expr(f"rank div {BLOCK}").alias("block")
    level = nodes.select("grp", "levels", block, *digits, "hash", "item").repartition("grp", "block")
    for k in range(DIGITS):
        inner = "item" if k == 0 else "children"
        keys = ["grp", "levels", "block", *(f"d{j}" for j in range(k + 1, DIGITS))]
        child = F.struct(F.col(f"d{k}").alias("digit"), "hash", inner)
        level = level.groupBy(*keys).agg(F.sort_array(F.collect_list(child)).alias("children"))
        joined = F.expr("sha2(array_join(children.hash, ''), 256)")
        # Above the root of a small group only a single node is passed on.
        level = level.withColumn("hash", F.when(F.col("levels") > k, joined).otherwise(F.col("children")[0]["hash"]))
    return level


def _unrolled(blocks: DataFrame) -> DataFrame:
    """(grp, item, path, subroot, root) of the nodes of blocks that know the path of their root."""
    level = blocks
    for k in reversed(range(DIGITS)):
        inner = "item" if k == 0 else "children"
        beside = (
            f"array(named_struct('left', array_join(slice(children.hash, 1, i), ''),"
            f" 'right', array_join(slice(children.hash, i + 2, {WIDTH}), '')))"
        )
        nodes = F.expr(
            f"transform(children, (c, i) -> named_struct('below', c.{inner}, 'beside', if(levels > {k}, {beside}, {NO_PATH})))"
        )
        level = level.select("grp", "levels", "path", "subroot", "root", F.explode(nodes).alias("node")).select(
            "grp", "levels", F.concat("node.beside", "path").alias("path"), "subroot", "root", F.col("node.below").alias(inner)
        )
    return level.drop("levels")


def _met(blocks: DataFrame, above: DataFrame, keys: list[str]) -> DataFrame:
    """Each block with the one row of ``above`` that has its keys, by grouping both together."""
    both = blocks.unionByName(above, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in rest])


def proofs(nodes: DataFrame, largest: int, crowned: bool) -> DataFrame:
    """(grp, item, path, subroot, root) for ``nodes`` (grp, levels, rank, hash, item).

    ``largest`` is the node count of the largest group, ``crowned`` asks for a tree over the
    roots of the groups (in the order of ``grp``); without it a group's root is the root.
    """
    blocks = stage(_rolled(nodes), "blocks")
    if largest > BLOCK:
        upper = blocks.select(
            "grp", F.greatest(F.col("levels") - DIGITS, F.lit(0)).alias("levels"), F.col("block").alias("rank"), "hash",
            F.col("block").alias("item"),
        )
        above = proofs(upper, -(-largest // BLOCK), crowned).withColumnRenamed("item", "block")
        return _unrolled(_met(blocks, above, ["grp", "block"]))
    tops = blocks.withColumn("subroot", F.col("hash"))
    if not crowned:
        return _unrolled(tops.withColumns({"path": F.expr(NO_PATH), "root": F.col("hash")}))
    roots = ranked(blocks.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "hash"), ["of"])
    roots = roots.withColumnRenamed("of", "item")
    crown = proofs(roots, blocks.count(), False).select(F.col("item").alias("grp"), "path", "root")
    return _unrolled(_met(tops, crown, ["grp"]))


def manifest(docs: DataFrame) -> DataFrame:
    """A leaf, the roots, a proof digest and a tampering check for each row of ``docs``.

    Needs the columns ``doc_id, source, lang, n_chars, text``; others are ignored, whatever
    their names. A null field counts as ``-``, an empty text as a text of no bytes, a null
    lang is a group of its own and the first. Rows of a group with equal ids (null ids come
    first) are ordered by their leaf, so repeated rows are interchangeable, each with its own
    place. A group of one row has the row's leaf as root. An empty table gives no rows.

    Where 3 divides the CRC of the id, ``folded_root`` starts from the row with A-Z of its
    text lower-cased (never for a null id); ``verified`` tells whether it meets ``root``.
    """
    fields = {f: F.col(f) for f in FIELDS}
    lowered = {**fields, "text": F.translate(F.col("text").cast("string"), UPPER, LOWER)}
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaves = docs.select(
        # "" stands for null and sorts first; other groups begin with a letter.
        F.coalesce(F.concat(F.lit("l"), F.col("lang").cast("string")), F.lit("")).alias("grp"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf(list(fields.values())).alias("hash"),
        F.when(tampered, leaf(list(lowered.values()))).alias("changed"),
    )
    nodes = ranked(leaves, ["doc_id", "hash"]).select(
        "grp", "levels", "rank", "hash", F.struct("doc_id", F.col("hash").alias("leaf"), "changed").alias("item")
    )
    largest = nodes.agg(F.max("rank")).first()[0]
    known = proofs(nodes, 0 if largest is None else largest + 1, True)
    return known.select(
        "item.doc_id",
        "item.leaf",
        "subroot",
        "root",
        F.expr("sha2(array_join(transform(path, p -> concat(p.left, p.right)), ''), 256)").alias("proof_sha256"),
        F.expr(
            "aggregate(path, coalesce(item.changed, item.leaf), (h, p) -> sha2(concat(p.left, h, p.right), 256))"
        ).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
