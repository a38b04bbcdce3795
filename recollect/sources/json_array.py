"""Records of JSON arrays of any size, found by many tasks.

A published dataset is one file with one JSON array. Spark's text reader cuts such a file
into byte ranges by itself if a line ends at ``}``. What a ``}`` means depends on all that
stands before it: whether a string is open, and how deep the brackets are. Both are running
sums over the pieces, with the byte ranges as slices: the number of quotes (without escaped
characters), then the change of depth, which a piece knows for either state of the string.
A record ends where the depth returns to that of the root array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import scan

END = "}"


def _depth(pieces: Column, parity: int) -> Column:
    """Opening less closing brackets in every other one of the pieces between quotes."""
    outside = F.array_join(F.filter(pieces, lambda _, i: i % 2 == parity), "")
    opened, closed = (F.length(F.regexp_replace(outside, pattern, "")) for pattern in (r"[^\[{]", r"[^\]}]"))
    return opened - closed


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, at, value, quotes, if_out, if_in) of the pieces of files between ``}``, in file order."""
    rows = spark.read.option("lineSep", END).text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    plain = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    return rows.withColumn("__plain", plain).select(
        "path", "block", "at", "value",
        (F.size("__plain") - 1).alias("quotes"),
        _depth(F.col("__plain"), 0).alias("if_out"),
        _depth(F.col("__plain"), 1).alias("if_in"),
    )


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, value): the objects of the root array of each file, as text.

    A root that is no array is an error. An empty array has no records. Values must be
    objects, as in every dataset here; what stands between them other than commas becomes
    part of the next record's text and fails there.
    """
    place = {"keys": ["path"], "order": [F.col("at")], "bucket": F.col("block")}
    rows = scan(fragments(spark, path), **place, sums={"quoted": F.col("quotes")}, previous={"before": F.lit(True)})
    was_out = (F.col("quoted") - F.col("quotes")) % 2 == 0
    is_out = F.col("quoted") % 2 == 0
    change = F.when(was_out, F.col("if_out")).otherwise(F.col("if_in")) - F.when(is_out, 1).otherwise(0)
    rows = rows.select("path", "block", "at", "value", "before", change.alias("change"), is_out.alias("is_out"))
    rows = scan(rows, **place, sums={"depth": F.col("change")}, following={"after": F.lit(True)})
    # A file's last piece has no } of its own.
    ends = F.col("is_out") & (F.col("depth") == 1) & F.col("after")
    rows = rows.withColumn("ends", F.coalesce(ends, F.lit(False)).cast("int"))
    rows = scan(rows, **place, sums={"ended": F.col("ends")})
    bare = F.regexp_replace("value", r"^\s+", "")
    refused = F.raise_error(F.lit("the dataset root must be a JSON array")).cast("string")
    opened = F.when(F.startswith(bare, F.lit("[")), F.substring(bare, 2, 2**31 - 1)).otherwise(refused)
    text = F.when(F.col("before").isNull(), opened).otherwise(F.col("value"))
    whole = F.concat(text, F.when(F.col("after"), F.lit(END)).otherwise(F.lit("")))
    pieces = F.sort_array(F.collect_list(F.struct("at", whole.alias("text"))))
    records = rows.groupBy("path", (F.col("ended") - F.col("ends")).alias("position")).agg(
        pieces.alias("pieces"), F.max("ends").alias("ends")
    )
    # What follows the last record closes the array; a root without records is read as well.
    value = F.regexp_replace(F.array_join(F.col("pieces.text"), ""), r"^[\s,]+", "")
    # An explode and no filter, as filters of the caller could be evaluated before it.
    found = F.when((F.col("ends") == 1) | (F.length("value") < 0), F.array("value")).otherwise(F.array().cast("array<string>"))
    return records.select("path", "position", value.alias("value"), "ends").select("path", "position", F.explode(found).alias("value"))
