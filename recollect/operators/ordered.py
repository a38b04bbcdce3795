"""Order-dependent columns (rank, neighbours, running sums) that survive a hot key.

A plain window over ``keys`` puts a whole key into one task. Here every key is cut into
slices that keep its order. Windows run inside (keys, slice), and of each slice one small row
with all that later slices need (count, first and last values, sums) is combined once. The
row data is shuffled once, on (keys, slice); the join back reuses that partitioning.

Slices are ranges of (keys, order) between bounds of a sample, so a key that holds most rows
at one time is cut as well as any other; the order's last column can break ties of the
others. A caller that knows an even, order-preserving slice (a hash prefix, a position range)
gives it as ``bucket`` and saves the sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_B = "__bucket"
SAMPLE = 8192  # rows drawn for the bounds, whatever the size of the input
SLICE_ROWS = 250_000
MOST_SLICES = 1024


def sliced(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` with ``__bucket``, which rises with (keys, order) and holds about ``SLICE_ROWS`` rows, or a
    share of ``1 / MOST_SLICES``.

    The bounds are a subquery: one row for each of ``SAMPLE`` hash slots, summed up before the
    shuffle. They differ with the input, results do not depend on them.
    """
    parts = [F.col(k) for k in keys] + list(order)
    me = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(parts)])
    drawn = (
        df.select(me.alias("me"), F.xxhash64(*parts).alias("h"))
        .groupBy(F.pmod("h", F.lit(SAMPLE)).alias("slot"))
        .agg(F.min_by("me", F.xxhash64("h")).alias("me"), F.count(F.lit(1)).alias("n"))
        .agg(F.sort_array(F.collect_list("me")).alias("drawn"), F.sum("n").alias("n"))
    )
    wanted = f"least({MOST_SLICES}, n div {SLICE_ROWS} + 1)"
    step = f"greatest(1, cast(ceil(size(drawn) / {wanted}) as int))"
    bounds = drawn.select(F.expr(f"filter(drawn, (x, i) -> i > 0 and i % {step} = 0)"))
    placed = df.withColumns({"__bounds": bounds.scalar(), "__me": me})

    def halved(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        reached = F.get("__bounds", middle) <= F.col("__me")
        narrower = F.when(reached, F.struct((middle + 1).alias("low"), s["high"].alias("high"))).otherwise(
            F.struct(s["low"].alias("low"), middle.alias("high"))
        )
        return F.when(s["low"] < s["high"], narrower).otherwise(s)

    start = F.struct(F.lit(0).alias("low"), F.size("__bounds").alias("high"))
    rounds = F.sequence(F.lit(0), F.lit(SAMPLE.bit_length()))
    found = F.when(F.size("__bounds") == 0, 0).otherwise(F.aggregate(rounds, start, halved)["low"])
    return placed.withColumn(_B, found).drop("__bounds", "__me")


def _named(values: dict[str, Column] | None) -> Column:
    return F.struct(*[v.alias(n) for n, v in (values or {}).items()], F.lit(True).alias("__there"))


def scan(
    df: DataFrame, keys: list[str], order: list[Column], bucket: Column | None = None, *,
    position: str | None = None, total: str | None = None, sums: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None, following: dict[str, Column] | None = None,
) -> DataFrame:
    """Add columns that depend on the order of rows inside ``keys``, all with one shuffle of the rows.

    ``position`` is the 0-based rank, ``total`` the number of rows of the key; ``sums`` add up this and all earlier rows; ``previous``
    and ``following`` are values of the row before and after (null at the ends of a key).
    Rows that are equal in ``order`` come in any order, so give one that has no ties.
    A null key is an error.
    """
    sums = sums or {}
    rows = sliced(df, keys, order) if bucket is None else df.withColumn(_B, bucket)
    rows = rows.withColumns(
        {"__ord": F.struct(*order), "__prev": _named(previous), "__next": _named(following)}
        | {f"__s_{n}": v for n, v in sums.items()}
    )
    by = [*keys, _B]
    parts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"),
        F.max_by("__prev", "__ord").alias("__last"),
        F.min_by("__next", "__ord").alias("__first"),
        *[F.sum(f"__s_{n}").alias(f"__s_{n}") for n in sums],
    )
    among = Window.partitionBy(*keys).orderBy(_B)
    earlier = among.rowsBetween(Window.unboundedPreceding, -1)
    before = {f"__c_{n}": F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)) for n in sums}
    carried = parts.select(
        *by,
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__c_n"),
        F.sum("__n").over(Window.partitionBy(*keys)).alias("__c_all"),
        F.lag("__last").over(among).alias("__c_last"),
        F.lead("__first").over(among).alias("__c_first"),
        *[c.alias(n) for n, c in before.items()],
        F.lit(True).alias("__known"),
    )
    inside = Window.partitionBy(*by).orderBy("__ord")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns(
        {"__at": F.row_number().over(inside) - 1, "__lag": F.lag("__prev").over(inside), "__lead": F.lead("__next").over(inside)}
        | {f"__s_{n}": F.sum(f"__s_{n}").over(upto) for n in sums}
    )
    # A null key or bucket finds no partner. The left join keeps such a row, so that it is
    # reported and not lost.
    joined = local.join(carried, by, "left")
    lost = F.raise_error(F.lit("keys and buckets must not be null"))
    out = {} if position is None else {position: F.col("__c_n") + F.col("__at")}
    out |= {} if total is None else {total: F.col("__c_all")}
    out |= {n: F.col(f"__c_{n}") + F.col(f"__s_{n}") for n in sums}
    out |= {n: F.coalesce("__lag", "__c_last")[n] for n in previous or {}}
    out |= {n: F.coalesce("__lead", "__c_first")[n] for n in following or {}}
    kept = [c for c in df.columns if c not in out]
    return joined.select(*kept, *[F.when(F.col("__known"), c).otherwise(lost).alias(n) for n, c in out.items()])


def ordered_position(
    df: DataFrame, keys: list[str], order: list[Column], bucket: Column | None = None, out: str = "position"
) -> DataFrame:
    """Add the 0-based rank of each row inside ``keys`` by (``bucket``, ``order``)."""
    return scan(df, keys, order, bucket, position=out)


def running_sum(
    df: DataFrame, keys: list[str], order: list[Column], bucket: Column | None, value: Column, out: str
) -> DataFrame:
    """Add the sum of ``value`` over this and all earlier rows of ``keys``."""
    return scan(df, keys, order, bucket, sums={out: value})


def previous_row(
    df: DataFrame, keys: list[str], order: list[Column], bucket: Column | None, values: dict[str, Column]
) -> DataFrame:
    """Add ``values`` as they were on the previous row of ``keys`` (null on the first)."""
    return scan(df, keys, order, bucket, previous=values)


def stretches(
    df: DataFrame, keys: list[str], order: list[Column], value: Column, collected: dict[str, Column], merged: dict[str, Column],
    bucket: Column | None = None,
) -> DataFrame:
    """(keys, value, ``merged``): runs of consecutive rows of ``keys`` with the same ``value``, reading ``df`` once.

    ``collected`` are aggregates over rows, ``merged`` aggregates that combine them. Runs are
    first built inside slices; only those at a slice's edge can go on in another, and these,
    two a slice at most, meet in one group per key.
    """
    rows = sliced(df, keys, order) if bucket is None else df.withColumn(_B, bucket)
    by = [*keys, _B]
    inside = Window.partitionBy(*by).orderBy("__ord")
    flagged = rows.withColumns({"__ord": F.struct(*order), "value": value})
    flagged = flagged.withColumn("__new", (~F.lag(F.struct("value")).over(inside).eqNullSafe(F.struct("value"))).cast("int"))
    numbered = flagged.withColumn("__run", F.sum("__new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy(*by, "__run", "value").agg(*[c.alias(n) for n, c in collected.items()])
    last = F.max("__run").over(Window.partitionBy(*by))
    edge = F.when((F.col("__run") == 1) | (F.col("__run") == last), F.lit(-1)).otherwise(F.col(_B))
    meet = Window.partitionBy(*keys, "__edge").orderBy(_B, "__run")
    joined = runs.withColumn("__edge", edge).withColumn("__slice", F.col(_B).cast("long"))
    # Neighbours among the edges are neighbours in the key only across slices.
    same = (
        F.lag("value").over(meet).eqNullSafe(F.col("value"))
        & (F.col("__edge") == -1)
        & F.coalesce(F.lag("__slice").over(meet) < F.col("__slice"), F.lit(False))
    )
    joined = joined.withColumn("__start", (~same).cast("int"))
    joined = joined.withColumn("__all", F.sum("__start").over(meet.rowsBetween(Window.unboundedPreceding, 0)))
    found = joined.groupBy(*keys, "__edge", "__all", "value").agg(*[c.alias(n) for n, c in merged.items()])
    return found.drop("__edge", "__all")
