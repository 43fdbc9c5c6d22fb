"""Running sums in a total order without sorting a whole group in one task: over buckets of the order first, then inside them.

A bucket is a function of the order that never falls along it: a beginning of a hash's digits, or a range of numbers. Sums
of buckets are small; only rows of one bucket meet in one task, and only of buckets that a budget reaches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hex digits of a hash, or the ranges of numbers, that make the buckets: 4096 a group.
DIGITS, RANGES = 3, 4096


def by_digits(digest: Column) -> Column:
    """The bucket of a hash in hex digits, for an order by that hash."""
    return F.left(digest, F.lit(DIGITS))


def by_range(rows: DataFrame, order: str, falling: bool = False) -> Column:
    """The bucket of a whole number, for an order by it: equal ranges between the least and the greatest one of ``rows``."""
    ends = rows.agg(F.min(order).alias("a"), F.max(order).alias("b")).first()
    low, high = (0, 0) if ends.a is None else (ends.a, ends.b)
    width = max(1, -(-(high - low + 1) // RANGES))
    place = F.floor((F.lit(high) - F.col(order) if falling else F.col(order) - F.lit(low)) / F.lit(width))
    return F.coalesce(place.cast("long"), F.lit(RANGES + 1 if falling else -1))  # null stands first, or last where it falls


def before(rows: DataFrame, group: str, bucket: Column, order: list, size: Column, budget: Column | None = None, name: str = "used_before") -> DataFrame:
    """``rows`` with the sum of ``size`` over the group's rows that come before each one. With a ``budget``, only rows with less
    than that before them."""
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    dealt = rows.withColumns({"_b": bucket, "_s": size, "_g": F.col(group)})
    sums = dealt.groupBy("_g", "_b").agg(F.sum("_s").alias("_t"))
    sums = sums.withColumn("_held", F.coalesce(F.sum("_t").over(upto(W.partitionBy("_g").orderBy("_b"))), F.lit(0)))
    if budget is not None:
        sums = sums.where(F.col("_held") < budget)
    sums = sums.select(F.col("_g").alias("_h"), F.col("_b").alias("_c"), "_held")
    inside = upto(W.partitionBy("_g", "_b").orderBy(*order))
    both = dealt.join(sums, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_b") == F.col("_c")))
    out = both.withColumn(name, F.col("_held") + F.coalesce(F.sum("_s").over(inside), F.lit(0)))
    if budget is not None:
        out = out.where(F.col(name) < budget)
    return out.drop("_b", "_s", "_g", "_h", "_c", "_held")


def ranked(rows: DataFrame, group: str, bucket: Column, order: list, name: str = "rank") -> DataFrame:
    """``rows`` with their place from 1 in the group's order."""
    return before(rows, group, bucket, order, F.lit(1), name=name).withColumn(name, (F.col(name) + 1).cast("int"))
