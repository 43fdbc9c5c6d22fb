"""Lists of runs [lo, hi] of whole numbers as sets: union, intersection and difference by a sweep over end points.

A run is never expanded: what is done follows the number of runs, whatever numbers they hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _held(sides: list[DataFrame], group: str) -> DataFrame:
    """(group, at, _0, _1, ...): at every end point how many runs of each side cover the numbers from there to the next one.
    Every run adds one from lo on and takes it away from hi + 1 on."""
    n = len(sides)
    points = []
    for i, side in enumerate(sides):
        steps = F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("by")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-1).alias("by")))
        own = side.where("lo <= hi").select(group, F.inline(steps))
        points.append(own.groupBy(group, "at").agg(*[(F.sum("by") if j == i else F.lit(0).cast("long")).alias(f"_{j}") for j in range(n)]))
    one = reduce(DataFrame.unionByName, points).groupBy(group, "at").agg(*[F.sum(f"_{j}").alias(f"_{j}") for j in range(n)])
    upto = W.partitionBy(group).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    # every column sums its own step sizes up to here
    return one.select(group, "at", *[F.sum(f"_{j}").over(upto).alias(f"_{j}") for j in range(n)])


def _swept(sides: list[DataFrame], group: str, keep) -> DataFrame:
    """(group, lo, hi): maximal runs of the numbers where ``keep`` holds of the sides whose runs cover them."""
    order = W.partitionBy(group).orderBy("at")
    on = _held(sides, group).withColumn("_on", keep(*[F.col(f"_{j}") > 0 for j in range(len(sides))])).select(group, "at", "_on")
    changed = on.withColumn("_was", F.coalesce(F.lag("_on").over(order), F.lit(False))).where("_on <> _was")
    ends = changed.withColumn("_next", F.lead("at").over(order)).where("_on")
    return ends.select(group, F.col("at").alias("lo"), (F.col("_next") - 1).alias("hi"))


#: What is kept of two lists, by name.
KINDS = {"union": lambda x, y: x | y, "intersection": lambda x, y: x & y, "difference": lambda x, y: x & ~y}


def algebra(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """(kind, group, lo, hi): all KINDS of two lists in one sweep, so that the lists are made and sorted once."""
    order = W.partitionBy(group).orderBy("at")
    was = [F.coalesce(F.lag(c).over(order), F.lit(0)) > 0 for c in ("_0", "_1")]
    both = _held([a, b], group).withColumns({"_p": was[0], "_q": was[1]})
    turns = [F.when(keep(F.col("_0") > 0, F.col("_1") > 0) != keep(F.col("_p"), F.col("_q")), F.struct(F.lit(k).alias("kind"), keep(F.col("_0") > 0, F.col("_1") > 0).alias("_on"))) for k, keep in KINDS.items()]
    changed = both.select(group, "at", F.inline(F.array_compact(F.array(*turns))))
    ends = changed.withColumn("_next", F.lead("at").over(W.partitionBy(group, "kind").orderBy("at"))).where("_on")
    return ends.select("kind", group, F.col("at").alias("lo"), (F.col("_next") - 1).alias("hi"))


def union(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """The numbers in a run of either list; of one list with itself, its runs made maximal."""
    return _swept([a, b], group, KINDS["union"])


def intersection(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """The numbers in a run of both lists."""
    return _swept([a, b], group, KINDS["intersection"])


def difference(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """The numbers in a run of the first list and in none of the second."""
    return _swept([a, b], group, KINDS["difference"])


def clipped(runs: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """The runs as far as they lie between two bounds."""
    return runs.withColumns({"lo": F.greatest("lo", lo), "hi": F.least("hi", hi)}).where("lo <= hi")


def widths(runs: DataFrame, group: str) -> DataFrame:
    """How many numbers a list of disjoint runs holds: (group, n)."""
    return runs.groupBy(group).agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n"))


def capped(runs: DataFrame, group: str, cap: int) -> DataFrame:
    """The first ``cap`` runs of each group as an array, and the exact count of all: (group, runs, n_runs)."""
    rank = F.row_number().over(W.partitionBy(group).orderBy("lo"))
    few = runs.withColumn("_r", rank)
    return few.groupBy(group).agg(F.array_sort(F.collect_list(F.when(F.col("_r") <= cap, F.struct("lo", "hi")))).alias("runs"), F.count("*").alias("n_runs"))
