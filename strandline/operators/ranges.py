"""Range, interval and nearest joins as equi-joins on buckets.

Both sides name the buckets they touch, rows meet in a bucket by a hash join, and the exact condition filters. A pair
that meets in several buckets is kept in the first one they share, so that nothing has to be made distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _buckets(start: Column, stop: Column, width) -> Column:
    lo, hi = F.floor(start / F.lit(width)), F.floor(stop / F.lit(width))
    return F.sequence(lo, F.greatest(lo, hi))


def overlapping(left: DataFrame, right: DataFrame, width, on=(), a=("a_start", "a_stop"), b=("b_start", "b_stop")) -> DataFrame:
    """Pairs of half-open intervals that overlap, with ``overlap``, their common length. ``on``: equal columns."""
    x = left.withColumn("_b", F.explode(_buckets(F.col(a[0]), F.col(a[1]), width)))
    y = right.withColumn("_b", F.explode(_buckets(F.col(b[0]), F.col(b[1]), width)))
    met = x.join(y, [*on, "_b"])
    common = F.least(F.col(a[1]), F.col(b[1])) - F.greatest(F.col(a[0]), F.col(b[0]))
    once = F.col("_b") == F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / F.lit(width))
    return met.where((F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1])) & once).withColumn("overlap", common).drop("_b")


def best_overlap(left: DataFrame, right: DataFrame, width, key: str, label: str, on=(), a=("a_start", "a_stop"), b=("b_start", "b_stop")) -> DataFrame:
    """Every left row with the right label it overlaps most; ties take the least label, no overlap null."""
    met = overlapping(left, right, width, on, a, b)
    best = met.groupBy(key).agg(F.min(F.struct((-F.col("overlap")).alias("o"), F.col(label).alias("l"))).alias("_m"))
    return left.join(best.select(key, F.col("_m.l").alias(label), (-F.col("_m.o")).alias("overlap")), key, "left")


def in_interval(points: DataFrame, spans: DataFrame, width, point: str, start: str, stop: str, on=(), how: str = "inner") -> DataFrame:
    """Points with the half-open interval they lie in (or, ``left_semi``/``left_anti``, the spans by whether they hold one)."""
    p = points.withColumn("_b", F.floor(F.col(point) / F.lit(width)))
    s = spans.withColumn("_b", F.explode(_buckets(F.col(start), F.col(stop), width)))
    held = (F.col(point) >= F.col(start)) & (F.col(point) < F.col(stop))
    if how == "inner":
        return p.join(s, [*on, "_b"]).where(held).drop("_b")
    keys = spans.columns
    hit = s.join(p.select(*on, "_b", point), [*on, "_b"]).where(held).select(*keys).distinct()
    return spans.join(hit, keys, how)


def nearest(left: DataFrame, right: DataFrame, tolerance, key: str, at: str, other: str, on=(), later_wins: bool = True) -> DataFrame:
    """Every left row with the nearest right row within ``tolerance``; of two as near the later (or earlier) one; else null."""
    x = left.withColumn("_b", F.explode(F.sequence(F.floor((F.col(at) - tolerance) / tolerance), F.floor((F.col(at) + tolerance) / tolerance))))
    y = right.withColumn("_b", F.floor(F.col(other) / F.lit(tolerance)))
    met = x.join(y, [*on, "_b"]).withColumn("distance", F.abs(F.col(at) - F.col(other))).where(F.col("distance") <= tolerance)
    order = W.partitionBy(key).orderBy("distance", F.desc(other) if later_wins else F.asc(other))
    best = met.withColumn("_rn", F.row_number().over(order)).where("_rn = 1")
    extra = [c for c in right.columns if c not in left.columns]
    return left.join(best.select(key, *extra, "distance"), key, "left")
