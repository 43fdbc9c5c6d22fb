"""Statistics of the evaluation: exact tests, matrices, spreads, histograms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Chances of the exact test that are taken at a time.
BLOCK = 65536


def _weights(n1: int, n2: int, good: int, start: int, step: int) -> np.ndarray:
    """Chances of ``start``, ``start + step``, ... hits in the first sample over that of ``start``, as far as they are not 0."""
    least, most = max(0, good - n2), min(good, n1)
    out, last, at = [np.ones(1, np.longdouble)], np.longdouble(1), start
    while last > 0 and least <= at + step <= most:
        k = np.arange(at, min(at + BLOCK, most) if step > 0 else max(at - BLOCK, least), step, dtype=np.longdouble)
        up, down = (n1 - k) * (good - k), k * (n2 - good + k)
        ratios = up / ((k + 1) * (n2 - good + k + 1)) if step > 0 else down / ((n1 - k + 1) * (good - k + 1))
        out.append(last * np.cumprod(ratios))
        last, at = out[-1][-1], at + step * len(k)
    return np.concatenate(out)


def _fisher(a: int, n1: int, b: int, n2: int) -> float:
    """The tail from ``a`` on over the whole: each chance follows from its neighbour, from the likeliest one on both ways, so
    that the work is the chances that differ from 0 (some 140 standard deviations at most) and not numbers of n digits."""
    good = a + b
    mode = (n1 + 1) * (good + 1) // (n1 + n2 + 2)
    right, left = _weights(n1, n2, good, mode, 1), _weights(n1, n2, good, mode, -1)[1:]
    low, high = left[::-1].sum(), right.sum()
    if a > mode:
        return float(right[a - mode :][::-1].sum() / (low + high))
    return float((left[: mode - a][::-1].sum() + high) / (low + high))


@F.pandas_udf(T.DoubleType())
def fisher_greater(hits: pd.Series, n: pd.Series, base_hits: pd.Series, base_n: pd.Series) -> pd.Series:
    """One-sided Fisher exact p: as many hits as seen or more, if both samples had one rate; null for an empty sample."""
    rows = zip(hits, n, base_hits, base_n)
    return pd.Series([_fisher(*map(int, r)) if all(map(pd.notna, r)) and r[1] and r[3] else None for r in rows], dtype="float64")


def permutation_test(spark, a: list[float], b: list[float]) -> DataFrame:
    """Exact two-sided permutation test of two means: every split of the pooled values by the bits of a number.

    At most 20 values in all; one row (n_splits, n_extreme, p)."""
    pooled, n = a + b, len(a) + len(b)
    if n > 20:
        raise ValueError("the exact test takes at most 20 values")
    seen = abs(sum(a) / len(a) - sum(b) / len(b))
    values = F.array(*map(F.lit, map(float, pooled)))
    masks = spark.range(1 << n).where(F.bit_count("id") == len(a))
    own = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda s, i: s + F.when(F.getbit("id", i) == 1, F.get(values, i)).otherwise(0.0))
    apart = F.abs(own / len(a) - (sum(pooled) - own) / len(b))
    return masks.agg(F.count("*").alias("n_splits"), F.count_if(apart >= seen - 1e-12).alias("n_extreme")).withColumn("p", F.col("n_extreme") / F.col("n_splits"))


def histogram(df: DataFrame, value: str, edges: list[float], *labels: str) -> DataFrame:
    """Cumulative bucket counts as a metrics histogram has them: (labels, le, n), the last edge +Inf."""
    sums = [F.count_if(F.col(value) <= e).alias(f"_{i}") for i, e in enumerate(edges)]
    got = df.groupBy(*labels).agg(*sums, F.count(value).alias(f"_{len(edges)}"))
    names = [*(f"{e:g}" for e in edges), "+Inf"]
    return got.select(*labels, F.inline(F.array(*[F.struct(F.lit(n).alias("le"), F.col(f"_{i}").alias("n")) for i, n in enumerate(names)])))


def bucket_quantile(hist: DataFrame, q: float, *labels: str) -> DataFrame:
    """The quantile a monitoring system interpolates from cumulative buckets: linear inside the first bucket that reaches it."""
    rows = F.array_sort(F.collect_list(F.struct(F.when(F.col("le") == "+Inf", float("inf")).otherwise(F.col("le").cast("double")).alias("e"), F.col("n"))))
    held = hist.groupBy(*labels).agg(rows.alias("_r")).withColumn("_t", F.element_at("_r", -1).n * q)
    i = F.size(F.filter("_r", lambda b: b.n < F.col("_t")))
    low = F.when(i == 0, F.struct(F.lit(0.0).alias("e"), F.lit(0).cast("long").alias("n"))).otherwise(F.get("_r", F.greatest(i - 1, F.lit(0))))
    high = F.get("_r", i)
    inside = low.e + (high.e - low.e) * (F.col("_t") - low.n) / (high.n - low.n)
    return held.select(*labels, F.when(F.isnan(high.e) | (high.e == float("inf")), low.e).otherwise(inside).alias("quantile"))


def spread(df: DataFrame, value: str, *labels: str) -> DataFrame:
    """n, mean, sample deviation (0 for one value), population deviation, median, least and greatest."""
    return df.groupBy(*labels).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"),
        F.stddev_pop(value).alias("pop_sd"),
        F.median(value).alias("median"),
        F.min(value).alias("least"),
        F.max(value).alias("greatest"),
    )


def decay_matrix(scores: DataFrame, step: str, day: str, value: str) -> DataFrame:
    """Mean score by (step, day), the lower triangle: a day is known from its own step on."""
    return scores.where(F.col(day) <= F.col(step)).groupBy(step, day).agg(F.avg(value).alias("score"))


def retention(matrix: DataFrame, step: str, day: str, least: float = 1e-6) -> DataFrame:
    """Per later (step, day) its score over the day's first one; days whose first score is not over ``least`` are skipped."""
    first = matrix.groupBy(day).agg(F.min_by("score", step).alias("_f"), F.min(step).alias("_s"))
    both = matrix.join(first, day).where((F.col(step) > F.col("_s")) & (F.col("_f") > least))
    return both.select(step, day, (F.col("score") / F.col("_f")).alias("kept"))


def in_band(x: Column, low: Column, high: Column, slack: float = 1e-4) -> Column:
    """Whether a readout lies in its band, with slack at the ends."""
    return x.between(low - slack, high + slack)


def half_even(x: Column) -> Column:
    """Rounding to an integer with halves to even."""
    return F.bround(x)


def seed_of(*parts: Column) -> Column:
    """A seed from the first eight hex digits of the parts' digest."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 8), 16, 10).cast("long")
