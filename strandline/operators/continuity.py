"""Continuity of numbered streams: runs, gaps, duplicates, conflicts, and the reconciliation verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def runs(received: DataFrame, stream: str, seq: str) -> DataFrame:
    """Maximal runs of consecutive numbers: (stream, lo, hi)."""
    order = W.partitionBy(stream).orderBy(seq)
    islands = received.select(stream, seq).distinct().withColumn("_i", F.col(seq) - F.row_number().over(order))
    return islands.groupBy(stream, "_i").agg(F.min(seq).alias("lo"), F.max(seq).alias("hi")).drop("_i")


def gaps(found: DataFrame, stream: str, first: int = 0) -> DataFrame:
    """The holes below each stream's largest number, from ``first`` on: (stream, lo, hi)."""
    before = F.lag("hi", 1, first - 1).over(W.partitionBy(stream).orderBy("lo"))
    return found.withColumn("_p", before).where("lo > _p + 1").select(stream, (F.col("_p") + 1).alias("lo"), (F.col("lo") - 1).alias("hi"))


def missing_info(received: DataFrame, stream: str, seq: str, cap: int = 20, ends: DataFrame | None = None) -> DataFrame:
    """Per stream: received (distinct), max_sequence, n_missing (exact) and the first ``cap`` missing numbers.

    ``ends`` (stream, ended, expected): the numbers from the greatest one received up to what an ended stream's client
    says it sent are missing too; a null expected says nothing."""
    held = received.groupBy(stream).agg(F.count_distinct(seq).alias("received"), F.max(seq).alias("max_sequence"))
    order = W.partitionBy(stream).orderBy("lo")
    stop = F.col("max_sequence") + 1
    if ends is not None:
        sent = F.coalesce(F.when(F.col("ended"), F.col("expected")), F.lit(0))
        held = held.join(ends.select(stream, sent.alias("_sent")), stream, "left")
        stop = F.greatest(stop, F.coalesce("_sent", F.lit(0)))
    held = held.withColumn("_stop", stop)
    tails = held.where(F.col("_stop") > F.col("max_sequence") + 1).select(stream, (F.col("max_sequence") + 1).alias("lo"), (F.col("_stop") - 1).alias("hi"))
    holes = gaps(runs(received, stream, seq), stream).select(stream, "lo", "hi").unionByName(tails).withColumn("_before", F.sum(F.col("hi") - F.col("lo") + 1).over(order) - (F.col("hi") - F.col("lo") + 1))
    few = holes.where(F.col("_before") < cap).groupBy(stream).agg(
        F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("lo", "hi"))), lambda r: F.sequence(r.lo, F.least(r.hi, r.lo + cap)))), 1, cap).alias("missing")
    )
    total = F.col("_stop") - F.col("received")
    return held.join(few, stream, "left").select(stream, "received", "max_sequence", total.alias("n_missing"), F.coalesce("missing", F.array().cast("array<bigint>")).alias("missing"))


def classified(deliveries: DataFrame, stream: str, seq: str, chunk: str, arrival: str) -> DataFrame:
    """``kind`` of each delivery: first, duplicate (same chunk again) or conflict (another chunk at a taken number)."""
    order = W.partitionBy(stream, seq).orderBy(arrival)
    owner = F.first(chunk).over(order.rowsBetween(W.unboundedPreceding, 0))
    kind = F.when(F.row_number().over(order) == 1, "first").when(F.col(chunk).eqNullSafe(owner), "duplicate").otherwise("conflict")
    return deliveries.withColumn("kind", kind)


def state_of_sequences(processed: DataFrame, dead: DataFrame, accepted: DataFrame, stream: str, seq: str) -> DataFrame:
    """One state per number: processed beats dead, dead beats accepted."""
    ranked = [df.select(stream, seq, F.lit(i).alias("_r")) for i, df in enumerate((processed, dead, accepted))]
    both = ranked[0].unionByName(ranked[1]).unionByName(ranked[2])
    best = both.groupBy(stream, seq).agg(F.min("_r").alias("_r"))
    return best.select(stream, seq, F.element_at(F.array(*map(F.lit, ("processed", "dead_letter", "accepted"))), F.col("_r") + 1).alias("state"))


def verdict(ended: Column, missing: Column, dead: Column) -> Column:
    """recording while open, gaps where anything is missing or dead, else clean."""
    return F.when(~ended, "recording").when((missing > 0) | (dead > 0), "gaps").otherwise("clean")


def reconciled(expected: DataFrame, got: DataFrame, group: str, item: str) -> DataFrame:
    """Per group: how many expected items are missing, foreign or matched, and whether all is well."""
    a = expected.select(group, item).distinct().withColumn("_e", F.lit(1))
    b = got.select(group, item).distinct().withColumn("_g", F.lit(1))
    both = a.join(b, [group, item], "full")
    return both.groupBy(group).agg(
        F.count_if(F.col("_g").isNull()).alias("n_missing"),
        F.count_if(F.col("_e").isNull()).alias("n_foreign"),
        F.count_if(F.col("_e").isNotNull() & F.col("_g").isNotNull()).alias("n_matched"),
        (F.count_if(F.col("_g").isNull() | F.col("_e").isNull()) == 0).alias("ok"),
    )
