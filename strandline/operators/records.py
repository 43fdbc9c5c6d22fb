"""The bitemporal record store as DataFrame rewrites: upserts, retraction, invalidation, idempotent allocation.

A write log has one row per write with a monotone ``seq``; a store is the fold of its log. Event time (when it
happened) and ``updated_at`` (when the store last changed) are separate axes, and all ranges are half-open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def within(time: Column, start=None, stop=None) -> Column:
    """start <= time < stop; a bound that is None is open."""
    parts = [time >= start if start is not None else None, time < stop if stop is not None else None]
    return reduce(lambda a, b: a & b, [p for p in parts if p is not None], F.lit(True))


def range_scan(records: DataFrame, user_col: str, user, time_col: str, start=None, stop=None, order=()) -> DataFrame:
    """One user's records in a half-open range, in a total order; the filter reaches the scan."""
    return records.where((F.col(user_col) == user) & within(F.col(time_col), start, stop)).orderBy(*(order or (time_col,)))


def last_wins(log: DataFrame, *keys: str, seq: str = "seq") -> DataFrame:
    """Replace-upsert: the last write of each key."""
    order = W.partitionBy(*keys).orderBy(F.desc(seq))
    return log.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def compare_and_upsert(log: DataFrame, key: str, body: str, at: str, seq: str = "seq") -> DataFrame:
    """Fold of a write log in which a write with an unchanged body does nothing.

    Per key: created_at (first landing), updated_at (last change), body, n_writes, n_changes.
    """
    order = W.partitionBy(key).orderBy(seq)
    changed = log.withColumn("_was", F.lag(body).over(order)).withColumn("_first", F.row_number().over(order) == 1)
    changed = changed.withColumn("_new", F.col("_first") | ~F.col(body).eqNullSafe(F.col("_was")))
    return changed.groupBy(key).agg(
        F.min_by(at, seq).alias("created_at"),
        F.max_by(F.when(F.col("_new"), F.col(at)), F.when(F.col("_new"), F.col(seq))).alias("updated_at"),
        F.max_by(body, seq).alias(body),
        F.count("*").alias("n_writes"),
        F.count_if("_new").alias("n_changes"),
    )


def versioned(log: DataFrame, key: str, value: str, seq: str = "seq") -> DataFrame:
    """Every write raises the version, an equal value too: (key, version, value)."""
    return log.groupBy(key).agg(F.count("*").alias("version"), F.max_by(value, seq).alias(value))


def insert_if_absent(store: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """The store with the rows of ``new`` whose keys it lacks."""
    return store.unionByName(new.dropDuplicates(list(keys)).join(store, list(keys), "left_anti"))


def retraction_manifest(records: DataFrame, selectors: dict, version: str) -> DataFrame:
    """How many records each pipeline version would lose: a dry run. Selectors are ANDed; at least one is needed."""
    if not selectors:
        raise ValueError("a retraction needs a selector")
    chosen = reduce(lambda a, b: a & b, [F.col(c) == v for c, v in selectors.items()])
    return records.where(chosen).groupBy(version).agg(F.count("*").alias("n_records"))


def retract(records: DataFrame, selectors: dict) -> DataFrame:
    """The records that stay; rows where a selector is null stay."""
    if not selectors:
        raise ValueError("a retraction needs a selector")
    chosen = reduce(lambda a, b: a & b, [F.col(c) == v for c, v in selectors.items()])
    return records.where(~F.coalesce(chosen, F.lit(False)))


def admit(entries: DataFrame, *keys: str, digest: str = "sha", seq: str = "seq") -> DataFrame:
    """Append-only admission: ``verdict`` is admitted for a key's first entry, same or conflict for later ones."""
    order = W.partitionBy(*keys).orderBy(seq)
    first = F.first(digest).over(order.rowsBetween(W.unboundedPreceding, 0))
    verdict = F.when(F.row_number().over(order) == 1, "admitted").when(F.col(digest) == first, "same").otherwise("conflict")
    return entries.withColumn("verdict", verdict)


def dense_sequence(items: DataFrame, stream: str, *order: str) -> DataFrame:
    """``sequence`` 0, 1, 2, ... per stream; a repeated item keeps the number it was given first."""
    distinct = items.select(stream, *order).distinct()
    numbered = distinct.withColumn("sequence", F.row_number().over(W.partitionBy(stream).orderBy(*order)) - 1)
    return items.join(numbered, [stream, *order])


def pruned_snapshots(log: DataFrame, user: str, name: str, position: str, protected: Column, keep: int) -> DataFrame:
    """Snapshots to delete: all but the ``keep`` most recently named per user and the protected ones."""
    distinct = log.groupBy(user, name).agg(F.max(position).alias("last"), F.bool_or(protected).alias("held"))
    rank = F.row_number().over(W.partitionBy(user).orderBy(F.desc("last"), name))
    return distinct.withColumn("rank", rank).where((F.col("rank") > keep) & ~F.col("held")).select(user, name, "last")


def with_default(rows: DataFrame, directory: DataFrame, key: str, value: str, default_key, constant) -> DataFrame:
    """A row's own directory entry, else the default key's, else the constant. The default is one row."""
    base = directory.where(F.col(key) == default_key).agg(F.max(value).alias("_base"))
    own = directory.select(key, F.col(value).alias("_own"))
    return rows.join(own, key, "left").crossJoin(F.broadcast(base)).withColumn(value, F.coalesce("_own", "_base", F.lit(constant))).drop("_own", "_base")
