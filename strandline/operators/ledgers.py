"""Window ledgers and ordered logs: derived watermarks, budgets, activation stacks, claims and strikes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def watermark(windows: DataFrame, user: str, outcome: str, stop: str) -> DataFrame:
    """Per user the end of the last published window, null if there is none; failures never move it."""
    return windows.groupBy(user).agg(F.max(F.when(F.col(outcome) == "published", F.col(stop))).alias("watermark"))


def open_window(records: DataFrame, marks: DataFrame, user: str, updated: str, now: Column, delay: Column) -> DataFrame:
    """The next window of each user, [watermark or first update, now - delay); users it would not advance are left out."""
    first = records.groupBy(user).agg(F.min(updated).alias("_first"))
    both = first.join(marks, user, "left").select(user, F.coalesce("watermark", "_first").alias("start"), (now - delay).alias("stop"))
    return both.where(F.col("stop") > F.col("start"))


def take_budget(pool: DataFrame, group: str, size: str, budget, *order) -> DataFrame:
    """Items in order while what is used before them is under the budget: the last one may overshoot."""
    before = F.sum(size).over(W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return pool.withColumn("used_before", F.coalesce(before, F.lit(0))).where(F.col("used_before") < budget)


def first_n(rows: DataFrame, n: int, group, *order) -> DataFrame:
    """The first n rows of each group in a total order."""
    keys = [group] if isinstance(group, str) else list(group)
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def active_stack(log: DataFrame, user: str, position: str, name: str, status: str) -> DataFrame:
    """Per user the stack that replaying the log leaves: active pushes, rolled_back takes the last of that name off."""
    entries = F.array_sort(F.collect_list(F.struct(position, name, status)))
    step = lambda held, e: F.when(e[status] == "active", F.concat(held, F.array(e[name]))).when(
        (e[status] == "rolled_back") & (F.element_at(F.concat(F.array(F.lit("")), held), -1) == e[name]), F.slice(held, 1, F.size(held) - 1)
    ).otherwise(held)
    stack = F.aggregate("_log", F.array().cast("array<string>"), step)
    return log.groupBy(user).agg(entries.alias("_log")).select(user, stack.alias("stack"))


def even_subset(rows: DataFrame, group: str, cap: int, *order) -> DataFrame:
    """At most ``cap`` rows of each group, evenly spaced from the first to the last (halves round to even)."""
    w = W.partitionBy(group)
    numbered = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    places = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda k: F.bround(k * (F.col("_n") - 1) / F.lit(max(1, cap - 1))).cast("long"))
    return numbered.where((F.col("_n") <= cap) | F.array_contains(places, F.col("_i"))).drop("_i", "_n")


def claim(ledger_state: Column, ledger_version: Column, all_ok: Column, heals: Column, inflight: Column, version, budget: int = 3) -> Column:
    """The verdict on a delivery: fresh, inflight, version_forward, heal (holes left and budget to fill them) or skip."""
    return (
        F.when(inflight, "inflight")
        .when(ledger_state.isNull(), "fresh")
        .when(ledger_version != version, "version_forward")
        .when(~all_ok & (heals < budget), "heal")
        .otherwise("skip")
    )


def strikes(outcomes: DataFrame, user: str, window: str, passed: str, limit: int) -> DataFrame:
    """Consecutive failures at the end of each user's windows (one strike a window), and whether that freezes the user."""
    once = outcomes.groupBy(user, window).agg(F.bool_or(passed).alias("_ok"))
    last_pass = F.max(F.when(F.col("_ok"), F.col(window))).over(W.partitionBy(user))
    run = once.withColumn("_p", last_pass).groupBy(user).agg(F.count_if(F.col("_p").isNull() | (F.col(window) > F.col("_p"))).alias("strikes"))
    return run.withColumn("frozen", F.col("strikes") >= limit)
