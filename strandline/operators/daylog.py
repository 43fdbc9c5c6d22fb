"""Day-log construction: latest record per chunk, epoch-grid segments, gap-and-cap blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A block ends when the silence between two segments is longer than this many segments.
GAP_SEGMENTS = 6
#: A block holds this many segments at most.
BLOCK_SEGMENTS = 12


def with_stream_columns(events: DataFrame) -> DataFrame:
    """Bind the events table to the record model: chunk_id, and updated_at as the completeness axis."""
    key = F.get_json_object("props", "$.k")
    return events.withColumns(
        {
            "chunk_id": F.concat_ws(":", F.col("user_id").cast("string"), key, F.date_format("ts", "yyyyMMdd")),
            "updated_at": F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 97).cast("int")),
        }
    )


def latest_per_chunk(records: DataFrame, user: str = "user_id", chunk: str = "chunk_id", seq: str = "event_id") -> DataFrame:
    """One record per chunk: the largest (updated_at, seq). A null chunk is its own key, so such rows all stay."""
    key = F.coalesce(F.col(chunk), F.concat(F.lit("\0record:"), F.col(seq).cast("string")))
    best = W.partitionBy(user, key).orderBy(F.desc("updated_at"), F.desc(seq))
    return records.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn")


def bucket(ts: Column, seconds: int) -> Column:
    """The index of the epoch-grid bucket; floors towards minus infinity before 1970."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000))


def segments(records: DataFrame, seconds: int, user: str = "user_id", seq: str = "event_id") -> DataFrame:
    """Rows per (user, bucket) with the event types joined in time order."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", seq, "event_type")))
    return (
        records.groupBy(user, bucket(F.col("ts"), seconds).alias("bucket"))
        .agg(ordered.alias("o"), F.count("*").alias("n"))
        .select(user, "bucket", F.array_join(F.col("o.event_type"), " | ").alias("line"), "n")
    )


def blocks(segs: DataFrame, seconds: int, user: str = "user_id") -> DataFrame:
    """Blocks of segments: a new one after a gap over GAP_SEGMENTS segments, or when BLOCK_SEGMENTS are in it."""
    order = W.partitionBy(user).orderBy("bucket")
    gap = (F.col("bucket") - F.lag("bucket").over(order)) * seconds - seconds
    flagged = segs.withColumn("brk", F.when(gap > GAP_SEGMENTS * seconds, 1).otherwise(0))
    island = flagged.withColumn("island", F.sum("brk").over(order.rowsBetween(W.unboundedPreceding, 0)))
    inside = W.partitionBy(user, "island").orderBy("bucket")
    parts = island.withColumn("part", F.floor((F.row_number().over(inside) - 1) / F.lit(BLOCK_SEGMENTS)))
    lines = F.array_sort(F.collect_list(F.struct("bucket", "line")))
    grouped = parts.groupBy(user, "island", "part").agg(
        F.min("bucket").alias("first_bucket"),
        F.max("bucket").alias("last_bucket"),
        F.count("*").alias("n_segments"),
        F.sum("n").alias("n_events"),
        lines.alias("lines"),
    )
    ordinal = F.row_number().over(W.partitionBy(user).orderBy("first_bucket")) - 1
    return grouped.select(
        user,
        F.concat(F.lit("w_b"), F.lpad(ordinal.cast("string"), 4, "0")).alias("block_id"),
        "first_bucket",
        "last_bucket",
        "n_segments",
        "n_events",
        F.array_join(F.col("lines.line"), "\n").alias("text"),
    )
