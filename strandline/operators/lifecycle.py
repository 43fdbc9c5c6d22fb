"""Life of captures, chunks and windows: monotone marks, acknowledgement, re-drive, healing, closing, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def monotone(log: DataFrame, key: str, value: str) -> DataFrame:
    """A mark that only rises: the greatest value written, 0 if only nulls were."""
    return log.groupBy(key).agg(F.greatest(F.coalesce(F.max(value), F.lit(0)), F.lit(0)).alias(value))


def reopened(captures: DataFrame, segments: DataFrame, key: str, ended: str, number: str) -> DataFrame:
    """Captures with ``open_again``: a segment past the declared end reopens an ended capture."""
    top = segments.groupBy(key).agg(F.max(number).alias("_top"))
    past = F.col(ended).isNotNull() & (F.col("_top") > F.col(ended))
    return captures.join(top, key, "left").withColumn("open_again", F.coalesce(past, F.lit(False))).drop("_top")


def reset(rows: DataFrame, state: str, of: str, to: str) -> tuple[DataFrame, DataFrame]:
    """(all rows with state ``of`` set back to ``to``, the rows that were)."""
    return rows.withColumn(state, F.when(F.col(state) == of, to).otherwise(F.col(state))), rows.where(F.col(state) == of)


def acknowledged(chunks: DataFrame, processed: DataFrame, key: str, status: str) -> DataFrame:
    """A chunk whose record is stored is confirmed, but only from accepted; other states stay."""
    done = processed.select(key).distinct().withColumn("_d", F.lit(True))
    return chunks.join(done, key, "left").withColumn(status, F.when((F.col(status) == "accepted") & F.col("_d"), "confirmed").otherwise(F.col(status))).drop("_d")


def closed(closes: DataFrame, window: str, outcome: str, seq: str) -> DataFrame:
    """Each close with its answer: ok for the first, same for an equal outcome again, conflict for another."""
    order = W.partitionBy(window).orderBy(seq)
    first = F.first(outcome).over(order.rowsBetween(W.unboundedPreceding, 0))
    answer = F.when(F.row_number().over(order) == 1, "ok").when(F.col(outcome) == first, "same").otherwise("conflict")
    return closes.withColumn("answer", answer)


def redriven(pending: DataFrame, processed: DataFrame, key: str, attempts: str, cap: int) -> DataFrame:
    """What a restart does with each pending chunk: again under the cap; over it finalize what has a record, else dead-letter."""
    done = processed.select(key).distinct().withColumn("_d", F.lit(True))
    over = F.col(attempts) >= cap
    action = F.when(~over, "again").when(F.col("_d"), "finalize").otherwise("dead_letter")
    return pending.join(done, key, "left").withColumn("action", action).drop("_d")


def healed(attempts: DataFrame, key: str, seq: str, ok: str, budget: int) -> DataFrame:
    """Per record after its attempts: heals used (failed ones after the first), whether it is final, and how."""
    order = W.partitionBy(key).orderBy(seq)
    numbered = attempts.withColumn("_i", F.row_number().over(order) - 1)
    good = F.min(F.when(F.col(ok), F.col("_i")))
    return numbered.groupBy(key).agg(good.alias("_g"), F.max("_i").alias("_n")).select(
        key,
        F.least(F.coalesce("_g", "_n"), F.lit(budget)).alias("heals"),
        (F.col("_g").isNotNull() & (F.col("_g") <= budget)).alias("whole"),
        ((F.col("_g").isNotNull() & (F.col("_g") <= budget)) | (F.col("_n") >= budget)).alias("final"),
    )


def guarded(writes: DataFrame, epochs: DataFrame, key: str, epoch: str) -> DataFrame:
    """Writes of the current epoch only: a stale worker's do nothing."""
    return writes.join(epochs.select(key, F.col(epoch).alias("_now")), key).where(F.col(epoch) == F.col("_now")).drop("_now")


def failure_kind(status: Column, attempt: Column, most: int) -> Column:
    """done, retry (server errors and none while attempts are left), or dead_letter (client errors, attempts used up)."""
    transient = status.isNull() | (status >= 500)
    return F.when(status.between(200, 299), "done").when(transient & (attempt < most), "retry").otherwise("dead_letter")


def capped_samples(rows: DataFrame, group: str, order: str, cap: int) -> DataFrame:
    """Exact count per group, and its first ``cap`` keys as samples."""
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(order)))
    return ranked.groupBy(group).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_r") <= cap, F.col(order)))).alias("samples"))


def zone_of_block(rows: DataFrame, block: str, order: str, zone: str, known: Column, home: Column) -> DataFrame:
    """Each block's zone: the first one any of its rows names, if that is known; else home. A second one is not tried."""
    first = F.min_by(zone, F.when(F.col(zone).isNotNull(), F.col(order)))
    return rows.groupBy(block).agg(first.alias("_z")).select(block, F.when(known, F.col("_z")).otherwise(home).alias("zone"))


def assembled(c1: DataFrame, slots: Column, version: str) -> DataFrame:
    """Processed records of envelopes: the identifier, times verbatim, the slots, optional fields left out when null."""
    source = F.struct("stream_id", "chunk_id", "device_tz")
    body = F.to_json(F.struct("user_id", "modality", source.alias("source"), "t_start", F.lit(version).alias("pipeline_version"), slots.alias("slots")))
    return c1.select(F.sha2(F.concat(F.col("chunk_id"), F.lit("\0" + version)), 256).alias("record_id"), body.alias("record_json"))


def identity_mismatches(expected: DataFrame, actual: DataFrame, key: str, path: str, value: str) -> DataFrame:
    """Expected path-value pairs that the actual identity of a server lacks."""
    return expected.join(actual, [key, path, value], "left_anti")


def readouts(matrix: DataFrame, base: DataFrame, step: str, day: str) -> DataFrame:
    """Per step the seen mean, the base mean over the same days, and their separation."""
    both = matrix.join(base.withColumnRenamed("score", "base"), day)
    return both.groupBy(step).agg(F.avg("score").alias("seen"), F.avg("base").alias("base"), (F.avg("score") - F.avg("base")).alias("separation"))


def frame_plan(frames: DataFrame, key: str, span: str, per: float, least: int, most: int) -> DataFrame:
    """How many frames of a clip are read: one per ``per`` seconds, rounded up, within bounds."""
    return frames.select(key, F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.col(span) / per))).cast("int").alias("n_frames"))


# The change from which a cell counts, and the count of cells beyond which a change is one of layout.
CELL, WIDE = 13, 32


def map_summary(cells: Column, cell: int = CELL) -> Column:
    """struct(peak, spread) of a change map: its greatest cell, and how many are at or over ``cell``; 0 and 0 if empty."""
    return F.struct(F.coalesce(F.array_max(cells), F.lit(0)).alias("peak"), F.size(F.filter(cells, lambda v: v >= cell)).alias("spread"))


def change_class(peak: Column, spread: Column, idle: int, layout: int, wide: int = WIDE) -> Column:
    """IDLE (a peak of ``idle`` or less), LAYOUT (a peak over ``layout``, or more than ``wide`` cells) or TEXT."""
    return F.when(peak <= idle, "IDLE").when((peak > layout) | (spread > wide), "LAYOUT").otherwise("TEXT")


def linear_backoff(attempt: Column, step: float) -> Column:
    """The wait before retry number ``attempt`` (from 1): a step more each time."""
    return F.lit(step) * attempt


def backoff(attempt: Column, base: float, cap: float) -> Column:
    """Exponential delay with a cap."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt))
