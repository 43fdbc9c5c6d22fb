"""Uploads of segments as a stream: what each delivery was, kept by segment, with a batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandline.operators import continuity

RECEIPT = "capture_id string, segment_num long, received_at long, sha256 string, status string"
_KEPT = "captures array<string>, numbers array<array<long>>, digests array<array<string>>"
KEY = ["capture_id", "segment_num"]
#: Keys of the state: a bucket holds the captures whose names hash to it. Fixed for the life of a checkpoint.
BUCKETS = 1024


def receipts(uploads: DataFrame) -> DataFrame:
    """A receipt per delivery of the stream: received (the segment's first), duplicate (the same bytes) or conflict (others).

    What is kept of a capture is the first digest of each of its segments; a capture is as long as a recording is. Captures
    are kept by BUCKETS, so that a call has the deliveries of many. Deliveries of one micro-batch count in the order of
    ``received_at``."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = {c: dict(zip(n, d)) for c, n, d in zip(*state.get)} if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(["received_at", "sha256"], kind="stable")
        status = []
        for capture, n, digest in zip(rows["capture_id"].tolist(), rows["segment_num"].tolist(), rows["sha256"].tolist()):
            own = first.setdefault(capture, {})
            n = int(n) if n == n else None
            held = own.get(n)
            status.append("received" if held is None else "duplicate" if digest == held else "conflict")
            own[n] = digest if held is None else held
        state.update((list(first), [list(f) for f in first.values()], [list(f.values()) for f in first.values()]))
        yield rows.assign(status=status)[["capture_id", "segment_num", "received_at", "sha256", "status"]]

    slim = uploads.select(*KEY, "received_at", "sha256")  # the bytes stay in the spool
    return slim.withColumn("_bucket", F.pmod(F.xxhash64("capture_id"), F.lit(BUCKETS))).groupBy("_bucket").applyInPandasWithState(run, RECEIPT, _KEPT, "append", GroupStateTimeout.NoTimeout)


def receipts_batch(uploads: DataFrame) -> DataFrame:
    """The same over a complete set of deliveries."""
    rows = uploads.select(*KEY, "received_at", "sha256").withColumn("_o", F.struct("received_at", "sha256"))
    kinds = continuity.classified(rows, "capture_id", "segment_num", "sha256", "_o")
    return kinds.select(*KEY, "received_at", "sha256", F.when(F.col("kind") == "first", "received").otherwise(F.col("kind")).alias("status"))


def ledger(receipts: DataFrame, marks: DataFrame) -> DataFrame:
    """Per capture: segments received, deliveries that were duplicates and conflicts, and whether it ended. ``marks``
    (capture_id, ended_at_segment): the client's end markers, the greatest of which counts; one that lies under a
    received segment is stale, and the capture is open again."""
    counts = receipts.groupBy("capture_id").agg(
        F.count_if(F.col("status") == "received").alias("segments"),
        F.count_if(F.col("status") == "duplicate").alias("duplicates"),
        F.count_if(F.col("status") == "conflict").alias("conflicts"),
        F.max(F.when(F.col("status") == "received", F.col("segment_num"))).alias("last"),
    )
    ends = marks.groupBy("capture_id").agg(F.max("ended_at_segment").alias("expected"))
    both = counts.join(ends, "capture_id", "left")
    return both.withColumn("state", F.when(F.col("expected").isNull(), "open").when(F.col("last") > F.col("expected"), "reopened").otherwise("ended"))
