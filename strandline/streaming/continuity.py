"""Continuity of numbered streams with bounded state: runs as a list, and the chunks of recent numbers only.

A stream's state is its totals, one entry per run of received numbers, and for the numbers seen in the last ``delay`` the chunk
that took each. A timer behind the watermark forgets older chunks: a number that comes again later still counts as a
duplicate, since it lies in a run, but no longer tells whether its chunk is another one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SEEN = "stream_id long, received long, duplicates long, conflicts long, max_sequence long, runs string, remembered long"
_COLUMNS = [c.split(" ")[0] for c in SEEN.split(", ")]
#: The state store that timers and list states need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def joined(lo: np.ndarray, hi: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint runs in order with further numbers, as disjoint runs that don't touch."""
    a, b = np.concatenate([lo, new]), np.concatenate([hi, new])
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order]) if len(a) else b
    first = np.concatenate([[True], a[1:] > b[:-1] + 1]) if len(a) else np.zeros(0, bool)
    return a[first], np.append(b[:-1][first[1:]], b[-1:]) if len(a) else b


class Tracker(StatefulProcessor):
    """Rows (stream_id, sequence, chunk_id, at) of one stream; ``delay`` in milliseconds."""

    def __init__(self, delay: int):
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "received long, duplicates long, conflicts long")
        self.runs = handle.getListState("runs", "lo long, hi long")
        self.recent = handle.getValueState("recent", "sequence array<long>, chunk array<string>, at array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["at", "chunk_id"], kind="stable")
        received, duplicates, conflicts = self.totals.get() if self.totals.exists() else (0, 0, 0)
        held = list(self.runs.get()) if self.runs.exists() else []
        lo, hi = (np.array([int(r[i]) for r in held], np.int64) for i in (0, 1))
        owner, seen = {}, {}
        if self.recent.exists():
            numbers, chunks, times = self.recent.get()
            owner, seen = dict(zip(numbers, chunks)), dict(zip(numbers, times))
        numbers = frame["sequence"].to_numpy(np.int64)
        place = np.searchsorted(lo, numbers, side="right") - 1
        known = (place >= 0) & (numbers <= hi[place]) if len(lo) else np.zeros(len(numbers), bool)
        stamps = frame["at"].astype("int64").to_numpy() // 1_000_000 if frame["at"].dtype.kind == "M" else frame["at"].to_numpy()
        new = []
        for n, chunk, at, old in zip(numbers.tolist(), frame["chunk_id"], stamps.tolist(), known.tolist()):
            if n in owner:
                duplicates, conflicts = duplicates + (owner[n] == chunk), conflicts + (owner[n] != chunk)
            elif old:
                duplicates += 1
            else:
                owner[n], received = chunk, received + 1
                new.append(n)
            if n in owner:
                seen[n] = max(at, seen.get(n, at))
        lo, hi = joined(lo, hi, np.array(new, np.int64))
        self.totals.update((int(received), int(duplicates), int(conflicts)))
        self.runs.put(list(zip(lo.tolist(), hi.tolist())))
        self._remember(owner, seen, timerValues)
        text = ",".join(f"{a}-{b}" for a, b in zip(lo.tolist(), hi.tolist()))
        yield pd.DataFrame([(key[0], int(received), int(duplicates), int(conflicts), int(hi.max(initial=-1)), text, len(owner))], columns=_COLUMNS)

    def _remember(self, owner: dict, seen: dict, timerValues) -> None:
        """Keep the recent chunks, and a timer for the time when all of them are old."""
        if not owner:
            self.recent.clear()
            return
        order = sorted(owner)
        self.recent.update((order, [owner[n] for n in order], [int(seen[n]) for n in order]))
        self.handle.registerTimer(max(max(seen[n] for n in order) + self.delay, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.recent.exists():
            numbers, chunks, times = self.recent.get()
            stays = [i for i, t in enumerate(times) if t + self.delay > timerValues.getCurrentWatermarkInMs()]
            if stays:
                self.recent.update(([numbers[i] for i in stays], [chunks[i] for i in stays], [times[i] for i in stays]))
            else:
                self.recent.clear()
        yield pd.DataFrame([], columns=_COLUMNS)

    def close(self) -> None:
        pass


def tracked(deliveries: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Per stream and update: the totals so far, the runs as text, and how many chunks are remembered. ``at``: a timestamp.

    The session's state store provider must be PROVIDER."""
    rows = deliveries.select("stream_id", "sequence", "chunk_id", F.col("at").cast("timestamp").alias("at")).withWatermark("at", delay)
    span = int(pd.Timedelta(delay).total_seconds() * 1000)
    return rows.groupBy("stream_id").transformWithStateInPandas(Tracker(span), SEEN, "Update", "EventTime")
