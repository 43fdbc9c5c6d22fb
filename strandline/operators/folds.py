"""Order-dependent folds that no window function expresses: one group at a time, in Arrow or pandas batches.

Groups are chunks or captures, which are bounded by how long a recording segment is.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_near_repeats(df: DataFrame, group: str, order: str, text: str, ratio: float = 0.92) -> DataFrame:
    """Rows whose text differs from the last *kept* row of the group (similarity under ``ratio``)."""

    def keep(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        kept, last = [], None
        for t in frame[text].fillna(""):
            new = last is None or SequenceMatcher(None, last, t).ratio() < ratio
            kept.append(new)
            last = t if new else last
        return frame[kept]

    return df.groupBy(group).applyInPandas(keep, df.schema)


def change_events(maps: DataFrame, group: str, order: str, cells: str, threshold: float, share: float) -> DataFrame:
    """Frames to read: where the saturating sum of change per cell since the last read exceeds ``threshold`` in a
    ``share`` of the cells. Reading a frame resets the sum. (group, order)"""
    schema = maps.select(group, order).schema

    def read(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        held, hits = None, []
        for m in frame[cells]:
            m = np.asarray(m, float)
            held = m if held is None else np.minimum(held + m, 255.0)
            hit = bool((held > threshold).mean() >= share)
            hits.append(hit)
            held = np.zeros_like(held) if hit else held
        return frame.loc[hits, [group, order]]

    return maps.groupBy(group).applyInPandas(read, schema)


def cut_points(levels: DataFrame, group: str, order: str, level: str, quiet_hops: int, least: int, most: int) -> DataFrame:
    """Cuts of a recording in hops: the middle of the first pause at or after ``least`` hops, else hard at ``most``.

    A pause is a run of ``quiet_hops`` or more hops under max(200, 2.5 x the 20th percentile). (group, cut)"""

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame.sort_values(order, kind="stable")[level].to_numpy(float)
        below = x < max(200.0, 2.5 * np.percentile(x, 20))
        quiet = np.concatenate([[False], below & ~below.all(), [False]])  # without any speech there is no pause in it
        begin, stop = np.flatnonzero(quiet[1:] & ~quiet[:-1]), np.flatnonzero(~quiet[1:] & quiet[:-1])
        middles = [(a + b) // 2 for a, b in zip(begin, stop) if b - a >= quiet_hops]
        at, cuts = 0, []
        while len(x) - at > most:
            at = next((m for m in middles if at + least <= m <= at + most), at + most)
            cuts.append(at)
        return pd.DataFrame({group: frame[group].iloc[0], "cut": np.array(cuts, np.int64)})

    kind = levels.schema[group].dataType.simpleString()
    return levels.groupBy(group).applyInPandas(cut, f"`{group}` {kind}, cut long")


def adjacent_spans(cuts: DataFrame, totals: DataFrame, group: str, total: str) -> DataFrame:
    """The spans between cuts, from 0 to the total: (group, start, stop)."""
    points = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), F.coalesce("_c", F.array().cast("array<bigint>")), F.array(F.col(total).cast("long")))))
    held = totals.join(cuts.groupBy(group).agg(F.collect_list("cut").alias("_c")), group, "left").select(group, points.alias("_p"))
    return held.select(group, F.inline(F.arrays_zip(F.slice("_p", 1, F.size("_p") - 1).alias("start"), F.slice("_p", 2, F.size("_p")).alias("stop"))))


def fixed_spans(df: DataFrame, group: str, total: str, step: int) -> DataFrame:
    """Spans of ``step``, the last one shorter: (group, start, stop)."""
    starts = F.explode(F.when(F.col(total) > 0, F.sequence(F.lit(0).cast("long"), F.col(total).cast("long") - 1, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>")))
    return df.select(group, total, starts.alias("start")).select(group, "start", F.least(F.col("start") + step, F.col(total)).alias("stop"))
