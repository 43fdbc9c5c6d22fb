"""WAV files by byte range: levels per hop, pauses joined across the ranges, and cuts at pauses.

A file is planned by its size alone; each range finds the header itself and reads the hops that begin in it, so that a
recording of any length is many tasks' work. Pauses are runs of quiet hops: found in every range, then joined where one ends
and the next begins, which is associative, so that no task needs the hops of a whole file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandline.sources.spool import opened

# The level under which a hop is quiet at any rate, the margin over the quiet fifth of the hops, the quantile that
# says what that is, milliseconds of a hop and of a pause, seconds of a chunk at least and at most.
FLOOR, MARGIN, FIFTH = 200.0, 2.5, 0.2
HOP_MS, PAUSE_MS = 30, 300
LEAST_S, MOST_S = 5.0, 30.0

LEVELS = "file string, rate long, total long, hop long, range long, nth long, rms double"


def header(data: bytes) -> tuple[int, int, int, int]:
    """(frames a second, bytes of a frame, offset of the frames, their bytes) of 16-bit mono PCM; others raise."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, kind = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            kind = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data":
            if kind is None or kind[0] != 1 or kind[1] != 1 or kind[5] != 16:
                raise ValueError("pauses need 16-bit mono PCM")
            return kind[2], 2, at + 8, size
        at += 8 + size + size % 2
    raise ValueError("a WAV file without frames, or with a longer header than is read")


class Range(InputPartition):
    """A range of bytes of a file."""

    def __init__(self, path: str, size: int, number: int, split: int):
        self.path, self.size, self.number, self.split = path, size, number, split


class LevelReader(DataSourceReader):
    """Options path, split (bytes of a range), hop_ms."""

    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("wav_levels needs the option path")
        self.path, self.split, self.hop_ms = options["path"], int(options.get("split", 64 << 20)), int(options.get("hop_ms", HOP_MS))

    def partitions(self) -> list[InputPartition]:
        files, root = opened(self.path)
        info = files.get_file_info(root)
        held = [info] if info.is_file else files.get_file_info(pafs.FileSelector(root, recursive=True))
        named = sorted((f.path, f.size) for f in held if f.is_file and f.path.lower().endswith(".wav"))
        return [Range(p, n, k, self.split) for p, n in named for k in range(max(1, -(-n // self.split)))]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.path)
        with files.open_input_file(partition.path) as held:
            rate, width, first, size = header(held.read_at(min(partition.size, 1 << 16), 0))
            total = min(size, partition.size - first) // width
            hop = max(1, round(rate * self.hop_ms / 1000))
            step = hop * width
            begin = lambda at: max(0, -(-(at - first) // step))  # noqa: E731  the first hop that begins at ``at`` or later
            a = begin(partition.number * partition.split)
            b = min(begin((partition.number + 1) * partition.split), total // hop)
            many = max(1, (4 << 20) // step)
            for lo in range(a, b, many):
                hi = min(b, lo + many)
                x = np.frombuffer(held.read_at((hi - lo) * step, first + lo * step), "<i2").astype(np.float64).reshape(hi - lo, hop)
                yield self._batch(partition, rate, total, hop, np.arange(lo, hi), np.sqrt((x**2).mean(1)))
            if a >= b and partition.number == 0:  # a file too short for a hop still says how long it is
                yield self._batch(partition, rate, total, hop, np.array([-1]), np.array([np.nan]))

    def _batch(self, p: Range, rate: int, total: int, hop: int, nth: np.ndarray, rms: np.ndarray) -> pa.RecordBatch:
        n = len(nth)
        whole = lambda v: pa.array(np.full(n, v, np.int64))
        name = pa.array([p.path.rsplit("/", 1)[-1]] * n)
        return pa.RecordBatch.from_arrays([name, whole(rate), whole(total), whole(hop), whole(p.number), pa.array(nth.astype(np.int64)), pa.array(rms)], names=[c.split(" ")[0] for c in LEVELS.split(", ")])


class WavLevels(DataSource):
    """``format("wav_levels")``: a row per hop of every WAV file under ``path``; options split, hop_ms."""

    @classmethod
    def name(cls) -> str:
        return "wav_levels"

    def schema(self) -> str:
        return LEVELS

    def reader(self, schema) -> DataSourceReader:
        return LevelReader(self.options)


def pauses(levels: DataFrame, hop_ms: int = HOP_MS, pause_ms: int = PAUSE_MS) -> DataFrame:
    """(file, middle) of every pause: quiet hops on end for ``pause_ms`` or more; without any speech in a file there is none."""
    real = levels.where("nth >= 0")
    known = real.groupBy("file").agg((F.greatest(F.lit(FLOOR), MARGIN * F.percentile("rms", FIFTH))).alias("_t"), F.max("rms").alias("_m"))
    quiet = real.join(known, "file").where("rms < _t and _m >= _t")
    island = F.col("nth") - F.row_number().over(W.partitionBy("file", "range").orderBy("nth"))
    parts = quiet.withColumn("_i", island).groupBy("file", "range", "_i", "total", "hop").agg(F.min("nth").alias("lo"), F.max("nth").alias("hi"))
    # parts of one pause that lie in several ranges
    order = W.partitionBy("file").orderBy("lo")
    begins = F.when(F.col("lo") > F.lag("hi", 1, -2).over(order) + 1, 1).otherwise(0)
    runs = parts.withColumn("_b", begins).withColumn("_g", F.sum("_b").over(order)).groupBy("file", "_g", "total", "hop").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    least = max(1, -(-pause_ms // hop_ms))
    return runs.where(F.col("hi") - F.col("lo") + 1 >= least).select("file", F.expr("div(lo * hop + least((hi + 1) * hop, total), 2)").alias("middle"))


def walked(total: int, rate: int, middles: list[int], least_s: float, most_s: float) -> list[int]:
    """Cuts of a recording: at the first pause from ``least_s`` on, hard at ``most_s``; what is left over is the last chunk."""
    least = max(1, round(least_s * rate))
    most = max(least, round(most_s * rate))
    held, at, cuts = np.sort(np.array(middles, np.int64)), 0, []
    while True:
        i = int(np.searchsorted(held, at + least))
        if i < len(held) and held[i] <= at + most:
            at = int(held[i])
        elif total - at > most:
            at += most
        else:
            return cuts
        cuts.append(at)


def carved(levels: DataFrame, least_s: float = LEAST_S, most_s: float = MOST_S, hop_ms: int = HOP_MS, pause_ms: int = PAUSE_MS) -> DataFrame:
    """(file, chunk, start, stop) in frames, and start_s, stop_s: adjacent chunks cut at pauses. ``levels``: of wav_levels."""
    if least_s <= 0 or most_s < least_s:
        raise ValueError(f"need 0 < least_s <= most_s, got {least_s} and {most_s}")
    files = levels.groupBy("file").agg(F.max("total").alias("total"), F.max("rate").alias("rate"))
    middles = pauses(levels, hop_ms, pause_ms).groupBy("file").agg(F.collect_list("middle").alias("middles"))

    def run(batches):
        for b in batches:
            rows = []
            for file, total, rate, held in zip(b["file"], b["total"], b["rate"], b["middles"]):
                points = [0, *walked(total, rate, [] if held is None else list(held), least_s, most_s), total]
                rows += [(file, k, x, y, x / rate, y / rate) for k, (x, y) in enumerate(zip(points, points[1:])) if y > x]
            yield pd.DataFrame(rows, columns=["file", "chunk", "start", "stop", "start_s", "stop_s"])

    return files.join(middles, "file", "left").mapInPandas(run, "file string, chunk long, start long, stop long, start_s double, stop_s double")
