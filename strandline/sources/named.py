"""Sources by key: data sources under short names, with declared options, for ``spark.read.format(key)``."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandline.sources.shipping import ship
from strandline.sources.spool import SegmentSpool, opened
from strandline.sources.waves import WavLevels


class Part(InputPartition):
    """What one task reads: a name and a range."""

    def __init__(self, name: str, begin: int = 0, stop: int = 0):
        self.name, self.begin, self.stop = name, begin, stop


class PlanReader(DataSourceReader):
    """A plan in JSON lines, a partition per file; the order of a file's lines is the order of capture."""

    needed = ("chunk_key", "t_start", "t_end", "audio")

    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        files, root = opened(self.path)
        info = files.get_file_info(root)
        held = [info] if info.is_file else files.get_file_info(pafs.FileSelector(root))
        return [Part(f.path) for f in sorted(held, key=lambda f: f.path) if f.is_file and f.path.endswith(".jsonl")]

    def read(self, partition: Part) -> Iterator[tuple]:
        files, _ = opened(self.path)
        place = 0
        with files.open_input_stream(partition.name) as held:
            for line in held.read().decode("utf-8").splitlines():
                if not line.strip():
                    continue
                row = json.loads(line)
                if lacking := [k for k in self.needed if row.get(k) is None]:
                    raise ValueError(f"row {place} of the plan lacks {', '.join(lacking)}")
                yield (partition.name.rsplit("/", 1)[-1], place, *(str(row[k]) for k in self.needed), row.get("media"))
                place += 1
        if not place:
            raise ValueError(f"the plan {partition.name} is empty")


class ReplayPlan(DataSource):
    """``format("replay_plan")``; option path."""

    @classmethod
    def name(cls) -> str:
        return "replay_plan"

    def schema(self) -> str:
        return "file string, place long, chunk_key string, t_start string, t_end string, audio string, media string"

    def reader(self, schema) -> DataSourceReader:
        return PlanReader(self.options)


def mixed(seed: int, salt: int, ids: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend on (seed, salt, id) alone."""
    x = ids.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + salt * 0xBF58476D1CE4E5B9) % 2**64)
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53


class CaptureReader(DataSourceReader):
    """Seeded capture records; a row depends on its number alone, not on the partitions."""

    step = 100_000

    def __init__(self, options: dict):
        self.rows, self.seed = int(options["rows"]), int(options.get("seed", 0))
        self.users, self.stragglers = int(options.get("users", 20)), float(options.get("stragglers", 0.1))
        self.start = datetime.fromisoformat(options.get("start", "2024-01-01T00:00:00")).replace(tzinfo=timezone.utc)

    def partitions(self) -> list[InputPartition]:
        return [Part("rows", a, min(self.rows, a + self.step)) for a in range(0, self.rows, self.step)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        ids = np.arange(partition.begin, partition.stop)
        first = int(self.start.timestamp()) * 1_000_000
        at = first + (mixed(self.seed, 1, ids) * 86_400_000_000).astype(np.int64)
        late = np.where(mixed(self.seed, 2, ids) < self.stragglers, timedelta(days=1).total_seconds(), 5)
        stamp = lambda x: pa.array(x, pa.timestamp("us", "UTC"))
        columns = [pa.array(ids), pa.array((mixed(self.seed, 3, ids) * self.users).astype(np.int64)), stamp(at), stamp(at + (late * 1e6).astype(np.int64)), pa.array([f"event {i}" for i in ids])]
        yield pa.RecordBatch.from_arrays(columns, names=["seq", "user_id", "t_start", "updated_at", "text"])


class SyntheticCaptures(DataSource):
    """``format("synthetic_captures")``; options rows, seed, users, stragglers (the share a day late), start."""

    @classmethod
    def name(cls) -> str:
        return "synthetic_captures"

    def schema(self) -> str:
        return "seq long, user_id long, t_start timestamp, updated_at timestamp, text string"

    def reader(self, schema) -> DataSourceReader:
        return CaptureReader(self.options)


#: Key -> (data source, options that must be given, options that may be).
SOURCES: dict[str, tuple[type[DataSource], tuple[str, ...], tuple[str, ...]]] = {
    s.name(): (s, needed, further)
    for s, needed, further in (
        (SegmentSpool, ("path",), ("retain",)),
        (WavLevels, ("path",), ("split", "hop_ms")),
        (ReplayPlan, ("path",), ()),
        (SyntheticCaptures, ("rows",), ("seed", "users", "stragglers", "start")),
    )
}


def register(spark: SparkSession) -> None:
    """Make all sources known to the session by their keys."""
    ship(spark)
    for source, _, _ in SOURCES.values():
        spark.dataSource.register(source)


def _options(key: str, options: dict) -> dict:
    if key not in SOURCES:
        raise ValueError(f"no source {key!r}; there are {', '.join(sorted(SOURCES))}")
    _, needed, further = SOURCES[key]
    if lacking := [k for k in needed if options.get(k) is None]:
        raise ValueError(f"the source {key} needs {', '.join(lacking)}")
    if unknown := sorted(set(options) - {*needed, *further}):
        raise ValueError(f"the source {key} has no option {', '.join(unknown)}")
    return {k: str(v) for k, v in options.items() if v is not None}


def source(spark: SparkSession, key: str, **options) -> DataFrame:
    """The source of this key; an unknown key, an unknown option and a missing one raise before anything is read."""
    held = _options(key, options)
    register(spark)
    return spark.read.format(key).options(**held).load()


def stream_source(spark: SparkSession, key: str, **options) -> DataFrame:
    """The same as a stream, for sources that are streams too."""
    held = _options(key, options)
    register(spark)
    return spark.readStream.format(key).options(**held).load()
