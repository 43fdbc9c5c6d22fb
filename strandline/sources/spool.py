"""Uploaded segments: a spool of numbered batches, and a data source that reads it, in batch or as a stream.

An upload is checked, then lands with its bytes in the folder ``batch=N`` of the spool, which counts once its ``_SUCCESS`` is
there: the bytes are kept before anything says they were received. The stream's offset is the number of the last whole batch;
batches are read in order without gaps, so a batch that is still being written holds back those after it, and a restart
from a checkpoint neither loses nor repeats one. A batch is read by row group, a partition each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from strandline.functions import checks

#: The greatest segment number, and the characters of a capture's name. Fixed values.
MOST, SAFE = 9_999_999, r"\A[A-Za-z0-9._-]+\z"
#: Bytes and rows of a batch that is read at once, about.
BATCH, ROWS = 8_000_000, 10_000

UPLOAD = (
    "capture_id string, segment_num long, user_id string, device_id string, t_start string, t_end string, mime string, device_tz string, "
    "sha256 string, n_bytes long, received_at long, body binary"
)


def checked(uploads: DataFrame, zones: DataFrame) -> DataFrame:
    """``uploads`` (UPLOAD without n_bytes; sha256 as the client says it, or null) with the digest of the body, n_bytes, a blank
    zone as none, and ``faults``: why an upload is refused. ``zones``: the known zone names, a bounded list."""
    known = F.broadcast(zones.select(F.col("zone").alias("_z")))
    tz = F.nullif(F.trim("device_tz"), F.lit(""))
    both = uploads.withColumn("device_tz", tz).join(known, F.col("device_tz") == F.col("_z"), "left")
    digest = F.sha2(F.col("body"), 256)
    named = F.col("device_tz").contains("/") | F.col("device_tz").isin("UTC", "GMT")
    some = lambda c: F.length(F.col(c)) > 0
    faults = checks.violations(
        {
            "body": (F.octet_length("body") > 0, "is empty"),
            "capture_id": (F.col("capture_id").rlike(SAFE) & ~F.col("capture_id").isin(".", ".."), "is no safe name"),
            "device_id": (some("device_id"), "is missing"),
            "device_tz": (F.col("device_tz").isNull() | (named & F.col("_z").isNotNull()), "is no known zone"),
            "mime": (some("mime"), "is missing"),
            "segment_num": (F.col("segment_num").between(0, MOST), "is out of range"),
            "sha256": (F.coalesce(F.length("sha256") == 0, F.lit(True)) | (F.lower("sha256") == digest), "is not the body's"),
            "t_end": (F.try_to_timestamp("t_end").isNotNull(), "is no time"),
            "t_start": (F.try_to_timestamp("t_start").isNotNull(), "is no time"),
            "user_id": (some("user_id"), "is missing"),
        }
    )
    return both.withColumns({"faults": faults, "sha256": digest, "n_bytes": F.octet_length("body").cast("long")}).drop("_z")


def accepted(found: DataFrame) -> DataFrame:
    """The uploads that ``checked`` found no fault with, in the spool's columns."""
    return found.where(F.size("faults") == 0).select(*[c.strip().split(" ")[0] for c in UPLOAD.split(",")])


def spool(uploads: DataFrame, path: str, number: int) -> None:
    """Write a batch of accepted uploads; written again it replaces itself."""
    uploads.write.mode("overwrite").parquet(f"{path}/batch={number}")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return pafs.FileSystem.from_uri(re.sub(r"\Afile:/(?!/)", "file:///", path)) if ":" in path else (pafs.LocalFileSystem(), path)


class Group(InputPartition):
    """A row group of a file of the spool."""

    def __init__(self, path: str, group: int):
        self.path, self.group = path, group


class _Spool:
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("segment_spool needs the option path")
        self.path = options["path"].rstrip("/")
        self.retain = int(options["retain"]) if "retain" in options else None

    def whole(self) -> list[int]:
        """The numbers of the batches from the first one there on, up to the first that is not whole."""
        files, root = opened(self.path)
        listed = files.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        numbers = sorted(int(m[1]) for f in listed if (m := re.fullmatch(r"batch=(\d+)", f.base_name)))
        out: list[int] = []
        for n in numbers:
            if out and n != out[-1] + 1 or files.get_file_info(f"{root}/batch={n}/_SUCCESS").type == pafs.FileType.NotFound:
                break
            out.append(n)
        return out

    def groups(self, numbers: list[int]) -> list[InputPartition]:
        """A partition for each row group of these batches."""
        files, root = opened(self.path)
        out: list[InputPartition] = []
        for n in numbers:
            for f in sorted(files.get_file_info(pafs.FileSelector(f"{root}/batch={n}")), key=lambda f: f.path):
                if f.path.endswith(".parquet"):
                    with files.open_input_file(f.path) as held:
                        out += [Group(f.path, g) for g in range(pq.ParquetFile(held).num_row_groups)]
        return out

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.path)
        with files.open_input_file(partition.path) as held:
            file = pq.ParquetFile(held)
            own = file.metadata.row_group(partition.group)
            rows = max(1, min(ROWS, BATCH * own.num_rows // max(1, own.total_byte_size)))
            yield from file.iter_batches(batch_size=rows, row_groups=[partition.group])


class SpoolReader(_Spool, DataSourceReader):
    """All whole batches."""

    def partitions(self) -> list[InputPartition]:
        return self.groups(self.whole())


class SpoolStream(_Spool, DataSourceStreamReader):
    """Whole batches as they come; with ``retain``, committed ones but the last so many are deleted."""

    def initialOffset(self) -> dict:
        return {"batch": -1}

    def latestOffset(self) -> dict:
        return {"batch": max(self.whole(), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.groups(list(range(max(start["batch"] + 1, min(self.whole(), default=0)), end["batch"] + 1)))

    def commit(self, end: dict) -> None:
        if self.retain is not None:
            files, root = opened(self.path)
            for n in self.whole():
                if n <= end["batch"] - self.retain:
                    files.delete_dir(f"{root}/batch={n}")


class SegmentSpool(DataSource):
    """``format("segment_spool")``; options: path, retain (streams only, off by default)."""

    @classmethod
    def name(cls) -> str:
        return "segment_spool"

    def schema(self) -> str:
        return UPLOAD

    def reader(self, schema) -> DataSourceReader:
        return SpoolReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SpoolStream(self.options)
