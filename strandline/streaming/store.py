"""Tables that micro-batches write: a folder per batch, one commit for all tables of a batch, and snapshots.

A batch writes its rows of every table into folders of its own number, then one marker. Readers see committed batches only.
A batch that is run again, or again after it failed between two writes, overwrites its own folders with the same rows,
because it reads only what earlier batches committed. The newest row of a key counts. Every ``every`` batches the newest
rows are written as a snapshot, so that a read takes one snapshot and at most ``every`` - 1 batches, however many there were.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none where there is no folder. Any file system that Spark reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []


def _touch(spark: SparkSession, path: str) -> None:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(file, True).close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder or file if it is there."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(file, True)


@dataclass(frozen=True)
class Table:
    """A table's columns, and its key: of rows of one key the newest batch's counts. Without a key it is a log."""

    schema: str
    key: tuple[str, ...] = ()


class Store:
    """The tables in one folder."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table], every: int = 16):
        self.spark, self.path, self.tables, self.every = spark, path.rstrip("/"), tables, every

    def last(self) -> int:
        """The number of the last committed batch, -1 before the first."""
        return max((int(n) for n in names(self.spark, f"{self.path}/commits") if n.isdigit()), default=-1)

    def write(self, table: str, rows: DataFrame, number: int) -> None:
        """A batch's rows of a table."""
        kind = T.StructType.fromDDL(self.tables[table].schema)
        rows.select(*[F.col(f.name).cast(f.dataType) for f in kind]).write.mode("overwrite").parquet(f"{self.path}/{table}/batch={number}")

    def commit(self, number: int) -> None:
        """Make the batch's rows visible; then, if it is due, write snapshots and forget the marker before the last one."""
        for table, held in self.tables.items():
            if held.key and (number + 1) % self.every == 0:
                rows = self._newest(table, number)
                rows.write.mode("overwrite").parquet(f"{self.path}/{table}.whole/batch={number}")
        _touch(self.spark, f"{self.path}/commits/{number}")
        for n in names(self.spark, f"{self.path}/commits"):
            if n.isdigit() and int(n) < number - 1:
                remove(self.spark, f"{self.path}/commits/{n}")

    def _batches(self, folder: str, before: int) -> list[int]:
        return sorted(int(n[6:]) for n in names(self.spark, f"{self.path}/{folder}") if n.startswith("batch=") and int(n[6:]) <= before)

    def _newest(self, table: str, upto: int) -> DataFrame:
        held, schema = self.tables[table], T.StructType.fromDDL(self.tables[table].schema)
        whole = self._batches(f"{table}.whole", upto - 1)[-1:] if held.key else []
        after = [n for n in self._batches(table, upto) if not whole or n > whole[0]]
        folders = [f"{self.path}/{table}.whole/batch={n}" for n in whole] + [f"{self.path}/{table}/batch={n}" for n in after]
        if not folders:
            return self.spark.createDataFrame([], schema)
        if not held.key:
            return self.spark.read.schema(schema).parquet(*folders)
        # the folders are named here, so a row's age is its folder's place in the list
        rows = self.spark.read.schema(schema).parquet(*folders).withColumn("_age", F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/[^/]*$", 1).cast("long"))
        rest = [f.name for f in schema if f.name not in held.key]
        best = rows.groupBy(*held.key).agg(F.max_by(F.struct(*rest), "_age").alias("_r"))
        return best.select(*held.key, "_r.*").select(*[f.name for f in schema])

    def read(self, table: str, before: int | None = None) -> DataFrame:
        """The committed rows, or those that batches of smaller numbers committed."""
        last = self.last()
        return self._newest(table, last if before is None else min(last, before - 1))
