"""Resumable stages: a stage's rows are kept per owner under a content key, and built again only where the key changed.

A stage writes the rows it built, then a memo of (owner, key); both are folders of one run, and only a run whose memo is whole
counts. A night that is killed anywhere goes on at the first stage without a memo, and ends with the same tables: what was
half written is written over. All owners of a night go through a stage together, those whose memo is fresh by a read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.streaming.store import names, remove


def key_of(*parts):
    """A content key: the digest of the parts as text, NUL between them; null counts as empty."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


class Stages:
    """The stages of one folder. ``ran``: (stage, owners built, owners read) of this object's calls, in order."""

    def __init__(self, spark: SparkSession, path: str, owner: tuple[str, ...], after: Callable[[str, str], None] | None = None):
        self.spark, self.path, self.owner, self.after = spark, path.rstrip("/"), list(owner), after
        self.ran: list[tuple[str, int, int]] = []

    def _runs(self, name: str) -> list[int]:
        """Numbers of the runs whose memo is whole."""
        found = [int(n[4:]) for n in names(self.spark, f"{self.path}/{name}.memo") if n.startswith("run=")]
        return sorted(n for n in found if "_SUCCESS" in names(self.spark, f"{self.path}/{name}.memo/run={n}"))

    def _read(self, folder: str, runs: list[int], schema: T.StructType) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{folder}/run={n}").withColumn("_run", F.lit(n)) for n in runs]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], T.StructType([*schema, T.StructField("_run", T.IntegerType())]))

    def _memo(self, name: str, keys: DataFrame) -> DataFrame:
        """(owner, key, _run): of each owner and key the newest run."""
        schema = keys.select(*self.owner, "key").schema
        return self._read(f"{name}.memo", self._runs(name), schema).groupBy(*self.owner, "key").agg(F.max("_run").alias("_run"))

    def rows(self, name: str, schema: str) -> DataFrame:
        """Every owner's rows of the newest run it has, whatever its key."""
        kind, runs = T.StructType.fromDDL(schema), self._runs(name)
        held = self._read(name, runs, kind)
        memo = self._read(f"{name}.memo", runs, T.StructType([kind[c] for c in self.owner])).groupBy(*self.owner).agg(F.max("_run").alias("_run"))
        return held.join(memo, [*self.owner, "_run"], "left_semi").select(*[f.name for f in kind])

    def held(self, rows: DataFrame) -> DataFrame:
        """The rows, written down for as long as the night goes on: cuts lineage."""
        path = f"{self.path}/asked/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def run(self, name: str, keys: DataFrame, schema: str, build: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
        """(the stage's rows for the owners and keys asked for, those owners and keys). ``schema`` begins with the owner;
        ``build`` makes the rows of the owners it is given; an owner without rows is done too."""
        kind = T.StructType.fromDDL(schema)
        asked = self.held(keys.select(*self.owner, "key").distinct())
        todo = asked.join(self._memo(name, asked), [*self.owner, "key"], "left_anti")
        total, new = asked.count(), todo.count()
        self.ran.append((name, new, total - new))
        if new:
            number = max((int(n[4:]) for n in names(self.spark, f"{self.path}/{name}.memo") if n.startswith("run=")), default=0) + 1
            made = build(todo.select(*self.owner)).select(*[F.col(f.name).cast(f.dataType) for f in kind])
            made.write.mode("overwrite").parquet(f"{self.path}/{name}/run={number}")
            self._told(name, "rows")
            todo.write.mode("overwrite").parquet(f"{self.path}/{name}.memo/run={number}")
            self._told(name, "memo")
        held = self._read(name, self._runs(name), kind)
        own = asked.join(self._memo(name, asked), [*self.owner, "key"]).select(*self.owner, "_run")
        return held.join(own, [*self.owner, "_run"], "left_semi").select(*[f.name for f in kind]), asked

    def done(self) -> None:
        """Forget what ``held`` wrote."""
        remove(self.spark, f"{self.path}/asked")

    def _told(self, name: str, what: str) -> None:
        if self.after is not None:
            self.after(name, what)
