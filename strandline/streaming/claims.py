"""Structured Streaming: the claim machine over at-least-once deliveries, and continuity per stream, with batch twins.

Continuity keeps one small state per key in the state store, claims one per bucket of keys; over a complete set of files the stream's last rows per key equal
the batch twin's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandline.streaming.store import Store, Table

#: Attempts to fill a record's holes.
HEAL_BUDGET = 3

CLAIM = "chunk_id string, seq long, verdict string, heals int"
CLAIM_STATE = "chunk array<string>, version array<string>, ok array<boolean>, heals array<int>"
#: Keys of the state: a bucket holds the chunks whose names hash to it. Fixed for the life of a checkpoint.
BUCKETS = 1024


def claims_stream(deliveries: DataFrame) -> DataFrame:
    """A verdict per delivery (chunk_id, seq, version, ok): fresh, version_forward, heal or skip.

    ``ok`` says whether this attempt left no holes. A chunk's first delivery is fresh; another version moves it forward;
    a delivery of a record with holes heals it while its budget lasts; the rest are skipped. Chunks are kept by BUCKETS, so
    that a call of the fold has the rows of many chunks, however few deliveries each of them has."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {c: tuple(r) for c, *r in zip(*state.get)} if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(["_none", "seq"], kind="stable")
        verdicts, spent = [], []
        for chunk, own, good in zip(rows["chunk_id"].tolist(), rows["version"].tolist(), rows["ok"].tolist()):
            version, ok, heals = held.get(chunk, (None, None, 0))
            if version is None:
                verdict, version, ok = "fresh", own, bool(good)
            elif own != version:
                verdict, version, ok, heals = "version_forward", own, bool(good), 0
            elif not ok and heals < HEAL_BUDGET:
                verdict, ok, heals = "heal", bool(good), heals + 1
            else:
                verdict = "skip"
            held[chunk] = (version, ok, heals)
            verdicts.append(verdict)
            spent.append(heals)
        state.update((list(held), *(list(c) for c in zip(*held.values()))))
        yield rows[["chunk_id"]].assign(seq=rows["seq"].astype("Int64").mask(rows["_none"]), verdict=verdicts, heals=spent)

    # a null number comes last, and stays apart so that the others keep all their digits
    dealt = deliveries.select("chunk_id", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), "version", "ok", F.col("seq").isNull().alias("_none"))
    return dealt.withColumn("_bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(BUCKETS))).groupBy("_bucket").applyInPandasWithState(run, CLAIM, CLAIM_STATE, "append", GroupStateTimeout.NoTimeout)


def claims_batch(deliveries: DataFrame) -> DataFrame:
    """The same verdicts over a complete set of deliveries: a fold over each chunk's sorted deliveries, JVM-side."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "version", "ok")))
    zero = F.struct(
        F.lit(None).cast("string").alias("version"),
        F.lit(None).cast("boolean").alias("ok"),
        F.lit(0).alias("heals"),
        F.array().cast("array<struct<seq:bigint,verdict:string,heals:int>>").alias("out"),
    )

    def step(s, r):
        fresh, forward = s.version.isNull(), s.version != r.version
        heal = ~s.ok & (s.heals < HEAL_BUDGET)
        verdict = F.when(fresh, "fresh").when(forward, "version_forward").when(heal, "heal").otherwise("skip")
        heals = F.when(fresh, 0).when(forward, 0).when(heal, s.heals + 1).otherwise(s.heals)
        done = F.struct(r.seq.alias("seq"), verdict.alias("verdict"), heals.alias("heals"))
        return F.struct(r.version.alias("version"), F.when(verdict == "skip", s.ok).otherwise(r.ok).alias("ok"), heals.alias("heals"), F.concat(s.out, F.array(done)).alias("out"))

    folded = deliveries.groupBy("chunk_id").agg(rows.alias("_r")).select("chunk_id", F.aggregate("_r", zero, step).alias("_s"))
    return folded.select("chunk_id", F.inline("_s.out"))


CONTINUITY = "stream_id long, received long, duplicates long, conflicts long, max_sequence long, runs string"
CONTINUITY_STATE = "lo array<long>, hi array<long>, owner map<long,string>, duplicates long, conflicts long"


def continuity_stream(deliveries: DataFrame) -> DataFrame:
    """Per stream (stream_id, sequence, chunk_id, at): runs received, duplicates and conflicts so far; a row per update."""

    def run(key, frames, state: GroupState):
        lo, hi, owner, duplicates, conflicts = state.get if state.exists else ([], [], {}, 0, 0)
        owner = dict(owner)
        for r in pd.concat(list(frames)).sort_values("at", kind="stable").itertuples(index=False):
            held = owner.setdefault(int(r.sequence), r.chunk_id)
            duplicates, conflicts = duplicates + 0, conflicts + (held != r.chunk_id)
            runs = list(zip(lo, hi))
            if any(a <= r.sequence <= b for a, b in runs):
                duplicates += held == r.chunk_id
                continue
            runs = sorted([*runs, (int(r.sequence), int(r.sequence))])
            merged = [list(runs[0])]
            for a, b in runs[1:]:
                if a <= merged[-1][1] + 1:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            lo, hi = [m[0] for m in merged], [m[1] for m in merged]
        state.update((lo, hi, owner, int(duplicates), int(conflicts)))
        text = ",".join(f"{a}-{b}" for a, b in zip(lo, hi))
        yield pd.DataFrame([(key[0], sum(b - a + 1 for a, b in zip(lo, hi)), int(duplicates), int(conflicts), max(hi, default=-1), text)], columns=[c.split(" ")[0] for c in CONTINUITY.split(", ")])

    return deliveries.groupBy("stream_id").applyInPandasWithState(run, CONTINUITY, CONTINUITY_STATE, "update", GroupStateTimeout.NoTimeout)


def continuity_batch(deliveries: DataFrame) -> DataFrame:
    """The same totals over a complete set of deliveries."""
    from strandline.operators import continuity

    kinds = continuity.classified(deliveries, "stream_id", "sequence", "chunk_id", "at").groupBy("stream_id").agg(
        F.count_distinct("sequence").alias("received"),
        F.count_if(F.col("kind") == "duplicate").alias("duplicates"),
        F.count_if(F.col("kind") == "conflict").alias("conflicts"),
        F.max("sequence").alias("max_sequence"),
    )
    runs = continuity.runs(deliveries, "stream_id", "sequence").groupBy("stream_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", "hi"))), lambda r: F.concat_ws("-", r.lo.cast("string"), r.hi.cast("string"))), ",").alias("runs")
    )
    return kinds.join(runs, "stream_id")


def first_deliveries(deliveries: DataFrame, delay: str = "1 hour") -> DataFrame:
    """At-least-once to once within a bounded delay (``at`` is the event-time column)."""
    return deliveries.withWatermark("at", delay).dropDuplicatesWithinWatermark(["chunk_id"])


def _rows_of(spark, store: str, key: str, schema: T.StructType, every: int) -> Store:
    return Store(spark, store, {"rows": Table(schema.simpleString()[len("struct<") : -1].replace(":", " "), (key,))}, every)


def upserted(spark, store: str, key: str) -> DataFrame:
    """The rows of a store that ``upsert_batch`` writes: of each key the one of the latest batch."""
    schema = T.StructType([f for f in spark.read.parquet(f"{store}/rows").schema if f.name != "batch"])
    return _rows_of(spark, store, key, schema, 1).read("rows")


def upsert_batch(store: str, key: str, body: str, at: str, every: int = 16):
    """A foreachBatch function: folds the batch into the Parquet store at ``store``. A batch writes one folder, of the keys
    whose newest body differs from what earlier batches hold, so that equal bodies keep their stamp and a batch that is run
    again overwrites its own folder with the same rows; what earlier batches hold is a snapshot and fewer than ``every``
    batches after it. ``upserted`` reads the store."""

    def write(batch: DataFrame, number: int) -> None:
        held = _rows_of(batch.sparkSession, store, key, batch.select(key, body, at).schema, every)
        last = batch.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(F.desc(at)))).where("_rn = 1").select(key, body, at)
        old = held.read("rows", number).select(key, F.col(body).alias("_was"), F.lit(True).alias("_held"))
        both = last.join(old, key, "left")
        held.write("rows", both.where(F.col("_held").isNull() | ~F.col(body).eqNullSafe(F.col("_was"))), number)
        held.commit(number)

    return write
