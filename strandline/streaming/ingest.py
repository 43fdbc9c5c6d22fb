"""Ingest of a micro-batch: claim, fetch, enrich, write the record and finalise, in one commit.

A delivery names a chunk and where its bytes lie. A chunk without a receipt is fresh; a receipt of another pipeline version is
moved forward; one with holes is healed while its budget lasts; the rest are skipped and answered with the record there is.
The first delivery of a chunk in a batch claims it, further ones find it in flight: a chunk runs once a batch. Bytes that are
deleted, or whose digest differs, and records whose required stages fail are dead letters, which a later delivery takes up
again; unknown bytes may still come, so the chunk stays pending for its next delivery, up to a cap. A heal that fails keeps
the record and counts, as one does that leaves holes; a receipt with holes and no budget left is final. There is one record
a chunk and version; an unchanged one keeps the batch that wrote it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import stagegraph
from strandline.streaming.claims import HEAL_BUDGET
from strandline.streaming.store import Store, Table, remove

#: Deliveries of a chunk whose bytes are unknown before it is given up.
ATTEMPTS = 5
DELIVERY = "chunk_id string, user_id string, modality string, t_start string, t_end string, blob_ref string, blob_sha256 string, seq long"

TABLES = {
    "records": Table("record_id string, chunk_id string, user_id string, pipeline_version string, record_json string, batch long", ("record_id",)),
    "ledger": Table("chunk_id string, state string, pipeline_version string, record_id string, green boolean, heals int, done_final boolean, attempts int, superseded string, reason string", ("chunk_id",)),
    "answers": Table("chunk_id string, seq long, verdict string, record_id string"),
}


def store(spark: SparkSession, path: str, every: int = 16) -> Store:
    """The store that batches of ``ingest`` write: records, ledger and answers."""
    return Store(spark, path, TABLES, every)


def _claimed(batch: DataFrame, ledger: DataFrame, version: str) -> DataFrame:
    """One row per chunk of the batch: its first delivery (d.*), its receipt (l.*) and the verdict on it."""
    held = F.struct(*[c for c in batch.columns if c != "chunk_id"])
    own = batch.groupBy("chunk_id").agg(F.min_by(held, "seq").alias("d"))
    both = own.join(ledger.select("chunk_id", F.struct(*[c for c in ledger.columns if c != "chunk_id"]).alias("l")), "chunk_id", "left")
    verdict = (
        F.when(F.coalesce(F.col("l.state") != "processed", F.lit(True)), "fresh")
        .when(F.col("l.pipeline_version") != version, "version_forward")
        .when(~F.col("l.green") & ~F.col("l.done_final"), "heal")
        .otherwise("skip")
    )
    return both.withColumn("verdict", verdict)


def _json(registry: stagegraph.Registry, version: str) -> Column:
    """The record's text: slots that are ok, each with its version; optional fields and holes are left out."""
    slots = [F.when(F.col(f"{s.slot}.status") == "ok", F.struct(F.col(f"{s.slot}.value").alias("value"), F.lit(s.version).alias("version"))).alias(s.slot) for s in registry.resolved()]
    return F.to_json(F.struct("record_id", "chunk_id", "d.user_id", "d.modality", "d.t_start", "d.t_end", F.lit(version).alias("pipeline_version"), F.struct(*slots).alias("slots")))


def processed(claimed: DataFrame, blobs: DataFrame, registry: stagegraph.Registry) -> DataFrame:
    """The claimed chunks that run, with ``outcome`` (done, dead_letter or pending), ``reason``, green, record_id, record_json.

    ``blobs``: (blob_ref, data, deleted). Stages see the bytes as ``data`` and the delivery's fields."""
    version = registry.version()
    rows = claimed.where("verdict <> 'skip'").withColumn("blob_ref", F.col("d.blob_ref"))
    held = rows.join(blobs.select("blob_ref", "data", F.col("deleted").alias("_gone")), "blob_ref", "left")
    fields = {c: F.col(f"d.{c}") for c in ("user_id", "modality", "t_start", "t_end")}
    ran = stagegraph.enrich(held.withColumns(fields), registry).withColumn("record_id", F.sha2(F.concat(F.col("chunk_id"), F.lit("\0" + version)), 256))
    bad = (
        F.when(F.coalesce("_gone", F.lit(False)), "bytes are deleted")
        .when(F.col("data").isNull(), "bytes are unknown")
        .when(F.sha2(F.col("data"), 256) != F.col("d.blob_sha256"), "bytes differ from their digest")
        .when(~F.col("record_ok"), "a required stage failed")
    )
    green = F.forall(F.array(*[F.col(f"{s.slot}.status") for s in registry.resolved()]), lambda s: s == "ok")
    outcome = F.when(F.col("reason").isNull(), "done").when(F.col("reason") == "bytes are unknown", "pending").otherwise("dead_letter")
    out = ran.withColumn("reason", bad).withColumns({"outcome": outcome, "green": green & F.col("reason").isNull(), "record_json": _json(registry, version)})
    return out.select("chunk_id", "d", "l", "verdict", "outcome", "reason", "green", "record_id", "record_json")


def receipts(ran: DataFrame, version: str) -> DataFrame:
    """The ledger rows that a batch's runs leave."""
    heal, done = F.col("verdict") == "heal", F.col("outcome") == "done"
    kept = heal & ~done  # a heal that failed: the record stays what it was
    green = F.when(kept, F.col("l.green")).when(done, F.col("green"))
    heals = F.when(heal, F.col("l.heals") + F.when(done & F.col("green"), 0).otherwise(1)).otherwise(0).cast("int")
    # a dead letter that is delivered again begins anew
    tried = F.when(F.coalesce(F.col("l.state") == "pending", F.lit(False)), F.col("l.attempts")).otherwise(0) + 1
    attempts = F.when(done | kept, 0).otherwise(tried).cast("int")
    state = F.when(done | kept, "processed").when((F.col("outcome") == "pending") & (tried < ATTEMPTS), "pending").otherwise("dead_letter")
    was = F.col("l.pipeline_version")
    return ran.select(
        "chunk_id",
        state.alias("state"),
        F.lit(version).alias("pipeline_version"),
        F.when(kept, F.col("l.record_id")).when(done, F.col("record_id")).alias("record_id"),
        green.alias("green"),
        heals.alias("heals"),
        F.when(done | kept, ~green & (heals >= HEAL_BUDGET)).alias("done_final"),
        attempts.alias("attempts"),
        F.when(was != version, was).otherwise(F.col("l.superseded")).alias("superseded"),
        F.when(~done, F.col("reason")).alias("reason"),
    )


def ingest(held: Store, registry: stagegraph.Registry, blobs: DataFrame, after: Callable[[str], None] | None = None):
    """A foreachBatch function that takes deliveries into the store. ``after``: called after each write, for tests."""
    version = registry.version()

    def write(batch: DataFrame, number: int) -> None:
        deliveries = batch.select(*[c.strip().split(" ")[0] for c in DELIVERY.split(",")])
        folder = f"{held.path}/runs/batch={number}"

        def once(rows: DataFrame, name: str) -> DataFrame:
            """The rows, written down: they are made once, whatever reads them."""
            rows.write.mode("overwrite").parquet(f"{folder}/{name}")
            return held.spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

        claimed = once(_claimed(deliveries, held.read("ledger", number), version), "claimed")
        ran = once(processed(claimed, blobs, registry), "ran")

        made = ran.where("outcome = 'done'").select("record_id", "chunk_id", "d.user_id", F.lit(version).alias("pipeline_version"), "record_json", F.lit(number).alias("batch"))
        old = held.read("records", number).select("record_id", F.col("record_json").alias("_was"))
        held.write("records", made.join(old, "record_id", "left").where("_was is null or _was <> record_json"), number)
        _told(after, "records")
        ledger = receipts(ran, version)
        held.write("ledger", ledger, number)
        _told(after, "ledger")
        first = claimed.select("chunk_id", "verdict", F.col("d.seq").alias("_first"), F.when(F.col("verdict") == "skip", F.col("l.record_id")).alias("_old"))
        told = deliveries.select("chunk_id", "seq").join(first, "chunk_id").join(ledger.select("chunk_id", "record_id"), "chunk_id", "left")
        verdict = F.when((F.col("seq") > F.col("_first")) & (F.col("verdict") != "skip"), "inflight").otherwise(F.col("verdict"))
        held.write("answers", told.select("chunk_id", "seq", verdict.alias("verdict"), F.coalesce("_old", "record_id").alias("record_id")), number)
        _told(after, "answers")
        held.commit(number)
        remove(held.spark, folder)

    return write


def _told(after: Callable[[str], None] | None, table: str) -> None:
    if after is not None:
        after(table)


def totals(held: Store) -> DataFrame:
    """Chunks by state and reason, with their heals and attempts."""
    return held.read("ledger").groupBy("state", "reason").agg(F.count("*").alias("n"), F.sum("heals").alias("heals"), F.sum("attempts").alias("attempts"), F.count_if("done_final").alias("final"))
