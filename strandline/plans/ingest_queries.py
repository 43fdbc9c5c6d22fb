"""Queries over uploads, ingest, dedup and continuity as streams, day-logs on demand and the nightly cycle, bound to the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import cycle, materialized, profiles, slots, stagegraph
from strandline.operators.stages import Stages
from strandline.plans.evaluation_queries import POLICY
from strandline.plans.record_queries import E, _events
from strandline.plans.window_queries import _slot_records
from strandline.sources import named, spool
from strandline.sources.tables import shared_folder, stream
from strandline.streaming import claims, continuity, ingest, uploads

ZONES = ["Europe/Paris", "America/Lima"]


def _uploads(spark, d):
    """Every event as an upload of its user's capture: some name a wrong digest, some a zone that is none."""
    e = _events(spark, d)
    body = F.encode(F.col("event_type"), "utf-8")
    claimed = F.when(F.col("event_id") % 50 == 7, "00").when(F.col("event_id") % 2 == 0, F.upper(F.sha2(body, 256)))
    zone = F.when(F.col("event_id") % 40 == 3, "PST").when(F.col("event_id") % 3 == 0, " Europe/Paris ").when(F.col("event_id") % 3 == 1, " ")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return e.select(
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("capture_id"), F.col("k").alias("segment_num"), F.col("user_id").cast("string").alias("user_id"), F.lit("phone").alias("device_id"),
        at.alias("t_start"), at.alias("t_end"), F.lit("audio/wav").alias("mime"), zone.alias("device_tz"), claimed.alias("sha256"), F.col("event_id").alias("received_at"), body.alias("body"),
    )


def _checked(spark, d):
    return spool.checked(_uploads(spark, d), spark.createDataFrame([(z,) for z in ZONES], "zone string"))


def refused_uploads(spark, d):
    return _checked(spark, d).select(F.explode("faults").alias("fault")).groupBy("fault").agg(F.count("*").alias("n"))


def _slices(rows, order, n):
    """``rows`` with ``part``, their place among n equal ranges of a number."""
    top = rows.agg(F.max(order).alias("top")).first().top or 0
    return rows.withColumn("part", F.least(F.lit(n - 1), F.floor(F.col(order) * n / (top + 1))).cast("int"))


def uploaded_segments(spark, d):
    """The accepted uploads, spooled in three batches and read as a stream: what each capture's ledger says."""
    folder = shared_folder(spark)
    good = _slices(spool.accepted(_checked(spark, d)), "received_at", 3)
    for n in range(3):
        spool.spool(good.where(F.col("part") == n).drop("part"), f"{folder}/spool", n)
    rows = named.stream_source(spark, "segment_spool", path=f"{folder}/spool")
    q = uploads.receipts(rows).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    q.awaitTermination()
    marks = _events(spark, d).select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("capture_id"), F.when(F.col("user_id") % 3 == 0, 50).when(F.col("user_id") % 3 == 1, 99).alias("ended_at_segment")).distinct()
    return uploads.ledger(spark.read.parquet(f"{folder}/rows"), marks.where("ended_at_segment is not null"))


def _stages():
    r = stagegraph.Registry()
    r.add(stagegraph.Stage("asr", "asr", lambda: F.decode("data", "utf-8"), required=True))
    r.add(stagegraph.Stage("diarize", "diarization", lambda: F.when(F.col("user_id").cast("long") % 3 != 0, F.concat(F.lit("S"), F.col("user_id"))), version="v2"))
    r.add(stagegraph.Stage("align", "transcript", lambda a, s: F.concat_ws(": ", s, a), needs=("asr", "diarization")))
    return r


def ingested_chunks(spark, d):
    """The events as deliveries in five micro-batches: chunks by state, with heals and attempts."""
    folder = shared_folder(spark)
    chunk = F.concat_ws(":", F.col("user_id").cast("string"), (F.col("k") % 10).cast("string"))
    digest = F.when(F.col("k") % 10 == 7, "bad").otherwise(F.sha2(F.encode(chunk, "utf-8"), 256))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    e = _events(spark, d).select(chunk.alias("chunk_id"), F.col("user_id").cast("string").alias("user_id"), F.lit("audio").alias("modality"), at.alias("t_start"), at.alias("t_end"), chunk.alias("blob_ref"), digest.alias("blob_sha256"), F.col("event_id").alias("seq"), (F.col("k") % 10).alias("m"))
    e.where("m <> 8").select("blob_ref", F.encode("blob_ref", "utf-8").alias("data"), (F.col("m") == 9).alias("deleted")).distinct().write.parquet(f"{folder}/blobs")
    blobs = spark.read.parquet(f"{folder}/blobs")
    sliced = _slices(e.drop("m"), "seq", 5)
    held = ingest.store(spark, f"{folder}/store", every=3)
    for n in range(5):  # a slice arrives, in as many files as it is read by, and is the stream's next micro-batch
        sliced.where(F.col("part") == n).drop("part").write.mode("append").parquet(f"{folder}/deliveries")
        rows = spark.readStream.schema(ingest.DELIVERY).parquet(f"{folder}/deliveries")
        q = rows.writeStream.foreachBatch(ingest.ingest(held, _stages(), blobs)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return ingest.totals(held)


def first_deliveries_streamed(spark, d):
    """The chunks of the events, each once, from the stream."""
    e = stream(spark, d, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), F.get_json_object("props", "$.k")).alias("chunk_id"), F.col("ts").cast("timestamp").alias("at"))
    folder = shared_folder(spark)
    q = claims.first_deliveries(e, "1 hour").writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("chunk_id")


def continuity_tracked(spark, d):
    """Continuity from the stream with bounded state; the last row of each stream is its total."""
    # arrival order is by identifier here
    at = F.timestamp_millis(F.col("event_id") + 1)
    e = stream(spark, d, "events").select(F.col("user_id").alias("stream_id"), F.get_json_object("props", "$.k").cast("long").alias("sequence"), F.col("event_type").alias("chunk_id"), at.alias("at"))
    folder = shared_folder(spark)
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key, None)
    spark.conf.set(key, continuity.PROVIDER)
    try:
        write = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/rows/batch_id={n}")
        q = continuity.tracked(e, "1 day").writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)
    last = spark.read.parquet(f"{folder}/rows").groupBy("stream_id").agg(F.max_by(F.struct("received", "duplicates", "conflicts", "max_sequence", "runs"), "batch").alias("r"))
    return last.select("stream_id", "r.*")


def daylog_fetches(spark, d):
    """The second fetch of every window's day-log, after some profiles changed and some went, and some windows were dropped."""
    records = _slot_records(spark, d)
    windows = records.select(F.col("user_id").cast("string").alias("user_id"), "window_id").distinct()
    u = F.col("user_id").cast("long")
    profile = lambda zone: windows.select("user_id").distinct().select("user_id", zone.alias("home_tz"))
    zones = spark.createDataFrame([("Etc/GMT-2",), ("UTC",)], "zone string")

    def build(todo):
        own = records.withColumn("user_id", F.col("user_id").cast("string")).join(todo.select("user_id", "window_id"), ["user_id", "window_id"], "left_semi")
        return slots.window_bodies(slots.text_blocks(slots.slot_lines(own), 600, "UTC", zones))

    held = materialized.store(spark, f"{shared_folder(spark)}/daylogs")
    first = profile(F.when(u % 5 == 0, None).otherwise("UTC")).where("home_tz is not null")
    materialized.fetched(held, windows, first, "2", "r1", build).write.format("noop").mode("overwrite").save()
    materialized.forgotten(held, windows.where(u % 7 == 1))
    second = profile(F.when(u % 5 == 0, None).when(u % 4 == 2, "Etc/GMT-2").otherwise("UTC")).where("home_tz is not null and user_id % 9 <> 4")
    return materialized.fetched(held, windows, second, "2", "r1", build).select("user_id", "window_id", "state", "home_tz", "n_blocks", F.length("corpus").cast("long").alias("chars"), "content_fingerprint")


def nightly_cycle(spark, d):
    """Two nights of every user, half a month each; a block is a day."""
    e = _events(spark, d).withColumns({"user_id": F.col("user_id").cast("string"), "day": F.dayofmonth("ts")})
    window = F.concat(F.lit("w"), F.when(F.col("day") <= 15, 1).otherwise(2).cast("string"))
    line = F.concat_ws(" ", F.col("event_id").cast("string"), "event_type", F.lit("at some length"))
    blocks = e.groupBy("user_id", window.alias("window_id"), F.col("day").cast("long").alias("block")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("said"), F.avg("value").alias("quality"))
    day = F.col("block").cast("string")
    profile = profiles.PROFILES["days"]
    blocks = blocks.select(
        "user_id", "window_id", "block", F.format_string("b%02d", "block").alias("block_id"), F.col("block").alias("first_bucket"), F.concat(F.lit("day "), day, F.lit("\n"), "said").alias("text"), "quality",
        profile.anchored(lambda name: day if name == "day" else F.lit("town")).alias("anchors"),
    )
    stages = Stages(spark, f"{shared_folder(spark)}/nights", cycle.OWNER)
    blocks = stages.held(blocks)  # both nights read them several times
    recipe, policy = cycle.Recipe("r1", ok_rate_min=0.5), POLICY | {"policy_id": "p1", "freeze": 2}
    out = None
    for w in ("w1", "w2"):
        night = cycle.night(stages, blocks.where(F.col("window_id") == w), recipe, policy, cycle.mock()).select("user_id", "window_id", "status")
        out = night if out is None else out.unionByName(night)
    return out


_UPLOADS = E + """, u as (select 'c' || user_id as capture_id, user_id, k, event_type, event_id from e where event_id % 50 <> 7 and event_id % 40 <> 3),
        r as (select *, row_number() over w as rn, first_value(event_type) over w as f from u window w as (partition by capture_id, k order by event_id))"""
_CHUNKS = E + """, t as (select max(event_id) as top from e), c as (select user_id || ':' || (k % 10) as chunk_id, any_value(user_id) as user_id, any_value(k % 10) as m, count(distinct least(4, event_id * 5 // (top + 1))) as nb from e, t group by 1),
        s as (select *, case when m in (7, 9) then 'dead_letter' when m = 8 and nb < 5 then 'pending' when m = 8 then 'dead_letter' else 'processed' end as state,
          case m when 7 then 'bytes differ from their digest' when 8 then 'bytes are unknown' when 9 then 'bytes are deleted' end as reason,
          case when m < 7 and user_id % 3 = 0 then least(nb - 1, 3) else 0 end as heals, case when m = 8 then nb when m in (7, 9) then 1 else 0 end as attempts from c)
        select state, reason, count(*) as n, sum(heals)::bigint as heals, sum(attempts)::bigint as attempts, count(*) filter (heals >= 3) as final from s group by 1, 2"""

QUERIES = {
    "refused_uploads": (refused_uploads, E + """select 'sha256: is not the body''s' as fault, count(*) as n from e where event_id % 50 = 7 having count(*) > 0
        union all select 'device_tz: is no known zone', count(*) from e where event_id % 40 = 3 having count(*) > 0"""),
    "uploaded_segments": (uploaded_segments, _UPLOADS + """ select capture_id, count(*) filter (rn = 1) as segments, count(*) filter (rn > 1 and event_type = f) as duplicates, count(*) filter (rn > 1 and event_type <> f) as conflicts, max(k) as last,
        any_value(case user_id % 3 when 0 then 50 when 1 then 99 end) as expected, any_value(case when user_id % 3 = 2 then 'open' else 'ended' end) as state from r group by 1
        having any_value(user_id % 3) <> 0 or max(k) <= 50
        union all select capture_id, count(*) filter (rn = 1), count(*) filter (rn > 1 and event_type = f), count(*) filter (rn > 1 and event_type <> f), max(k), 50, 'reopened' from r group by 1 having any_value(user_id % 3) = 0 and max(k) > 50"""),
    "ingested_chunks": (ingested_chunks, _CHUNKS),
    "first_deliveries_streamed": (first_deliveries_streamed, E + "select distinct user_id || ':' || k as chunk_id from e"),
    "continuity_tracked": (continuity_tracked, E + """, a as (select user_id, k, event_type, row_number() over w as rn, first_value(event_type) over w as f from e window w as (partition by user_id, k order by event_id)),
        u as (select distinct user_id, k from e), i as (select *, k - row_number() over (partition by user_id order by k) as g from u), r as (select user_id, min(k) as lo, max(k) as hi from i group by user_id, g),
        t as (select user_id, string_agg(lo || '-' || hi, ',' order by lo) as runs from r group by 1)
        select a.user_id as stream_id, count(distinct k) as received, count(*) filter (rn > 1 and event_type = f) as duplicates, count(*) filter (rn > 1 and event_type <> f) as conflicts, max(k) as max_sequence, any_value(runs) as runs
        from a join t using (user_id) group by 1"""),
    "daylog_fetches": (daylog_fetches, None),
    "nightly_cycle": (nightly_cycle, E + """, b as (select cast(user_id as varchar) as user_id, case when day(ts) <= 15 then 'w1' else 'w2' end as window_id, day(ts) as day, 4 + length(cast(day(ts) as varchar)) + 1 + sum(length(event_id || ' ' || event_type || ' at some length') + 1) - 1 as n, avg(value) as q from e group by 1, 2, 3),
        s as (select user_id, window_id, avg(case when 12 + least(n, 2000) + 12 > 120 then 1.0 else 0.0 end) filter (q >= 0) as ok, from b group by 1, 2)
        select user_id, window_id, case when ok is null then 'skipped_no_data' when ok >= 0.5 then 'published' else 'aborted' end as status from s"""),
}
