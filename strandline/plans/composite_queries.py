"""Composite queries: stage graphs, folds, claims, reply repair and corpus assembly over the given tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions import repair, text
from strandline.operators import folds, ledgers, running, stagegraph
from strandline.plans.record_queries import E, _events
from strandline.sources import files
from strandline.sources.tables import shared_folder, stream, table
from strandline.streaming import claims


def stage_graph() -> stagegraph.Registry:
    """Four mock stages over events: a required slot, an optional one that fails for some, and what depends on them."""
    r = stagegraph.Registry()
    r.add(stagegraph.Stage("asr", "asr", lambda: F.col("event_type"), required=True))
    r.add(stagegraph.Stage("diarize", "diarization", lambda: F.when(F.col("k") % 3 != 0, F.concat(F.lit("S"), (F.col("k") % 4).cast("string"))), version="v2"))
    r.add(stagegraph.Stage("align", "transcript", lambda a, d: F.concat_ws(": ", d, a), needs=("asr", "diarization")))
    r.add(stagegraph.Stage("tags", "acoustic", lambda a: F.when(a != "view", F.upper(a)), needs=("asr",), budget=18))
    return r


def enriched(spark, d):
    e = stagegraph.enrich(_events(spark, d).select("event_id", "event_type", "k"), stage_graph())
    return e.select("event_id", "record_ok", "pipeline_version", F.col("diarization.status").alias("diarization"), F.col("transcript.value").alias("transcript"), F.col("transcript.status").alias("transcript_status"), F.col("acoustic.status").alias("acoustic_status"))


def stage_holes(spark, d):
    e = stagegraph.enrich(_events(spark, d).select("event_id", "event_type", "k"), stage_graph())
    status = F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.col(f"{s}.status").alias("status")) for s in ("asr", "diarization", "transcript", "acoustic")]))
    return e.select(status.alias("x")).where("x.status <> 'ok'").groupBy("x.slot", "x.status").agg(F.count("*").alias("n"))


def _deliveries(spark, d):
    return _events(spark, d).select(F.concat_ws(":", F.col("user_id").cast("string"), (F.col("k") % 10).cast("string")).alias("chunk_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") < 7000, "v1").otherwise("v2").alias("version"), (F.col("event_type") != "error").alias("ok"))


def claim_verdicts(spark, d):
    return claims.claims_batch(_deliveries(spark, d)).groupBy("verdict").agg(F.count("*").alias("n"), F.max("heals").alias("most"))


def continuity_totals(spark, d):
    e = _events(spark, d).select(F.col("user_id").alias("stream_id"), F.col("k").alias("sequence"), F.col("event_type").alias("chunk_id"), F.col("event_id").alias("at"))
    return claims.continuity_batch(e)


def continuity_streamed(spark, d):
    """The table's files as a stream through keyed state; the last row of each stream is its total."""
    e = stream(spark, d, "events").select(F.col("user_id").alias("stream_id"), F.get_json_object("props", "$.k").cast("long").alias("sequence"), F.col("event_type").alias("chunk_id"), F.col("event_id").alias("at"))
    out = shared_folder(spark)
    write = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/rows/batch_id={n}")
    q = claims.continuity_stream(e).writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows").drop("batch_id")
    last = rows.withColumn("_r", F.row_number().over(W.partitionBy("stream_id").orderBy(F.desc("batch")))).where("_r = 1")
    return last.drop("_r", "batch")


def claims_streamed(spark, d):
    """Claim verdicts from the stream, counted."""
    e = stream(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    rows = e.select(F.concat_ws(":", F.col("user_id").cast("string"), (k % 10).cast("string")).alias("chunk_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") < 7000, "v1").otherwise("v2").alias("version"), (F.col("event_type") != "error").alias("ok"))
    out = shared_folder(spark)
    q = claims.claims_stream(rows).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows")
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy("verdict").agg(F.count("*").alias("n"), F.max("heals").alias("most"))


def near_repeats(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return folds.drop_near_repeats(c, "conv_id", "turn", "text")


def change_frames(spark, d):
    e = _events(spark, d).select("user_id", "event_id", F.array(F.col("value"), F.col("k") * 1.0, (F.col("k") % 7) * 5.0).alias("cells"))
    return folds.change_events(e, "user_id", "event_id", "cells", 100.0, 0.5)


def carve_points(spark, d):
    e = _events(spark, d).select("user_id", "event_id", (F.col("value") * 100).alias("level"))
    return folds.cut_points(e, "user_id", "event_id", "level", 2, 10, 30)


def carved_spans(spark, d):
    totals = _events(spark, d).groupBy("user_id").agg(F.count("*").alias("total"))
    return folds.adjacent_spans(carve_points(spark, d), totals, "user_id", "total")


def fixed_carve(spark, d):
    return folds.fixed_spans(_events(spark, d).groupBy("user_id").agg(F.count("*").alias("total")), "user_id", "total", 25)


def repaired_replies(spark, d):
    e = _events(spark, d)
    good = F.concat(F.lit('{"application": "'), F.col("event_type"), F.lit('", "action": "a'), F.col("k").cast("string"), F.lit('", "summary": "x"}'))
    shape = F.col("event_id") % 6
    raw = F.when(shape == 0, good).when(shape == 1, F.concat(F.lit("Sure:\n```json\n"), good, F.lit("\n```"))).when(shape == 2, F.concat(F.lit("It is "), good, F.lit(" ok"))).when(shape == 3, F.replace(good, F.lit("}"), F.lit(",}"))).when(shape == 4, F.left(good, F.length(good) - 4)).otherwise(F.lit("  "))
    return e.select("event_id", repair.repair_reply(raw).alias("r")).select("event_id", "r.step", "r.app", "r.activity")


def replay_sample(spark, d):
    pool = table(spark, d, "documents").select("doc_id", "source", F.posexplode(text.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("n", "p"))
    pool = pool.withColumns({"size": F.length("p"), "u": F.md5(F.concat_ws(":", F.lit("11"), F.col("doc_id").cast("string"), F.col("n").cast("string")))})
    got = running.before(pool, "source", running.by_digits(F.col("u")), ["u", "doc_id", "n"], F.col("size"), F.lit(3000))
    return got.select("source", "doc_id", "n", "used_before")


def suite_assembly(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source"))
    parts = [("new_day", F.col("source") == "src1", 60), ("traps", F.col("source") == "src2", 50), ("heldout", F.col("source") == "src3", 60)]
    out = None
    for name, on, n in parts:
        own = ledgers.first_n(docs.where(on).withColumn("suite", F.lit(name)), n, "suite", "doc_id").select("suite", "doc_id", "rank")
        out = own if out is None else out.unionByName(own)
    return out


def seeded_order(spark, d):
    docs = table(spark, d, "documents").select("lang", "doc_id", F.md5(F.concat_ws("|", F.lit("3"), F.col("doc_id").cast("string"))).alias("u"))
    return running.ranked(docs, "lang", running.by_digits(F.col("u")), ["u", "doc_id"], "place").select("lang", "doc_id", "place")


def metric_lines(spark, d):
    return files.exposition(_events(spark, d).groupBy("event_type", (F.col("k") % 3).alias("lane")).agg(F.count("*").alias("n")), "deliveries_total", "n", "event_type", "lane")


def adapter_versions(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("window"), F.count("*").alias("n"))
    return o.select("o_custkey", F.left(F.sha2(F.concat_ws("\0", F.col("o_custkey").cast("string"), F.col("window").cast("string")), 256), F.lit(12)).alias("version"))


def user_messages(spark, d):
    said = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.sha2(F.array_join(said.text, "\n"), 256).alias("prompt"))


def turn_pairs(spark, d):
    c = table(spark, d, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn")
    return c.withColumns({"r": F.lag("role").over(w), "t": F.lag("turn").over(w)}).where("role = 'assistant' and r = 'user'").select("conv_id", F.col("t").alias("ask"), F.col("turn").alias("reply"))


def rolled_up_days(spark, d):
    e = _events(spark, d)
    return e.groupBy(F.date_format("ts", "yyyyMMdd").alias("day")).agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("event_type") == "error").alias("errors"), F.bool_and(F.col("value") >= 0).alias("ok"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds")
    )


_DEL = E + ", v as (select user_id || ':' || k % 10 as chunk_id, event_id as seq, case when event_id < 7000 then 'v1' else 'v2' end as version, event_type <> 'error' as ok from e) "

_CONTINUITY = E + """, a as (select user_id, k, event_type, row_number() over w as rn, first_value(event_type) over w as f from e window w as (partition by user_id, k order by event_id)),
        u as (select distinct user_id, k from e), i as (select *, k - row_number() over (partition by user_id order by k) as g from u), r as (select user_id, min(k) as lo, max(k) as hi from i group by user_id, g),
        t as (select user_id, string_agg(lo || '-' || hi, ',' order by lo) as runs from r group by 1)
        select a.user_id as stream_id, count(distinct k) as received, count(*) filter (rn > 1 and event_type = f) as duplicates, count(*) filter (rn > 1 and event_type <> f) as conflicts, max(k) as max_sequence, any_value(runs) as runs
        from a join t using (user_id) group by 1"""

QUERIES = {
    "enriched": (enriched, E + """select event_id, true as record_ok, 'align@v1+asr@v1+diarize@v2+tags@v1' as pipeline_version, case when k % 3 <> 0 then 'ok' else 'failed' end as diarization,
        case when k % 3 <> 0 then 'S' || k % 4 || ': ' || event_type end as transcript, case when k % 3 <> 0 then 'ok' else 'cancelled' end as transcript_status,
        case when event_type = 'view' or length(event_type) + 8 > 18 then 'failed' else 'ok' end as acoustic_status from e"""),
    "stage_holes": (stage_holes, E + """, s as (select 'diarization' as slot, 'failed' as status from e where k % 3 = 0 union all select 'transcript', 'cancelled' from e where k % 3 = 0
        union all select 'acoustic', 'failed' from e where event_type = 'view' or length(event_type) + 8 > 18) select slot, status, count(*) as n from s group by 1, 2"""),
    "claim_verdicts": (claim_verdicts, None),
    "continuity_totals": (continuity_totals, _CONTINUITY),
    "continuity_streamed": (continuity_streamed, _CONTINUITY),
    "claims_streamed": (claims_streamed, None),
    "near_repeats": (near_repeats, None),
    "change_frames": (change_frames, None),
    "carve_points": (carve_points, None),
    "carved_spans": (carved_spans, None),
    "fixed_carve": (fixed_carve, "with c as (select user_id, count(*) as total from events group by 1) select user_id, s * 25 as start, least(s * 25 + 25, total) as stop from c, range(1000) r(s) where s * 25 < total"),
    "repaired_replies": (repaired_replies, E + """select event_id, case event_id % 6 when 0 then 'strict' when 1 then 'fenced' when 2 then 'balanced' when 3 then 'mended' when 4 then 'salvaged' else 'empty' end as step,
        case when event_id % 6 < 5 then event_type end as app, case when event_id % 6 < 5 then 'a' || k end as activity from e"""),
    "replay_sample": (replay_sample, """with p as (select doc_id, source, unnest(list_filter(string_split(text, chr(10)), lambda x: length(x) > 100)) as p, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: length(x) > 100), 1) - 1 as n from documents),
        b as (select source, doc_id, cast(n as integer) as n, cast(coalesce(sum(length(p)) over (partition by source order by md5('11:' || doc_id || ':' || n), doc_id, n rows between unbounded preceding and 1 preceding), 0) as bigint) as used_before from p) select * from b where used_before < 3000"""),
    "suite_assembly": (suite_assembly, """with s as (select case source when 'src1' then 'new_day' when 'src2' then 'traps' else 'heldout' end as suite, doc_id from documents where source in ('src1', 'src2', 'src3'))
        select suite, doc_id, cast(row_number() over (partition by suite order by doc_id) as integer) as rank from s qualify rank <= case suite when 'traps' then 50 else 60 end"""),
    "seeded_order": (seeded_order, "select lang, doc_id, cast(row_number() over (partition by lang order by md5('3|' || doc_id), doc_id) as integer) as place from documents"),
    "metric_lines": (metric_lines, E + "select 'deliveries_total{event_type=\"' || event_type || '\",lane=\"' || k % 3 || '\"} ' || count(*) as line from e group by event_type, k % 3"),
    "adapter_versions": (adapter_versions, "select o_custkey, sha256(o_custkey || chr(0) || max(o_orderkey))[1:12] as version from orders group by 1"),
    "user_messages": (user_messages, "select conv_id, sha256(string_agg(text, chr(10) order by turn)) as prompt from conversations where role = 'user' group by 1"),
    "turn_pairs": (turn_pairs, "with l as (select *, lag(role) over w as r, lag(turn) over w as t from conversations window w as (partition by conv_id order by turn)) select conv_id, t as ask, turn as reply from l where role = 'assistant' and r = 'user'"),
    "rolled_up_days": (rolled_up_days, "select strftime(ts, '%Y%m%d') as day, count(*) as n, count(distinct user_id) as users, count(*) filter (event_type = 'error') as errors, bool_and(value >= 0) as ok, string_agg(distinct event_type, ',' order by event_type) as kinds from events group by 1"),
}
