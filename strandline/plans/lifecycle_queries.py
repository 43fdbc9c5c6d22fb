"""Queries over the life of captures, windows and evaluations, bound to the given tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions import stats
from strandline.operators import lifecycle, ledgers
from strandline.plans.function_queries import decay_matrix
from strandline.plans.record_queries import E, _events
from strandline.sources.tables import table


def monotone_marks(spark, d):
    return lifecycle.monotone(_events(spark, d), "user_id", "k")


def reopened_captures(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.lit(4)).alias("ended"))
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return lifecycle.reopened(o, s, "o_orderkey", "ended", "l_linenumber").select("o_orderkey", "open_again")


def reset_failed(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    after, keys = lifecycle.reset(rows, "o_orderstatus", "P", "O")
    return after.groupBy("o_orderstatus").agg(F.count("*").alias("n")).crossJoin(keys.agg(F.count("*").alias("n_reset")))


def acknowledged_chunks(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "unemitted").otherwise("accepted").alias("status"))
    done = table(spark, d, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("o_orderkey"))
    return lifecycle.acknowledged(o, done, "o_orderkey", "status")


def window_closes(spark, d):
    c = _events(spark, d).withColumn("window", F.concat_ws("/", F.col("user_id").cast("string"), (F.col("k") % 5).cast("string")))
    return lifecycle.closed(c, "window", "event_type", "event_id").groupBy("answer").agg(F.count("*").alias("n"))


def redrive_plan(spark, d):
    p = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 6).alias("attempts"))
    done = table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return lifecycle.redriven(p, done, "o_orderkey", "attempts", 3).select("o_orderkey", "action")


def heal_budget(spark, d):
    a = _events(spark, d).select(F.concat_ws(":", F.col("user_id").cast("string"), (F.col("k") % 20).cast("string")).alias("chunk"), "event_id", (F.col("event_type") == "purchase").alias("ok"))
    return lifecycle.healed(a, "chunk", "event_id", "ok", 3)


def epoch_guard(spark, d):
    e = _events(spark, d).withColumn("epoch", F.col("k") % 4)
    now = e.groupBy("user_id").agg(F.max("epoch").alias("epoch"))
    return lifecycle.guarded(e, now, "user_id", "epoch").select("event_id", "user_id")


def failure_kinds(spark, d):
    s = F.when(F.col("k") < 50, 200).when(F.col("k") < 70, 503).when(F.col("k") < 90, 422)
    return _events(spark, d).select("event_id", lifecycle.failure_kind(s, F.col("event_id") % 5, 3).alias("kind"))


def dead_letter_samples(spark, d):
    got = lifecycle.capped_samples(_events(spark, d).where("event_type = 'error'"), "user_id", "event_id", 5)
    return got.select("user_id", "n", F.array_join(F.col("samples").cast("array<string>"), ",").alias("samples"))


def block_zones(spark, d):
    z = F.element_at(F.array(F.lit(None).cast("string"), F.lit("Europe/Paris"), F.lit("Mars/Base"), F.lit("Asia/Tokyo")), (F.col("k") % 4 + 1).cast("int"))
    e = _events(spark, d).withColumn("zone", z).withColumn("block", F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")))
    return lifecycle.zone_of_block(e, "block", "event_id", "zone", F.col("_z").isin("Europe/Paris", "Asia/Tokyo"), F.lit("UTC"))


def assembled_records(spark, d):
    e = _events(spark, d).select(
        F.col("user_id").cast("string").alias("user_id"), F.lit("audio").alias("modality"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("stream_id"), "chunk_id",
        F.when(F.col("k") % 2 == 0, "UTC").alias("device_tz"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t_start"), "event_type",
    )
    slots = F.struct(F.struct(F.col("event_type").alias("value")).alias("asr"))
    return lifecycle.assembled(e, slots, "asr@v1").select("record_id", F.length("record_json").alias("n"))


def identity_check(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("server"), F.lit("type").alias("path"), F.col("p_type").alias("value")).distinct()
    want = table(spark, d, "part").select(F.col("p_brand").alias("server")).distinct().crossJoin(F.broadcast(spark.createDataFrame([("type", "ECONOMY"), ("type", "GIANT")], "path string, value string")))
    return lifecycle.identity_mismatches(want, p, "server", "path", "value")


def readouts(spark, d):
    m = decay_matrix(spark, d)
    base = m.groupBy("day").agg(F.min("score").alias("score"))
    return lifecycle.readouts(m, base, "step", "day").select("step", F.round("seen", 9).alias("seen"), F.round("base", 9).alias("base"), F.round("separation", 9).alias("separation"))


def frame_counts(spark, d):
    return lifecycle.frame_plan(table(spark, d, "part"), "p_partkey", "p_size", 4.0, 2, 10)


def change_classes(spark, d):
    cells = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.pmod(F.col("p_partkey") * i, F.col("p_size") + 1).cast("int"))
    p = table(spark, d, "part").select("p_partkey", lifecycle.map_summary(cells).alias("s"))
    return p.select("p_partkey", "s.peak", "s.spread", lifecycle.change_class(F.col("s.peak"), F.col("s.spread"), 8, 40).alias("kind"))


def retry_delays(spark, d):
    n = F.col("k") % 8
    return _events(spark, d).select("event_id", lifecycle.backoff(n.cast("double"), 0.5, 30.0).alias("delay"), lifecycle.linear_backoff(n + 1, 0.5).alias("linear"))


def windowed_rms(spark, d):
    e = _events(spark, d).withColumn("hop", F.floor(F.col("event_id") / 20)).withColumn("s", F.round(F.col("value")).cast("long"))
    return e.groupBy("hop").agg(F.sum(F.col("s") * F.col("s")).alias("energy"), F.count("*").alias("n")).select("hop", F.round(F.sqrt(F.col("energy") / F.col("n")), 6).alias("rms"))


def quiet_threshold(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.greatest(F.lit(200.0), 2.5 * F.percentile(F.col("p_size") * 10, 0.2)).alias("threshold"))


def quality_gate(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return j.where(F.col("quality").isNull() | (F.col("quality") >= 1)).select("doc_id", "quality")


def block_quality(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return j.groupBy("source").agg(F.min("quality").alias("quality"), F.max("n_chars").alias("longest"), F.count_if(F.col("n_chars") > 6000).alias("over_cap"), F.count("*").alias("n"))


def validity_gate(spark, d):
    t = F.col("text")
    ok = (F.length(F.trim(t)) > 120) & ~t.contains("RECORD") & t.contains("the")
    early = F.substring(t, 1, 300).rlike("(?i)password|secret|idiot")
    return table(spark, d, "documents").select("doc_id", ok.alias("valid"), early.alias("calibration"))


def routes(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    r = spark.createDataFrame([("BUILDING", "fast"), ("MACHINERY", "slow"), ("*", "default")], "c_mktsegment string, route string")
    base = r.where("c_mktsegment = '*'").select(F.col("route").alias("base"))
    return c.join(F.broadcast(r), "c_mktsegment", "left").crossJoin(F.broadcast(base)).select("c_custkey", F.coalesce("route", "base").alias("route"))


def last_marker(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.substring_index("text", ". ", -1).alias("tail"))


def permanent_holes(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("attempts"), F.array_distinct(F.collect_list("l_returnflag")).alias("flags"))
    return li.where("attempts >= 6").select(F.explode("flags").alias("stage")).where("stage <> 'A'").groupBy("stage").agg(F.count("*").alias("n"))


def new_spans(spark, d):
    e = _events(spark, d).select("user_id", "event_id", F.least(F.greatest(F.col("value"), F.lit(0.0)), F.lit(60.0)).alias("a"), F.least(F.greatest(F.col("k") * 1.0, F.lit(0.0)), F.lit(60.0)).alias("b"))
    return e.where("b > a").select("user_id", "event_id", F.row_number().over(W.partitionBy("user_id").orderBy("a", "event_id")).alias("place"))


def adjacent_loss(spark, d):
    return stats.spread(table(spark, d, "orders").withColumn("n", F.col("o_custkey") % 50), "n", "o_orderpriority").select("o_orderpriority", "n", "least", "greatest", F.col("median"))


def feedback_rows(spark, d):
    c = table(spark, d, "conversations")
    return c.where(F.col("role").isin("user", "assistant")).select("conv_id", "turn", F.left("text", F.lit(50)).alias("note"), F.when(F.col("turn") % 2 == 0, "up").otherwise("down").alias("rating"))


def seen_before(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id")
    nights = docs.withColumn("night", F.col("doc_id") % 9)
    per = nights.groupBy("night").agg(F.count("*").alias("n"))
    return per.select("night", "n", F.sum("n").over(W.orderBy("night").rowsBetween(W.unboundedPreceding, -1)).alias("before"))


def probes_per_day(spark, d):
    return ledgers.first_n(table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"), 2, "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey").select("l_suppkey", "l_orderkey", "rank")


QUERIES = {
    "monotone_marks": (monotone_marks, E + "select user_id, greatest(coalesce(max(k), 0), 0) as k from e group by 1"),
    "reopened_captures": (reopened_captures, "select o_orderkey, coalesce(o_orderstatus = 'F' and top > 4, false) as open_again from orders left join (select l_orderkey, max(l_linenumber) as top from lineitem group by 1) on o_orderkey = l_orderkey"),
    "reset_failed": (reset_failed, "select case o_orderstatus when 'P' then 'O' else o_orderstatus end as o_orderstatus, count(*) as n, (select count(*) from orders where o_orderstatus = 'P') as n_reset from orders group by 1"),
    "acknowledged_chunks": (acknowledged_chunks, "select o_orderkey, case when o_orderstatus = 'P' then 'unemitted' when o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'N') then 'confirmed' else 'accepted' end as status from orders"),
    "window_closes": (window_closes, E + """, a as (select event_type, row_number() over w as rn, first_value(event_type) over w as f from e window w as (partition by user_id, k % 5 order by event_id))
        select case when rn = 1 then 'ok' when event_type = f then 'same' else 'conflict' end as answer, count(*) as n from a group by 1"""),
    "redrive_plan": (redrive_plan, "select o_orderkey, case when o_custkey % 6 < 3 then 'again' when o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'A') then 'finalize' else 'dead_letter' end as action from orders"),
    "heal_budget": (heal_budget, E + """, a as (select user_id || ':' || k % 20 as chunk, event_type = 'purchase' as ok, row_number() over (partition by user_id, k % 20 order by event_id) - 1 as i from e), g as (select chunk, min(i) filter (ok) as g, max(i) as n from a group by 1)
        select chunk, cast(least(coalesce(g, n), 3) as integer) as heals, coalesce(g <= 3, false) as whole, coalesce(g <= 3, false) or n >= 3 as final from g"""),
    "epoch_guard": (epoch_guard, E + "select event_id, user_id from e qualify k % 4 = max(k % 4) over (partition by user_id)"),
    "failure_kinds": (failure_kinds, E + ", s as (select event_id, case when k < 50 then 200 when k < 70 then 503 when k < 90 then 422 end as s from e) select event_id, case when s between 200 and 299 then 'done' when (s is null or s >= 500) and event_id % 5 < 3 then 'retry' else 'dead_letter' end as kind from s"),
    "dead_letter_samples": (dead_letter_samples, "with r as (select *, row_number() over (partition by user_id order by event_id) as r from events where event_type = 'error') select user_id, count(*) as n, string_agg(event_id, ',' order by event_id) filter (r <= 5) as samples from r group by 1"),
    "block_zones": (block_zones, E + """, z as (select user_id || '/' || strftime(ts, '%Y%m%d') as block, event_id, case k % 4 when 1 then 'Europe/Paris' when 2 then 'Mars/Base' when 3 then 'Asia/Tokyo' end as zone from e),
        f as (select block, arg_min(zone, event_id) filter (zone is not null) as z from z group by 1) select block, case when z in ('Europe/Paris', 'Asia/Tokyo') then z else 'UTC' end as zone from f"""),
    "assembled_records": (assembled_records, E + """select sha256(chunk_id || chr(0) || 'asr@v1') as record_id, cast(length('{"user_id":"' || user_id || '","modality":"audio","source":{"stream_id":"s' || user_id || '","chunk_id":"' || chunk_id || '"' || case when k % 2 = 0 then ',"device_tz":"UTC"' else '' end
        || '},"t_start":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","pipeline_version":"asr@v1","slots":{"asr":{"value":"' || event_type || '"}}}') as integer) as n from e"""),
    "identity_check": (identity_check, "select server, 'type' as path, value from (select distinct p_brand as server from part), (select unnest(['ECONOMY', 'GIANT']) as value) where (server, value) not in (select (p_brand, p_type) from part)"),
    "readouts": (readouts, """with m as (select cast(source[4:] as integer) as step, cast(doc_id % 20 as integer) as day, avg(quality) as score from documents join labels using (doc_id) where doc_id % 20 <= cast(source[4:] as integer) group by 1, 2),
        b as (select day, min(score) as base from m group by 1) select step, round(avg(score), 9) as seen, round(avg(base), 9) as base, round(avg(score) - avg(base), 9) as separation from m join b using (day) group by 1"""),
    "frame_counts": (frame_counts, "select p_partkey, cast(greatest(2, least(10, ceil(p_size / 4.0::double))) as integer) as n_frames from part"),
    "change_classes": (change_classes, """with m as (select p_partkey, cast(max(p_partkey * i % (p_size + 1)) as integer) as peak, cast(count(*) filter (p_partkey * i % (p_size + 1) >= 13) as integer) as spread from part, range(1, 65) r(i) group by 1)
        select p_partkey, peak, spread, case when peak <= 8 then 'IDLE' when peak > 40 or spread > 32 then 'LAYOUT' else 'TEXT' end as kind from m"""),
    "retry_delays": (retry_delays, E + "select event_id, least(30.0::double, 0.5::double * pow(2.0::double, k % 8)) as delay, 0.5::double * (k % 8 + 1) as linear from e"),
    "windowed_rms": (windowed_rms, "select event_id // 20 as hop, round(sqrt(sum(cast(round(value) as bigint) * cast(round(value) as bigint)) / count(*)), 6) as rms from events group by 1"),
    "quiet_threshold": (quiet_threshold, "select p_brand, greatest(200.0::double, 2.5::double * quantile_cont(10 * p_size::double, 0.2)) as threshold from part group by 1"),
    "quality_gate": (quality_gate, "select doc_id, quality from documents left join labels using (doc_id) where quality is null or quality >= 1"),
    "block_quality": (block_quality, "select source, min(quality) as quality, max(n_chars) as longest, count(*) filter (n_chars > 6000) as over_cap, count(*) as n from documents left join labels using (doc_id) group by 1"),
    "validity_gate": (validity_gate, "select doc_id, length(trim(text)) > 120 and not contains(text, 'RECORD') and contains(text, 'the') as valid, regexp_matches(lower(substr(text, 1, 300)), 'password|secret|idiot') as calibration from documents"),
    "routes": (routes, "select c_custkey, case c_mktsegment when 'BUILDING' then 'fast' when 'MACHINERY' then 'slow' else 'default' end as route from customer"),
    "last_marker": (last_marker, "select item_id, string_split(text, '. ')[-1] as tail from benchmark"),
    "permanent_holes": (permanent_holes, "with o as (select l_orderkey from lineitem group by 1 having max(l_linenumber) >= 6) select l_returnflag as stage, count(distinct l_orderkey) as n from lineitem where l_orderkey in (select l_orderkey from o) and l_returnflag <> 'A' group by 1"),
    "new_spans": (new_spans, E + ", s as (select user_id, event_id, least(greatest(value, 0), 60) as a, least(greatest(k, 0), 60) as b from e) select user_id, event_id, cast(row_number() over (partition by user_id order by a, event_id) as integer) as place from s where b > a"),
    "adjacent_loss": (adjacent_loss, "select o_orderpriority, count(*) as n, min(o_custkey % 50) as least, max(o_custkey % 50) as greatest, median(o_custkey % 50) as median from orders group by 1"),
    "feedback_rows": (feedback_rows, "select conv_id, turn, substr(text, 1, 50) as note, case when turn % 2 = 0 then 'up' else 'down' end as rating from conversations where role in ('user', 'assistant')"),
    "seen_before": (seen_before, "with n as (select doc_id % 9 as night, count(*) as n from documents group by 1) select night, n, cast(sum(n) over (order by night rows between unbounded preceding and 1 preceding) as bigint) as before from n"),
    "probes_per_day": (probes_per_day, "select l_suppkey, l_orderkey, cast(row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) as integer) as rank from lineitem qualify rank <= 2"),
}
