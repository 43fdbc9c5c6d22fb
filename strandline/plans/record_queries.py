"""Queries over the record store, continuity, ranges and ledgers, bound to the given tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.operators import continuity, daylog, ledgers, ranges, records, running
from strandline.sources.tables import table

#: The events table as records, for the oracle.
E = """with e as (select *, cast(user_id as varchar) || ':' || json_extract_string(props, '$.k') || ':' || strftime(ts, '%Y%m%d') as chunk_id,
  ts + to_minutes(event_id % 97) as updated_at, cast(json_extract_string(props, '$.k') as bigint) as k, epoch_us(ts) as us from events) """


def _events(spark, d):
    e = daylog.with_stream_columns(table(spark, d, "events"))
    return e.withColumns({"k": F.get_json_object("props", "$.k").cast("long"), "us": F.unix_micros(F.col("ts").cast("timestamp"))})


def _lineitem(spark, d):
    return table(spark, d, "lineitem")


def point_lookup(spark, d):
    return _events(spark, d).where("event_id = 42").select("event_id", "user_id", "event_type", "k")


def event_time_range(spark, d):
    span = [F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05", "2024-01-12")]
    return records.range_scan(_events(spark, d), "user_id", 7, "ts", *span, order=("ts", "event_id")).select("event_id", "event_type", "us")


def completeness_range(spark, d):
    span = [F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05", "2024-01-06")]
    got = records.range_scan(_events(spark, d), "user_id", 8, "updated_at", *span, order=("ts", "event_id"))
    return got.select("event_id", "us", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_us"))


def session_turns(spark, d):
    return table(spark, d, "conversations").where("conv_id = 5").select("turn", "role", F.length("text").alias("n")).orderBy("turn")


def latest_per_chunk(spark, d):
    return daylog.latest_per_chunk(_events(spark, d)).select("event_id", "user_id", "chunk_id")


def replace_upsert(spark, d):
    return records.last_wins(_events(spark, d), "user_id", "k", seq="event_id").select("user_id", "k", "event_id", "event_type")


def compare_and_upsert(spark, d):
    log = _events(spark, d).withColumn("key", F.col("user_id") * 1000 + F.col("k") % 10)
    return records.compare_and_upsert(log, "key", "event_type", "us", "event_id")


def versioned_profile(spark, d):
    return records.versioned(_events(spark, d), "user_id", "event_type", "event_id")


def insert_if_absent(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus")
    old = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderstatus").alias("state"))
    new = o.groupBy("o_custkey").agg(F.max("o_orderstatus").alias("state"))
    return records.insert_if_absent(old, new, "o_custkey")


def retraction_manifest(spark, d):
    return records.retraction_manifest(_events(spark, d), {"user_id": 7, "event_type": "error"}, "k")


def retract_cascade(spark, d):
    e = _events(spark, d)
    gone = e.where((F.col("user_id") == 7) & (F.col("event_type") == "error")).select(F.col("us").alias("at"))
    days = e.select((F.floor(F.col("us") / 86400000000) * 86400000000).alias("start")).distinct().withColumn("stop", F.col("start") + 86400000000)
    left = ranges.in_interval(gone, days, 86400000000, "at", "start", "stop", how="left_anti")
    kept = records.retract(e, {"user_id": 7, "event_type": "error"}).agg(F.count("*").alias("n_records"))
    return kept.crossJoin(left.agg(F.count("*").alias("n_days")))


def admit_entries(spark, d):
    e = _events(spark, d)
    return records.admit(e, "user_id", "k", digest="event_type", seq="event_id").groupBy("verdict").agg(F.count("*").alias("n"))


def dense_sequence(spark, d):
    return records.dense_sequence(_events(spark, d).select("user_id", "event_id"), "user_id", "event_id").select("user_id", "event_id", "sequence")


def prune_snapshots(spark, d):
    e = _events(spark, d).withColumn("snap", F.col("k") % 20)
    return records.pruned_snapshots(e, "user_id", "snap", "event_id", F.col("event_type") == "purchase", 3).select("user_id", "snap", "last")


def default_lookup(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").where("n_nationkey < 10").select("n_nationkey", "n_name")
    return records.with_default(c, n, "n_nationkey", "n_name", 0, "NONE").select("c_custkey", "n_name")


def stream_runs(spark, d):
    return continuity.runs(_events(spark, d), "user_id", "k")


def stream_gaps(spark, d):
    return continuity.gaps(continuity.runs(_events(spark, d), "user_id", "k"), "user_id")


def _ends(e):
    """End markers of streams: those that ended, and how many numbers their client says it sent."""
    return e.groupBy("user_id").agg((F.max("us") < 1706572800000000).alias("ended"), (F.max("k") + 1 + F.col("user_id") % 4).alias("expected"), F.count_if(F.col("event_type") == "error").alias("dead"))


def missing_info(spark, d):
    e = _events(spark, d)
    got = continuity.missing_info(e, "user_id", "k", 5, _ends(e).select("user_id", "ended", "expected"))
    return got.withColumn("missing", F.array_join(F.col("missing").cast("array<string>"), ","))


def delivery_kinds(spark, d):
    return continuity.classified(_events(spark, d), "user_id", "k", "event_type", "event_id").groupBy("user_id", "kind").agg(F.count("*").alias("n"))


def sequence_states(spark, d):
    e = _events(spark, d)
    parts = [e.where(F.col("event_type").isin(*x)) for x in (["purchase"], ["error"], ["view", "click", "signup"])]
    return continuity.state_of_sequences(*parts, "user_id", "k").groupBy("user_id", "state").agg(F.count("*").alias("n"))


def gap_report(spark, d):
    e = _events(spark, d)
    ends = _ends(e)
    info = continuity.missing_info(e, "user_id", "k", ends=ends.select("user_id", "ended", "expected")).select("user_id", "n_missing")
    return info.join(ends, "user_id").select("user_id", "n_missing", continuity.verdict(F.col("ended"), F.col("n_missing"), F.col("dead")).alias("verdict"))


def reconcile_days(spark, d):
    e = _events(spark, d).withColumn("day", F.date_format("ts", "yyyyMMdd"))
    return continuity.reconciled(e.where("event_type <> 'view'"), e.where("event_type <> 'click'"), "day", "user_id")


def chunks_of_segments(spark, d):
    li, o, c = _lineitem(spark, d), table(spark, d, "orders"), table(spark, d, "customer")
    got = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).where("o_orderstatus = 'O' and l_linestatus = 'F' and c_mktsegment = 'BUILDING'")
    return got.select("l_orderkey", "l_linenumber", "c_custkey", F.col("l_quantity").cast("long").alias("qty"))


def pending_with_flag(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    done = _lineitem(spark, d).where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("_d", F.lit(1))
    return o.join(done, "o_orderkey", "left").select("o_orderkey", F.col("_d").isNotNull().alias("has_record"))


def _turns(spark, d):
    e = _events(spark, d)
    splits = e.where("event_type in ('view', 'click')").select("event_id", "user_id", (F.col("us") / 1000).cast("long").alias("a_start"), ((F.col("us") / 1000).cast("long") + 3600000).alias("a_stop"))
    turns = e.where("event_type = 'purchase'").select("user_id", F.concat(F.lit("S"), (F.col("k") % 4).cast("string")).alias("speaker"), ((F.col("us") / 1000).cast("long") - 1800000).alias("b_start"), ((F.col("us") / 1000).cast("long") + 5400000).alias("b_stop"))
    return splits, turns


def speaker_align(spark, d):
    splits, turns = _turns(spark, d)
    return ranges.best_overlap(splits, turns, 7200000, "event_id", "speaker", on=("user_id",)).select("event_id", "speaker", "overlap")


def captions_in_chunk(spark, d):
    splits, turns = _turns(spark, d)
    points = splits.select("event_id", "user_id", "a_start")
    got = ranges.in_interval(points, turns, 7200000, "a_start", "b_start", "b_stop", on=("user_id",))
    return got.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("event_id")).alias("ids"))


def match_frame(spark, d):
    e = _events(spark, d)
    frames = e.where("event_type = 'error'").select("user_id", F.col("us").alias("f_us"), F.col("event_id").alias("f_id"))
    return ranges.nearest(e.where("event_type = 'purchase'").select("event_id", "user_id", "us"), frames, 21600000000, "event_id", "us", "f_us", on=("user_id",)).select("event_id", "f_id")


def window_overlaps(spark, d):
    w = W.partitionBy("user_id").orderBy("us", "event_id")
    e = _events(spark, d).withColumn("stop", F.col("us") + 3600000000).withColumn("nxt", F.lead("us").over(w))
    return e.where("nxt < stop").select("event_id", (F.col("stop") - F.col("nxt")).alias("overlap_us"))


def blocks_by_variant(spark, d):
    b = table(spark, d, "benchmark").select("item_id")
    return b.crossJoin(F.broadcast(spark.range(3).select(F.col("id").alias("variant"))))


def derived_watermark(spark, d):
    o = table(spark, d, "orders").withColumn("outcome", F.when(F.col("o_orderstatus") == "F", "published").otherwise("failed"))
    return ledgers.watermark(o.withColumn("day", F.date_format("o_orderdate", "yyyyMMdd")), "o_custkey", "outcome", "day")


def open_windows(spark, d):
    e = _events(spark, d)
    marks = ledgers.watermark(e.withColumn("outcome", F.when(F.col("event_type") == "purchase", "published")), "user_id", "outcome", "us")
    return ledgers.open_window(e, marks, "user_id", "us", F.lit(1706400000000000), F.lit(60000000))


def budget_fill(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    got = running.before(docs, "source", running.by_range(docs, "doc_id"), ["doc_id"], F.col("n_chars"), F.lit(20000))
    return got.select("doc_id", "source", "used_before")


def first_probes(spark, d):
    return ledgers.first_n(table(spark, d, "documents"), 3, "lang", "doc_id").select("lang", "doc_id", "rank")


def top_tags(spark, d):
    li = _lineitem(spark, d).where("l_discount >= 0.02 and l_returnflag <> 'N'")
    return ledgers.first_n(li, 3, "l_suppkey", F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


def even_frames(spark, d):
    return ledgers.even_subset(_events(spark, d), "user_id", 7, "us", "event_id").select("user_id", "event_id")


def activation_stack(spark, d):
    e = _events(spark, d).withColumns({"name": (F.col("k") % 3).cast("string"), "status": F.when(F.col("event_type") == "error", "rolled_back").otherwise("active")})
    return ledgers.active_stack(e, "user_id", "event_id", "name", "status").select("user_id", F.size("stack").alias("depth"), F.array_join("stack", ",").alias("stack"))


def claims(spark, d):
    o = table(spark, d, "orders")
    done = _lineitem(spark, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_linenumber").alias("heals"), F.bool_and(F.col("l_returnflag") != "R").alias("all_ok"), F.min(F.col("l_suppkey") % 3).alias("pv")
    )
    j = o.join(done, "o_orderkey", "left")
    kind = ledgers.claim(F.col("pv"), F.col("pv"), F.col("all_ok"), F.col("heals"), F.col("o_orderpriority") == "5-LOW", 0)
    return j.select("o_orderkey", kind.alias("verdict"))


def strike_counts(spark, d):
    e = _events(spark, d).withColumns({"day": F.floor(F.col("us") / 86400000000), "passed": F.col("event_type") == "purchase"})
    return ledgers.strikes(e, "user_id", "day", "passed", 3)


_TURNS = E + """, s as (select event_id, user_id, us // 1000 as a_start, us // 1000 + 3600000 as a_stop from e where event_type in ('view', 'click')),
 t as (select user_id, 'S' || (k % 4) as speaker, us // 1000 - 1800000 as b_start, us // 1000 + 5400000 as b_stop from e where event_type = 'purchase') """
_RUNS = E + """, u as (select distinct user_id, k from e), i as (select *, k - row_number() over (partition by user_id order by k) as g from u),
 r as (select user_id, min(k) as lo, max(k) as hi from i group by user_id, g), h as (select user_id, coalesce(lag(hi) over (partition by user_id order by lo), -1) + 1 as lo, lo - 1 as hi from r),
 gaps as (select * from h where lo <= hi) """

QUERIES = {
    "point_lookup": (point_lookup, E + "select event_id, user_id, event_type, k from e where event_id = 42"),
    "event_time_range": (event_time_range, E + "select event_id, event_type, us from e where user_id = 7 and ts >= '2024-01-05' and ts < '2024-01-12'"),
    "completeness_range": (completeness_range, E + "select event_id, us, epoch_us(updated_at) as updated_us from e where user_id = 8 and updated_at >= '2024-01-05' and updated_at < '2024-01-06'"),
    "session_turns": (session_turns, "select turn, role, cast(length(text) as integer) as n from conversations where conv_id = 5"),
    "latest_per_chunk": (latest_per_chunk, E + "select event_id, user_id, chunk_id from e qualify row_number() over (partition by user_id, chunk_id order by updated_at desc, event_id desc) = 1"),
    "replace_upsert": (replace_upsert, E + "select user_id, k, event_id, event_type from e qualify row_number() over (partition by user_id, k order by event_id desc) = 1"),
    "compare_and_upsert": (
        compare_and_upsert,
        E + """, l as (select *, user_id * 1000 + k % 10 as key, lag(event_type) over (partition by user_id * 1000 + k % 10 order by event_id) as was from e)
        select key, arg_min(us, event_id) as created_at, arg_max(us, event_id) filter (was is null or was <> event_type) as updated_at, arg_max(event_type, event_id) as event_type,
        count(*) as n_writes, count(*) filter (was is null or was <> event_type) as n_changes from l group by key""",
    ),
    "versioned_profile": (versioned_profile, E + "select user_id, count(*) as version, arg_max(event_type, event_id) as event_type from e group by 1"),
    "insert_if_absent": (
        insert_if_absent,
        """select o_custkey, 'F' as state from orders where o_orderstatus = 'F' group by 1
        union all select o_custkey, max(o_orderstatus) from orders where o_custkey not in (select o_custkey from orders where o_orderstatus = 'F') group by 1""",
    ),
    "retraction_manifest": (retraction_manifest, E + "select k, count(*) as n_records from e where user_id = 7 and event_type = 'error' group by 1"),
    "retract_cascade": (
        retract_cascade,
        E + """select (select count(*) from e where not (user_id = 7 and event_type = 'error')) as n_records,
        (select count(distinct us // 86400000000) from e) - (select count(distinct us // 86400000000) from e where user_id = 7 and event_type = 'error') as n_days""",
    ),
    "admit_entries": (
        admit_entries,
        E + """, a as (select event_type, row_number() over w as rn, first_value(event_type) over w as f from e window w as (partition by user_id, k order by event_id))
        select case when rn = 1 then 'admitted' when event_type = f then 'same' else 'conflict' end as verdict, count(*) as n from a group by 1""",
    ),
    "dense_sequence": (dense_sequence, "select user_id, event_id, cast(row_number() over (partition by user_id order by event_id) - 1 as integer) as sequence from events"),
    "prune_snapshots": (
        prune_snapshots,
        E + """, s as (select user_id, k % 20 as snap, max(event_id) as last, bool_or(event_type = 'purchase') as held from e group by 1, 2),
        r as (select *, row_number() over (partition by user_id order by last desc, snap) as rank from s) select user_id, snap, last from r where rank > 3 and not held""",
    ),
    "default_lookup": (default_lookup, "select c_custkey, coalesce(n_name, 'NATION_0') as n_name from customer left join (select * from nation where n_nationkey < 10) on c_nationkey = n_nationkey"),
    "stream_runs": (stream_runs, _RUNS + "select * from r"),
    "stream_gaps": (stream_gaps, _RUNS + "select * from gaps"),
    "missing_info": (
        missing_info,
        _RUNS + """, t as (select user_id, max(k) + 1 as lo, case when max(us) < 1706572800000000 then max(k) + 1 + user_id % 4 else max(k) + 1 end as stop from e group by 1),
        m as (select user_id, unnest(range(lo, hi + 1)) as x from gaps union all select user_id, unnest(range(lo, stop)) from t), c as (select user_id, string_agg(x, ',' order by x) as missing from (select * from m qualify row_number() over (partition by user_id order by x) <= 5) group by 1)
        select u.user_id, count(*) as received, max(k) as max_sequence, any_value(stop) - count(*) as n_missing, coalesce(any_value(missing), '') as missing from u join t using (user_id) left join c using (user_id) group by 1""",
    ),
    "delivery_kinds": (
        delivery_kinds,
        E + """, a as (select user_id, event_type, row_number() over w as rn, first_value(event_type) over w as f from e window w as (partition by user_id, k order by event_id))
        select user_id, case when rn = 1 then 'first' when event_type = f then 'duplicate' else 'conflict' end as kind, count(*) as n from a group by 1, 2""",
    ),
    "sequence_states": (
        sequence_states,
        E + """, a as (select user_id, k, min(case event_type when 'purchase' then 0 when 'error' then 1 else 2 end) as r from e group by 1, 2)
        select user_id, case r when 0 then 'processed' when 1 then 'dead_letter' else 'accepted' end as state, count(*) as n from a group by 1, 2""",
    ),
    "gap_report": (
        gap_report,
        E + """, a as (select user_id, max(k) + 1 - count(distinct k) + case when max(us) < 1706572800000000 then user_id % 4 else 0 end as n_missing, max(us) < 1706572800000000 as ended, count(*) filter (event_type = 'error') as dead from e group by 1)
        select user_id, n_missing, case when not ended then 'recording' when n_missing > 0 or dead > 0 then 'gaps' else 'clean' end as verdict from a""",
    ),
    "reconcile_days": (
        reconcile_days,
        E + """, x as (select strftime(ts, '%Y%m%d') as day, user_id, bool_or(event_type <> 'view') as ex, bool_or(event_type <> 'click') as got from e group by 1, 2)
        select day, count(*) filter (ex and not got) as n_missing, count(*) filter (got and not ex) as n_foreign, count(*) filter (ex and got) as n_matched, count(*) filter (ex <> got) = 0 as ok from x group by 1""",
    ),
    "chunks_of_segments": (
        chunks_of_segments,
        """select l_orderkey, l_linenumber, c_custkey, cast(l_quantity as bigint) as qty from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
        where o_orderstatus = 'O' and l_linestatus = 'F' and c_mktsegment = 'BUILDING'""",
    ),
    "pending_with_flag": (pending_with_flag, "select o_orderkey, o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R') as has_record from orders where o_orderpriority = '1-URGENT'"),
    "speaker_align": (
        speaker_align,
        _TURNS + """, m as (select event_id, speaker, least(a_stop, b_stop) - greatest(a_start, b_start) as overlap from s join t using (user_id) where a_start < b_stop and b_start < a_stop),
        b as (select * from m qualify row_number() over (partition by event_id order by overlap desc, speaker) = 1) select s.event_id, speaker, overlap from s left join b using (event_id)""",
    ),
    "captions_in_chunk": (captions_in_chunk, _TURNS + "select user_id, count(*) as n, cast(sum(event_id) as bigint) as ids from s join t using (user_id) where a_start >= b_start and a_start < b_stop group by 1"),
    "match_frame": (
        match_frame,
        E + """, p as (select event_id, user_id, us from e where event_type = 'purchase'), f as (select user_id, us as f_us, event_id as f_id from e where event_type = 'error'),
        m as (select event_id, f_id from p join f using (user_id) where abs(us - f_us) <= 21600000000 qualify row_number() over (partition by event_id order by abs(us - f_us), f_us desc) = 1)
        select p.event_id, f_id from p left join m using (event_id)""",
    ),
    "window_overlaps": (window_overlaps, E + ", n as (select event_id, us + 3600000000 as stop, lead(us) over (partition by user_id order by us, event_id) as nxt from e) select event_id, stop - nxt as overlap_us from n where nxt < stop"),
    "blocks_by_variant": (blocks_by_variant, "select item_id, variant from benchmark cross join range(3) r(variant)"),
    "derived_watermark": (derived_watermark, "select o_custkey, max(strftime(o_orderdate, '%Y%m%d')) filter (o_orderstatus = 'F') as watermark from orders group by 1"),
    "open_windows": (
        open_windows,
        E + """, w as (select user_id, coalesce(max(us) filter (event_type = 'purchase'), min(us)) as start, 1706399940000000 as stop from e group by 1) select * from w where stop > start""",
    ),
    "budget_fill": (
        budget_fill,
        """select doc_id, source, cast(used_before as bigint) as used_before from (select doc_id, source, coalesce(sum(n_chars) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as used_before from documents) where used_before < 20000""",
    ),
    "first_probes": (first_probes, "select lang, doc_id, cast(row_number() over (partition by lang order by doc_id) as integer) as rank from documents qualify rank <= 3"),
    "top_tags": (
        top_tags,
        """select l_suppkey, l_orderkey, l_linenumber, cast(row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as integer) as rank from lineitem
        where l_discount >= 0.02 and l_returnflag <> 'N' qualify rank <= 3""",
    ),
    "even_frames": (
        even_frames,
        E + """, n as (select user_id, event_id, row_number() over (partition by user_id order by us, event_id) - 1 as i, count(*) over (partition by user_id) as c from e)
        select user_id, event_id from n where c <= 7 or list_contains(list_transform(range(7), lambda x: cast(round_even(x * (c - 1) / 6, 0) as bigint)), i)""",
    ),
    "activation_stack": (activation_stack, None),
    "claims": (
        claims,
        """with l as (select l_orderkey, max(l_linenumber) as heals, bool_and(l_returnflag <> 'R') as all_ok, min(l_suppkey % 3) as pv from lineitem group by 1)
        select o_orderkey, case when o_orderpriority = '5-LOW' then 'inflight' when pv is null then 'fresh' when pv <> 0 then 'version_forward' when not all_ok and heals < 3 then 'heal' else 'skip' end as verdict
        from orders left join l on o_orderkey = l_orderkey""",
    ),
    "strike_counts": (
        strike_counts,
        E + """, d as (select user_id, us // 86400000000 as day, bool_or(event_type = 'purchase') as ok from e group by 1, 2), p as (select *, max(day) filter (ok) over (partition by user_id) as lp from d)
        select user_id, count(*) filter (lp is null or day > lp) as strikes, count(*) filter (lp is null or day > lp) >= 3 as frozen from p group by 1""",
    ),
}
