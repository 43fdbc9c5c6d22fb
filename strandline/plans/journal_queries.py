"""Queries over journals, publication logs, ledgers and requests, bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import journal
from strandline.plans.record_queries import E, _events
from strandline.sources.tables import table


def rehydrated_streams(spark, d):
    e = _events(spark, d)
    parts = [e.where(F.col("event_type").isin(*x)) for x in (["purchase"], ["error"], ["view", "click"])]
    return journal.rehydrated(*parts, "user_id", "k", "chunk_id", "us")


def restart_streams(spark, d):
    e = _events(spark, d)
    live = e.where("user_id % 3 = 0").groupBy("user_id").agg(F.count("*").alias("received"))
    return journal.unseen(live, rehydrated_streams(spark, d).select("user_id", "received"), "user_id")


def _receipts(spark, d):
    o = table(spark, d, "orders")
    stages = F.when(F.col("o_orderkey") % 4 != 0, F.create_map(F.lit("asr"), F.lit("ok"), F.lit("ocr"), F.when(F.col("o_orderkey") % 5 == 0, "failed").otherwise("ok")))
    return o.where("o_orderstatus <> 'P' and o_orderkey % 6 <> 0").select(
        "o_orderkey", F.col("o_orderpriority").alias("modality"), F.when(F.col("o_orderkey") % 7 == 0, "v1").otherwise("v2").alias("pipeline_version"), stages.alias("stage_status"), (F.col("o_orderkey") % 15 == 0).alias("done_final")
    )


def done_rows(spark, d):
    dialects = spark.createDataFrame([("1-URGENT", "v2"), ("5-LOW", "v1")], "modality string, version string")
    got = journal.done_rows(table(spark, d, "orders").select("o_orderkey"), _receipts(spark, d), dialects, "o_orderkey", "modality")
    return got.select("o_orderkey", "pipeline_version", "green", "answer")


def _pending(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", "o_custkey", "o_totalprice", (F.col("o_custkey") % 4).alias("attempts"), (F.col("o_orderkey") % 3).alias("epoch"), F.when(F.col("o_orderstatus") == "P", "unemitted").otherwise("accepted").alias("state"))


def charged_attempts(spark, d):
    got = journal.charged(_pending(spark, d), table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")
    return got.select("o_orderkey", "attempts")


def cleared_pending(spark, d):
    skips = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") % 3).cast("long").alias("epoch"))
    return journal.cleared(_pending(spark, d), skips, "o_orderkey", "epoch").select("o_orderkey", "epoch", "state")


def work_list(spark, d):
    return journal.work_list(_pending(spark, d), "o_custkey", "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "place")


def _log(spark, d):
    e = _events(spark, d)
    return e.select("user_id", "event_id", F.concat(F.lit("a"), (F.col("k") % 3).cast("string")).alias("name"), F.when(F.col("event_type") == "error", "rolled_back").otherwise("active").alias("status"), (F.col("k") * 7 % 100).alias("window_id"))


def resume_lineage(spark, d):
    """Checked against the entries without rollbacks, where the stack is the log."""
    log = _log(spark, d).where("status = 'active'")
    return journal.resumed_from(log, "user_id", "event_id", "name", "status", "window_id", 60).select("user_id", "event_id", "window_id")


def live_activations(spark, d):
    return journal.live_activations(_log(spark, d), "user_id", "event_id", "name", "status", "window_id").groupBy("user_id").agg(F.count("*").alias("depth"), F.max("window_id").alias("latest"))


def publication_rows(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("user_id"), (F.col("o_custkey") % 7).alias("window_id"), F.concat(F.lit("v"), (F.col("o_orderkey") % 5).cast("string")).alias("name"), "o_orderkey")
    live = o.where("o_orderkey % 11 = 0").select("user_id", "window_id", "name").distinct()
    asked = o.groupBy("user_id", "window_id").agg(F.max_by("name", "o_orderkey").alias("name"), (F.max("o_orderkey") % 4 != 0).alias("passed"))
    return journal.publication(live, asked, "user_id", "window_id", "name")


def corpus_ledger(spark, d):
    t = F.concat(F.lit(journal.CORRECTION), F.lit(" x.\n\n"), F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\n\n"), F.lit(journal.CORRECTION))).otherwise(""))
    docs = table(spark, d, "documents").where("text is not null").select(F.col("lang").alias("user_id"), F.col("doc_id").alias("window_id"), F.lit("r1").alias("recipe"), t.alias("t"))
    return journal.corpus_entries(docs, "t").select("user_id", "window_id", "chars", "sha", "neg_paragraphs")


def ledger_before(spark, d):
    docs = table(spark, d, "documents")
    named = lambda n: F.format_string("w%012d", n)
    before = docs.agg(named(F.floor(F.max("doc_id") * 3 / 5)).alias("w")).first().w
    user = F.concat_ws(":", F.col("lang"), F.floor(F.col("doc_id") / 100).cast("string"))  # a user's nights: a hundred at most
    entries = docs.select(user.alias("user_id"), named("doc_id").alias("window_id"), F.lit("r1").alias("recipe"), "n_chars")
    b = journal.ledger_bodies(entries, "user_id", "window_id", "recipe", before)
    return b.select("user_id", "head.contract", "head.before_window", F.size("entries").alias("n"), F.array_join(F.transform("entries", lambda x: F.concat_ws(":", x.window_id, x.n_chars.cast("string"))), ",").alias("entries"))


def fresh_stages(spark, d):
    s = table(spark, d, "supplier").withColumns({"stage": F.concat(F.lit("s"), (F.col("s_suppkey") % 20).cast("string")), "at": F.col("s_suppkey")})
    memo = s.select("stage", F.concat(F.lit("k"), (F.col("s_suppkey") % 3).cast("string")).alias("key"), F.array(F.concat(F.lit("f"), (F.col("s_suppkey") % 7).cast("string"))).alias("outputs"), "at")
    asked = s.select("stage").distinct().withColumn("key", F.lit("k1"))
    files = spark.range(5).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"))
    return journal.fresh_stages(asked, memo, files, "stage", "key", "at").select("stage", "fresh")


def created_streams(spark, d):
    e = _events(spark, d).withColumn("codec", F.concat(F.lit("c"), (F.col("k") % 3).cast("string")))
    return journal.streams_of(e, "user_id", "event_type", "event_id")


def blob_reads(spark, d):
    blobs = table(spark, d, "part").select(F.col("p_partkey").alias("ref"), (F.col("p_size") % 3 == 0).alias("deleted"), F.encode("p_name", "UTF-8").alias("data"))
    asked = table(spark, d, "lineitem").select((F.col("l_partkey") * 2).alias("ref")).distinct()
    return journal.blobs_read(asked, blobs, "ref").select("ref", F.octet_length("data").alias("n"))


def body_faults(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    b = o.select("o_orderkey", F.when(k % 5 != 0, "C10").alias("contract"), F.lit("2").alias("version"), F.col("o_custkey").alias("user_id"), (F.col("o_custkey") + (k % 7 == 0).cast("int")).alias("asked_user"), k.alias("window_id"), k.alias("asked_window"), (k % 3).alias("format_version"), F.when(k % 2 == 0, "r1").otherwise("r0").alias("recipe_id"))
    return b.select("o_orderkey", F.array_join(journal.body_faults(b, ("1", "2"), "r1"), ",").alias("faults"))


def built_prompts(spark, d):
    e = _events(spark, d)
    r = e.select("event_id", F.when(F.col("k") % 9 == 0, " \n\t").when(F.col("k") % 9 != 1, F.col("event_type")).alias("text"), F.when(F.col("k") % 2 == 0, "mine").alias("session_id"), F.lit(None).cast("string").alias("turn_id"))
    return journal.prompts_built(r, "text", F.col("event_id"))


def filled_templates(spark, d):
    t = F.lit("Hello [[name]], you are in [[place]]; [[name]].")
    return table(spark, d, "supplier").select("s_suppkey", journal.filled(t, {"name": F.col("s_name"), "place": F.col("s_nationkey"), "unused": F.lit("x")}).alias("text"))


def prompt_digests(spark, d):
    b = table(spark, d, "benchmark")
    spaced = F.concat(F.replace("text", F.lit("\n"), F.lit(" \t\r\n")), F.lit("\n \n"))
    return b.select("item_id", journal.text_digest(F.col("text")).alias("digest"), (journal.text_digest(spaced) == journal.text_digest(F.col("text"))).alias("same"))


def rendered_fields(spark, d):
    p = table(spark, d, "part")
    size = F.when(F.col("p_size") > 10, F.col("p_size")).when(F.col("p_size") > 5, F.lit(None))
    kind = F.when(F.col("p_partkey") % 3 == 0, "N/A").when(F.col("p_partkey") % 3 == 1, " none ").otherwise(F.col("p_type"))
    return p.select("p_partkey", journal.fields_rendered(F.concat(F.lit("[Part "), F.col("p_partkey").cast("string"), F.lit("]")), {"Type": kind, "Size": size, "Brand": F.col("p_brand")}).alias("text"))


def capped_prompts(spark, d):
    t = F.format_string("Day %d of %d: %s", F.col("doc_id") % 35, F.lit(35), F.left(F.coalesce("text", F.lit("")), F.lit(6000)))
    return table(spark, d, "documents").select("doc_id", F.length(t).alias("n"), F.md5(t).alias("h"))


def merged_anchors(spark, d):
    k = F.col("p_partkey")
    own = F.create_map(F.lit("day"), k.cast("string"), F.lit("city"), F.lit("x"))
    extra = F.create_map(F.when(k % 2 == 0, "city").otherwise("state"), F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", journal.sorted_map(journal.merged_maps(own, extra)).alias("anchors"), F.map_contains_key(extra, "state").alias("has_state"))


def modality_order(spark, d):
    from pyspark.sql import Window as W

    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority").distinct()
    return o.withColumn("place", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderpriority")))


def known_records(spark, d):
    """Whether any record stands behind each identifier asked for."""
    li = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    o = table(spark, d, "orders").select("o_orderkey")
    return o.join(li, "o_orderkey", "left_semi").withColumn("known", F.lit(True)).unionByName(o.join(li, "o_orderkey", "left_anti").withColumn("known", F.lit(False)))


def touched_stamps(spark, d):
    return _events(spark, d).select(F.date_format("updated_at", "yyyy-MM-dd HH:mm").alias("stamp")).distinct()


def offset_stamps(spark, d):
    """A base and an offset in seconds, in the two spellings; the tour's date; now less a delay, to the second."""
    e = _events(spark, d)
    at = F.date_trunc("second", F.col("ts").cast("timestamp")) + F.make_dt_interval(secs=(F.col("k") * 30).cast("double"))
    late = F.date_trunc("second", F.col("ts").cast("timestamp") - F.make_dt_interval(secs=F.lit(60)))
    return e.select("event_id", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("z"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("offset_form"), F.date_add(F.lit("2025-08-28").cast("date"), (F.col("k") - 1).cast("int")).cast("string").alias("tour_date"), F.date_format(late, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t_end"))


def allowed_captions(spark, d):
    """Rows whose time is in an allow-list."""
    e = _events(spark, d)
    dated = e.withColumn("day", F.date_format("ts", "yyyyMMdd"))
    return dated.join(dated.where("event_type = 'purchase'").select("k", "day"), ["k", "day"], "left_semi").select("event_id", "day")


def plan_days(spark, d):
    """Per day: seconds, chunks of the training split, captions inside the day's window."""
    e = _events(spark, d)
    day = F.date_format("ts", "yyyyMMdd")
    return e.groupBy(day.alias("day")).agg(
        F.count("*").alias("chunks"), F.sum(F.col("k") * 30).alias("content_seconds"), F.count_if(F.col("user_id") % 5 != 0).alias("train_chunks"), F.count_if((F.col("event_type") == "click") & (F.hour("ts").between(6, 21))).alias("captions_in_window")
    )


_STREAM = E + """, c as (select user_id, k, chunk_id, us, case event_type when 'purchase' then 0 when 'error' then 1 else 2 end as c from e where event_type in ('purchase', 'error', 'view', 'click')),
 o as (select user_id, k, min(c) as c, arg_min(chunk_id, row(c, us, chunk_id)) as f, min(us) as a, max(us) as b from c group by 1, 2),
 r as (select user_id, count(*) as received, count(*) filter (c = 0) as n_processed, count(*) filter (c = 1) as n_dead, max(k) as max_sequence, min(a) as first_seen, max(b) as last_seen, count(distinct f) as first_chunks from o group by 1) """
_PUB = """with o as (select o_custkey % 50 as user_id, o_custkey % 7 as window_id, 'v' || o_orderkey % 5 as name, o_orderkey from orders), l as (select distinct user_id, window_id, name from o where o_orderkey % 11 = 0),
 a as (select user_id, window_id, arg_max(name, o_orderkey) as name, max(o_orderkey) % 4 <> 0 as passed from o group by 1, 2),
 s as (select a.*, exists (select 1 from l where l.user_id = a.user_id and l.window_id = a.window_id and l.name = a.name) as same from a) """
_CORR = "'Contrary to what one might assume'"

QUERIES = {
    "rehydrated_streams": (rehydrated_streams, _STREAM + "select * from r"),
    "restart_streams": (restart_streams, _STREAM + "select user_id, count(*) as received from e where user_id % 3 = 0 group by 1 union all select user_id, received from r where user_id % 3 <> 0"),
    "done_rows": (done_rows, """with r as (select o_orderkey, o_orderpriority as m, case when o_orderkey % 7 = 0 then 'v1' else 'v2' end as pv, o_orderkey % 4 = 0 or o_orderkey % 5 <> 0 as green, o_orderkey % 15 = 0 as final from orders where o_orderstatus <> 'P' and o_orderkey % 6 <> 0)
        select o.o_orderkey, pv as pipeline_version, coalesce(green, true) as green, case when pv is null then 'fresh' when (m = '1-URGENT' and pv <> 'v2') or (m = '5-LOW' and pv <> 'v1') then 'reprocess' when not green and not final then 'heal' else 'skip' end as answer from orders o left join r using (o_orderkey)"""),
    "charged_attempts": (charged_attempts, "select o_orderkey, o_custkey % 4 + case when o_orderstatus <> 'P' and o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R') then 1 else 0 end as attempts from orders"),
    "cleared_pending": (cleared_pending, """select o_orderkey, o_orderkey % 3 as epoch, case when o_orderstatus = 'P' then 'unemitted' else 'accepted' end as state from orders
        where o_orderstatus = 'P' or not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linenumber % 3 = o_orderkey % 3)"""),
    "work_list": (work_list, "select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as integer) as place from orders where o_orderstatus <> 'P'"),
    "resume_lineage": (resume_lineage, E + """select user_id, event_id, k * 7 % 100 as window_id from e where event_type <> 'error' and k * 7 % 100 < 60 qualify row_number() over (partition by user_id order by k * 7 % 100 desc, event_id) = 1"""),
    "live_activations": (live_activations, None),
    "publication_rows": (publication_rows, _PUB + """select user_id, window_id, l.name, 'rolled_back' as status, 0 as step from s join l using (user_id, window_id) where passed and not same
        union all select user_id, window_id, name, case when passed then 'active' else 'gate_failed' end, 1 from s where not passed or not same"""),
    "corpus_ledger": (corpus_ledger, f"""with t as (select lang as user_id, doc_id as window_id, {_CORR} || ' x.' || chr(10) || chr(10) || text || case when doc_id % 2 = 0 then chr(10) || chr(10) || {_CORR} else '' end as t from documents where text is not null)
        select user_id, window_id, cast(length(t) as integer) as chars, sha256(t) as sha, cast(len(list_filter(string_split(t, chr(10) || chr(10)), lambda p: starts_with(p, {_CORR}))) as integer) as neg_paragraphs from t"""),
    "ledger_before": (ledger_before, """with t as (select max(doc_id) * 3 // 5 as top from documents) select concat_ws(':', lang, doc_id // 100) as user_id, 'C14' as contract, 'w' || lpad(cast(any_value(top) as varchar), 12, '0') as before_window, cast(count(*) as integer) as n, string_agg(concat_ws(':', 'w' || lpad(cast(doc_id as varchar), 12, '0'), n_chars), ',' order by doc_id) as entries from documents, t where doc_id < top group by 1"""),
    "fresh_stages": (fresh_stages, "with m as (select s_suppkey % 20 as s, arg_max(s_suppkey % 3, s_suppkey) as k, arg_max(s_suppkey % 7, s_suppkey) as f from supplier group by 1) select 's' || s as stage, k = 1 and f < 5 as fresh from m"),
    "created_streams": (created_streams, E + "select user_id, event_type, 'c' || arg_min(k, event_id) % 3 as codec, sha256(user_id || chr(0) || event_type) as stream_id from e group by 1, 2"),
    "blob_reads": (blob_reads, "with a as (select distinct l_partkey * 2 as ref from lineitem) select ref, cast(strlen(p_name) as integer) as n from a left join part on p_partkey = ref and p_size % 3 <> 0"),
    "body_faults": (body_faults, """select o_orderkey, concat_ws(',', case when o_orderkey % 5 = 0 then 'contract' end, case when o_orderkey % 7 = 0 then 'address' end, case when o_orderkey % 3 = 0 then 'dialect' end, case when o_orderkey % 2 <> 0 then 'recipe' end) as faults from orders"""),
    "built_prompts": (built_prompts, E + """select event_id, event_type as text, case when k % 2 = 0 then 'mine' else 's-' || sha256('s-' || chr(0) || event_id)[1:16] end as session_id, 't-' || sha256('t-' || chr(0) || event_id)[1:16] as turn_id from e where k % 9 > 1"""),
    "filled_templates": (filled_templates, "select s_suppkey, 'Hello ' || s_name || ', you are in ' || s_nationkey || '; ' || s_name || '.' as text from supplier"),
    "prompt_digests": (prompt_digests, r"select item_id, sha256(regexp_replace(regexp_replace(text, '[ \t]+(\n|$)', '\1', 'g'), '\n+$', ''))[1:8] as digest, true as same from benchmark"),
    "rendered_fields": (rendered_fields, """select p_partkey, concat_ws(chr(10), '[Part ' || p_partkey || ']', case when p_partkey % 3 = 2 then 'Type: ' || p_type end, case when p_size > 10 then 'Size: ' || p_size end, 'Brand: ' || p_brand) as text from part"""),
    "capped_prompts": (capped_prompts, "with t as (select doc_id, 'Day ' || doc_id % 35 || ' of 35: ' || substr(coalesce(text, ''), 1, 6000) as t from documents) select doc_id, cast(length(t) as integer) as n, md5(t) as h from t"),
    "merged_anchors": (merged_anchors, "select p_partkey, 'city=' || case when p_partkey % 2 = 0 then p_brand else 'x' end || ',day=' || p_partkey || case when p_partkey % 2 = 1 then ',state=' || p_brand else '' end as anchors, p_partkey % 2 = 1 as has_state from part"),
    "modality_order": (modality_order, "with o as (select distinct o_custkey, o_orderpriority from orders) select *, cast(row_number() over (partition by o_custkey order by o_orderpriority) as integer) as place from o"),
    "known_records": (known_records, "select o_orderkey, o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R') as known from orders"),
    "touched_stamps": (touched_stamps, E + "select distinct strftime(updated_at, '%Y-%m-%d %H:%M') as stamp from e"),
    "offset_stamps": (offset_stamps, E + """, s as (select event_id, k, ts, date_trunc('second', ts) + to_seconds(k * 30) as t from e)
        select event_id, strftime(t, '%Y-%m-%dT%H:%M:%SZ') as z, strftime(t, '%Y-%m-%dT%H:%M:%S+00:00') as offset_form, strftime(date '2025-08-28' + cast(k - 1 as integer), '%Y-%m-%d') as tour_date, strftime(date_trunc('second', ts - interval 60 second), '%Y-%m-%dT%H:%M:%SZ') as t_end from s"""),
    "allowed_captions": (allowed_captions, E + """select event_id, strftime(ts, '%Y%m%d') as day from e where exists (select 1 from e p where p.event_type = 'purchase' and p.k = e.k and strftime(p.ts, '%Y%m%d') = strftime(e.ts, '%Y%m%d'))"""),
    "plan_days": (plan_days, E + """select strftime(ts, '%Y%m%d') as day, count(*) as chunks, cast(sum(k * 30) as bigint) as content_seconds, count(*) filter (user_id % 5 <> 0) as train_chunks, count(*) filter (event_type = 'click' and hour(ts) between 6 and 21) as captions_in_window from e group by 1"""),
}
