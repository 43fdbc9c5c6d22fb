"""Queries over text, time, statistics and checks, bound to the given tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions import checks, stats, text, timeaxis
from strandline.operators import running
from strandline.plans.record_queries import E, _events
from strandline.sources.tables import table

DOC = "documents"
_P = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"


def _docs(spark, d):
    return table(spark, d, DOC)


def _tok(x):
    return f"list_filter(string_split(trim(regexp_replace(translate(lower({x}), {_P}, repeat(' ', 32)), '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 0 and w not in ('a', 'an', 'the'))"


def squeezed_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(text.squeezed(F.regexp_replace("text", "[^\\x00-\\x7f]", "?"))).alias("h"))


def cut_text(spark, d):
    x = F.regexp_replace("text", "[^\\x00-\\x7f]", "?")
    return _docs(spark, d).select("doc_id", text.cut_at_word(F.replace(x, F.lit("\n"), F.lit(" ")), 80).alias("words"))


def cut_sentences(spark, d):
    got = text.cut_at_sentence(F.replace("text", F.lit("\n"), F.lit(" ")), 120)
    return _docs(spark, d).select("doc_id", F.length(got).alias("n"), got.alias("head"))


def caption_budget(spark, d):
    return _docs(spark, d).select("doc_id", text.char_budget(F.col("n_chars") / 10.0, 1.25).alias("cap"))


def redaction(spark, d):
    r = _docs(spark, d).select("doc_id", text.redaction(F.col("text")).alias("r"))
    return r.select("doc_id", "r.n", F.md5("r.text").alias("h"))


def emails_found(spark, d):
    return _docs(spark, d).select("doc_id", F.regexp_count("text", F.lit(text.EMAIL)).alias("n")).where("n > 0")


def token_scores(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    q = c.where("role = 'user'").select("conv_id", F.col("turn").alias("qt"), text.tokens(F.col("text")).alias("gold"))
    a = c.where("role = 'assistant'").select("conv_id", "turn", text.tokens(F.col("text")).alias("guess"))
    both = a.join(q, (a.conv_id == q.conv_id) & (a.turn == q.qt + 1)).drop(q.conv_id)
    return both.select("conv_id", "turn", F.size("gold").alias("n_gold"), F.size("guess").alias("n_guess"), text.token_f1(F.col("guess"), F.col("gold")).alias("f1"), text.contains_gold(F.col("guess"), F.col("gold")).alias("held"))


def trap_markers(spark, d):
    return _docs(spark, d).select("doc_id", text.marked(F.col("text"), ["license", "password", "idiot"]).alias("trap"))


def order_scores(spark, d):
    return _docs(spark, d).select("doc_id", text.order_score(F.col("text"), ["the", "with", "that", "from"]).alias("score"))


def paragraph_pool(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(text.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("p")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("p")).alias("chars"))


def word_counts(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.sum(text.n_words(F.regexp_replace("text", "[\\n\\t]", " "))).alias("n_words"), F.count("*").alias("n_turns"))


def record_ids(spark, d):
    e = _events(spark, d)
    rid = text.record_id(F.col("event_id").cast("string"), F.col("event_type"))
    return e.select("event_id", rid.alias("record_id"), text.sharded_ref(rid).alias("ref"), stats.seed_of(F.col("user_id").cast("string"), F.col("event_type")).alias("seed"))


def pipeline_versions(spark, d):
    return _events(spark, d).groupBy("user_id").agg(text.composed_version(F.collect_set("event_type")).alias("version"))


def split_reply(spark, d):
    s = text.split_once(F.col("text"), "\n")
    return _docs(spark, d).select("doc_id", F.length(s.text).alias("n_text"), F.length(s.tail).alias("n_tail"))


def captions(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", text.caption(F.col("p_brand"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(" "), F.when(F.col("p_size") % 2 == 0, F.col("p_name"))).alias("caption"))


def grid_buckets(spark, d):
    e = _events(spark, d)
    return e.groupBy(F.floor(F.col("us") / 10_000_000).alias("bucket")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def window_ids(spark, d):
    t = F.date_trunc("second", F.col("ts").cast("timestamp"))
    return _events(spark, d).select("event_id", timeaxis.window_id(t).alias("window_id"), timeaxis.iso(t).alias("iso_z"), timeaxis.iso(F.col("ts").cast("timestamp"), False).alias("iso_offset"))


def spans(spark, d):
    w = W.partitionBy("user_id").orderBy("us", "event_id")
    e = _events(spark, d).withColumn("nxt", F.lead("ts").over(w)).where("nxt is not null")
    return e.select("event_id", timeaxis.span_seconds(F.col("ts").cast("timestamp"), F.col("nxt").cast("timestamp")).alias("seconds"))


def floor_times(spark, d):
    return _events(spark, d).select("event_id", timeaxis.next_floor(F.col("us") / 1e6, 30).cast("long").alias("next_floor"))


def civil_times(spark, d):
    zones = spark.createDataFrame([("America/New_York",), ("Europe/Paris",), ("Asia/Tokyo",)], "zone string")
    z = F.element_at(F.array(*map(F.lit, ("America/New_York", "Europe/Paris", "Asia/Tokyo", "Mars/Base"))), (F.col("user_id") % 4 + 1).cast("int"))
    e = _events(spark, d).select("event_id", F.col("ts").cast("timestamp").alias("t"), z.alias("zone"))
    return timeaxis.civil(e, "t", "zone", zones, "UTC").select("event_id", F.date_format("local", "yyyy-MM-dd HH:mm").alias("local"))


def local_days(spark, d):
    days = _events(spark, d).select(F.to_date("ts").alias("day")).distinct()
    a, b = timeaxis.local_day(F.col("day"), "Europe/Paris")
    return days.select(F.date_format("day", "yyyyMMdd").alias("day"), F.unix_micros(a).alias("start_us"), F.unix_micros(b).alias("stop_us"))


def clamped_splits(spark, d):
    a, b = timeaxis.clamped(F.col("l_linenumber").cast("double"), F.col("l_linenumber") + 10.0, F.col("l_quantity") - 20.0, F.col("l_quantity") - 5.0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", a.alias("start"), b.alias("stop"))


EDGES = [0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0]


def value_histogram(spark, d):
    return stats.histogram(_events(spark, d), "value", EDGES, "event_type")


def value_quantile(spark, d):
    return stats.bucket_quantile(value_histogram(spark, d), 0.9, "event_type")


def counters(spark, d):
    return _events(spark, d).groupBy("event_type", (F.col("k") % 5).alias("lane")).agg(F.count("*").alias("total"), F.max_by("event_id", F.struct("us", "event_id")).alias("gauge"))


def segments_by_state(spark, d):
    got = table(spark, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return got.select("o_custkey", *[F.coalesce(F.col(c), F.lit(0)).alias(c.lower() + "_count") for c in ("F", "O", "P")])


def state_counts(spark, d):
    s = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus"))
    return table(spark, d, "orders").groupBy(F.coalesce(s, F.lit("unemitted")).alias("state")).agg(F.count("*").alias("n"))


def ledger_totals(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)), F.lit(0)).alias("open"), F.sum(F.col("l_quantity").cast("long")).alias("qty"))


def metrics_snapshot(spark, d):
    li = table(spark, d, "lineitem")
    got = li.groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return got.select("l_returnflag", "l_linestatus", "n")


def spread_by_flag(spark, d):
    return stats.spread(table(spark, d, "lineitem"), "l_quantity", "l_returnflag").select("l_returnflag", "n", "mean", "median", "least", "greatest", F.round("sd", 6).alias("sd"), F.round("pop_sd", 6).alias("pop_sd"))


def percentiles(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.percentile("p_size", F.array(F.lit(0.2), F.lit(0.5), F.lit(0.9))).alias("q")).select("p_brand", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p20", "p50", "p90"))])


def _judged(spark, d):
    j = _docs(spark, d).join(table(spark, d, "labels"), "doc_id")
    return j.select(F.substring("source", 4, 3).cast("int").alias("step"), (F.col("doc_id") % 20).cast("int").alias("day"), F.col("quality").alias("ok"))


def judged_summary(spark, d):
    j = _docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    return j.groupBy("source").agg(F.count("quality").alias("n"), F.count_if(F.col("quality").isNull()).alias("n_unjudged"), F.coalesce(F.avg("quality"), F.lit(0.0)).alias("judge_exact"))


def decay_matrix(spark, d):
    return stats.decay_matrix(_judged(spark, d), "step", "day", "ok")


def contract_violations(spark, d):
    e = _events(spark, d)
    v = checks.violations({"k": (F.col("k").between(5, 95), "out of range"), "event_type": (F.col("event_type").isin("view", "click", "purchase"), "not in enum"), "value": (F.col("value") > 1, "too small")})
    return e.select("event_id", F.array_join(v, "; ").alias("violations"))


def valid_ids(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, timeaxis.window_id(F.col("ts"))).when(F.col("event_id") % 3 == 1, F.concat(timeaxis.window_id(F.col("ts")), F.lit("\n"))).otherwise(F.col("event_type"))
    return _events(spark, d).select("event_id", checks.fullmatch(raw, checks.WINDOW_ID).alias("ok"), checks.fullmatch(raw, checks.PATH_ID).alias("path_ok"))


def heldout_p_value(spark, d):
    j = _docs(spark, d).join(table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.sum("quality").alias("h"), F.count("*").alias("n"))
    base = j.where("lang = 'en'").select(F.col("h").alias("bh"), F.col("n").alias("bn"))
    return j.crossJoin(F.broadcast(base)).select("lang", stats.fisher_greater("h", "n", "bh", "bn").alias("p"))


def same_distribution(spark, d):
    return stats.permutation_test(spark, [1.0, 2.0, 3.5, 4.0, 2.5], [3.0, 4.5, 5.0, 6.0, 2.0, 4.0])


def line_join(spark, d):
    e = _events(spark, d)
    parts = F.array_sort(F.collect_list(F.struct("us", "event_id", "event_type")))
    return e.groupBy("user_id", F.date_format("ts", "yyyyMMdd").alias("day")).agg(F.array_join(parts.event_type, " | ").alias("line"), F.sha2(F.array_join(parts.event_type, "\n"), 256).alias("fingerprint"))


def running_loss(spark, d):
    w = W.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    n = table(spark, d, "lineitem").withColumns({"i": F.row_number().over(w), "n": F.count("*").over(W.partitionBy("l_suppkey"))})
    mean = lambda c: F.avg(F.when(c, F.col("l_quantity")))
    return n.groupBy("l_suppkey").agg(mean(F.col("i") <= 20).alias("first"), mean(F.col("i") > F.col("n") - 20).alias("last"))


def onset_labels(spark, d):
    first = _events(spark, d).groupBy("user_id", "event_type").agg(F.min("us").alias("onset"))
    rank = F.dense_rank().over(W.partitionBy("user_id").orderBy("onset", "event_type"))
    return first.select("user_id", "event_type", F.concat(F.lit("SPEAKER_"), F.lpad((rank - 1).cast("string"), 2, "0")).alias("label"))


def run_sets(spark, d):
    e = _events(spark, d).groupBy("user_id").agg(F.collect_set("k").alias("got"))
    miss = F.array_except(F.sequence(F.lit(0), F.lit(99)).cast("array<bigint>"), F.col("got"))
    return e.select("user_id", F.size(miss).alias("n_missing"), F.array_join(F.array_sort(F.array_intersect("got", F.array(*[F.lit(i).cast("long") for i in range(0, 100, 7)]))).cast("array<string>"), ",").alias("dead_delivered"))


def status_maps(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct(F.col("l_returnflag"), (F.col("l_returnflag") != "R").alias("v"))))).alias("m"))
    return m.select("l_orderkey", F.forall(F.map_values("m"), lambda v: v).alias("all_ok"), F.size("m").alias("n_stages"))


def recency(spark, d):
    last = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"))
    last = last.withColumn("lane", F.col("o_custkey") % 16)
    return running.ranked(last, "lane", running.by_range(last, "last", falling=True), [F.desc("last")]).select("o_custkey", "rank")


def rate_over_range(spark, d):
    e = _events(spark, d)
    got = e.groupBy(F.window(F.col("ts").cast("timestamp"), "2 hours", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return got.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", (F.col("n") / 7200.0).alias("rate"))


def active_dialects(spark, d):
    return _events(spark, d).groupBy("event_type").agg(F.count_distinct(F.col("k") % 7).alias("n"), (F.count_distinct(F.col("k") % 7) > 1).alias("alert"))


def exposition(spark, d):
    c = _events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))
    return c.select(F.format_string('events_total{type="%s"} %d', "event_type", "n").alias("line"))


def differential(spark, d):
    a = _events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"))
    b = _events(spark, d).where("event_id % 500 <> 0").groupBy("user_id").agg(F.count("*").alias("n"))
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def amplify_plan(spark, d):
    docs = _docs(spark, d).select("doc_id", "n_chars", F.col("source").alias("day"))
    jobs = docs.crossJoin(F.broadcast(spark.range(2).withColumnRenamed("id", "variant")))
    ok = (F.col("n_chars") > 120) & ((F.col("doc_id") + F.col("variant")) % 11 != 0)
    return jobs.groupBy("day").agg(F.count("*").alias("n_jobs"), F.count_if(ok).alias("n_ok"), F.sum(F.when(ok, F.col("n_chars"))).alias("chars"), (F.count_if(ok) / F.count("*")).alias("ok_rate"))


def hash_sample(spark, d):
    docs = _docs(spark, d).select("source", "doc_id", "n_chars", F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))).alias("u"))
    return running.before(docs, "source", running.by_digits(F.col("u")), ["u", "doc_id"], F.col("n_chars"), F.lit(15000)).select("source", "doc_id")


def spine_layout(spark, d):
    docs = _docs(spark, d).select("source", "doc_id", "n_chars")
    got = running.before(docs, "source", running.by_range(docs, "doc_id"), ["doc_id"], F.ceil(F.col("n_chars") / 60) * 60, name="spine_at")
    return got.select("source", "doc_id", "spine_at")


QUERIES = {
    "squeezed_text": (squeezed_text, "select doc_id, md5(trim(regexp_replace(regexp_replace(text, '[^\\x00-\\x7f]', '?', 'g'), '\\s+', ' ', 'g'))) as h from documents"),
    "cut_text": (cut_text, """with x as (select doc_id, replace(regexp_replace(text, '[^\\x00-\\x7f]', '?', 'g'), chr(10), ' ') as t from documents),
        y as (select *, case when t[81:81] = ' ' then t[1:80] else regexp_extract(t[1:80], '^(.*) ', 1, 's') end as w from x)
        select doc_id, case when length(t) <= 80 then t when w = '' then t[1:80] else rtrim(w) end as words from y"""),
    "cut_sentences": (cut_sentences, None),
    "caption_budget": (caption_budget, "select doc_id, greatest(0, cast(round_even(n_chars / 10.0::double * 1.25::double, 0) as bigint)) as cap from documents"),
    "redaction": (redaction, None),
    "emails_found": (emails_found, "select doc_id, cast(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) as integer) as n from documents where len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) > 0"),
    "token_scores": (token_scores, f"""with c as (select conv_id, turn, role, text from conversations), x as (select a.conv_id, a.turn, {_tok('a.text')} as guess, {_tok('q.text')} as gold from c a join c q on a.conv_id = q.conv_id and a.turn = q.turn + 1 where a.role = 'assistant' and q.role = 'user'),
        y as (select *, coalesce(list_sum(list_transform(list_distinct(guess), lambda w: least(len(list_filter(guess, lambda v: v = w)), len(list_filter(gold, lambda v: v = w))))), 0) as b from x)
        select conv_id, turn, len(gold)::integer as n_gold, len(guess)::integer as n_guess, case when b = 0 then 0.0::double else 2.0::double * b / (len(gold) + len(guess)) end as f1,
        case when contains(array_to_string(guess, ' '), array_to_string(gold, ' ')) then 1.0::double else 0.0::double end as held from y"""),
    "trap_markers": (trap_markers, "select doc_id, contains(lower(text), 'license') or contains(lower(text), 'password') or contains(lower(text), 'idiot') as trap from documents"),
    "order_scores": (order_scores, """with x as (select doc_id, list_filter([instr(lower(text), 'the'), instr(lower(text), 'with'), instr(lower(text), 'that'), instr(lower(text), 'from')], lambda p: p > 0) as p from documents),
        y as (select doc_id, len(p) as n, (select count(*) from range(4) a(i), range(4) b(j) where i < j and j < len(p) and p[j + 1] > p[i + 1]) as r from x)
        select doc_id, case when n < 2 then 0.0::double else r / (n * (n - 1) / 2) end as score from y"""),
    "paragraph_pool": (paragraph_pool, "select doc_id, count(*) as n, cast(sum(length(p)) as bigint) as chars from (select doc_id, unnest(string_split(text, chr(10))) as p from documents) where length(p) > 100 group by 1"),
    "word_counts": (word_counts, "select conv_id, cast(sum(case when trim(t) = '' then 0 else len(string_split_regex(trim(t), '\\s+')) end) as bigint) as n_words, count(*) as n_turns from (select conv_id, regexp_replace(text, '[\\n\\t]', ' ', 'g') as t from conversations where role = 'user') group by 1"),
    "record_ids": (record_ids, E + ", r as (select event_id, user_id, event_type, sha256(event_id || chr(0) || event_type) as record_id from e) select event_id, record_id, record_id[1:2] || '/' || record_id[3:4] || '/' || record_id as ref, cast('0x' || sha256(user_id || chr(0) || event_type)[1:8] as bigint) as seed from r"),
    "pipeline_versions": (pipeline_versions, "select user_id, string_agg(distinct event_type, '+' order by event_type) as version from events group by 1"),
    "split_reply": (split_reply, "select doc_id, cast(case when instr(text, chr(10)) > 0 then instr(text, chr(10)) - 1 else length(text) end as integer) as n_text, cast(case when instr(text, chr(10)) > 0 then length(text) - instr(text, chr(10)) end as integer) as n_tail from documents"),
    "captions": (captions, "select p_partkey, concat_ws('. ', concat_ws(' — ', p_brand, case when p_size > 25 then p_type end), case when p_size % 2 = 0 then p_name end) as caption from part"),
    "grid_buckets": (grid_buckets, E + "select us // 10000000 as bucket, count(*) as n, min(event_id) as first_id from e group by 1"),
    "window_ids": (window_ids, E + "select event_id, strftime(ts, 'w%Y%m%dT%H%M%SZ') as window_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso_z, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when us % 1000000 = 0 then '' else '.' || lpad(cast(us % 1000000 as varchar), 6, '0') end || '+00:00' as iso_offset from e"),
    "spans": (spans, E + ", n as (select event_id, us, lead(us) over (partition by user_id order by us, event_id) as nx from e) select event_id, greatest(0.0::double, (nx - us) / 1e6::double) as seconds from n where nx is not null"),
    "floor_times": (floor_times, E + "select event_id, (us // 30000000 + 1) * 30 as next_floor from e"),
    "civil_times": (civil_times, None),
    "local_days": (local_days, None),
    "clamped_splits": (clamped_splits, """with x as (select *, l_linenumber::double as s, greatest(0.0::double, least(l_quantity - 20.0::double, 10.0::double)) as a from lineitem)
        select l_orderkey, l_linenumber, l_partkey, s + a as start, s + greatest(a, least(l_quantity - 5.0::double, 10.0::double)) as stop from x"""),
    "value_histogram": (value_histogram, "with b as (select unnest([0.5, 1, 2.5, 5, 10, 25, 50, 100, 'infinity'::double]) as e, unnest(['0.5', '1', '2.5', '5', '10', '25', '50', '100', '+Inf']) as le) select event_type, le, count(*) filter (value <= e) as n from events, b group by 1, 2"),
    "value_quantile": (value_quantile, None),
    "counters": (counters, E + "select event_type, k % 5 as lane, count(*) as total, arg_max(event_id, (us, event_id)) as gauge from e group by 1, 2"),
    "segments_by_state": (segments_by_state, "select o_custkey, count(*) filter (o_orderstatus = 'F') as f_count, count(*) filter (o_orderstatus = 'O') as o_count, count(*) filter (o_orderstatus = 'P') as p_count from orders group by 1"),
    "state_counts": (state_counts, "select case when o_orderpriority <> '5-LOW' then o_orderstatus else 'unemitted' end as state, count(*) as n from orders group by 1"),
    "ledger_totals": (ledger_totals, "select count(*) as n, count(*) filter (l_linestatus = 'O') as open, cast(sum(l_quantity) as bigint) as qty from lineitem"),
    "metrics_snapshot": (metrics_snapshot, "select l_returnflag, l_linestatus, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())"),
    "spread_by_flag": (spread_by_flag, "select l_returnflag, count(*) as n, avg(l_quantity) as mean, median(l_quantity) as median, min(l_quantity) as least, max(l_quantity) as greatest, round(stddev_samp(l_quantity), 6) as sd, round(stddev_pop(l_quantity), 6) as pop_sd from lineitem group by 1"),
    "percentiles": (percentiles, "select p_brand, round(quantile_cont(p_size::double, 0.2), 6) as p20, round(quantile_cont(p_size::double, 0.5), 6) as p50, round(quantile_cont(p_size::double, 0.9), 6) as p90 from part group by 1"),
    "judged_summary": (judged_summary, "select source, count(quality) as n, count(*) - count(quality) as n_unjudged, coalesce(avg(quality), 0.0::double) as judge_exact from documents left join labels using (doc_id) group by 1"),
    "decay_matrix": (decay_matrix, "select cast(source[4:] as integer) as step, cast(doc_id % 20 as integer) as day, avg(quality) as score from documents join labels using (doc_id) where doc_id % 20 <= cast(source[4:] as integer) group by 1, 2"),
    "contract_violations": (contract_violations, E + "select event_id, concat_ws('; ', case when event_type not in ('view', 'click', 'purchase') then 'event_type: not in enum' end, case when k not between 5 and 95 then 'k: out of range' end, case when not value > 1 then 'value: too small' end) as violations from e"),
    "valid_ids": (valid_ids, "select event_id, event_id % 3 = 0 as ok, event_id % 3 <> 1 as path_ok from events"),
    "heldout_p_value": (heldout_p_value, None),
    "same_distribution": (same_distribution, None),
    "line_join": (line_join, E + "select user_id, strftime(ts, '%Y%m%d') as day, string_agg(event_type, ' | ' order by us, event_id) as line, sha256(string_agg(event_type, chr(10) order by us, event_id)) as fingerprint from e group by 1, 2"),
    "running_loss": (running_loss, """with n as (select *, row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) as i, count(*) over (partition by l_suppkey) as c from lineitem)
        select l_suppkey, avg(l_quantity) filter (i <= 20) as first, avg(l_quantity) filter (i > c - 20) as last from n group by 1"""),
    "onset_labels": (onset_labels, E + ", o as (select user_id, event_type, min(us) as m from e group by 1, 2) select user_id, event_type, 'SPEAKER_' || lpad(cast(dense_rank() over (partition by user_id order by m, event_type) - 1 as varchar), 2, '0') as label from o"),
    "run_sets": (run_sets, E + "select user_id, cast(100 - count(distinct k) as integer) as n_missing, coalesce(string_agg(distinct k, ',' order by k) filter (k % 7 = 0), '') as dead_delivered from e group by 1"),
    "status_maps": (status_maps, "select l_orderkey, bool_and(l_returnflag <> 'R') as all_ok, cast(count(distinct l_returnflag) as integer) as n_stages from lineitem group by 1"),
    "recency": (recency, "with l as (select o_custkey, max(o_orderkey) as last from orders group by 1) select o_custkey, cast(row_number() over (partition by o_custkey % 16 order by last desc) as integer) as rank from l"),
    "rate_over_range": (rate_over_range, E + ", h as (select unnest([us // 3600000000, us // 3600000000 - 1]) * 3600000000 as start_us, event_type from e) select start_us, event_type, count(*) as n, count(*) / 7200.0::double as rate from h group by 1, 2"),
    "active_dialects": (active_dialects, E + "select event_type, count(distinct k % 7) as n, count(distinct k % 7) > 1 as alert from e group by 1"),
    "exposition": (exposition, "select 'events_total{type=\"' || event_type || '\"} ' || count(*) as line from events group by event_type"),
    "differential": (differential, "with a as (select user_id, count(*) as n from events group by 1), b as (select user_id, count(*) as n from events where event_id % 500 <> 0 group by 1) select *, 'left' as side from (select * from a except all select * from b) union all select *, 'right' from (select * from b except all select * from a)"),
    "amplify_plan": (amplify_plan, "with j as (select source as day, n_chars, n_chars > 120 and (doc_id + v) % 11 <> 0 as ok from documents, range(2) r(v)) select day, count(*) as n_jobs, count(*) filter (ok) as n_ok, cast(sum(n_chars) filter (ok) as bigint) as chars, count(*) filter (ok) / count(*) as ok_rate from j group by 1"),
    "hash_sample": (hash_sample, "select source, doc_id from (select source, doc_id, coalesce(sum(n_chars) over (partition by source order by md5('7:' || doc_id), doc_id rows between unbounded preceding and 1 preceding), 0) as b from documents) where b < 15000"),
    "spine_layout": (spine_layout, "select source, doc_id, cast(coalesce(sum(ceil(n_chars / 60) * 60) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as spine_at from documents"),
}
