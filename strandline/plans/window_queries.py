"""Queries over slot records, rendered windows and screen text, bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import daylog, screen, slots
from strandline.plans.record_queries import E, _events
from strandline.sources.tables import table

HOME, ZONE = "UTC", "Etc/GMT-2"


def _slot_records(spark, d):
    e = daylog.latest_per_chunk(_events(spark, d))
    kind, k, ts = F.col("event_type"), F.col("k"), F.col("ts").cast("timestamp")
    name = k.cast("string")
    later = lambda s: ts + F.make_dt_interval(secs=F.lit(s))
    two = F.array(
        F.struct(F.concat(F.lit(" p"), name).alias("value"), F.when(k % 5 != 0, F.concat(F.lit("S"), (k % 4).cast("string"))).alias("speaker"), ts.alias("t_start")),
        F.struct(F.when(k % 7 != 0, "then").otherwise(" ").alias("value"), F.lit(None).cast("string").alias("speaker"), later(900).alias("t_start")),
    )
    none = F.array().cast("array<struct<value:string,speaker:string,t_start:timestamp>>")
    plain = F.array().cast("array<struct<value:string,t_start:timestamp>>")
    asr = F.struct(F.concat(F.lit("e"), name).alias("value"), F.when(k % 2 == 0, F.array(F.struct(F.lit("split").alias("value"), later(1200).alias("t_start")))).otherwise(plain).alias("splits"))
    held = F.struct(
        F.when(kind == "view", F.struct(F.when(k % 10 == 0, "  ").otherwise(F.concat(F.lit("view "), name)).alias("value"))).alias("caption"),
        F.when(kind == "click", F.struct(F.concat(F.lit("+1s main: "), name).alias("value"))).alias("ocr"),
        F.when(kind == "purchase", F.struct(two.alias("splits"))).when(kind == "signup", F.struct(none.alias("splits"))).alias("transcript"),
        F.when(kind.isin("error", "signup"), asr).alias("asr"),
    ).cast(slots.SLOTS)
    tz = F.when(F.col("user_id") % 3 == 0, ZONE).when((F.col("user_id") % 3 == 2) & (k % 2 == 0), "Nowhere/Else")
    return e.select("event_id", "user_id", F.date_format("updated_at", "'w'yyyyMM").alias("window_id"), ts.alias("t_start"), tz.alias("device_tz"), held.alias("slots"))


def slot_lines(spark, d):
    return slots.slot_lines(_slot_records(spark, d)).select("event_id", "pos", "kind", F.unix_micros("at").alias("at_us"), "text", "speaker")


def _text_blocks(spark, d):
    zones = spark.createDataFrame([(ZONE,), (HOME,)], "zone string")
    return slots.text_blocks(slots.slot_lines(_slot_records(spark, d)), 600, HOME, zones)


def text_blocks(spark, d):
    return _text_blocks(spark, d).select("user_id", "block_id", "n_segments", "date", "text")


def window_bodies(spark, d):
    b = slots.window_bodies(_text_blocks(spark, d))
    return b.select("user_id", "window_id", "n_blocks", F.length("corpus").cast("long").alias("chars"), "content_fingerprint")


def _windows(spark, d):
    o = table(spark, d, "orders").withColumns({"user_id": F.col("o_custkey") % 97, "day": F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")})
    return o.groupBy("user_id", F.floor(F.col("day") / 100).alias("n")).agg(F.min("day").alias("t_start"), (F.max("day") + 1).alias("t_end"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open")).select(
        "user_id", F.format_string("w%04d", "n").alias("window_id"), "t_start", "t_end", F.when(F.col("n_open") == 0, "closed").otherwise("open").alias("state")
    )


def cache_states(spark, d):
    w = _windows(spark, d)
    n = F.substring("window_id", 2, 4).cast("int")
    cache = w.where(n % 3 != 0).select("user_id", "window_id", F.when(n % 5 == 0, "1").otherwise("2").alias("format_version"), F.when(n % 7 == 0, "r0").otherwise("r1").alias("recipe_id"), F.when(F.col("user_id") % 4 == 0, "UTC").otherwise("Asia/Tokyo").alias("home_tz"))
    profiles = w.where(F.col("user_id") % 6 != 0).select("user_id", F.lit("Asia/Tokyo").alias("home_tz")).distinct()
    return slots.cache_states(w, cache, profiles, "2", "r1")


def dissolved_windows(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    writes = o.select((F.col("o_custkey") % 97).alias("user_id"), F.when(F.col("o_orderkey") % 2 == 0, day).alias("was"), (day + 150).alias("now"))
    return slots.dissolved(_windows(spark, d), writes, 200)


def opened_windows(spark, d):
    w = _windows(spark, d)
    asked = w.select("user_id").distinct().withColumn("now", F.lit(1700000000000000))
    return slots.opened(asked, w.where("user_id % 2 = 0 or state = 'closed'"))


def listed_windows(spark, d):
    return slots.listed(_windows(spark, d), "user_id", "closed", "w0018").select("user_id", "window_id", "place")


def _boxes(spark, d):
    p = table(spark, d, "part")
    x0, y0 = (F.col("p_partkey") * 37) % 1000, (F.col("p_partkey") * 61) % 800
    return p.withColumns({"x0": x0, "y0": F.when(F.col("p_partkey") % 50 != 0, y0), "x1": x0 + (F.col("p_size") - 5) * 8, "y1": y0 + F.col("p_size") * 4})


def normal_boxes(spark, d):
    b = _boxes(spark, d).withColumn("box", screen.normal_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.lit(1000), F.lit(800)))
    return b.select("p_partkey", *[F.round(f"box.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


def role_of_box(spark, d):
    b = _boxes(spark, d).withColumn("box", screen.normal_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.lit(1000), F.lit(800)))
    return b.select("p_partkey", screen.role_of(F.col("box")).alias("role"))


def _regions(spark, d):
    c = table(spark, d, "conversations")
    box = F.struct((F.col("turn") % 3 / 4.0).alias("x0"), F.lit(0.5).alias("y0"), F.lit(0.9).alias("x1"), F.lit(0.6).alias("y1"))
    return c.select("conv_id", F.floor(F.col("turn") / 2).alias("t_offset"), F.col("turn").alias("place"), (F.length("text") % 10 / 10.0).alias("conf"), F.when(F.col("role") == "user", "message").otherwise("?").alias("role"), box.alias("box"), "text")


def screen_items(spark, d):
    i = screen.screen_items(_regions(spark, d), 0.3, 20)
    place = F.row_number().over(_by("conv_id", "order"))
    return i.select("conv_id", "place", "role", place.alias("nth"), F.length("line").alias("n"))


def _by(group, order):
    from pyspark.sql import Window as W

    return W.partitionBy(group).orderBy(order)


def screen_lines(spark, d):
    r = _regions(spark, d)
    spans = r.groupBy("conv_id").agg((F.max("t_offset") * 30.0 + 10).alias("seconds"))
    return screen.screen_lines(screen.screen_items(r, 0.3, 20), "conv_id", 0.9, spans, 4.0)


def read_outcomes(spark, d):
    s = table(spark, d, "supplier").withColumns({"a": F.col("s_suppkey") % 5, "b": F.col("s_suppkey") % 4})
    return s.select("s_suppkey", screen.read_outcome(F.lit(4), F.col("a"), F.least("a", "b")).alias("outcome"), screen.variant(F.col("a"), F.col("b") == 0, F.lit("default")).alias("variant"))


def frames_to_read(spark, d):
    e = _events(spark, d)
    return screen.floor_and_events(e.where("k % 10 = 0"), e.where("event_type = 'error'"), "user_id", "event_id")


_LINES = E + """, r as (select *, 'w' || strftime(updated_at, '%Y%m') as window_id, case when user_id % 3 = 0 then 'Etc/GMT-2' when user_id % 3 = 2 and k % 2 = 0 then 'Nowhere/Else' end as tz
  from e qualify row_number() over (partition by user_id, chunk_id order by updated_at desc, event_id desc) = 1),
 l0 as (select event_id, 0 as n, 'scene' as kind, us as at_us, 'view ' || k as text, cast(null as varchar) as speaker from r where event_type = 'view' and k % 10 <> 0
  union all select event_id, 0, 'screen', us, '+1s main: ' || k, null from r where event_type = 'click'
  union all select event_id, 0, 'heard', us, 'p' || k, case when k % 5 <> 0 then 'S' || k % 4 end from r where event_type = 'purchase'
  union all select event_id, 1, 'heard', us + 900000000, 'then', null from r where event_type = 'purchase' and k % 7 <> 0
  union all select event_id, 0, 'heard', us + case when k % 2 = 0 then 1200000000 else 0 end, case when k % 2 = 0 then 'split' else 'e' || k end, null from r where event_type = 'error'),
 l as (select *, cast(row_number() over (partition by event_id order by n) - 1 as integer) as pos from l0) """
_BLOCKS = _LINES + """, x as (select l.*, r.us, r.user_id, r.window_id, r.tz, at_us // 600000000 as bucket from l join r using (event_id)),
 g as (select user_id, window_id, bucket, arg_min(tz, row(us, event_id, pos)) filter (tz is not null) as tz from x group by 1, 2, 3),
 f as (select *, case when bucket - lag(bucket) over (partition by user_id, window_id order by bucket) - 1 > 6 then 1 else 0 end as far from g),
 i as (select *, sum(far) over (partition by user_id, window_id order by bucket) as island from f),
 p as (select *, (row_number() over (partition by user_id, window_id, island order by bucket) - 1) // 12 as part from i),
 h as (select user_id, window_id, island, part, min(bucket) as lo, max(bucket) as hi, count(*) as n_segments, arg_min(tz, bucket) filter (tz is not null) as tz from p group by 1, 2, 3, 4),
 b as (select *, row_number() over (partition by user_id, window_id order by lo) - 1 as block, case when tz = 'Etc/GMT-2' then 7200 else 0 end as off from h),
 t as (select b.user_id, b.window_id, block, string_agg(text, ' ' order by bucket, us, event_id, pos) filter (kind = 'scene') as scene,
  string_agg(concat_ws(': ', speaker, text), ' | ' order by bucket, us, event_id, pos) filter (kind = 'heard') as heard,
  string_agg(text, ' | ' order by bucket, us, event_id, pos) filter (kind = 'screen') as screen from b join x on b.user_id = x.user_id and b.window_id = x.window_id and bucket between lo and hi group by 1, 2, 3),
 z as (select b.user_id, b.window_id, block, b.window_id || '_b' || lpad(cast(block as varchar), 4, '0') as block_id, n_segments, strftime(make_timestamp((lo * 600 + off) * 1000000), '%Y-%m-%d') as date,
  concat_ws(chr(10), 'On ' || strftime(make_timestamp((lo * 600 + off) * 1000000), '%Y-%m-%d') || ', around ' || strftime(make_timestamp((lo * 600 + off) * 1000000), '%H:%M') || '–' ||
  strftime(make_timestamp(((hi + 1) * 600 + off) * 1000000), '%H:%M') || ' local time:', 'Scene: ' || scene, 'Heard: ' || heard, 'World text (OCR): ' || screen) as text from b join t using (user_id, window_id, block)) """
_WINDOWS = """with o as (select *, o_custkey % 97 as user_id, date_diff('day', date '1992-01-01', cast(o_orderdate as date)) as day from orders),
 w as (select user_id, 'w' || lpad(cast(day // 100 as varchar), 4, '0') as window_id, day // 100 as n, min(day) as t_start, max(day) + 1 as t_end, case when count(*) filter (o_orderstatus = 'O') = 0 then 'closed' else 'open' end as state from o group by 1, 2, 3) """
_BOX = """with q as (select p_partkey, p_partkey * 37 % 1000 as x0, case when p_partkey % 50 <> 0 then p_partkey * 61 % 800 end as y0, p_partkey * 37 % 1000 + (p_size - 5) * 8 as x1, p_partkey * 61 % 800 + p_size * 4 as y1 from part),
 b as (select p_partkey, case when y0 is null then 0.0::double else x0 / 1000.0::double end as x0, case when y0 is null then 0.0::double else y0 / 800.0::double end as y0,
  case when y0 is null then 0.0::double else x1 / 1000.0::double end as x1, case when y0 is null then 0.0::double else y1 / 800.0::double end as y1 from q) """

QUERIES = {
    "slot_lines": (slot_lines, _LINES + "select event_id, pos, kind, at_us, text, speaker from l"),
    "text_blocks": (text_blocks, _BLOCKS + "select user_id, block_id, n_segments, date, text from z"),
    "window_bodies": (window_bodies, _BLOCKS + "select user_id, window_id, count(*) as n_blocks, length(string_agg(text, chr(10) || chr(10) order by block)) as chars, sha256(string_agg(text, chr(0) order by block)) as content_fingerprint from z group by 1, 2"),
    "cache_states": (cache_states, _WINDOWS + """select user_id, window_id, case when n % 3 <> 0 and n % 5 <> 0 and n % 7 <> 0 and (user_id % 6 = 0 or user_id % 4 <> 0) then 'cached' when user_id % 6 = 0 then 'refused' else 'build' end as state from w"""),
    "dissolved_windows": (dissolved_windows, _WINDOWS + """, s as (select user_id, day + 150 as s from o where o_orderpriority = '1-URGENT' union select user_id, day from o where o_orderpriority = '1-URGENT' and o_orderkey % 2 = 0)
        select distinct user_id, window_id from w join s using (user_id) where t_start <= s and s < t_end"""),
    "opened_windows": (opened_windows, _WINDOWS + """, v as (select user_id, min(window_id) filter (state = 'open' and user_id % 2 = 0) as id, max(t_end) filter (state = 'closed') as last from w group by 1)
        select v.user_id, coalesce(id, 'w20231114T221320Z') as window_id, coalesce(w.t_start, v.last, 0) as t_start, coalesce(w.t_end, 1700000000000000) as t_end, id is null as created from v left join w on v.user_id = w.user_id and v.id = w.window_id"""),
    "listed_windows": (listed_windows, _WINDOWS + "select user_id, window_id, cast(row_number() over (partition by user_id order by window_id) as integer) as place from w where state = 'closed' and window_id < 'w0018'"),
    "normal_boxes": (normal_boxes, _BOX + "select p_partkey, round(x0, 6) as x0, round(y0, 6) as y0, round(x1, 6) as x1, round(y1, 6) as y1 from b"),
    "role_of_box": (role_of_box, _BOX + """, c as (select p_partkey, greatest(0, least(1, x0)) as x0, greatest(0, least(1, y0)) as y0, greatest(0, least(1, x1)) as x1, greatest(0, least(1, y1)) as y1 from b)
        select p_partkey, case when x1 <= x0 or y1 <= y0 then 'main' when (y0 + y1) / 2 <= 0.05 then 'titlebar' when (y0 + y1) / 2 <= 0.3 and (x0 + x1) / 2 >= 0.82 then 'notification'
        when (y0 + y1) / 2 <= 0.12 then case when (x0 + x1) / 2 < 0.5 then 'tab' else 'toolbar' end when (y0 + y1) / 2 >= 0.95 then 'statusbar' when (x0 + x1) / 2 <= 0.18 then 'sidebar'
        when (x0 + x1) / 2 between 0.3 and 0.7 and (y0 + y1) / 2 between 0.3 and 0.7 and x1 - x0 between 0.15 and 0.45 and y1 - y0 between 0.06 and 0.3 then 'dialog' when (y0 + y1) / 2 >= 0.7 then 'compose' else 'main' end as role from c"""),
    "screen_items": (screen_items, None),
    "screen_lines": (screen_lines, None),
    "read_outcomes": (read_outcomes, """select s_suppkey, case when s_suppkey % 5 = 0 then 'unmatched' when least(s_suppkey % 5, s_suppkey % 4) / (s_suppkey % 5)::double > 0.5 then 'failed' else 'read' end as outcome,
        case when s_suppkey % 5 <= 1 then 'single' when s_suppkey % 4 = 0 then 'idle' else 'default' end as variant from supplier"""),
    "frames_to_read": (frames_to_read, E + "select user_id, event_id from e where k % 10 = 0 or event_type = 'error'"),
}
