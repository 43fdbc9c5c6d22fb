"""Queries over metric families, ledger snapshots and block statistics, bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import metrics
from strandline.plans.record_queries import E, _events
from strandline.plans.window_queries import _text_blocks
from strandline.sources.tables import table

LANE = ["event_type", "lane"]


def _lanes(spark, d):
    return _events(spark, d).withColumns({"lane": F.col("k") % 3, "v": F.round("value")})


def exposition_lines(spark, d):
    """A counter, a gauge and a histogram of the events, as a scrape shows them."""
    e = _lanes(spark, d)
    count = e.groupBy(*LANE).agg(F.count("*").alias("value"))
    gauge = e.groupBy("event_type").agg((F.max("event_id") / 4).alias("value"))
    hist = metrics.histogram(e, "v", ["event_type"])
    return metrics.exposed([
        metrics.rendered(count, "deliveries_total", "counter", "Deliveries.", LANE),
        metrics.rendered(gauge, "last_quarter", "gauge", "A quarter of the last number.", ["event_type"]),
        metrics.rendered(hist, "value_units", "histogram", "Values.", ["event_type"]),
    ])


def histogram_quantiles(spark, d):
    return metrics.quantile(metrics.histogram(_lanes(spark, d), "v", ["event_type"]), 0.5, ["event_type"]).select("event_type", F.round("quantile", 6).alias("quantile"))


def ledger_snapshot(spark, d):
    """Customers as captures, orders as segments, lines as chunks."""
    o = table(spark, d, "orders").withColumns({"capture_id": F.col("o_custkey"), "segment_num": F.col("o_orderkey") % 40})
    captures = table(spark, d, "customer").select(F.col("c_custkey").alias("capture_id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 50).alias("expected"))
    chunks = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("status"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("dp_state"))
    return metrics.ledger_snapshot(captures, o.select("capture_id", "segment_num", F.col("o_orderstatus").alias("state")), chunks)


def day_block_stats(spark, d):
    return metrics.block_stats(_text_blocks(spark, d), ["user_id", "window_id"], "text", "n_segments", 400)


_HIST = E + """, l as (select *, k % 3 as lane, round(value) as v from e), b as (select unnest([0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0, 'infinity'::double]) as le, unnest(range(16)) as i),
    h as (select event_type, le, i, count(*) filter (v <= le) as n from l, b where v is not null group by 1, 2, 3) """
_NUM = "case when {0} = floor({0}) then cast(cast({0} as bigint) as varchar) else cast({0} as varchar) end"

QUERIES = {
    "exposition_lines": (exposition_lines, _HIST + f""", c as (select event_type, lane, count(*) as n, row_number() over (order by event_type, cast(lane as varchar)) as r from l group by 1, 2), g as (select event_type, max(event_id) / 4.0 as v, row_number() over (order by event_type) as r from l group by 1),
        s as (select event_type, sum(v) as s, count(v) as n, row_number() over (order by event_type) as r from l where v is not null group by 1)
        select 0 as family, 0::bigint as place, '# HELP deliveries_total Deliveries.' as line union all select 0, 1, '# TYPE deliveries_total counter'
        union all select 0, r * 1000, 'deliveries_total{{event_type="' || event_type || '",lane="' || lane || '"}} ' || n from c
        union all select 1, 0, '# HELP last_quarter A quarter of the last number.' union all select 1, 1, '# TYPE last_quarter gauge'
        union all select 1, r * 1000, 'last_quarter{{event_type="' || event_type || '"}} ' || {_NUM.format("v::double")} from g
        union all select 2, 0, '# HELP value_units Values.' union all select 2, 1, '# TYPE value_units histogram'
        union all select 2, s.r * 1000 + i, 'value_units_bucket{{event_type="' || h.event_type || '",le="' || case when i = 15 then '+Inf' when le = floor(le) then cast(cast(le as bigint) as varchar) else cast(le as varchar) end || '"}} ' || h.n from h join s using (event_type)
        union all select 2, r * 1000 + 16, 'value_units_sum{{event_type="' || event_type || '"}} ' || cast(cast(s as bigint) as varchar) from s
        union all select 2, r * 1000 + 17, 'value_units_count{{event_type="' || event_type || '"}} ' || n from s"""),
    "histogram_quantiles": (histogram_quantiles, _HIST + """, t as (select event_type, max(n) as total from h group by 1), f as (select h.*, total * 0.5 as rank, lag(le, 1, 0) over (partition by event_type order by i) as lo, lag(n, 1, 0) over (partition by event_type order by i) as before from h join t using (event_type)),
        g as (select * from f where n >= rank qualify row_number() over (partition by event_type order by i) = 1)
        select event_type, round(case when i = 15 then lo when n = before then le else lo + (le - lo) * (rank - before) / (n - before) end, 6) as quantile from g"""),
    "ledger_snapshot": (ledger_snapshot, """with s as (select o_custkey as c, count(distinct o_orderkey % 40) as got, max(o_orderkey % 40) as last from orders group by 1), m as (select c_custkey % 50 as expected, got, last from customer left join s on c = c_custkey where c_custkey % 3 <> 0)
        select 'segments' as family, o_orderstatus as state, count(*) as n from orders group by 2 union all select 'chunks', l_linestatus, count(*) from lineitem group by 2
        union all select 'dp_state', case when l_returnflag <> 'N' then l_returnflag else 'unknown' end, count(*) from lineitem group by 2 union all select 'captures', case when c_custkey % 3 = 0 then 'open' else 'ended' end, count(*) from customer group by 2
        union all select 'missing', 'ended', coalesce(sum(greatest(expected, coalesce(last + 1, 0)) - coalesce(got, 0)), 0)::bigint from m"""),
    "day_block_stats": (day_block_stats, None),
}
