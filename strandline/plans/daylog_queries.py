"""Day-log queries over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.operators import daylog
from strandline.sources.tables import table


def daylog_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each user's event log: dedup, 10-minute grid, gap and size cap, ordered text."""
    events = daylog.with_stream_columns(table(spark, sf_dir, "events"))
    return daylog.blocks(daylog.segments(daylog.latest_per_chunk(events), 600), 600)


_BLOCKS_SQL = """
with e as (
  select event_id, user_id, event_type, ts,
         cast(user_id as varchar) || ':' || json_extract_string(props, '$.k') || ':' || strftime(ts, '%Y%m%d') as chunk_id,
         ts + to_minutes(event_id % 97) as updated_at
  from events),
d as (select * from e qualify row_number() over (partition by user_id, chunk_id order by updated_at desc, event_id desc) = 1),
s as (select user_id, cast(floor(epoch(ts) / 600) as bigint) as bucket,
             string_agg(event_type, ' | ' order by ts, event_id) as line, count(*) as n
      from d group by all),
g as (select *, case when (bucket - lag(bucket) over (partition by user_id order by bucket)) * 600 - 600 > 3600 then 1 else 0 end as brk from s),
i as (select *, sum(brk) over (partition by user_id order by bucket rows unbounded preceding) as island from g),
b as (select *, cast(floor((row_number() over (partition by user_id, island order by bucket) - 1) / 12) as bigint) as part from i),
k as (select user_id, island, part, min(bucket) as first_bucket, max(bucket) as last_bucket, count(*) as n_segments,
             cast(sum(n) as bigint) as n_events, string_agg(line, chr(10) order by bucket) as text
      from b group by all)
select user_id, 'w_b' || lpad(cast(row_number() over (partition by user_id order by first_bucket) - 1 as varchar), 4, '0') as block_id,
       first_bucket, last_bucket, n_segments, n_events, text from k
"""

QUERIES = {"daylog_blocks": (daylog_blocks, _BLOCKS_SQL)}
