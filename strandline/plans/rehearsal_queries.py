"""Queries over rehearsal, bound to the given tables: languages stand for users, documents for windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import rehearsal
from strandline.sources.tables import table


def _nights(spark, d):
    docs = table(spark, d, "documents").where("lang is not null")
    w = docs.select(F.col("lang").alias("user_id"), F.format_string("w%012d", "doc_id").alias("window_id"), "doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    windows = w.select("user_id", "window_id", F.when(F.col("doc_id") % 5 == 0, "open").otherwise("consolidated").alias("state"), F.when(F.col("doc_id") % 3 == 0, "failed").otherwise("published").alias("outcome"))
    tonight = w.groupBy("user_id").agg(F.format_string("w%012d", F.floor(F.max("doc_id") * 3 / 5)).alias("before"), F.lit(20000).alias("target"))
    return w.withColumn("part", F.lit(0)), windows, tonight


def prior_windows(spark, d):
    _, windows, tonight = _nights(spark, d)
    return rehearsal.prior_windows(windows, tonight, "user_id", "window_id").select("user_id", "window_id")


def rehearsal_draws(spark, d):
    blocks, windows, tonight = _nights(spark, d)
    held = rehearsal.sources("rawlog", tonight, "user_id", "window_id", blocks=blocks, windows=windows)
    budgets = tonight.select("user_id", (F.col("target") * 0.3).alias("budget"))
    got = rehearsal.drawn(rehearsal.pooled(held, "user_id", "window_id", "11"), budgets, "user_id", "window_id")
    return got.select("user_id", "window_id", "n", "used_before")


def rehearsals(spark, d):
    """Tonight's rehearsal by user, a tenth of it for paragraphs with a digit."""
    blocks, _, tonight = _nights(spark, d)
    held = rehearsal.sources("amp", tonight, "user_id", "window_id", corpora=blocks)
    got = rehearsal.rehearsal(held, tonight, "user_id", "window_id", 0.3, 11, 0.1, lambda p: p.rlike("[0-9]"))
    return got.select("user_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


_PRIOR = "with h as (select lang as user_id, doc_id, 'w' || lpad(cast(doc_id as varchar), 12, '0') as window_id, text from documents where lang is not null), h2 as (select * from h where doc_id % 5 <> 0 and doc_id % 3 <> 0 and doc_id < (select max(doc_id) * 3 // 5 from h g where g.user_id = h.user_id))"

QUERIES = {
    "prior_windows": (prior_windows, _PRIOR + " select user_id, window_id from h2"),
    "rehearsal_draws": (rehearsal_draws, _PRIOR + """, p as (select user_id, window_id, unnest(list_filter(string_split(text, chr(10)), lambda x: length(x) > 100)) as p, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: length(x) > 100), 1) - 1 as n from h2),
        b as (select user_id, window_id, cast(n as integer) as n, cast(coalesce(sum(length(p)) over (partition by user_id order by md5('11:' || user_id || ':' || window_id || ':0:' || n), window_id, n rows between unbounded preceding and 1 preceding), 0) as bigint) as used_before from p)
        select * from b where used_before < 6000"""),
    "rehearsals": (rehearsals, None),
}
