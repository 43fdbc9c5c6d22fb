"""Metric families over rows: counters, gauges and histograms, and the lines of the text exposition format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The upper edges of a histogram's buckets where none are named; +Inf comes after them.
EDGES = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)
KINDS = ("counter", "gauge", "histogram")


def escaped(value: Column) -> Column:
    """A label's value as the format wants it; null is empty."""
    out = F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def number(x: Column) -> Column:
    """A number as the format wants it: whole ones without a point up to 1e15, +Inf, -Inf and NaN by name, others in full."""
    d = x.cast("double")
    exact = (d == F.floor(d)) & (F.abs(d) < 1e15)
    text = F.lower(F.regexp_replace(d.cast("string"), r"E(-?\d)$", "e$1"))
    return F.when(F.isnan(d), "NaN").when(d == float("inf"), "+Inf").when(d == float("-inf"), "-Inf").when(exact, d.cast("decimal(20,0)").cast("string")).otherwise(text)


def _labels(names: list[str], extra: dict[str, Column] | None = None) -> Column:
    pairs = [F.concat(F.lit(f'{n}="'), escaped(F.col(n)), F.lit('"')) for n in names]
    pairs += [F.concat(F.lit(f'{n}="'), escaped(v), F.lit('"')) for n, v in (extra or {}).items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")) if pairs else F.lit("")


def histogram(rows: DataFrame, value: str, labels: list[str], edges: tuple[float, ...] = EDGES) -> DataFrame:
    """(labels, buckets, sum, count): per label set the cumulative counts at every edge and +Inf, and sum and count of the
    values; nulls are no observations."""
    held = rows.where(F.col(value).isNotNull())
    ends = sorted({e for e in edges if e != float("inf")})
    counts = [F.count_if(F.col(value) <= e).alias(f"_{i}") for i, e in enumerate(ends)]
    got = held.groupBy(*labels).agg(*counts, F.sum(F.col(value).cast("double")).alias("sum"), F.count("*").alias("count"))
    steps = [F.struct(F.lit(float(e)).alias("le"), F.col(f"_{i}").alias("n")) for i, e in enumerate(ends)]
    return got.select(*labels, F.array(*steps, F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("n"))).alias("buckets"), "sum", "count")


def rendered(family: DataFrame, name: str, kind: str, said: str, labels: list[str], value: str = "value") -> DataFrame:
    """(place, line) of one family: HELP, TYPE, then its samples by label set. A counter or gauge has a row (labels, value) per
    label set, a histogram what ``histogram`` gives. A family without samples has no lines."""
    if kind not in KINDS:
        raise ValueError(f"a metric is a {', '.join(KINDS)}, not {kind!r}")
    if kind == "histogram":
        steps = F.transform("buckets", lambda b: F.concat(F.lit(f"{name}_bucket"), _labels(labels, {"le": number(b["le"])}), F.lit(" "), b["n"].cast("string")))
        tail = F.array(F.concat(F.lit(f"{name}_sum"), _labels(labels), F.lit(" "), number(F.col("sum"))), F.concat(F.lit(f"{name}_count"), _labels(labels), F.lit(" "), F.col("count").cast("string")))
        lines = F.concat(steps, tail)
    else:
        lines = F.array(F.concat(F.lit(name), _labels(labels), F.lit(" "), number(F.col(value))))
    # a metric has few label sets: they are a dimension
    order = W.orderBy(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in labels]) if labels else W.orderBy(F.lit(0))
    numbered = family.withColumns({"_r": F.row_number().over(order), "_l": lines})
    body = numbered.select("_r", F.posexplode("_l").alias("_i", "line")).select((F.col("_r") * 1000 + F.col("_i")).cast("long").alias("place"), "line")
    head = family.limit(1).select(F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("place"), F.lit(t).alias("line")) for i, t in enumerate((f"# HELP {name} {said}", f"# TYPE {name} {kind}"))])))
    return head.unionByName(body)


def exposed(families: list[DataFrame]) -> DataFrame:
    """(family, place, line) of several families' lines, in the order of the list."""
    out = None
    for i, f in enumerate(families):
        own = f.select(F.lit(i).alias("family"), "place", "line")
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no families")
    return out


def quantile(hist: DataFrame, q: float, labels: list[str]) -> DataFrame:
    """(labels, quantile): linear inside the first bucket that reaches the share ``q``; the last edge that is a number where that
    is the last bucket; null without observations."""
    rank = F.col("count") * F.lit(q)
    i = F.size(F.filter("buckets", lambda b: b["n"] < rank))
    low = F.when(i == 0, F.struct(F.lit(0.0).alias("le"), F.lit(0).cast("long").alias("n"))).otherwise(F.get("buckets", F.greatest(i - 1, F.lit(0))))
    high = F.get("buckets", i)
    inside = low["le"] + (high["le"] - low["le"]) * (rank - low["n"]) / F.nullif(high["n"] - low["n"], F.lit(0))
    return hist.select(*labels, F.when(F.col("count") == 0, None).when(high["le"] == float("inf"), low["le"]).otherwise(F.coalesce(inside, high["le"])).alias("quantile"))


def ledger_snapshot(captures: DataFrame, segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """(family, state, n) of a recording ledger: segments by state, chunks by status and by what the processor says of them,
    captures by whether they ended, and the missing segments of ended captures.

    ``captures``: (capture_id, expected; null while it is open), ``segments``: (capture_id, segment_num, state), ``chunks``:
    (status, dp_state; null counts as unknown)."""
    count = lambda df, name, state: df.groupBy(state.cast("string").alias("state")).agg(F.count("*").alias("n")).select(F.lit(name).alias("family"), "state", "n")
    held = segments.groupBy("capture_id").agg(F.count_distinct("segment_num").alias("got"), F.max("segment_num").alias("last"))
    both = captures.join(held, "capture_id", "left")
    sent = F.greatest(F.col("expected"), F.coalesce(F.col("last") + 1, F.lit(0)))
    missing = both.where("expected is not null").agg(F.coalesce(F.sum(sent - F.coalesce("got", F.lit(0))), F.lit(0)).alias("n"))
    parts = [
        count(segments, "segments", F.col("state")),
        count(chunks, "chunks", F.col("status")),
        count(chunks, "dp_state", F.coalesce("dp_state", F.lit("unknown"))),
        count(captures, "captures", F.when(F.col("expected").isNull(), "open").otherwise("ended")),
        missing.select(F.lit("missing").alias("family"), F.lit("ended").alias("state"), F.col("n").cast("long").alias("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def block_stats(blocks: DataFrame, owner: list[str], text: str, size: str, cap: int) -> DataFrame:
    """Per owner: blocks, their sizes as text ('3:2 5:1', by size), mean (rounded half to even), greatest and total length of
    their texts, and how many are longer than ``cap``."""
    n = F.length(text)
    sizes = blocks.groupBy(*owner, size).agg(F.count("*").alias("_n")).groupBy(*owner).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(size, "_n"))), lambda r: F.concat_ws(":", r[size].cast("string"), r["_n"].cast("string"))), " ").alias("sizes"))
    own = blocks.groupBy(*owner).agg(F.count("*").alias("blocks"), F.bround(F.avg(n)).cast("long").alias("chars_mean"), F.max(n).cast("long").alias("chars_max"), F.sum(n).alias("chars_total"), F.count_if(n > cap).alias("over_cap"))
    return own.join(sizes, owner)
