"""Operator 9, mixing sources to target weights: min-cost flow over membership patterns, then seeded documents.

Documents are aggregated by membership pattern (the set of sources they belong to): a table of at most MAX_PATTERNS
rows. On the driver a network routes each pattern's words to the quotas of its sources; a word's second and third pass
cost more than its first (convex costs), so that nothing is repeated while fresh words can fill a quota. Each pattern
then takes whole passes of all its documents, and the rest from seeded documents: a prefix of the documents in hash
order, then refills of what is left with documents that still fit. A prefix is known by its cut, the last row in it,
which sums per hash bucket locate; only the one bucket of each pattern that holds the cut is put in order. The cuts are
a few values per pattern, so that a row's verdict is a narrow expression and no document is shuffled.

Edge cases: null or empty text has size 0 and takes 0; a null source is a source of its own, last in order; sources of
size 0 have target 0; rows that repeat an identifier, or have none, are mixed each; an empty table gives an empty result; other columns
are not read by ``mix``.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm import common

#: Patterns the driver's network holds at most; more raise an error, since sources are a small dimension.
MAX_PATTERNS = 20_000
#: Passes over a source at most.
MAX_PASSES = 3
#: Hash buckets of a pattern's documents.
BUCKETS = 4096
#: Refills of what the seeded prefix left open.
REFILLS = 8
#: Beyond every hash and every row number.
LAST = (1 << 63) - 1
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict, weights: dict, total: int | None = None) -> dict:
    """Each source's share of ``total`` (all sizes) by weight, at most MAX_PASSES times its size; what is over is
    shared again by weight among the others until none is above."""
    total = sum(sizes.values()) if total is None else total
    out, open_ = {}, sorted(sizes, key=lambda s: (s is None, s or ""))
    left = float(total)
    while open_:
        by = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / by > MAX_PASSES * sizes[s]]
        if not over:
            out |= {s: left * weights[s] / by for s in open_}
            break
        for s in over:
            out[s] = float(MAX_PASSES * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def flow(patterns: dict[tuple, int], quotas: dict) -> dict[tuple, float]:
    """Words each pattern gives: a min-cost flow by successive shortest paths.

    Network: start -> pattern (MAX_PASSES arcs of the pattern's size, costs 0, 1, 2), pattern -> its sources (free),
    source -> end (its quota). Every augmentation saturates an arc; ties follow the order of patterns and sources.
    """
    names = list(patterns)
    sources = sorted(quotas, key=lambda s: (s is None, s or ""))
    node_p = {p: 1 + i for i, p in enumerate(names)}
    node_s = {s: 1 + len(names) + i for i, s in enumerate(sources)}
    end = 1 + len(names) + len(sources)
    to, cap, cost, out = [], [], [], [[] for _ in range(end + 1)]

    def arc(a, b, c, w):
        for x, y, z, v in ((a, b, c, w), (b, a, 0.0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(z)
            cost.append(v)

    for p in names:
        for k in range(MAX_PASSES):
            arc(0, node_p[p], float(patterns[p]), k)
        for s in p:
            arc(node_p[p], node_s[s], float("inf"), 0)
    for s in sources:
        arc(node_s[s], end, float(quotas[s]), 0)
    potential = [0] * (end + 1)
    while True:
        far, via = [float("inf")] * (end + 1), [-1] * (end + 1)
        far[0], queue = 0, [(0, 0)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for e in out[a]:
                if cap[e] > 1e-9 and d + cost[e] + potential[a] - potential[to[e]] < far[to[e]]:
                    far[to[e]], via[to[e]] = d + cost[e] + potential[a] - potential[to[e]], e
                    heapq.heappush(queue, (far[to[e]], to[e]))
        if far[end] == float("inf"):
            break
        potential = [p + (f if f < float("inf") else 0) for p, f in zip(potential, far)]
        path, a = [], end
        while a:
            path.append(via[a])
            a = to[via[a] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push
    return {p: sum(cap[e ^ 1] for e in out[node_p[p]] if cost[e] == 0 and not e & 1 and to[e] > len(names)) for p in names}


def _measures(seed: int, id_col: str, text_col: str, source_col: str, kind: T.DataType) -> dict:
    """What the mix needs of a row, by name. ``u`` hashes the text too, so that rows without an identifier spread."""
    many = isinstance(kind, T.ArrayType)
    return {
        "sources": F.coalesce(F.array_sort(F.array_distinct(F.col(source_col))), F.array().cast("array<string>")) if many else F.array(F.col(source_col)),
        "size": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"),
        "u": F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(F.col(text_col))),
    }


def _routed(rows: DataFrame, weights) -> list[dict]:
    """Per membership pattern of ``rows``: its number, key, passes, room for more words, source_size and target."""
    found = rows.groupBy("sources").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns: sources are meant to be a small dimension")
    key = lambda p: [(s is None, s or "") for s in p]
    patterns = {p: n for p, n in sorted(((tuple(r.sources), r.size) for r in found), key=lambda x: key(x[0]))}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = weights or {s: 1 + i % 3 for i, s in enumerate(ordered)}
    quota = targets(sizes, weights, sum(patterns.values()))
    given = flow(patterns, quota)
    out = []
    for p, n in patterns.items():
        passes = min(MAX_PASSES, int(given[p] // n)) if n else 0
        room = int(round(given[p] - passes * n)) if passes < MAX_PASSES else 0
        out.append({"sources": list(p), "pattern": len(out), "passes": passes, "room": room, "source_size": sum(sizes[s] for s in p), "target": float(sum(quota[s] for s in p)), "cuts": []})
    return out


def _named(sources) -> Column:
    """A pattern as a join key; null sources join too."""
    return F.transform(sources, lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit("")))


def _planned(rows: DataFrame, plan: list[dict]) -> DataFrame:
    """``rows`` with their pattern's columns and ``extra``: whether some cut takes the row once more."""
    fields = ["sources", "pattern", "passes", "room", "source_size", "target", "cuts"]
    kind = "sources array<string>, pattern int, passes int, room long, source_size long, target double, cuts array<struct<room:long,bucket:int,u:long,row:long>>"
    small = rows.sparkSession.createDataFrame([tuple(p[f] for f in fields) for p in plan], kind)
    place = F.struct("bucket", "u", "row")
    taken = F.exists("cuts", lambda c: (F.col("size") <= c.room) & (place <= F.struct(c.bucket, c.u, c.row)))
    # at most MAX_PATTERNS rows of at most REFILLS cuts
    both = rows.withColumns({"bucket": F.pmod("u", F.lit(BUCKETS)).cast("int"), "_k": _named(F.col("sources"))}).join(F.broadcast(small.withColumn("_k", _named(F.col("sources"))).drop("sources")), "_k")
    return both.drop("_k").withColumn("extra", (F.col("size") > 0) & taken)


def _refill(rows: DataFrame, plan: list[dict]) -> bool:
    """One more cut for each pattern with room, over the rows that fit and are not taken yet; false when none is found.

    A job sums by hash bucket, a second one orders the bucket in which the sum passes the room."""
    fits = _planned(rows, plan).where(~F.col("extra") & (F.col("size") > 0) & (F.col("size") <= F.col("room")))
    sums = fits.groupBy("pattern", "bucket").agg(F.sum("size").alias("own"), F.first("room").alias("room"))
    upto = F.sum("own").over(W.partitionBy("pattern").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    whole = F.col("upto") <= F.col("room")
    found = sums.withColumn("upto", upto).groupBy("pattern").agg(F.max(F.when(whole, F.col("upto"))).alias("used"), F.max(F.when(whole, F.col("bucket"))).alias("last"), F.min(F.when(~whole, F.col("bucket"))).alias("bucket")).collect()
    if not found:
        return False
    kind = "pattern int, bucket int, before long"
    edges = rows.sparkSession.createDataFrame([(r.pattern, r.bucket, r.used or 0) for r in found if r.bucket is not None], kind)
    inside = W.partitionBy("pattern").orderBy("u", "row").rowsBetween(W.unboundedPreceding, 0)
    ordered = fits.join(F.broadcast(edges), ["pattern", "bucket"]).withColumn("upto", F.col("before") + F.sum("size").over(inside)).where("upto <= room")
    inner = {r.pattern: r for r in ordered.groupBy("pattern").agg(F.max(F.struct("upto", "bucket", "u", "row")).alias("m")).select("pattern", "m.*").collect()}
    cut = False
    for r in found:
        p, last = plan[r.pattern], inner.get(r.pattern)
        if last is not None:
            p["cuts"].append((p["room"], last.bucket, last.u, last.row))
            p["room"] -= last.upto
        elif r.last is not None:
            p["cuts"].append((p["room"], r.last, LAST, LAST))
            p["room"] -= r.used
        else:
            continue
        cut = True
    return cut


def _mixed(rows: DataFrame, weights=None) -> DataFrame:
    """``rows`` (a staged table with row, sources, size and u) with source_size, target and times, the passes over a row."""
    needed = rows.select("row", "sources", "size", "u")
    plan = _routed(needed, weights)
    for _ in range(REFILLS):
        if not _refill(needed, plan):
            break
    times = F.when(F.col("size") > 0, F.col("passes") + F.col("extra").cast("int")).otherwise(0)
    return _planned(rows, plan).withColumn("times", times)


def mix(docs: DataFrame, weights=None, seed: int = 9, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: id, size, source_size, target, taken (words, repeats counted).

    ``source_col`` holds a string, or an array of strings for overlapping sources: then source_size and target are sums
    over the row's sources. ``weights``: source -> weight; by default 1, 2, 3 repeating in code-point order, null last.
    """
    found = _measures(seed, id_col, text_col, source_col, docs.schema[source_col].dataType)
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), *[c.alias(n) for n, c in found.items()])
    done = _mixed(common.staged(rows, "mix"), weights)
    return done.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 9) -> DataFrame:
    """The rows of the mix with all their columns, each as many times as the mix passes over it.

    The documents are staged once with their measures, the cuts are found on the measures alone, and the last scan
    deals rows out; no text is shuffled."""
    found = _measures(seed, "doc_id", "text", "source", docs.schema["source"].dataType)
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("whole")
    rows = docs.select(whole, F.monotonically_increasing_id().alias("row"), *[c.alias(n) for n, c in found.items()])
    done = _mixed(common.staged(rows, "documents"), None).where("times > 0")
    return done.select("whole", F.explode(F.sequence(F.lit(1), F.col("times")))).select("whole.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: weights 1, 2, 3 over the sources of all documents."""
    return mix(common.table(spark, sf_dir, "documents"))
