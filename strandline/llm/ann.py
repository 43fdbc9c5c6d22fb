"""Operator 10, approximate nearest neighbours: a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample (SAMPLE vectors of lowest hashes). Every vector of the table is put into the
leaf it descends to. A query descends too, keeps the branches it did not take in a priority queue ordered by the
distance to their centres, and visits leaves from the queue. How many it visits is calibrated: for a bounded set of
queries the true neighbours are found by brute force over all rows (the stated queries against all rows, in blocks), and
visits widen until TARGET of them are found, and for each query until its leaves hold more than k vectors. Queries and vectors meet by (bin, block): neighbouring leaves share a bin of about
BLOCK vectors, and a leaf of more is cut into blocks by its counted size, so that a leaf with a third of all rows is many
tasks' work, and queries by parts of about ASKED; per block only a query's best k among the leaves it visits go on.

Edge cases: vectors that are null, zero, of another length than most, or that hold null or non-finite components take
no part, as queries or candidates; equal distances are ordered by the smaller identifier; rows that repeat an identifier
are candidates each, but never of a query of that identifier; with fewer candidates than k all are returned; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm import common

#: Vectors the tree is fitted on, at most.
SAMPLE = 20_000
#: Children of a node, and the sampled vectors from which a node is not split further.
FANOUT, LEAF = 64, 48
#: Vectors of a leaf that meet queries in one task, and queries that meet them there, about.
BLOCK, ASKED = 4096, 4096
#: Queries calibrated on, and the recall they must reach.
CALIBRATION, TARGET = 200, 0.96


def fit_tree(sample: np.ndarray, seed: int = 10) -> list[tuple[np.ndarray, list[int]]]:
    """Nodes as (centres of the children, the children's node numbers); a child below 0 is leaf -1 - number."""
    rng, nodes, leaves = np.random.default_rng(seed), [], 0

    def grow(x: np.ndarray, depth: int) -> int:
        nonlocal leaves
        distinct = len(np.unique(x[:LEAF * 4], axis=0)) if len(x) else 0
        if len(x) <= LEAF or distinct < 2 or depth > 8:
            leaves += 1
            return -leaves
        centres = x[rng.choice(len(x), min(FANOUT, len(x)), replace=False)].copy()
        for _ in range(8):
            at = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
            for j in range(len(centres)):
                if (at == j).any():
                    centres[j] = x[at == j].mean(0)
        used = [j for j in range(len(centres)) if (at == j).any()]
        if len(used) < 2:
            leaves += 1
            return -leaves
        own = len(nodes)
        nodes.append(None)
        nodes[own] = (centres[used], [grow(x[at == j], depth + 1) for j in used])
        return own

    root = grow(sample, 0)
    return nodes if root >= 0 else []


def leaf_of(tree, x: np.ndarray) -> np.ndarray:
    """The leaf each row of ``x`` descends to."""
    out = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))] if tree else []
    while todo:
        node, rows = todo.pop()
        centres, children = tree[node]
        near = ((centres**2).sum(1) - 2 * x[rows] @ centres.T).argmin(1)
        for j, child in enumerate(children):
            if len(own := rows[near == j]):
                if child < 0:
                    out[own] = -1 - child
                else:
                    todo.append((child, own))
    return out


def best_bins(tree, q: np.ndarray, visits: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
    """The first ``visits`` leaves of a best-bin-first traversal for the query ``q``, and as many more as hold ``least``
    vectors in all by their ``sizes``."""
    if not tree:
        return [0]
    out, held, queue = [], 0, [(0.0, 0, 0)]
    while queue and (len(out) < visits or held < least):
        _, node, _ = heapq.heappop(queue)
        if node < 0:
            out.append(-1 - node)
            held += 0 if sizes is None else int(sizes[-1 - node])
            continue
        centres, children = tree[node]
        for d, child in zip(((centres - q) ** 2).sum(1).tolist(), children):
            heapq.heappush(queue, (d, child, 0))
    return out


def n_leaves(tree) -> int:
    """Number of leaves."""
    return max((-c for _, cs in tree for c in cs if c < 0), default=1)


def packed(sizes: dict[int, int], leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each leaf, blocks of each bin): neighbouring leaves share a bin of about BLOCK vectors; a leaf of more than
    BLOCK has a bin of its own, in several blocks."""
    bins, blocks, held = np.zeros(leaves, np.int64), [1], 0
    for leaf in range(leaves):
        n = sizes.get(leaf, 0)
        if held and held + n > BLOCK:
            blocks.append(1)
            held = 0
        bins[leaf], held = len(blocks) - 1, held + n
        blocks[-1] = max(1, -(-held // BLOCK))
    return bins, np.array(blocks, np.int64)


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist(), np.float64) if len(column) else np.zeros((0, 0))


def _best(q_ids, q, v_ids, v, k: int, allowed=None) -> pd.DataFrame:
    """Each query's k nearest of these vectors, by distances in double precision; a query never finds its own id.

    ``allowed(i)``: booleans, the vectors that query i visits."""
    out = []
    step = max(1, 4_000_000 // max(1, v.size))
    for a in range(0, len(q_ids) if len(v_ids) else 0, step):
        d = np.sqrt(((q[a : a + step, None, :] - v[None]) ** 2).sum(2))
        d[q_ids[a : a + step, None] == v_ids[None]] = np.inf
        for i in range(len(d)):
            if allowed is not None:
                d[i][~allowed(a + i)] = np.inf
            last = min(k, len(v_ids)) - 1
            near = np.flatnonzero(d[i] <= np.partition(d[i], last)[last])
            near = near[np.isfinite(d[i][near])]
            near = near[np.lexsort((v_ids[near], d[i][near]))][:k]
            out.append((np.full(len(near), q_ids[a + i]), v_ids[near], d[i][near]))
    if not out:
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    return pd.DataFrame({n: np.concatenate([o[j] for o in out]) for j, n in enumerate(("query_id", "vec_id", "score"))})


_FOUND = "query_id long, vec_id long, score double"


def _brute(vectors: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """The k nearest per batch of ``vectors`` for a bounded set of queries that travels with the task."""

    def run(batches):
        for b in batches:
            yield _best(q_ids, q, b["vec_id"].to_numpy(np.int64), _matrix(b["v"]), k)

    return vectors.mapInPandas(run, _FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part; of several lengths the most frequent one."""
    v = F.col(vec_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(fine & F.exists("v", lambda x: x != 0))
    dim = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (dim.n if dim else 0))


def nearest(table: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """For each row whose id is divisible by ``every``, its ``k`` nearest other rows: query_id, rank, vec_id, score."""
    spark = table.sparkSession
    common.ship(spark)
    rows = usable(table, id_col, vec_col)
    hashed = F.xxhash64(F.lit(10), "vec_id", "v")
    picked = rows.orderBy(hashed, "vec_id").limit(SAMPLE).collect()
    tree = fit_tree(np.array([r.v for r in picked]))

    def place(batches):
        for b in batches:
            yield b.assign(leaf=leaf_of(tree, _matrix(b["v"])))

    placed = common.staged(rows.mapInPandas(place, "vec_id long, v array<double>, leaf long"), "leaves")
    asked = placed.where(F.col("vec_id") % every == 0)
    trial = asked.orderBy(hashed, "vec_id").limit(CALIBRATION).collect()
    if not trial:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    q_ids, q = np.array([r.vec_id for r in trial]), np.array([r.v for r in trial])
    visits = _calibrated(placed, tree, q_ids, q, k, target)

    # the tree has at most SAMPLE leaves, so their sizes are a bounded table
    sizes = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().collect()}
    bins, blocks = packed(sizes, n_leaves(tree))
    counted = np.array([sizes.get(leaf, 0) for leaf in range(n_leaves(tree))], np.int64)
    parts = max(1, -(-asked.count() // ASKED))  # queries are dealt to parts, so that no block meets more at once

    def deal(batches):
        for b in batches:
            leaf = b["leaf"].to_numpy(np.int64)
            own = pd.util.hash_array(b["vec_id"].to_numpy(np.int64)) % blocks[bins[leaf]].astype(np.uint64)
            each = b.assign(bin=bins[leaf], block=own.astype(np.int64))
            for part in range(parts):
                yield each.assign(part=part)

    def visit(batches):
        for b in batches:
            rows = []
            for i, v in zip(b["vec_id"], b["v"]):
                seen = np.array(best_bins(tree, np.asarray(v, np.float64), visits, counted, k + 1), np.int64)
                at = bins[seen]
                rows += [(i, v, x, y, seen[at == x]) for x in np.unique(at) for y in range(blocks[x])]
            met = pd.DataFrame(rows, columns=["vec_id", "v", "bin", "block", "leaves"])
            part = pd.util.hash_array(met["vec_id"].to_numpy(np.int64)) % np.uint64(parts)
            yield met.assign(part=part.astype(np.int64))[["vec_id", "v", "bin", "block", "part", "leaves"]]

    def meet(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        q, v = _matrix(queries["v"]), _matrix(vectors["v"])
        leaf, seen = vectors["leaf"].to_numpy(np.int64), queries["leaves"].tolist()
        return _best(queries["vec_id"].to_numpy(np.int64), q, vectors["vec_id"].to_numpy(np.int64), v, k, lambda i: np.isin(leaf, seen[i]))

    dealt = placed.mapInPandas(deal, "vec_id long, v array<double>, leaf long, bin long, block long, part long").groupBy("bin", "block", "part")
    visiting = asked.mapInPandas(visit, "vec_id long, v array<double>, bin long, block long, part long, leaves array<long>").groupBy("bin", "block", "part")
    found = dealt.cogroup(visiting).applyInPandas(meet, _FOUND)
    return _top(found, k).select("query_id", "rank", "vec_id", "score")


def _calibrated(placed: DataFrame, tree, q_ids: np.ndarray, q: np.ndarray, k: int, target: float) -> int:
    """The least number of visited leaves with which ``target`` of the trial queries' true neighbours are found."""
    if not tree:
        return 1
    true = F.broadcast(_top(_brute(placed.select("vec_id", "v"), q_ids, q, k), k).select("query_id", "vec_id"))  # CALIBRATION times k rows
    truth = placed.select("vec_id", "leaf").join(true, "vec_id").distinct().select("query_id", "leaf").collect()
    by: dict[int, list[int]] = {}
    for r in truth:
        by.setdefault(r.query_id, []).append(r.leaf)
    all_leaves = n_leaves(tree)
    places = []
    for i, x in zip(q_ids.tolist(), q):
        at = {leaf: n for n, leaf in enumerate(best_bins(tree, x, all_leaves))}
        places += [at[leaf] for leaf in by.get(i, [])]
    places.sort()
    return places[min(len(places) - 1, int(np.ceil(target * len(places))))] + 1 if places else 1


def recall(table: DataFrame, found: DataFrame, queries: int = CALIBRATION, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> float:
    """Share of the true k nearest of a bounded set of the queries in ``found``, by brute force over all rows."""
    rows = usable(table, id_col, vec_col)
    ids = found.select("query_id").distinct().orderBy(F.xxhash64("query_id")).limit(queries)
    own = rows.join(F.broadcast(ids), rows.vec_id == ids.query_id).select("vec_id", "v").collect()
    true = _top(_brute(rows, np.array([r.vec_id for r in own]), np.array([r.v for r in own]), k), k)
    hits = true.join(found, ["query_id", "vec_id"], "left_semi").count()
    return hits / max(1, true.count())


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: 10 nearest of every hundredth vector among all embeddings."""
    return nearest(common.table(spark, sf_dir, "embeddings"))
