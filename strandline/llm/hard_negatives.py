"""Operator 11, hard-negative mining: a pivot table over vectors augmented so that inner products are Euclidean distances.

A row x gets one more component, sqrt(M^2 - |x|^2), an anchor q gets 0; then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, and the
nearest rows are those of the highest score. Distances of all rows to PIVOTS pivots (of a bounded sample) are stored.
By the triangle inequality |d(q,p) - d(x,p)| <= d(q,x) <= d(q,p) + d(x,p), so the table brackets every score:

- Rows are dealt to the region of their nearest pivot, and a region to blocks by hash, so that a hot region or vector is many
  tasks' work. A region's least and greatest distances to all pivots bracket the scores of all its rows; an anchor chunk
  visits only the regions whose bracket reaches what one of its anchors still looks for.
- In a block the first TABLE pivots bracket each row's score. Only rows whose bracket passes are scored exactly.

Three searches: each chunk in one block of its own region, which gives every anchor a score that its positives must reach; the
positives, over all regions which that leaves; the negatives, between 4/5 of the least positive score and the greatest one.
A block of rows or a chunk of anchors is one Spark row of a bounded size; chunks and blocks meet by (block, part of chunks),
so that a task holds one block and at most PART anchors whatever the table's size. The anchors are the stated query set.

Exactness: brackets carry a slack for rounding; scores are integers, by floating-point products where all of them stay below
2^53, else by whole numbers. A score beyond 64 bits raises an error.

Edge cases: rows with a null label, a null vector, or a null or non-finite component take no part; a null identifier is
ordered last among equal scores and is no anchor; rows that repeat an identifier are rows of their own, as anchors,
positives and negatives; vectors of several lengths are filled up with zeros; equal scores go by identifier; an anchor
without positives, or whose positives have negative scores, has no negatives; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm import common

#: Vectors that pivots are chosen from, pivots, and those whose distances bracket single rows.
SAMPLE, PIVOTS, TABLE = 4000, 32, 8
#: Bytes of a block's vectors; anchors of a chunk, and of the chunks that meet a block in one task.
BYTES, CHUNK, PART = 2 << 20, 256, 2048
#: Positives of an anchor, negatives of a positive; the share of brackets that pass from which a block is scored whole.
POSITIVES, NEGATIVES, DENSE = 5, 5, 0.02
_LEAST, _MOST = -(2**63), 2**63 - 1
_BLOBS = ["rows", "ids", "gaps", "labels", "v", "d"]


def usable(table: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(row, id, label, v) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    rows = table.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where("label is not null and v is not null").where(fine)


def quantised(vectors: list, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, filled up with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(scale * out)


class Pivots:
    """Pivots in the augmented space, and distances to them."""

    def __init__(self, sample: np.ndarray, bound: float, seed: int = 11):
        self.bound = bound
        rng, held = np.random.default_rng(seed), np.unique(sample, axis=0)
        chosen = [int(rng.integers(len(held)))]
        far = self._squares(held, held[chosen], True)[:, 0]
        while len(chosen) < min(PIVOTS, len(held)) and far.max() > 0:
            chosen.append(int(rng.choice(len(held), p=far / far.sum())))
            far = np.minimum(far, self._squares(held, held[chosen[-1:]], True)[:, 0])
            far[chosen] = 0
        self.points = held[chosen]

    def _last(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.bound - (x**2).sum(1)))

    def _squares(self, x: np.ndarray, points: np.ndarray, row: bool) -> np.ndarray:
        last = self._last(x) if row else np.zeros(len(x))
        return np.maximum(0, (x**2).sum(1)[:, None] + last[:, None] ** 2 + self.bound - 2 * (x @ points.T + last[:, None] * self._last(points)[None]))

    def distances(self, x: np.ndarray, row: bool = True) -> np.ndarray:
        """Of rows, or of anchors (whose last component is 0)."""
        return np.sqrt(self._squares(x, self.points, row))


def placed(rows: DataFrame, pivots: Pivots, width: int, scale: int, moved, every: int) -> DataFrame:
    """(row, id, label, v, d, region, anchor, asked): quantised vectors and their distances to all pivots; of an anchor also
    those that it has as a query."""
    kinds = [pa.binary(), pa.binary(), pa.int32(), pa.bool_(), pa.binary()]

    def run(batches):
        for b in batches:
            x = quantised(b.column("v").to_pylist(), width, scale)
            d = pivots.distances(x)
            asks = [i is not None and i % every == 0 for i in b.column("id").to_pylist()]
            asked = pivots.distances(x, row=False)
            made = [[r.tobytes() for r in x], [r.tobytes() for r in d], d.argmin(1), asks, [r.tobytes() if a else None for r, a in zip(asked, asks)]]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), b.column("label"), *map(pa.array, made, kinds)], names=["row", "id", "label", "v", "d", "region", "anchor", "asked"])

    label = F.col("label") if moved is None else moved(F.col("id"), F.col("label"))
    return rows.withColumn("label", label.cast("long")).mapInArrow(run, "row long, id long, label long, v binary, d binary, region int, anchor boolean, asked binary")


def _packed(table: pa.Table, d: str = "d") -> dict:
    ids = table.column("id")
    return {
        "rows": table.column("row").to_numpy().tobytes(),
        "ids": ids.fill_null(0).to_numpy().tobytes(),
        "gaps": ids.is_null().to_numpy().astype(np.uint8).tobytes(),
        "labels": table.column("label").to_numpy().tobytes(),
        "v": b"".join(table.column("v").to_pylist()),
        "d": b"".join(table.column(d).to_pylist()),
    }


def pack_block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A block's rows as one row, with the least and greatest distances to every pivot."""
    held = _packed(table)
    d = np.frombuffer(held["d"]).reshape(table.num_rows, -1)
    own = {"block": [key[0].as_py()], "region": [table.column("region")[0].as_py()]} | {k: [x] for k, x in held.items()}
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 6, *[pa.list_(pa.float64())] * 2]
    return pa.table([pa.array(x, k) for x, k in zip([*own.values(), [d.min(0)], [d.max(0)]], kinds)], names=["block", "region", *_BLOBS, "low", "high"])


def pack_chunk(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A chunk's anchors as one row, with what each looks for: a least score, or the scores of its positives."""
    wanted = np.full((table.num_rows, POSITIVES), _LEAST, np.int64)
    for i, w in enumerate(table.column("wanted").to_pylist()):
        wanted[i, : len(w or ())] = w or ()
    own = {"chunk": [key[0].as_py()], "region": [table.column("region")[0].as_py()]} | {k: [x] for k, x in _packed(table, "asked").items()}
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 7]
    return pa.table([pa.array(x, k) for x, k in zip([*own.values(), [wanted.tobytes()]], kinds)], names=["chunk", "region", *_BLOBS, "wanted"])


class Side:
    """The arrays of a packed block or chunk."""

    def __init__(self, row: dict):
        get = lambda c, t: np.frombuffer(row[c], t)
        self.rows, self.ids, self.gaps, self.labels = get("rows", np.int64), get("ids", np.int64), get("gaps", np.uint8), get("labels", np.int64)
        n = len(self.rows)
        self.v, self.d = get("v", np.float64).reshape(n, -1), get("d", np.float64).reshape(n, -1)
        self.wanted = get("wanted", np.int64).reshape(n, POSITIVES) if "wanted" in row else None
        self.norm = (self.v**2).sum(1)


def limits(wanted: np.ndarray, negatives: bool) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) score that an anchor looks for; least above greatest if none."""
    if not negatives:
        return wanted[:, 0].astype(np.float64), np.full(len(wanted), np.inf)
    some = wanted >= 0  # below 0 there is no score between 4/5 of it and itself
    return np.where(some, wanted * 0.8, np.inf).min(1), np.where(some, wanted, -np.inf).max(1).astype(np.float64)


def scored(low: np.ndarray, high: np.ndarray, norm: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(greatest, least) scores of anchors with these norms at distances between ``low`` and ``high``, with slack."""
    whole = norm[:, None] + bound
    slack = 1e-6 * whole + 1e-3  # a distance near 0 is exact to 1e-8 of the vectors' length only
    return (whole - low**2) / 2 + slack, (whole - high**2) / 2 - slack


def exact(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (i, j), whole numbers."""
    if q.shape[1] * np.abs(q).max(initial=0) * np.abs(x).max(initial=0) < 2**53:
        if len(i) > DENSE * len(q) * len(x):
            return (q @ x.T)[i, j].astype(np.int64)
        step = max(1, 4_000_000 // max(1, q.shape[1]))
        return np.concatenate([np.einsum("ij,ij->i", q[i[a : a + step]], x[j[a : a + step]]) for a in range(0, len(i), step)] or [np.zeros(0)]).astype(np.int64)
    whole = lambda v: [[int(c) for c in r] for r in v.tolist()]
    left, right = whole(q), whole(x)
    out = [sum(a * b for a, b in zip(left[s], right[t])) for s, t in zip(i.tolist(), j.tolist())]
    if any(not _LEAST < s <= _MOST for s in out):
        raise OverflowError("a score is beyond 64 bits")
    return np.array(out, np.int64)


def first(i: np.ndarray, order: tuple, k: int) -> np.ndarray:
    """Places of the first ``k`` of every group i, by the sort keys of ``order``, the last one first."""
    at = np.lexsort((*order, i))
    own = i[at]
    begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    nth = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own))))
    return at[nth < k]


_FOUND = "anchor long, nth int, row long, id long, score long"


def search(chunk: Side, block: Side, bound: float, negatives: bool) -> list[pa.Array]:
    """_FOUND's columns for one chunk in one block: the best rows of each anchor, or of each of its positives (nth)."""
    low = np.zeros((len(chunk.rows), len(block.rows)))
    high = np.full(low.shape, np.inf)
    for p in range(min(TABLE, chunk.d.shape[1])):
        a, b = chunk.d[:, p, None], block.d[None, :, p]
        np.maximum(low, np.abs(a - b), out=low)
        if negatives:
            np.minimum(high, a + b, out=high)
    most, least = scored(low, high, chunk.norm, bound)
    from_, to = limits(chunk.wanted, negatives)
    same = chunk.labels[:, None] == block.labels[None]
    passes = (most >= from_[:, None]) & (least <= to[:, None]) & (~same if negatives else same & (chunk.rows[:, None] != block.rows[None]))
    i, j = np.nonzero(passes)
    score = exact(chunk.v, block.v, i, j)
    out = []
    for n in range(POSITIVES if negatives else 1):
        at = np.arange(len(i))
        if negatives:
            top = chunk.wanted[:, n]
            bottom = top - top // 5  # 4/5 of a score that is 0 or more, rounded up
            at = np.flatnonzero((top[i] >= 0) & (score <= top[i]) & (score >= bottom[i]))
        s, t, y = i[at], j[at], score[at]
        best = at[first(s, (block.rows[t], block.ids[t], block.gaps[t], -y), NEGATIVES if negatives else POSITIVES)]
        out.append((chunk.rows[i[best]], np.full(len(best), n, np.int32), block.rows[j[best]], block.ids[j[best]], score[best], block.gaps[j[best]].astype(bool)))
    anchor, nth, row, ids, got, gaps = (np.concatenate(c) for c in zip(*out))
    return [pa.array(anchor), pa.array(nth), pa.array(row), pa.array(ids, mask=gaps), pa.array(got)]


class Table:
    """The packed blocks of all rows, and what is known of the regions: at most PIVOTS rows."""

    def __init__(self, rows: DataFrame, bound: float, width: int):
        self.bound, self.rows = bound, rows
        size = max(64, BYTES // (8 * max(1, width)))
        counts = {r.region: (r.n, r.asks) for r in rows.groupBy("region").agg(F.count("*").alias("n"), F.sum(F.col("anchor").cast("long")).alias("asks")).collect()}
        self.regions = sorted(counts)
        self.many = {r: max(1, -(-n // size)) for r, (n, _) in counts.items()}
        self.first = dict(zip(self.regions, np.cumsum([0] + [self.many[r] for r in self.regions]).tolist()))
        self.chunks = {r: max(1, -(-a // CHUNK)) for r, (_, a) in counts.items()}
        self.parts = max(1, -(-sum(a for _, a in counts.values()) // PART))
        block = self._dealt(self.first, self.many, 1)
        kinds = "block long, region int, " + ", ".join(f"{b} binary" for b in _BLOBS) + ", low array<double>, high array<double>"
        self.blocks = common.staged(rows.select("row", "id", "label", "v", "d", "region", block.alias("block")).groupBy("block").applyInArrow(pack_block, kinds), "blocks")
        ends = self.blocks.select("region", F.posexplode(F.arrays_zip("low", "high"))).groupBy("region", "pos").agg(F.min("col.low").alias("low"), F.max("col.high").alias("high"))
        known = {(r.region, r.pos): (r.low, r.high) for r in ends.collect()}
        width = max((p for _, p in known), default=-1) + 1
        self.low, self.high = (np.array([[known[r, p][e] for p in range(width)] for r in self.regions]) for e in (0, 1))

    def _dealt(self, first: dict, many: dict, seed: int):
        """A number for each row: of its region's share, by hash."""
        literal = lambda held: F.create_map(*[F.lit(x) for r in self.regions for x in (r, held[r])])[F.col("region")]
        return (literal(first) + F.pmod(F.xxhash64(F.lit(seed), "row"), literal(many))).cast("long")

    def chunked(self, wanted: DataFrame) -> DataFrame:
        """The anchors in packed chunks. ``wanted``: (row, wanted) what an anchor looks for."""
        begin = dict(zip(self.regions, np.cumsum([0] + [self.chunks[r] for r in self.regions]).tolist()))
        anchors = self.rows.where("anchor").select("row", "id", "label", "v", "asked", "region", self._dealt(begin, self.chunks, 2).alias("chunk"))
        kinds = "chunk long, region int, " + ", ".join(f"{b} binary" for b in _BLOBS) + ", wanted binary"
        return anchors.join(wanted, "row", "left").groupBy("chunk").applyInArrow(pack_chunk, kinds)

    def visits(self, chunks: DataFrame, negatives: bool, home: bool) -> DataFrame:
        """Chunks with the blocks they meet: one of their own region, or all that the regions' brackets leave."""
        regions, many, begin, low, high, bound, parts = self.regions, self.many, self.first, self.low, self.high, self.bound, self.parts

        def run(batches):
            for b in batches:
                for row in b.to_pylist():
                    side, blocks = Side(row), []
                    from_, to = limits(side.wanted, negatives)
                    for at, r in enumerate(regions):
                        near = np.maximum(0, np.maximum(side.d - high[at], low[at] - side.d)).max(1, keepdims=True)
                        most, least = scored(near, (side.d + high[at]).min(1, keepdims=True), side.norm, bound)
                        if home and r == row["region"]:
                            blocks.append(begin[r])
                        elif not home and ((most[:, 0] >= from_) & (least[:, 0] <= to)).any():
                            blocks += range(begin[r], begin[r] + many[r])
                    for block in blocks:
                        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([row["chunk"] % parts]), *(pa.array([row[c]], pa.binary()) for c in [*_BLOBS, "wanted"])], names=["block", "part", *_BLOBS, "wanted"])

        return chunks.mapInArrow(run, "block long, part long, " + ", ".join(f"{b} binary" for b in _BLOBS) + ", wanted binary")

    def found(self, wanted: DataFrame, negatives: bool = False, home: bool = False) -> DataFrame:
        """_FOUND: the best rows of each anchor, or of each of its positives, in all blocks together."""
        bound = self.bound
        visits = self.visits(common.staged(self.chunked(wanted), "chunks"), negatives, home)
        if not home:  # a chunk's vectors are written once for each block it meets, so both sides of the join read the same
            visits = common.staged(visits, "visits")
        held = visits.select("block", "part").distinct().join(self.blocks, "block")
        met = held.select(*[F.col(c).alias(c) for c in ("block", "part", *_BLOBS)])  # both sides stem from one table

        def meet(key: tuple[pa.Scalar, ...], chunks: pa.Table, block: pa.Table) -> pa.Table:
            names = ["anchor", "nth", "row", "id", "score"]
            kinds = pa.schema([("anchor", pa.int64()), ("nth", pa.int32()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
            if not (chunks.num_rows and block.num_rows):
                return kinds.empty_table()
            own = Side(block.to_pylist()[0])
            tables = [pa.table(search(Side(c), own, bound, negatives), names=names).cast(kinds) for b in chunks.to_batches(max_chunksize=1) for c in b.to_pylist()]
            return pa.concat_tables(tables)

        pairs = visits.groupBy("block", "part").cogroup(met.groupBy("block", "part")).applyInArrow(meet, _FOUND)
        order = W.partitionBy("anchor", "nth").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
        return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= (NEGATIVES if negatives else POSITIVES))


def hard_negatives(table: DataFrame, every: int = 100, scale: int = 256, moved=None, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per anchor and positive its hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors: rows whose id is divisible by ``every``. ``scale``: components become floor(scale * x). ``moved(id, label)``:
    a column expression for the label to use."""
    spark = table.sparkSession
    common.ship(spark)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    rows = common.staged(usable(table, id_col, vec_col, label_col), "usable")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x) * scale + 1, F.lit(2.0)))
    known = rows.agg(F.max(F.size("v")).alias("width"), F.max(square).alias("bound")).first()
    if known.width is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = max(1, known.width)
    picked = rows.orderBy(F.xxhash64(F.lit(11), "id", "v"), "row").limit(SAMPLE).select("v").collect()
    pivots = Pivots(quantised([r.v for r in picked], width, scale), known.bound + 1.0)
    held = common.staged(placed(rows, pivots, width, scale, moved, every), "placed")
    known = Table(held, pivots.bound, width)

    nothing = spark.createDataFrame([], "row long, wanted array<long>")
    near = known.found(nothing, home=True)
    # an anchor with fewer than POSITIVES rows of its label there has no score to reach yet
    reach = near.groupBy("anchor").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= POSITIVES)
    positives = common.staged(known.found(reach.select(F.col("anchor").alias("row"), F.array("least").alias("wanted"))).drop("nth"), "positives")
    listed = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("all"))  # POSITIVES at most
    found = known.found(listed.select(F.col("anchor").alias("row"), F.col("all.score").alias("wanted")), negatives=True)
    found = found.select("anchor", (F.col("nth") + 1).alias("nth"), F.col("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    whose = positives.select("anchor", F.col("rank").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    anchors = held.where("anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return found.join(whose, ["anchor", "nth"]).join(anchors, "anchor").select(*names)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all embeddings: every seventh row's label is moved on by one."""
    moved = lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(common.table(spark, sf_dir, "embeddings"), moved=moved)


ORACLE_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.vec_id as positive_id, row_number() over w::int as rank, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from p join s n on n.anchor_id = p.anchor_id and not n.same and 80 * p.score <= 100 * n.score and n.score <= p.score
window w as (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id)
qualify row_number() over w <= 5
"""
