"""Operator 4, n-gram Jaccard join: a metric-space join with pivots, Voronoi regions and triangle-inequality windows.

Documents with equal shingle sets are one class from the start. What is joined is one set per class, in three steps that
lose no link:

1. Candidates. Two sets with similarity 0.8 share a shingle among the first (a fifth of each) in any fixed order, so each
   set is entered under those shingles; frequent shingles, as a bounded sample of documents tells, are ordered last.
   Shared shingles are found from packed 32-bit keys per shard and range. Under a shared shingle two sets are candidates if
   their distances to fixed landmarks (classes of shingles, more of them for larger sets) allow it: by the triangle inequality
   the counts per class differ in sum by no more than the sets do. Candidates are kept as spanning forests, not as pairs.
2. Regions. The connected components of all forests: no link leaves a region.
3. Each region is joined exactly: two pivots (a set and the one farthest from it) split it into Voronoi cells, the sets
   whose distances to the pivots differ by at most twice the radius are replicated into the other cell's join, and the
   cells are joined recursively until they are small or all one component. Distances are exact intersections of sets.
4. A region of more than REGION sets is joined by Spark in the same way: PIVOTS of its sets (of lowest hash) go to its
   blocks, every set learns its exact distances to them, and links to pivots give first components. The sets outside the
   region's largest component are then replicated to the Voronoi cells whose window they are in, there to the bands of
   distance from the cell's pivot that the triangle inequality leaves, and joined with those; a cell's band is cut into
   blocks of REGION / 2 by its count. Sets of one component are not compared again, so that a large group of near copies
   costs its distances to the pivots.

Edge cases: null and empty texts and texts of white space have no shingles and are linked with nothing; a text of under
five words is one shingle; a null identifier stays unlinked with a null component; rows that repeat a text are one class,
and rows that repeat an identifier with different texts are linked each by their own text; an empty table gives an empty
result; other columns are not read. Shingles are 64-bit digests.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm import common
from strandline.llm.exact_dedup import merged

#: Words of a shingle; the similarity of a link in hundredths.
WORDS, LEAST = 5, 80
#: Landmarks of the candidate filter: LANDMARKS, or as many times 4 as keep a set's mean count under CROWDED.
LANDMARKS, CROWDED = 64, 16
#: Documents sampled for frequent shingles, the sample's documents a frequent one is in, and frequent ones at most.
SAMPLE, OFTEN, FREQUENT = 4000, 4, 200_000
#: Classes in a shard.
SHARD = 6000
#: Sets of a region that one task joins, and shingles they have in all; in a larger one a task holds two blocks of half as
#: many. A set of more is alone with the block it meets.
REGION, HELD = 1000, 2_000_000
#: Bytes of texts whose shingles are made at once, about.
SLICE = 4_000_000
#: Pivots of a larger region, and bands of distance from a pivot.
PIVOTS, BANDS = 16, 20
#: Sets up to which candidates or a region are compared pair by pair.
FEW, SMALL = 48, 12
_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_I, _L, _B = pa.int32(), pa.int64(), pa.binary()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(29)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(32)
    return x


@functools.cache
def _tables(n: int):
    """(a number for each byte, the powers of the base, of its inverse) for n bytes."""
    rng = np.random.default_rng(4)
    letters = rng.integers(0, 2**64, 256, dtype=_U)
    base = _ODD[0]
    powers = np.cumprod(np.concatenate([[_U(1)], np.full(n, base)]), dtype=_U)
    inverse = np.cumprod(np.concatenate([[_U(1)], np.full(n, _U(pow(int(base), -1, 2**64)))]), dtype=_U)
    return letters, powers, inverse


def _word_digests(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A digest per word: differences of prefix sums of byte numbers times powers, over stretches of about 2^20 bytes."""
    out, i = np.empty(len(begin), _U), 0
    while i < len(begin):
        at = begin[i]
        j = max(i + 1, int(np.searchsorted(stop, at + (1 << 20), side="right")))
        own = data[at : stop[j - 1]]
        letters, powers, inverse = _tables(1 << max(20, len(own).bit_length()))
        total = np.concatenate([[_U(0)], np.cumsum(letters[own] * powers[: len(own)], dtype=_U)])
        out[i:j] = _mixed((total[stop[i:j] - at] - total[begin[i:j] - at]) * inverse[begin[i:j] - at])
        i = j
    return out


def shingles(texts: list) -> list[np.ndarray]:
    """The sorted distinct shingle digests of each text; whole texts, in groups of about a million bytes."""
    out: list[np.ndarray] = []
    a = 0
    raw = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    while a < len(raw):
        b, size = a, 0
        while b < len(raw) and (b == a or size + len(raw[b]) < 1_000_000):
            size += len(raw[b]) + 1
            b += 1
        joined = b" ".join(raw[a:b]) + b" "
        data = np.frombuffer(joined, np.uint8)
        white = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], white]).astype(np.int8)))
        begin, stop = edge[::2], edge[1::2]
        word = _word_digests(data, begin, stop)
        bound = np.searchsorted(begin, np.cumsum([0] + [len(x) + 1 for x in raw[a:b]]))
        n = max(0, len(word) - WORDS + 1)
        every = np.zeros(n, _U)
        for j in range(WORDS):
            every += word[j : n + j] * _ODD[j]
        every = _mixed(every)
        for lo, hi in zip(bound[:-1].tolist(), bound[1:].tolist()):
            if hi - lo >= WORDS:
                out.append(np.unique(every[lo : hi - WORDS + 1]))
            elif hi > lo:
                short = np.array([hi - lo], _U)
                for j in range(lo, hi):
                    short = _mixed(short * _ODD[1] + word[j])
                out.append(short)
            else:
                out.append(np.zeros(0, _U))
        a = b
    return out


def _least_overlap(n: int) -> int:
    return (LEAST * n + 99) // 100


def tier_of(n: int) -> int:
    """How many times the landmarks of a set of this size are made four."""
    tier = 0
    while n >= CROWDED * LANDMARKS * 4**tier:
        tier += 1
    return tier


def marks_of(s: np.ndarray, tier: int) -> np.ndarray:
    """The set's counts by landmark; empty if one does not fit a byte: such a set is not filtered."""
    width = LANDMARKS * 4**tier
    counts = np.bincount((s >> _U(65 - width.bit_length())).astype(np.int64), minlength=width)
    return counts.astype(np.uint8) if counts.max(initial=0) < 256 else np.zeros(0, np.uint8)


def sliced(batches, column: int):
    """Batches cut to about SLICE bytes of one column's texts; a longer text is alone. What a task holds follows bytes, not rows."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + SLICE, side="right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def features(docs: DataFrame, frequent: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, hash, n, digest, prefix, marks) per document: a hash of the text, set size, digest of the set, the shingles it is
    entered under, counts by landmark."""

    def run(batches):
        for batch in sliced(batches, 2):
            sets = shingles(batch.column(2).to_pylist())
            flat = np.concatenate(sets) if sets else np.zeros(0, _U)
            place = np.minimum(np.searchsorted(frequent, flat), max(0, len(frequent) - 1))
            often = frequent[place] == flat if len(frequent) else np.zeros(len(flat), bool)
            digests, prefixes, marks, at = [], [], [], 0
            for s in sets:
                n = len(s)
                own = often[at : at + n]
                ordered = np.concatenate([s[~own], s[own]])
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                prefixes.append(ordered[: n - _least_overlap(n) + 1].tobytes() if n else b"")
                marks.append(marks_of(s, tier_of(n)).tobytes())
                at += n
            columns = [*batch.columns[:2], pa.array([len(s) for s in sets], _L), pa.array(digests, _B), pa.array(prefixes, _B), pa.array(marks, _B)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "hash", "n", "digest", "prefix", "marks"])

    schema = "id long, hash long, n long, digest binary, prefix binary, marks binary"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def frequent_shingles(docs: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Shingles of OFTEN documents or more of a bounded sample: only the order of shingles depends on them."""
    picked = docs.select(id_col).orderBy(F.xxhash64(F.lit(4), id_col), id_col).limit(SAMPLE).distinct()
    texts = docs.join(F.broadcast(picked), id_col).select(F.col(text_col).alias("text"))

    def run(batches):
        for batch in sliced(batches, 0):
            sets = shingles(batch.column(0).to_pylist())
            flat = np.concatenate(sets) if sets else np.zeros(0, _U)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64))], names=["s"])

    counted = texts.mapInArrow(run, "s long").groupBy("s").count().where(F.col("count") >= OFTEN)
    got = counted.orderBy(F.desc("count"), "s").limit(FREQUENT).select("s").collect()
    return np.sort(np.array([r.s for r in got], np.int64).view(_U))


def _table(rows: list[tuple], names: str, kinds: list) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names.split())


def _by_range(values: np.ndarray, bits: int):
    """(order by the top ``bits`` bits, (range, begin, stop) in it of each range that has values)."""
    top = (values >> _U(64 - bits)).astype(np.int64)
    order = np.argsort(top, kind="stable")
    top = top[order]
    cut = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]])) if len(top) else np.zeros(0, np.int64)
    return order, list(zip(top[cut].tolist(), cut.tolist(), np.append(cut[1:], len(top)).tolist()))


def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, row of each) of a shard's prefixes."""
    parts = [np.frombuffer(p, _U) for p in table.column("prefix").to_pylist()]
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def keys_of(table: pa.Table, bits: int) -> pa.Table:
    """A shard's distinct prefix shingles, 32 bits each within their range."""
    if not table.num_rows:
        return _table([], "range shard keys", [_I, _I, _B])
    own = np.unique(_entries(table)[0])
    order, bound = _by_range(own, bits)
    keys = (own[order] << _U(bits) >> _U(32)).astype(np.uint32)
    shard = table.column("shard")[0].as_py()
    return _table([(r, shard, keys[a:b].tobytes()) for r, a, b in bound], "range shard keys", [_I, _I, _B])


def shared_keys(table: pa.Table) -> pa.Table:
    """Of one range: each shard's keys that other shards have too."""
    shards, ranges = table.column("shard").to_pylist(), table.column("range").to_pylist()
    arrays = [np.unique(np.frombuffer(x, np.uint32)) for x in table.column("keys").to_pylist()]
    every = np.sort(np.concatenate(arrays))
    several = np.unique(every[1:][every[1:] == every[:-1]])
    rows = [(s, r, a[np.isin(a, several, assume_unique=True)].tobytes()) for s, r, a in zip(shards, ranges, arrays)]
    return _table([x for x in rows if x[2]], "shard range keys", [_I, _I, _B])


_MEMBERS = ["range", "keys", "places", "ids", "sizes", "marks", "widths"]


def members_of(table: pa.Table, told: pa.Table, bits: int) -> pa.Table:
    """A shard's entries under shared shingles by range; what the candidate filter needs stands once per range and set."""
    kinds = [_I, *[_B] * 6]
    if not table.num_rows:
        return _table([], " ".join(_MEMBERS), kinds)
    keys, row = _entries(table)
    got = [_U(r) << _U(32) | np.frombuffer(k, np.uint32).astype(_U) for r, k in zip(told.column("range").to_pylist(), told.column("keys").to_pylist())]
    shared = np.concatenate(got) if got else np.zeros(0, _U)
    ordered = np.sort(keys)
    local = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    on = np.isin(keys >> _U(32 - bits), shared) | np.isin(keys, local)
    keys, row = keys[on], row[on]
    ids, sizes = np.array(table.column("id").to_pylist(), np.int64), np.array(table.column("n").to_pylist(), np.int64)
    marks = table.column("marks").to_pylist()
    order, bound = _by_range(keys, bits)
    short = (keys << _U(bits) >> _U(32)).astype(np.uint32)
    rows = []
    for r, a, b in bound:
        own = order[a:b]
        at, place = np.unique(row[own], return_inverse=True)
        held = [marks[i] for i in at.tolist()]
        widths = np.array([len(m) for m in held], np.int32)
        rows.append((r, short[own].tobytes(), place.astype(np.uint32).tobytes(), ids[at].tobytes(), sizes[at].tobytes(), b"".join(held), widths.tobytes()))
    return _table(rows, " ".join(_MEMBERS), kinds)


class Filter:
    """Whether two sets may be linked, by their sizes and their counts by landmark; never false for a link."""

    def __init__(self, sizes: np.ndarray, marks: np.ndarray, widths: np.ndarray):
        self.n = sizes
        self.tier = np.where(widths > 0, np.log2(np.maximum(widths, 1) / LANDMARKS).round().astype(np.int64) // 2, -1)
        self.counts, self.place = [], []
        start = np.cumsum(widths) - widths
        below = None
        for t in range(int(self.tier.max(initial=-1)), -1, -1):  # each tier holds its own sets and the folded larger ones
            own = np.flatnonzero(self.tier == t)
            width = LANDMARKS * 4**t
            counts = marks[start[own][:, None] + np.arange(width)].astype(np.uint16) if len(own) else np.zeros((0, width), np.uint16)
            who = own
            if below is not None:
                folded = below[1].reshape(len(below[0]), width, 4).sum(2, dtype=np.uint16)
                who, counts = np.concatenate([own, below[0]]), np.concatenate([counts, folded])
            place = np.full(len(sizes), -1, np.int64)
            place[who] = np.arange(len(who))
            self.counts.insert(0, counts)
            self.place.insert(0, place)
            below = (who, counts)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = 100 * np.minimum(self.n[i], self.n[j]) >= LEAST * np.maximum(self.n[i], self.n[j])
        tier = np.minimum(self.tier[i], self.tier[j])
        for t, (counts, place) in enumerate(zip(self.counts, self.place)):
            at = np.flatnonzero(ok & (tier == t))
            step = max(1, 8_000_000 // (LANDMARKS * 4**t))
            for a in range(0, len(at), step):
                x, y = i[at[a : a + step]], j[at[a : a + step]]
                apart = np.abs(counts[place[x]].astype(np.int32) - counts[place[y]]).sum(1)
                ok[at[a : a + step]] = (100 + LEAST) * apart <= (100 - LEAST) * (self.n[x] + self.n[y])
        return ok


def _components(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Least member of each one's component of the graph with the edges a-b, over labels that hold already."""
    label = np.arange(n) if label is None else label
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    return label


def candidate_forest(table: pa.Table) -> pa.Table:
    """Of one range: (id, root) for every set that has candidates, with roots such that all candidates meet."""
    lists = {c: table.column(c).to_pylist() for c in _MEMBERS[1:]}
    col = lambda c, t: np.frombuffer(b"".join(lists[c]), t)
    keys, ids, sizes, widths = col("keys", np.uint32), col("ids", np.int64), col("sizes", np.int64), col("widths", np.int32).astype(np.int64)
    base = np.cumsum([0] + [len(x) // 8 for x in lists["ids"]])[:-1]
    node = col("places", np.uint32).astype(np.int64) + np.repeat(base, [len(x) // 4 for x in lists["keys"]])
    may_link = Filter(sizes, col("marks", np.uint8), widths)
    order = np.lexsort((sizes[node], keys))
    keys, node = keys[order], node[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(begins, len(keys)))
    label = np.arange(len(ids))
    stop = np.repeat(begins + counts, counts)
    at = np.flatnonzero(np.repeat(counts <= FEW, counts))
    for k in range(1, min(FEW, int(counts.max(initial=0)))):
        at = at[at + k < stop[at]]
        i, j = node[at], node[at + k]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        on = may_link(i, j)
        label = _components(len(ids), i[on], j[on], label)
    for b, c in zip(begins[counts > FEW].tolist(), counts[counts > FEW].tolist()):
        # a common shingle: its sets in order of size, each against those its size and its component leave
        left = node[b : b + c]
        while len(left) > 1 and not (label[left] == label[left[0]]).all():
            p, left = left[0], left[1:]
            near = left[: np.searchsorted(sizes[left], sizes[p] * 100 // LEAST, side="right")]
            near = near[label[near] != label[p]]
            near = near[may_link(np.full(len(near), p), near)]
            label = _components(len(ids), np.full(len(near), p), near, label)
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return pa.table([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["id", "root"])


class Region:
    """The sets of a region, and exact distances between them."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.n)])
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, np.int64)
        self.codes = codes.astype(np.int32)
        self.mark = np.zeros(int(codes.max(initial=0)) + 1, np.int8)
        self.label = np.arange(len(sets))
        # finer landmarks than the candidates had
        marks = [marks_of(s, tier_of(len(s)) + 1) for s in sets]
        self.may_link = Filter(self.n, np.concatenate(marks) if marks else np.zeros(0, np.uint8), np.array([len(m) for m in marks], np.int64))

    def shared(self, p: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set p with the others."""
        own = self.codes[self.start[p] : self.start[p + 1]]
        self.mark[own] = 1
        sizes = self.n[others]
        at = np.repeat(self.start[others] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        hits = self.mark[self.codes[at]]
        self.mark[own] = 0
        return np.add.reduceat(hits, np.cumsum(sizes) - sizes, dtype=np.int64)

    def compare(self, p: int, others: np.ndarray) -> np.ndarray:
        """Join p with its links among the others; the Jaccard distances."""
        both = self.shared(p, others)
        union = self.n[p] + self.n[others] - both
        linked = others[100 * both >= LEAST * union]
        if len(linked):
            self.label = _components(len(self.label), np.full(len(linked), p), linked, self.label)
        return 1 - both / union

    def sweep(self, own: np.ndarray) -> None:
        """Join the sets pair by pair, but for pairs that are joined already or that the landmarks rule out."""
        own = own[np.argsort(self.n[own], kind="stable")]
        for i in range(len(own) - 1):
            rest = own[i + 1 :]
            rest = rest[: np.searchsorted(self.n[rest], self.n[own[i]] * 100 // LEAST, side="right")]
            rest = rest[self.label[rest] != self.label[own[i]]]
            rest = rest[self.may_link(np.full(len(rest), own[i]), rest)]
            if len(rest):
                self.compare(own[i], rest)

    def join(self) -> np.ndarray:
        """The component (least place) of each set. Regions still to be joined are on a stack."""
        radius, todo = 1 - LEAST / 100, [np.arange(len(self.n))]
        while todo:
            own = todo.pop()
            if len(own) < 2 or (self.label[own] == self.label[own[0]]).all():
                continue
            if len(own) <= SMALL:
                self.sweep(own)
                continue
            p, rest = own[0], own[1:]
            to_p = self.compare(p, rest)
            q = int(np.argmax(to_p))
            other = np.delete(rest, q)
            to_p = np.delete(to_p, q)
            to_q = self.compare(rest[q], other)
            # the cells of p and q; what lies within the window of p's border is joined with q's cell too
            of_p = to_p <= to_q
            border = of_p & (to_q - to_p <= 2 * radius + 1e-9)
            if border.sum() + (~of_p).sum() > 0.9 * len(other):
                self.sweep(other)  # far from all pivots: no window narrows these
            else:
                todo += [other[of_p], other[~of_p | border]]
        return self.label


def join_region(table: pa.Table) -> pa.Table:
    """(rep, component) of one region, from whole texts."""
    ids = np.array(table.column("rep").to_pylist(), np.int64)
    order = np.argsort(ids)
    texts = table.column("text").to_pylist()
    label = Region(shingles([texts[i] for i in order.tolist()])).join()
    return pa.table([pa.array(ids[order]), pa.array(ids[order][label])], names=["rep", "component"])


def to_pivots(table: pa.Table, pivots: pa.Table) -> pa.Table:
    """(rep, root, d, linked) of the sets of one block: distances to the region's pivots and a set it is in one component
    with; the pivots' own rows have no distances."""
    names, kinds = "rep root d linked", [_L, _L, _B, _L]
    if not (table.num_rows and pivots.num_rows):
        return _table([], names, kinds)
    order = np.argsort(pivots.column("pivot").to_pylist())
    own, root = np.array(table.column("rep").to_pylist(), np.int64), table.column("root")[0].as_py()
    ids = np.concatenate([own, np.array(pivots.column("rep").to_pylist(), np.int64)[order]])
    texts = pivots.column("text").to_pylist()
    region = Region(shingles(table.column("text").to_pylist() + [texts[i] for i in order.tolist()]))
    d = np.stack([region.compare(p, np.arange(len(own))) for p in range(len(own), len(ids))], 1).astype(np.float32)
    linked = ids[region.label]
    rows = [(i, root, x.tobytes(), y) for i, x, y in zip(own.tolist(), d, linked.tolist())]
    rows += [(i, root, None, y) for i, y in zip(ids[len(own) :].tolist(), linked[len(own) :].tolist()) if i != y]
    return _table(rows, names, kinds)


def _cells(d: bytes) -> tuple[np.ndarray, int, int]:
    far = np.frombuffer(d, np.float32)
    cell = int(far.argmin())
    return far, cell, int(far[cell] * BANDS)


def placed(batches):
    """(rep, root, label, cell, band): the Voronoi cell of each set and its band of distance there."""
    for b in batches:
        at = [_cells(d)[1:] for d in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([c for c, _ in at], _I), pa.array([x for _, x in at], _I)], names=["rep", "root", "label", "cell", "band"])


def windowed(batches):
    """(rep, root, label, cell, band): each set once for every cell and band where the triangle inequality allows a link."""
    radius = 1 - LEAST / 100 + 1e-5
    for b in batches:
        rows = []
        for rep, root, label, d in zip(*(b.column(i).to_pylist() for i in range(4))):
            far, cell, _ = _cells(d)
            for q in np.flatnonzero(far <= far[cell] + 2 * radius).tolist():
                bands = range(max(0, int((far[q] - radius) * BANDS)), min(BANDS, int((far[q] + radius) * BANDS)) + 1)
                rows += [(rep, root, label, q, x) for x in bands]
        yield from _table(rows, "rep root label cell band", [_L, _L, _L, _I, _I]).combine_chunks().to_batches()


def join_blocks(table: pa.Table, rest: pa.Table) -> pa.Table:
    """(id, root): edges between the components of a block and those of the sets that visit it, for the links there are."""
    if not (table.num_rows and rest.num_rows):
        return _table([], "id root", [_L, _L])
    col = lambda c: np.array(table.column(c).to_pylist() + rest.column(c).to_pylist(), np.int64)
    ids, labels, n = col("rep"), col("label"), table.num_rows
    region = Region(shingles(table.column("text").to_pylist() + rest.column("text").to_pylist()))
    first, place = np.unique(labels, return_index=True, return_inverse=True)[1:]
    region.label = start = first[place]
    block = np.arange(n)
    for p in range(n, len(ids)):
        others = block[region.label[:n] != region.label[p]]
        others = others[region.may_link(np.full(len(others), p), others)]
        if len(others):
            region.compare(p, others)
    own = np.flatnonzero((start == np.arange(len(ids))) & (region.label != start))
    return pa.table([pa.array(ids[own]), pa.array(ids[region.label[own]])], names=["id", "root"])


def _blocks(count: Column, held: Column) -> Column:
    """The blocks that so many sets with so many shingles in all make."""
    return F.ceil(F.greatest(count * 2 / F.lit(REGION), held * 2 / F.lit(HELD))).cast("int")


def join_large(texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(rep, component) of the sets of regions too large for one task. ``texts``: (rep, root, n, text), staged; ``sizes``:
    (root, size, held), the sets of a region and their shingles."""
    nth = F.row_number().over(W.partitionBy("root").orderBy(F.xxhash64(F.lit(4), "rep"), "rep"))
    picked = texts.select("rep", "root").withColumn("pivot", nth).where(F.col("pivot") <= PIVOTS)
    blocked = sizes.select("root", _blocks(F.col("size"), F.col("held")).alias("blocks"))
    dealt = texts.drop("n").join(blocked, "root").withColumn("block", F.pmod(F.xxhash64(F.lit(5), "rep"), F.col("blocks")).cast("int"))
    pivots = common.staged(texts.drop("n").join(picked.drop("root"), "rep").join(blocked, "root"), "pivots").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    measured = common.staged(
        dealt.groupBy("root", "block").cogroup(pivots.groupBy("root", "block")).applyInArrow(to_pivots, "rep long, root long, d binary, linked long"), "measured"
    )
    found = components(measured.where("rep <> linked").select(F.col("rep").alias("id"), F.col("linked").alias("root")))
    label = F.coalesce("label", "rep").alias("label")
    labelled = measured.where("d is not null").join(found.select(F.col("id").alias("rep"), F.col("root").alias("label")), "rep", "left").select("rep", "root", label, "d")
    labelled = common.staged(labelled, "labelled")
    largest = labelled.groupBy("root", "label").count().groupBy("root").agg(F.max_by("label", F.struct("count", "label")).alias("largest"))
    rest = labelled.join(largest, "root").where("label <> largest").select(*labelled.columns)  # a join puts its key first

    kinds = "rep long, root long, label long, cell int, band int"
    key = ["root", "cell", "band"]
    own, visits = labelled.mapInArrow(placed, kinds), common.staged(rest.mapInArrow(windowed, kinds), "visits")
    weight = texts.select("rep", "n")
    counts = own.join(weight, "rep").groupBy(*key).agg(_blocks(F.count("*"), F.sum("n")).alias("blocks"))
    chunks = visits.join(weight, "rep").groupBy(*key).agg(_blocks(F.count("*"), F.sum("n")).alias("chunks"))
    both = common.staged(counts.join(chunks, key), "bands")
    part = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "rep"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    body = texts.select("rep", "text")
    left = own.join(both, key).withColumn("block", part(6, "blocks")).join(body, "rep").withColumn("chunk", each("chunks"))
    right = visits.join(both, key).withColumn("chunk", part(7, "chunks")).join(body, "rep").withColumn("block", each("blocks"))
    parts, columns = [*key, "block", "chunk"], [*key, "block", "chunk", "rep", "label", "text"]
    renewed = right.select(*[F.col(c).alias(c) for c in columns])  # both sides stem from one table
    met = left.select(*columns).groupBy(*parts).cogroup(renewed.groupBy(*parts)).applyInArrow(join_blocks, "id long, root long")
    edges = labelled.where("rep <> label").select(F.col("rep").alias("id"), F.col("label").alias("root")).unionByName(met)
    return components(edges).select(F.col("id").alias("rep"), F.col("root").alias("component")).where("rep <> component")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): connected components of (id, root) edges, by least identifiers that spread and jump until they stay."""
    both = common.staged(edges.unionByName(edges.select(F.col("root").alias("id"), F.col("id").alias("root"))).distinct(), "edges")
    labels = common.staged(both.groupBy("id").agg(F.least("id", F.min("root")).alias("root")), "labels")
    while True:
        theirs = labels.select(F.col("id").alias("root"), F.col("root").alias("best"))
        spread = both.join(theirs, "root").groupBy("id").agg(F.min("best").alias("near"))
        new = labels.join(spread, "id").select("id", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = theirs.select(F.col("root").alias("root"), F.col("best").alias("far"))
        new = common.staged(new.join(jump, "root", "left").select("id", F.least("root", "far").alias("root"), "old"), "labels")
        labels = new.select("id", "root")
        if not new.where("root <> old").limit(1).count():
            return labels


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id. Rows are told apart by a key of their own; a set's text is found again by
    its row's identifier and a hash of the text, so that rows of one identifier with different texts are sets of their own."""
    spark = docs.sparkSession
    common.ship(spark)
    frequent = frequent_shingles(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    made = features(docs, frequent, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    made = common.staged(made, "shingles")
    live = made.where("n > 0 and id is not null").withColumn("check", F.col("n")).withColumn("run", F.pmod(F.xxhash64("row"), F.lit(common.RUNS)).cast("int"))
    leaves = live.select("id", "row", "run", "digest", "check", F.lit(0).alias("length"))
    classes = live.join(merged(leaves), ["digest", "check", "run"]).withColumn("rep", F.col("best.row"))
    classed = common.staged(classes.select("id", "hash", "row", "n", "rep", F.col("best.id").alias("least"), F.when(F.col("row") == F.col("rep"), F.col("prefix")).alias("prefix"), F.when(F.col("row") == F.col("rep"), F.col("marks")).alias("marks")), "classes")

    sets = classed.where("row = rep")
    shards = max(1, -(-sets.count() // SHARD))
    bits = max(4, (shards // 4).bit_length())
    sharded = sets.select(F.col("rep").alias("id"), "n", "prefix", "marks", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int").alias("shard"))
    by_shard = sharded.groupBy("shard")
    told = by_shard.applyInArrow(lambda t: keys_of(t, bits), "range int, shard int, keys binary")
    told = told.groupBy("range").applyInArrow(shared_keys, "shard int, range int, keys binary")
    renewed = sharded.select(*[F.col(c).alias(c) for c in sharded.columns])
    members = renewed.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(
        lambda t, k: members_of(t, k, bits), "range int, keys binary, places binary, ids binary, sizes binary, marks binary, widths binary"
    )
    regions = components(members.groupBy("range").applyInArrow(candidate_forest, "id long, root long")).select(F.col("id").alias("rep"), "root")

    own = common.staged(regions.join(sets.select("rep", "n", "id", "hash"), "rep"), "members")
    sizes = common.staged(own.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("held")), "regions")
    big = (F.col("size") > REGION) | (F.col("held") > HELD)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    of = lambda which: texts.join(own.join(sizes.where(which).select("root"), "root"), ["id", "hash"]).dropDuplicates(["rep"])
    joined = common.staged(of(~big).select("rep", "text", "root").groupBy("root").applyInArrow(join_region, "rep long, component long").where("rep <> component"), "components")
    large = sizes.where(big)
    if large.limit(1).count():
        joined = common.staged(joined.unionByName(join_large(common.staged(of(big).select("rep", "root", "n", "text"), "texts"), large)), "components")
    # a component's name is the least identifier of its rows, which is one of its classes' least ones
    named = joined.unionByName(joined.select(F.col("component").alias("rep"), "component")).distinct()
    least = named.join(sets.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("name"))
    named = named.join(least, "component").select("rep", "name")
    linked = classed.join(named, "rep", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("name", "least").alias("component_id"))
    rest = made.where("n = 0 or id is null").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return linked.unionByName(rest)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the least identifier of each component (null last), with all its columns. Rows are joined by a key of
    their own, so that those of one identifier, or of none, get a verdict each."""
    keyed, key = common.keyed(docs, "documents")
    found = jaccard_components(keyed, key, text_col).where(F.col(key) != F.col("component_id")).select(F.col(key).alias("r"), F.col("component_id").alias("c"))
    found = common.staged(found.unionByName(found.select(F.col("c").alias("r"), "c")).distinct(), "linked")
    named = found.join(keyed.select(F.col(key).alias("r"), F.col(id_col).alias("id")), "r")
    best = named.groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "r")).alias("best"))
    gone = named.join(best, "c").where(F.col("r") != F.col("best.r")).select(F.col("r").alias(key))
    return keyed.join(gone, key, "left_anti").select(*docs.columns)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents."""
    return jaccard_components(common.table(spark, sf_dir, "documents"))
