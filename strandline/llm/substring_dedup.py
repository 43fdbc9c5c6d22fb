"""Operator 2, suffix-array dedup: remove every byte in a WIDTH-byte string that also starts in an earlier document.

Documents are dealt to shards (blocks of about BLOCK bytes) by a hash of their identifier.

1. Which positions can matter: every WIDTH-byte window contains an anchor, the GRAM-byte string of least hash in it, so
   equal windows have equal anchors. A shard's distinct anchor hashes go, packed, to ranges of the hash space, where
   those of several shards are found and told to their shards. These hashes only choose what is looked at.
2. Neighbouring windows with one shared anchor form a stretch (at most 76 bytes). Equal stretches meet by digest: a
   stretch that an earlier document has too goes as a whole. Only where different stretches share an anchor, which is where
   copied passages begin and end, do single windows have to be compared.
3. Over those windows each shard builds a suffix array by Larsson-Sadakane refinement (to WIDTH bytes) and Kasai's common
   prefixes; prefixes of WIDTH bytes join windows into classes, each with its earliest document, and windows of later
   documents of the class are settled there and then.
4. Across shards the classes' earliest windows are merged: sorted runs of window digests (64 bits, of whole windows, and
   32 more that tell colliding ones apart) meet by range of digest, binary search finds each class in the merged runs, and
   a bit per class returns.
5. The covered bytes are removed and the rest is digested.

What is exchanged: the texts once (the exchange is reused), 4 bytes per distinct anchor and shard, 32 per distinct
repeated stretch and shard, 12 and an identifier per distinct window at a passage's edge; a group of copies, however
large, sends each of its stretches once per shard.

Edge cases: null counts as empty; texts under WIDTH bytes keep all; rows that repeat an identifier are not earlier than
each other; a null identifier is earlier than all others; texts of any length are whole; an empty table gives an empty
result; other columns are not read. Two different windows of two shards have the same 96 bits with a chance of 1 in 7.9e28
a pair, and two different stretches around one anchor the same 63 bits with one of 1 in 9.2e18.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import common, suffixes

#: Bytes of a string that counts as repeated, and of an anchor.
WIDTH, GRAM = 50, 24
#: Bytes of text in a shard, about.
BLOCK = 6_000_000
#: Bits of a digest that are used, beside the 32 of its check.
DIGEST_BITS = 64
#: Positions hashed at a time.
SLICE = 1 << 14
LEAST_ID = -(2**63)
_U = np.uint64
_MIX = [_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX[0]
    x ^= x >> _U(32)
    x *= _MIX[1]
    x ^= x >> _U(29)
    return x


class Shard:
    """The texts of a shard as one byte array, in order of identifier, with the 8 bytes at every position as a number."""

    def __init__(self, table: pa.Table):
        column = table.column("doc_id").to_pylist()
        ids, named = np.array([LEAST_ID if x is None else x for x in column], np.int64), np.array([x is not None for x in column], bool)
        order = np.lexsort((ids, named))
        texts = table.column("text").to_pylist()
        texts = [texts[i] for i in order.tolist()]
        self.ids, self.none = ids[order], ~named[order]
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.ends = np.cumsum(self.sizes)
        self.n = int(self.sizes.sum())
        self.data = b"".join(parts) + bytes(64)
        self.bytes = np.frombuffer(self.data, np.uint8)
        self.eights = np.ndarray((self.n + 56,), "<u8", self.data, 0, (1,))

    def valid(self) -> np.ndarray:
        """Whether a window may start here: WIDTH bytes are left in the document."""
        ok = np.zeros(self.n + 1, np.int8)
        wide = self.sizes >= WIDTH
        np.add.at(ok, (self.ends - self.sizes)[wide], 1)
        np.add.at(ok, (self.ends - WIDTH + 1)[wide], -1)
        return np.cumsum(ok[:-1], dtype=np.int8).astype(bool)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts of windows, position of each one's anchor, hash of the gram at every position)."""
        n, span = self.n, WIDTH - GRAM + 1
        bits = _U(32)  # of a position in the shard; the choice between hashes takes their other 32 in shards of any size
        every, least = np.empty(n, _U), np.empty(n, _U)
        for a in range(0, n, SLICE):  # slices that stay in a core's cache
            b = min(n, a + SLICE)
            far = min(n, b + span - 1)
            m = _mixed(self.eights[a : far + 16])
            h = m[:-16] * _MIX[2] + m[8:-8] * _MIX[3] + m[16:] * _MIX[4]
            h ^= h >> _U(31)
            h *= _MIX[5]
            every[a:b] = h[: b - a]
            low = (h >> bits << bits) | np.arange(a, far, dtype=_U)
            have = 1
            while have < span:  # least of `have` neighbours, doubling
                step = min(have, span - have)
                if step < len(low):
                    low[:-step] = np.minimum(low[:-step], low[step:])
                have += step
            least[a:b] = low[: b - a]
        starts = np.flatnonzero(self.valid())
        return starts, (least[starts] & ((_U(1) << bits) - _U(1))).astype(np.int64), every

    def windows(self, at: np.ndarray, salt: int = 0) -> np.ndarray:
        """64-bit digests of the windows that start at ``at``."""
        h = np.zeros(len(at), _U)
        for k, off in enumerate([*range(0, WIDTH - 7, 8), WIDTH - 8]):
            h += _mixed(self.eights[at + off]) * (_MIX[k] ^ _U(2 * salt))
        h ^= h >> _U(32)
        h *= _MIX[7]
        h ^= h >> _U(29)
        return h & _used()

    def checks(self, at: np.ndarray) -> np.ndarray:
        """32 further bits of the windows that start at ``at``, of other products."""
        h = np.zeros(len(at), _U)
        for k, off in enumerate([*range(0, WIDTH - 7, 8), WIDTH - 8]):
            h = (h ^ (h >> _U(31))) * _MIX[4] + (self.eights[at + off] ^ _MIX[k]) * _MIX[2]
        h ^= h >> _U(33)
        h *= _MIX[5]
        return (h >> _U(32)).astype(np.uint32)


def _used() -> np.uint64:
    return _U(2**64 - 2 ** (64 - DIGEST_BITS))


def _distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending."""
    return _steps(np.sort(values))


def _ordered(values: np.ndarray, check: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order of the values, which of them in that order begin a new class); equal values of other checks are other classes."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if check is not None:
        differs = check[order][1:] != check[order][:-1]
        if (differs & ~new[1:]).any():
            order = np.lexsort((check, values))
            ordered, checks = values[order], check[order]
            new[1:] = (ordered[1:] != ordered[:-1]) | (checks[1:] != checks[:-1])
    return order, new


def _classes(values: np.ndarray, check: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values ascending, first place of each, class of each place, size of each class)."""
    if not len(values):
        none = np.zeros(0, np.int64)
        return values, none, none, none
    order, new = _ordered(values, check)
    ordered = values[order]
    begins = np.flatnonzero(new)
    cls = np.empty(len(values), np.int64)
    cls[order] = np.cumsum(new) - 1
    return ordered[begins], np.minimum.reduceat(order, begins), cls, np.diff(np.append(begins, len(values)))


def _among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Whether each value is one of the ascending ones."""
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def _covered(at: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` bytes lie in a window that starts at one of ``at``."""
    start = np.zeros(n + WIDTH, np.int32)
    start[at + WIDTH] = 1
    total = np.cumsum(start, dtype=np.int32)
    return total[WIDTH:] != total[:n]


def _steps(ascending: np.ndarray) -> np.ndarray:
    """The distinct values of an ascending array; anchors ascend with their windows."""
    return ascending[np.concatenate([[True], ascending[1:] != ascending[:-1]])] if len(ascending) else ascending


def _runs(at: np.ndarray) -> np.ndarray:
    """Increasing positions as (start, length) pairs."""
    if not len(at):
        return np.zeros((0, 2), np.int32)
    cut = np.flatnonzero(np.diff(at) != 1) + 1
    begin, stop = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
    return np.stack([at[begin], stop - begin], 1).astype(np.int32)


def _unrun(pairs: np.ndarray) -> np.ndarray:
    begin, size = pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64)
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


def _planes(values: np.ndarray) -> bytes:
    """Integers as planes of their first bytes, second bytes and so on: the exchange's compression packs what is alike."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _unplaned(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _bytes(rows: list[tuple], names: str, kinds: list) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names.split())


def _kind(table: pa.Table, *kinds: int) -> pa.Table:
    return table.filter(pa.array([k in kinds for k in table.column("kind").to_pylist()], pa.bool_()))


def _split(values: np.ndarray, bits: int) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
    """(stable order by the top ``bits`` bits, bounds in it of each range that has values)."""
    top = (values >> _U(64 - bits)).astype(np.int64)
    order = np.argsort(top.astype(np.uint16) if bits <= 16 else top, kind="stable")
    top = top[order]
    cut = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]])) if len(top) else np.zeros(0, np.int64)
    return order, dict(zip(top[cut].tolist(), zip(cut.tolist(), np.append(cut[1:], len(top)).tolist())))


_I, _L, _B = pa.int32(), pa.int64(), pa.binary()


def anchors_of(table: pa.Table, bits: int) -> pa.Table:
    """A shard's distinct anchors, 32 bits each within their range of the hash space."""
    if not table.num_rows:
        return _bytes([], "range block keys", [_I, _I, _B])
    block = table.column("block")[0].as_py()
    _, where, h = Shard(table).anchors()
    own = _distinct(h[_steps(where)])
    order, bound = _split(own, bits)
    keys = (own[order] << _U(bits) >> _U(32)).astype(np.uint32)
    return _bytes([(r, block, keys[a:b].tobytes()) for r, (a, b) in bound.items()], "range block keys", [_I, _I, _B])


def shared_anchors(table: pa.Table) -> pa.Table:
    """Of one range: each shard's anchors that other shards have too."""
    blocks, ranges = table.column("block").to_pylist(), table.column("range").to_pylist()
    arrays = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
    distinct = [_distinct(a) for a in arrays]
    every = np.sort(np.concatenate(distinct)) if distinct else np.zeros(0, np.uint32)
    several = _steps(every[1:][every[1:] == every[:-1]])
    rows = [(b, r, a[_among(a, several)].tobytes()) for b, r, a in zip(blocks, ranges, distinct)]
    return _bytes([x for x in rows if x[2]], "block range keys", [_I, _I, _B])


def _shared(told: pa.Table) -> np.ndarray:
    """The shared anchors a shard was told of, as numbers of range and key."""
    got = [_U(r) << _U(32) | np.frombuffer(k, np.uint32).astype(_U) for r, k in zip(told.column("range").to_pylist(), told.column("keys").to_pylist())]
    return np.concatenate(got) if got else np.zeros(0, _U)


class Stretches:
    """The windows with one shared anchor form a stretch; equal stretches of a shard are a class.

    ``lo``, ``hi``: first and last window of each stretch. ``anchor``: the hash of its anchor. ``first``: of each class, the
    stretch in the earliest document; ``cls``: the class of each stretch; ``digest``: of each class, of its whole text.
    """

    def __init__(self, shard: Shard, shared: np.ndarray, bits: int):
        starts, where, h = shard.anchors()
        cut = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (starts[1:] != starts[:-1] + 1)])) if len(starts) else np.zeros(0, np.int64)
        last = np.concatenate([cut[1:], [len(starts)]]) - 1 if len(cut) else cut
        anchor, lo, hi = h[where[cut]], starts[cut], starts[last]
        doc = np.searchsorted(shard.ends, lo, side="right")
        # an anchor of several documents of this shard counts as shared too
        order = np.argsort(anchor)
        ordered, docs = anchor[order], doc[order]
        same = ordered[1:] == ordered[:-1]
        several = _steps(ordered[1:][same & (docs[1:] != docs[:-1])])
        on = np.empty(len(anchor), bool)
        on[order] = _among(ordered >> _U(32 - bits), np.sort(shared)) | _among(ordered, several)
        self.lo, self.hi, self.anchor, self.doc = lo[on], hi[on], anchor[on], shard.ids[doc[on]]
        digest = shard.windows(self.lo) * _MIX[6] + shard.windows(self.hi, 1) * _MIX[3] + (self.hi - self.lo).astype(_U)
        digest ^= digest >> _U(30)
        digest *= _MIX[1]
        digest &= _used()
        check = shard.checks(self.lo) * np.uint32(0x9E3779B1) + shard.checks(self.hi)
        self.digest, self.first, self.cls, _ = _classes(digest, check)
        self.check = check[self.first]

    def hashed(self, bits: int):
        """For the anchors' exchange: (anchors, 32-bit key in its range, 63 bits of the class or 0 if several, range order,
        bounds)."""
        anchor = self.anchor[self.first]
        own, begin, _, count = _classes(anchor)
        told = (self.digest[begin] ^ (self.check[begin].astype(_U) << _U(1))) | _U(1)
        fold = np.where(count > 1, _U(0), told)
        order, bound = _split(own, bits)
        return own, (own << _U(bits) >> _U(32)).astype(np.uint32), fold, order, bound


_CLASS = ["kind", "range", "block", "keys", "values", "checks"]
_CLASS_KINDS = [_I, _I, _I, _B, _B, _B]


def stretches_of(texts: pa.Table, told: pa.Table, bits: int) -> pa.Table:
    """A shard's anchors with their class (kind 0, by range of anchor) and its classes with their earliest document
    (kind 1, by range of digest)."""
    if not texts.num_rows:
        return _bytes([], " ".join(_CLASS), _CLASS_KINDS)
    shard, block = Shard(texts), texts.column("block")[0].as_py()
    s = Stretches(shard, _shared(told), bits)
    _, key, fold, order, bound = s.hashed(bits)
    rows = [(0, r, block, key[order[a:b]].tobytes(), fold[order[a:b]].tobytes(), None) for r, (a, b) in bound.items()]
    _, bound = _split(s.digest, bits)  # the digests are sorted
    doc = s.doc[s.first]
    rows += [(1, r, block, s.digest[a:b].tobytes(), _planes(doc[a:b]), s.check[a:b].tobytes()) for r, (a, b) in bound.items()]
    return _bytes(rows, " ".join(_CLASS), _CLASS_KINDS)


class Merged:
    """Sorted runs merged: distinct keys (and checks, by which equal keys of different strings are told apart), with the
    least and the greatest value of each."""

    def __init__(self, keys: list[np.ndarray], values: list[np.ndarray], checks: list[np.ndarray] | None = None):
        every, value = np.concatenate(keys), np.concatenate(values)
        check = None if checks is None else np.concatenate(checks)
        order, new = _ordered(every, check)
        begins = np.flatnonzero(new)
        self.keys = every[order][begins]
        self.checks = None if check is None else check[order][begins]
        self.least, self.most = np.minimum.reduceat(value[order], begins), np.maximum.reduceat(value[order], begins)

    def place(self, keys: np.ndarray, checks: np.ndarray | None = None) -> np.ndarray:
        """Where each key of one of the runs stands, by binary search; then on to its check among equal keys."""
        at = np.searchsorted(self.keys, keys)
        while self.checks is not None and (off := self.checks[at] != checks).any():
            at[off] += 1
        return at


def merge_stretches(table: pa.Table) -> pa.Table:
    """Of one range: a bit per anchor (kind 0), set if stretches around it differ; a bit per class (kind 1), set if
    another shard has it in an earlier document."""
    kinds, ranges, blocks = (table.column(c).to_pylist() for c in ("kind", "range", "block"))
    keys, values, checks = (table.column(c).to_pylist() for c in ("keys", "values", "checks"))
    rows = []
    for kind, key_type, value_type in ((0, np.uint32, _U), (1, _U, np.int64)):
        at = [i for i, k in enumerate(kinds) if k == kind]
        if not at:
            continue
        k = [np.frombuffer(keys[i], key_type) for i in at]
        v = [_unplaned(values[i], value_type) if kind else np.frombuffer(values[i], value_type) for i in at]
        c = [np.frombuffer(checks[i], np.uint32) for i in at] if kind else None
        known = Merged(k, v, c)
        for j, (i, own, value) in enumerate(zip(at, k, v)):
            place = known.place(own, c[j] if c else None)
            least, most = known.least[place], known.most[place]
            found = (least != most) | (least == 0) if kind == 0 else least < value
            rows.append((kind, ranges[i], blocks[i], np.packbits(found).tobytes()))
    return _bytes(rows, "kind range block bits", [_I, _I, _I, _B])


def _verdicts(told: pa.Table, kind: int, order: np.ndarray, bound: dict) -> np.ndarray:
    out = np.zeros(len(order), bool)
    for k, r, bits in zip(told.column("kind").to_pylist(), told.column("range").to_pylist(), told.column("bits").to_pylist()):
        if k == kind and bits is not None:
            own = order[slice(*bound[r])]
            out[own] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
    return out


def classes_of(shard: Shard, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each window, first window of each class) of ascending window starts, by a suffix array."""
    kept = np.flatnonzero(_covered(at, shard.n))
    text = shard.bytes[kept]
    eights = np.ndarray((len(text),), ">u8", text.tobytes() + bytes(8), 0, (1,)).astype(_U)
    sa, _ = suffixes.suffix_array(eights, 8, WIDTH)
    lcp = suffixes.common_prefixes(text, sa, WIDTH)
    group = np.empty(len(kept), np.int64)
    group[sa] = np.cumsum(lcp < WIDTH)
    own = group[np.searchsorted(kept, at)]
    _, first, cls, _ = _classes(own)
    by = np.argsort(first)
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    return place[cls], at[first[by]]


def candidates(texts: pa.Table, shared: pa.Table, told: pa.Table, bits: int, wide: int) -> pa.Table:
    """A shard's window classes for merging by digest range, and a row of what is settled already."""
    names, kinds = "range block digests checks docs local", [_I, _I, _B, _B, _B, _B]
    if not texts.num_rows:
        return _bytes([], names, kinds)
    shard, block = Shard(texts), texts.column("block")[0].as_py()
    s = Stretches(shard, _shared(shared), bits)
    if not len(s.lo):
        return _bytes([], names, kinds)
    own, _, _, order, bound = s.hashed(bits)
    mixed = _verdicts(told, 0, order, bound)[np.searchsorted(own, s.anchor)]
    gone = _verdicts(told, 1, np.arange(len(s.digest)), _split(s.digest, bits)[1])
    # a stretch that an earlier document has too goes as a whole
    whole = gone[s.cls] | (s.doc > s.doc[s.first][s.cls])
    spread = lambda on: _unrun(np.stack([s.lo[on], (s.hi - s.lo + 1)[on]], 1))
    settled, at = spread(whole), spread(~whole & mixed)
    parts = [_runs(settled)]
    rows = []
    if len(at):
        cls, firsts = classes_of(shard, at)
        doc_at = shard.ids[np.searchsorted(shard.ends, at, side="right")]
        doc_of = shard.ids[np.searchsorted(shard.ends, firsts, side="right")]
        later = doc_at > doc_of[cls]
        more = ~later & (at != firsts[cls])
        parts += [_runs(at[later]), _runs(firsts), np.stack([at[more], cls[more]], 1).astype(np.int32)]
        digest, check = shard.windows(firsts), shard.checks(firsts)
        order, bound = _split(digest, wide)
        digest, check, doc_of = digest[order], check[order], doc_of[order]
        rows = [(r, block, digest[a:b].tobytes(), check[a:b].tobytes(), _planes(doc_of[a:b]), None) for r, (a, b) in bound.items()]
    parts += [np.zeros((0, 2), np.int32)] * (4 - len(parts))
    local = np.array([len(x) for x in parts], np.int32).tobytes() + _planes(np.concatenate(parts))
    return _bytes([*rows, (block % (1 << wide), block, None, None, None, local)], names, kinds)


def merge_runs(table: pa.Table) -> pa.Table:
    """Of one digest range: a bit per class of each shard's run, set if another shard has the window in an earlier
    document. The sorted runs are merged, and every run is looked up in the merged one by binary search."""
    blocks, ranges = table.column("block").to_pylist(), table.column("range").to_pylist()
    digests = [np.frombuffer(x, _U) if x is not None else None for x in table.column("digests").to_pylist()]
    checks = [np.frombuffer(x, np.uint32) if x is not None else None for x in table.column("checks").to_pylist()]
    docs = [_unplaned(x, np.int64) if x is not None else None for x in table.column("docs").to_pylist()]
    local = table.column("local").to_pylist()
    some = [i for i, d in enumerate(digests) if d is not None]
    rows = [(blocks[i], ranges[i], None, x) for i, x in enumerate(local) if x is not None]
    if some:
        known = Merged(*([c[i] for i in some] for c in (digests, docs, checks)))
        for i in some:
            found = known.least[known.place(digests[i], checks[i])] < docs[i]
            rows.append((blocks[i], ranges[i], np.packbits(found).tobytes(), None))
    return _bytes(rows, "block range bits local", [_I, _I, _B, _B])


def removed(texts: pa.Table, told: pa.Table, wide: int) -> pa.Table:
    """Per document of a shard: what is removed and the digest of what stays."""
    names, kinds = "doc_id n_bytes n_removed n_spans kept_sha256", [_L, _L, _L, _L, pa.string()]
    if not texts.num_rows:
        return _bytes([], names, kinds)
    shard = Shard(texts)
    hits = np.zeros(0, np.int64)
    local = [x for x in told.column("local").to_pylist() if x is not None]
    if local:
        n0, n1, n2, _ = np.frombuffer(local[0][:16], np.int32).tolist()
        pairs = _unplaned(local[0][16:], np.int32).reshape(-1, 2)
        settled, later, firsts, more = _unrun(pairs[:n0]), _unrun(pairs[n0 : n0 + n1]), _unrun(pairs[n0 + n1 : n0 + n1 + n2]), pairs[n0 + n1 + n2 :]
        order, bound = _split(shard.windows(firsts), wide)
        verdict = np.zeros(len(firsts), bool)
        for r, bits in zip(told.column("range").to_pylist(), told.column("bits").to_pylist()):
            if bits is not None:
                own = order[slice(*bound[r])]
                verdict[own] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
        hits = np.concatenate([settled, later, firsts[verdict], more[verdict[more[:, 1]], 0].astype(np.int64)])
    mask = _covered(hits, shard.n)
    total = np.concatenate([[0], np.cumsum(mask)])
    rows = []
    for i, (size, end) in enumerate(zip(shard.sizes.tolist(), shard.ends.tolist())):
        n = int(total[end] - total[end - size])
        own, spans = shard.bytes[end - size : end], 0
        if n:
            m = mask[end - size : end]
            spans = int(m[0]) + int((m[1:] & ~m[:-1]).sum())
            own = own[~m]
        rows.append((None if shard.none[i] else int(shard.ids[i]), size, n, spans, hashlib.sha256(own.tobytes()).hexdigest()))
    return _bytes(rows, names, kinds)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    common.ship(spark)
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-total // BLOCK))
    bits = max(4, (blocks // 2).bit_length())
    wide = bits + 1
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    by_block = texts.groupBy("block")
    own = by_block.applyInArrow(lambda t: anchors_of(t, bits), "range int, block int, keys binary")
    shared = own.groupBy("range").applyInArrow(shared_anchors, "block int, range int, keys binary")
    # from here on a shard hears two things: its shared anchors (kind -1) and the verdicts on its stretches
    shared = shared.select("block", F.lit(-1).alias("kind"), "range", "keys", F.lit(None).cast("binary").alias("bits"))
    classed = by_block.cogroup(shared.groupBy("block")).applyInArrow(
        lambda t, k: stretches_of(t, k, bits), "kind int, range int, block int, keys binary, values binary, checks binary"
    )
    judged = classed.groupBy("kind", "range").applyInArrow(merge_stretches, "kind int, range int, block int, bits binary")
    heard = judged.select("block", "kind", "range", F.lit(None).cast("binary").alias("keys"), "bits").unionByName(shared)
    found = by_block.cogroup(heard.groupBy("block")).applyInArrow(
        lambda t, k: candidates(t, _kind(k, -1), _kind(k, 0, 1), bits, wide), "range int, block int, digests binary, checks binary, docs binary, local binary"
    )
    verdicts = found.groupBy("range").applyInArrow(merge_runs, "block int, range int, bits binary, local binary")
    return by_block.cogroup(verdicts.groupBy("block")).applyInArrow(
        lambda t, k: removed(t, k, wide), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents."""
    return substring_dedup(common.table(spark, sf_dir, "documents"))
