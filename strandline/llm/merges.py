"""Byte-pair merging of pieces, many at once in numpy, with a bounded cache."""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.int32(2**31 - 1)
#: Pieces up to this many bytes are merged together in arrays; longer ones one by one with a heap.
SHORT = 40


class Merger:
    """Finds the ids a piece's merges end in. The pair with the lowest merge number is merged first, leftmost first.

    ``first``: the id of each of the 256 bytes. ``pairs``: (left id, right id) to merge number. ``result``: the id that
    each merge number makes. ``whole``: pieces that are one id without merging. Only the newest distinct pieces stay
    cached: a worker's memory is bounded by ``limit`` pieces whatever the corpus holds.
    """

    def __init__(self, first: list[int], pairs: dict[tuple[int, int], int], result: np.ndarray, whole: dict | None = None, counts: bool = False, limit: int = 200_000):
        self.first = np.array(first, np.int32)
        self.result, self.whole, self.counts, self.limit = result.astype(np.int32), whole or {}, counts, limit
        keys = np.fromiter((a << 32 | b for a, b in pairs), np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.numbers = keys[order], np.fromiter(pairs.values(), np.int32, len(pairs))[order]
        self.pairs = pairs
        self.cache: dict[bytes, object] = {}

    def __call__(self, pieces: list[bytes]) -> list:
        """For each piece the tuple of its ids, or their number if ``counts``."""
        if len(self.cache) > self.limit:
            self.cache.clear()
        got = list(map(self.cache.get, pieces))
        if None not in got:
            return got
        new = list({p for p, g in zip(pieces, got) if g is None})
        own = dict(zip(new, self._merged(new)))
        self.cache.update((k, v) for k, v in own.items() if len(k) <= 256)
        return [own[p] if g is None else g for p, g in zip(pieces, got)]

    def _merged(self, pieces: list[bytes]) -> list:
        out: list = [None] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for i in np.flatnonzero(lengths > SHORT).tolist():
            out[i] = self._long(pieces[i])
        for low, high in ((0, 6), (6, 10), (10, 16), (16, SHORT)):
            own = np.flatnonzero((lengths > low) & (lengths <= high))
            for a in range(0, len(own), 50_000):
                at = own[a : a + 50_000]
                for i, ids in zip(at.tolist(), self._short([pieces[i] for i in at.tolist()], lengths[at])):
                    out[i] = ids
        return out

    def _numbers(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.numbers[at], NONE)

    def _short(self, pieces: list[bytes], lengths: np.ndarray) -> list:
        n, width = len(pieces), int(lengths.max())
        ids = np.full((n, width + 1), -1, np.int32)
        inside = np.arange(width + 1) < lengths[:, None]
        ids[inside] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        final = ids.copy()
        number = np.full((n, width + 1), NONE, np.int32)
        number[:, :width] = self._numbers(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width)
        row = np.arange(n)
        if self.whole:
            one = np.fromiter((self.whole.get(p, -1) for p in pieces), np.int32, n)
            final[one >= 0] = -1
            final[one >= 0, 0] = one[one >= 0]
            row = np.flatnonzero(one < 0)
            ids, number = ids[row], number[row]
        col = np.arange(width + 1)
        while len(row):
            j = number.argmin(axis=1)
            best = np.take_along_axis(number, j[:, None], 1)[:, 0]
            if (done := best == NONE).any():
                final[row[done]] = ids[done]
                keep = ~done
                row, ids, number, j, best = row[keep], ids[keep], number[keep], j[keep], best[keep]
                if not len(row):
                    break
            lane = np.arange(len(row))
            src = np.minimum(col + (col > j[:, None]), width)
            ids = np.take_along_axis(ids, src, 1)
            number = np.take_along_axis(number, np.minimum(col + (col >= j[:, None]), width), 1)
            ids[:, width], number[:, width] = -1, NONE
            ids[lane, j] = self.result[best]
            number[lane, j] = self._numbers(ids[lane, j], ids[lane, np.minimum(j + 1, width)])
            left = np.flatnonzero(j > 0)
            number[left, j[left] - 1] = self._numbers(ids[left, j[left] - 1], ids[left, j[left]])
        kept = (final >= 0).sum(axis=1)
        if self.counts:
            return kept.tolist()
        flat, ends = final[final >= 0].tolist(), np.cumsum(kept).tolist()
        return [tuple(flat[b - k : b]) for b, k in zip(ends, kept.tolist())]

    def _long(self, piece: bytes):
        """The same merges with a heap over a linked list: n log n for one piece of any length."""
        if piece in self.whole:
            return 1 if self.counts else (self.whole[piece],)
        get, n = self.pairs.get, len(piece)
        ids = self.first[np.frombuffer(piece, np.uint8)].tolist()
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            if not alive[i] or ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = int(self.result[m]), False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := get((ids[i], ids[after[i]]))) is not None:
                    heapq.heappush(heap, (x, i, ids[i], ids[after[i]]))
            if (p := before[i]) >= 0 and (x := get((ids[p], ids[i]))) is not None:
                heapq.heappush(heap, (x, p, ids[p], ids[i]))
        out = [x for x, on in zip(ids, alive) if on]
        return len(out) if self.counts else tuple(out)


def from_ranks(ranks: dict[bytes, int]) -> Merger:
    """A merger for a rank file: two neighbours merge when their joined bytes are a token, lowest rank first."""
    pairs = {
        (left, right): rank
        for token, rank in ranks.items()
        for i in range(1, len(token))
        if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None
    }
    return Merger([ranks[bytes([b])] for b in range(256)], pairs, np.arange(max(ranks.values()) + 1), ranks)


def from_merges(merges: list[tuple[bytes, bytes]], counts: bool) -> Merger:
    """A merger for an ordered list of merges over bytes; ids are places in that order after the 256 bytes."""
    ids = {bytes([b]): b for b in range(256)}
    pairs, result = {}, []
    for number, (left, right) in enumerate(merges):
        result.append(ids.setdefault(left + right, 256 + number))
        pairs.setdefault((ids[left], ids[right]), number)
    return Merger(list(range(256)), pairs, np.array(result), None, counts)
