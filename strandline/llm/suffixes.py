"""Suffix arrays in numpy: Larsson-Sadakane refinement to a bounded depth, and Kasai's common prefixes in lanes."""

from __future__ import annotations

import numpy as np


def _regroup(sa: np.ndarray, rank: np.ndarray, slots: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Sort the suffixes in ``slots`` of ``sa`` by ``key`` (their old rank and a further one), give them new ranks.
    Returns which slots are still in groups of several."""
    order = np.argsort(key, kind="stable")
    sa[slots] = sa[slots][order]
    key = key[order]
    new = np.empty(len(key), bool)
    new[:1], new[1:] = True, key[1:] != key[:-1]
    begins = np.flatnonzero(new)
    rank[sa[slots]] = slots[begins][np.cumsum(new) - 1]
    sizes = np.diff(np.append(begins, len(key)))
    return np.repeat(sizes > 1, sizes)


def suffix_array(first: np.ndarray, step: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, ranks) ordered by the first ``depth`` symbols; suffixes have equal ranks if these are equal.

    ``first``: an integer per position whose order is that of the next ``step`` symbols. A round sorts only the groups
    that are not yet resolved, by the ranks ``step`` further on; the depth doubles in each round.
    """
    n = len(first)
    sa, rank = np.arange(n), np.zeros(n, np.int64)
    if not n:
        return sa, rank
    open_ = _regroup(sa, rank, np.arange(n), first)
    slots = np.flatnonzero(open_)
    while step < depth and len(slots):
        ahead = min(step, depth - step)
        at = sa[slots] + ahead
        further = np.where(at < n, rank[np.minimum(at, n - 1)] + 1, 0)
        open_ = _regroup(sa, rank, slots, rank[sa[slots]] * (n + 1) + further)
        slots = slots[open_]
        step += ahead
    return sa, rank


def common_prefixes(symbols: np.ndarray, sa: np.ndarray, cap: int, lanes: int = 2048) -> np.ndarray:
    """Kasai's algorithm: the common prefix of each suffix in ``sa`` with the one before it, up to ``cap`` symbols.

    The text is cut into lanes that run side by side; each lane keeps its prefix length from one position to the next,
    less one, as the sequential algorithm does.
    """
    n = len(sa)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    before = np.where(place > 0, sa[np.maximum(place - 1, 0)], -1)
    width = -(-n // min(lanes, n))
    at = np.arange(0, n, width)
    stop = np.minimum(at + width, n)
    have = np.zeros(len(at), np.int64)
    while len(at):
        prev = before[at]
        a, b = at + have, prev + have
        same = (prev >= 0) & (have < cap) & (a < n) & (b < n)
        same[same] = symbols[a[same]] == symbols[b[same]]
        ended = ~same
        lcp[place[at[ended]]] = np.where(prev[ended] >= 0, have[ended], 0)
        # suffixes equal to the sorted depth may be in either order; what they share carries over only in the right one
        after, theirs = np.minimum(at + 1, n - 1), np.clip(prev + 1, 0, n - 1)
        carries = (prev >= 0) & (place[theirs] < place[after]) & (prev + 1 < n)
        have = np.where(same, have + 1, np.where(carries, np.maximum(have - 1, 0), 0))
        at = at + ended
        if (at >= stop).any():
            on = at < stop
            at, stop, have = at[on], stop[on], have[on]
    return lcp
