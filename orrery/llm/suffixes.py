"""Suffix arrays over the words of a block, and binary search in them."""

from __future__ import annotations

import numpy as np

_KEY_BITS = 63  # of the numbers that the first sort takes at once


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of `ids` (not negative) ordered by the `depth` values that follow them at least.

    The first sort takes as many values at once as one key holds, three at most
    (three below 2**21, two below 2**31); each later one doubles that, and
    only touches positions that are still tied, so text without long repeats
    costs little more than the first sort.  Past the end counts as -1.
    """
    n = len(ids)
    wide = np.zeros(n + 2, np.int64)
    wide[:n] = ids + 1
    bits = max(1, int(wide.max()).bit_length())
    done = max(1, min(3, _KEY_BITS // bits))
    key = wide[:n].copy()
    for i in range(1, done):
        key = (key << bits) | wide[i : n + i]
    order = np.argsort(key)
    sorted_key = key[order]
    del key
    head = np.ones(n, bool)
    head[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while done < depth:
        tied = ~head
        tied[:-1] |= ~head[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        where = order[at]
        ahead = where + done
        nxt = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = (rank[where] << 31) | nxt
        sort = np.argsort(by, kind="stable")
        by, where = by[sort], where[sort]
        order[at] = where
        new = np.ones(len(at), bool)
        new[1:] = by[1:] != by[:-1]
        head[at] = new
        rank[where] = np.maximum.accumulate(np.where(new, at, 0))
        done *= 2
    return order


def _bound(order: np.ndarray, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, value: np.ndarray, after: bool) -> np.ndarray:
    """Where value (or what is greater) begins among the depth-th values of the suffixes lo..hi."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        at = order[np.minimum(mid, len(order) - 1)] + depth
        there = np.where(at < len(ids), ids[np.minimum(at, len(ids) - 1)], -1)
        right = open_ & ((there <= value) if after else (there < value))
        lo = np.where(right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)
    return lo


def search(order: np.ndarray, ids: np.ndarray, test: np.ndarray, left: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary search of every suffix of `test`.

    left: values of each suffix before its item ends; need: how many must match.
    Returns the length of the longest match of each suffix, and the range
    [lo, hi) of `order` that shares its first `need` values (empty if none does).
    """
    n = len(test)
    longest = np.zeros(n, np.int64)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(order), np.int64)
    got_lo, got_hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    active = np.flatnonzero((left > 0) & (test >= 0)) if len(order) else np.zeros(0, np.int64)
    depth = 0
    while len(active):
        value = test[active + depth]
        a = _bound(order, ids, lo[active], hi[active], depth, value, False)
        b = _bound(order, ids, a, hi[active], depth, value, True)
        found = b > a
        active, lo_, hi_ = active[found], a[found], b[found]
        lo[active], hi[active] = lo_, hi_
        depth += 1
        longest[active] = depth
        now = active[need[active] == depth]
        got_lo[now], got_hi[now] = lo[now], hi[now]
        active = active[(left[active] > depth)]
        active = active[test[active + depth] >= 0] if len(active) else active
    return longest, got_lo, got_hi
