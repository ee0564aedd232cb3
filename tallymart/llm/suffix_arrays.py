"""Suffix arrays of many byte strings with numpy: Larsson-Sadakane refinement, Kasai prefixes, search across arrays.

The helper that a task of `suffix_dedup` uses on one shard of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np

FIRST = 7  # characters in the first sort key, 9 bits each
WORD = 8


class Shard(NamedTuple):
    """Strings laid end to end, each followed by a terminator that sorts before every byte."""

    data: np.ndarray  # bytes, padded so that a word can be read anywhere
    starts: np.ndarray  # of each string
    sizes: np.ndarray
    end: np.ndarray  # for each place, its string's terminator


def lay_out(strings: Sequence[bytes]) -> Shard:
    sizes = np.array([len(s) for s in strings], np.int64)
    data = np.frombuffer(b"\0".join([*strings, bytes(WORD)]), np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    end = np.repeat(starts + sizes, sizes + 1).astype(np.int32)
    return Shard(data, starts, sizes, end)


def suffix_array(shard: Shard) -> np.ndarray:
    """Places of all bytes and terminators in suffix order; equal suffixes stand in the order of their places.

    Ranks by the first h characters become ranks by 2h: members of a group that is not yet single are sorted by the
    rank of the place h further on. Groups that are single, or whose suffixes have ended, are left alone.
    """
    end, n = shard.end, len(shard.end)
    places = np.arange(n, dtype=np.int32)
    code = shard.data[:n].astype(np.uint64) + np.uint64(1)
    code[end[shard.starts]] = 0
    key = np.zeros(n, np.uint64)
    for k in range(FIRST):
        key = (key << np.uint64(9)) | code[np.minimum(places + k, end)]
    order = np.argsort(key).astype(np.int32)
    first = _group_starts(key[order])
    rank = np.empty(n, np.int32)
    rank[order] = first
    active = np.arange(n, dtype=np.int32)
    h = FIRST
    while True:
        # in groups of several whose suffixes go on beyond h
        group = rank[order[active]]
        single = np.ones(len(active), bool)
        single[1:] &= group[1:] != group[:-1]
        single[:-1] &= group[1:] != group[:-1]
        active = active[~single]
        active = active[end[order[active]] - order[active] >= h]
        if not len(active):
            break
        at = order[active]
        pair = rank[at].astype(np.uint64) << np.uint64(32) | rank[np.minimum(at + h, end[at])].astype(np.uint64)
        by = np.argsort(pair)
        order[active] = at = at[by]
        rank[at] = active[_group_starts(pair[by])]
        h *= 2
    # equal suffixes: by place, so that they keep their order when both are cut at the front
    group = rank[order].astype(np.int64)
    return order[np.argsort(group << 32 | order)]


def _group_starts(ordered: np.ndarray) -> np.ndarray:
    """For each element the index of the first that equals it."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(ordered), dtype=np.int32), 0))


def words(data: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The eight bytes that start at each place, as integers; a view."""
    return np.ndarray((len(data) - WORD + 1,), kind, data.data, strides=(1,))


def common_prefixes(shard: Shard, order: np.ndarray, cap: int) -> np.ndarray:
    """For each place, the bytes (at most `cap`) that its suffix shares with the one before it in the order.

    Kasai's rule: one byte further on, at most one byte less is shared. All strings advance side by side. Only places
    with `cap` bytes left are measured; the others are 0.
    """
    n, end, view = len(shard.end), shard.end, words(shard.data)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int32)
    lane = np.flatnonzero(shard.sizes >= cap)
    at, steps = shard.starts[lane].astype(np.int32), shard.sizes[lane] - cap + 1
    by = np.argsort(-steps)
    at, steps = at[by], steps[by]
    have = np.zeros(len(at), np.int32)
    for step in range(int(steps[0]) if len(steps) else 0):
        alive = int(np.searchsorted(-steps, -step))  # lanes with a place left come first
        at, have = at[:alive], have[:alive]
        other = before[at]
        have = np.where(other < 0, 0, np.maximum(have - (step > 0), 0)).astype(np.int32)
        open_ = np.flatnonzero(other >= 0)
        while len(open_):
            a, b, h = at[open_], other[open_], have[open_]
            room = np.minimum(np.minimum(end[a] - a, end[b] - b), cap) - h
            differ = view[np.minimum(a + h, len(view) - 1)] ^ view[np.minimum(b + h, len(view) - 1)]
            same = np.where(differ == 0, WORD, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3)
            gain = np.minimum(same, room).astype(np.int32)
            have[open_] = h + gain
            open_ = open_[(gain == WORD) & (room > WORD)]
        shared[at] = have
        at = at + 1
    return shared


def window_places(shard: Shard, cap: int) -> np.ndarray:
    """Whether at least `cap` bytes of the string are left from each place on."""
    return shard.end - np.arange(len(shard.end)) >= cap


def repeated_within(shard: Shard, order: np.ndarray, weights: np.ndarray, cap: int) -> np.ndarray:
    """Whether the `cap` bytes from each place on occur twice or more, a string counting `weights` times."""
    shared, whole = common_prefixes(shard, order, cap), window_places(shard, cap)
    group = np.cumsum(shared[order] < cap) - 1
    weight = np.repeat(weights, shard.sizes + 1)
    total = np.bincount(group, weights=np.where(whole[order], weight[order], 0))
    out = np.zeros(len(order), bool)
    out[order] = whole[order] & (total[group] >= 2)
    return out


def found_in(shard: Shard, places: np.ndarray, other: Shard, other_order: np.ndarray, cap: int) -> np.ndarray:
    """Whether the `cap` bytes from each of `places` on also start somewhere in the other shard: a binary search."""
    sorted_ = other_order[window_places(other, cap)[other_order]]
    if not len(sorted_) or not len(places):
        return np.zeros(len(places), bool)
    lo, hi = np.zeros(len(places), np.int64), np.full(len(places), len(sorted_))
    while (open_ := np.flatnonzero(lo < hi)).size:
        middle = (lo[open_] + hi[open_]) // 2
        less = _compare(other, sorted_[middle], shard, places[open_], cap) < 0
        lo[open_] = np.where(less, middle + 1, lo[open_])
        hi[open_] = np.where(less, hi[open_], middle)
    inside = lo < len(sorted_)
    out = np.zeros(len(places), bool)
    out[inside] = _compare(other, sorted_[lo[inside]], shard, places[inside], cap) == 0
    return out


def _compare(left: Shard, a: np.ndarray, right: Shard, b: np.ndarray, cap: int) -> np.ndarray:
    """-1, 0 or 1 for each pair of places, by their first `cap` bytes."""
    x, y = words(left.data, ">u8"), words(right.data, ">u8")
    out, open_ = np.zeros(len(a), np.int8), np.arange(len(a))
    for k in range(0, cap, WORD):
        k = min(k, cap - WORD)  # the last word may overlap the one before
        u, v = x[a[open_] + k], y[b[open_] + k]
        out[open_] = (u > v).astype(np.int8) - (u < v)
        open_ = open_[u == v]
        if not len(open_):
            break
    return out
