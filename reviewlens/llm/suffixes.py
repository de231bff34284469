"""Repeated substrings of a fixed length within one block of byte strings.

The suffixes of the block are sorted by a bounded prefix and give a Burrows-Wheeler transform.
Intervals of suffixes are then expanded breadth first, one byte to the left per level: the
interval of a longer string ends where a common prefix is as short as the level, so the lengths
of common prefixes come out by increasing value. An interval whose two ends are known already is
not followed, and the search stops at the length asked for: where no end was set, neighbours
share that many bytes.
"""

from __future__ import annotations

import numpy as np

_SYMBOL_BITS = 9
_FIRST = 7


def sort_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` symbols at least (0 … 256); doubling."""
    n = len(symbols)
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([symbols, np.zeros(_FIRST, symbols.dtype)]).astype(np.uint64)
    for i in range(_FIRST):
        key = key << np.uint64(_SYMBOL_BITS) | padded[i : n + i]
    order = np.argsort(key, kind="stable")
    known = _FIRST
    rank = np.empty(n, np.int64)
    while True:
        ordered = key[order]
        new = np.ones(n, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        first = np.flatnonzero(new)
        # A suffix's rank is the place of the first of its group, so groups can be sorted alone.
        rank[order] = np.repeat(first, np.diff(np.append(first, n)))
        if known >= depth or len(first) == n:
            return order
        shared = ~(new & np.append(new[1:], True))
        places = np.flatnonzero(shared)
        members = order[places]
        after = np.where(members + known < n, rank[np.minimum(members + known, n - 1)] + 1, 0)
        key = rank.astype(np.uint64) << np.uint64(32)
        sub = key[members] | after.astype(np.uint64)
        order[places] = members[np.argsort(sub, kind="stable")]
        key[members] = sub
        known *= 2


def expand(order: np.ndarray, symbols: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of each sorted suffix with the one before, up to `length`; 0 separates
    strings and belongs to none. The first entry and one behind the last are 0."""
    n = len(order)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = symbols[order - 1]  # the transform
    before[order == 0] = 0
    step = place[order - 1]
    common = np.full(n + 1, length, np.int16)
    common[[0, n]] = 0
    owner = np.zeros(n, np.int64)
    low, high = np.zeros(1, np.int64), np.full(1, n - 1, np.int64)
    for level in range(length):
        single = low == high
        at = low[single]
        at = step[at[before[at] != 0]]
        lows, highs = [at], [at]
        if not single.all():
            a, size = low[~single], (high - low + 1)[~single]
            group = np.repeat(np.arange(len(a)), size)
            places = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size) + a[group]
            byte = before[places]
            real = byte != 0
            to = step[places[real]]
            owner[to] = group[real] * 257 + byte[real]
            to.sort()
            held = owner[to]
            border = np.ones(len(to) + 1, bool)
            border[1:-1] = held[1:] != held[:-1]
            edge = np.flatnonzero(border)
            lows.append(to[edge[:-1]])
            highs.append(to[edge[1:] - 1])
        low, high = np.concatenate(lows), np.concatenate(highs)
        if not len(low):
            break
        open_ = (common[low] == length) | (common[high + 1] == length)
        low, high = low[open_], high[open_]
        for ends in (low, high + 1):
            ends = ends[common[ends] == length]
            common[ends] = level
    return common


def repeated_starts(strings: list[bytes], copies: np.ndarray, length: int) -> list[np.ndarray]:
    """For every string the starts of its substrings of `length` bytes that occur twice or more in
    all strings; a string counts `copies` times."""
    sizes = np.array([len(s) for s in strings], np.int64)
    symbols = np.zeros(int(sizes.sum()) + len(strings), np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    of = np.repeat(np.arange(len(strings)), sizes + 1)
    body = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
    inside = np.arange(len(symbols)) - begins[of] < sizes[of]
    symbols[inside] = body[inside].astype(np.int64) + 1
    order = sort_suffixes(symbols, length)
    common = expand(order, symbols, length)
    group_of_place = np.cumsum(common[:-1] < length) - 1
    starts = np.arange(len(symbols)) - begins[of]
    whole = starts + length <= sizes[of]
    group = np.empty(len(symbols), np.int64)
    group[order] = group_of_place
    times = np.bincount(group[whole], weights=copies[of[whole]], minlength=len(symbols))
    found = np.flatnonzero(whole & (times[group] >= 2))
    borders = np.searchsorted(of[found], np.arange(len(strings) + 1))
    return [starts[found[a:b]] for a, b in zip(borders[:-1], borders[1:], strict=True)]
