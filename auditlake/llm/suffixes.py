"""Suffix arrays by Lyndon grouping, and repeated windows found with them.

The suffix array takes linear time, without recursion and without renaming the text. Phase one sorts suffixes into
groups by their longest Lyndon prefix: groups are processed in descending order; each run of a group's suffixes is
finished and appended to the suffix before it that is smaller and still open (the previous smaller one), whose group
is split by how often the run's word follows. Phase two emits each group's order: going through the sorted suffixes in
ascending order, every suffix places those whose Lyndon prefix ends where it begins.

Texts are parsed first into phrases that begin and end with a trigger (four bytes with a certain hash), so no phrase
is a prefix of another and ranks of phrases sort like the bytes; the array is built over phrases. A byte's suffix then
sorts by what precedes the next phrase and by the rank of the suffix there.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

TRIGGER, SPACING = 4, 32
_random = np.random.default_rng(20240101)
#: Odd multiplier, its inverse modulo 2^64, and a value for each byte, for hashes of any substring from running sums.
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def suffix_array(s: list[int]) -> list[int]:
    """Starts of all suffixes of s (numbers from 0) in ascending order; the end counts as smaller than everything."""
    n = len(s)
    if not n:
        return []
    count = max(s) + 1
    members: list[list[int]] = [[] for _ in range(count)]
    for i, c in enumerate(s):
        members[c].append(i)
    group = list(s)
    below = [k - 1 for k in range(count)]  # groups in order, as a linked list
    above = [*range(1, count), -1]
    before = list(range(-1, n))  # open suffixes in text order, as a linked list; n is the end
    after = [*range(1, n + 1), n]
    ends: list[int] = [n] * n  # where the finished Lyndon prefix ends

    # Phase one.
    g = count - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        split: dict[tuple[int, int], list[int]] = {}
        for i in own:
            parent = before[i]
            if parent >= 0 and group[parent] == g:
                continue  # within a run; its first suffix deals with it
            j, times = i, 1
            ends[i] = nxt = after[i]
            while nxt < n and group[nxt] == g:
                j, times = nxt, times + 1
                ends[j] = nxt = after[j]
            before[nxt] = parent
            if parent >= 0:
                after[parent] = nxt
                key = (group[parent], times)
                if key in split:
                    split[key].append(parent)
                else:
                    split[key] = [parent]
        # The most frequent runs go above the rarer ones, all of them directly above the group that is split.
        for key in sorted(split, reverse=True) if len(split) > 1 else split:
            old, new = key[0], len(members)
            parents = split[key]
            members.append(parents)
            for i in parents:
                group[i] = new
            up = above[old]
            below.append(old)
            above.append(up)
            above[old] = new
            if up >= 0:
                below[up] = new
        g = below[g]

    # Phase two.
    place = [0] * len(members)
    g = 0  # the lowest group never moves: what is split off goes above
    at = 0
    while g >= 0:
        place[g] = at
        at += len(members[g])
        g = above[g]
    first, other = [-1] * (n + 1), [-1] * n  # suffixes by the end of their Lyndon prefix
    for i in range(n):
        e = ends[i]
        other[i] = first[e]
        first[e] = i
    order = [0] * n
    i = first[n]
    while i >= 0:
        g = group[i]
        order[place[g]] = i
        place[g] += 1
        i = other[i]
    for at in range(n):
        i = first[order[at]]
        while i >= 0:
            g = group[i]
            order[place[g]] = i
            place[g] += 1
            i = other[i]
    return order


class Text:
    """Hashes of a byte text's substrings from running sums."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        power = np.full(n + 1, _MULTIPLIER, dtype=np.uint64)
        power[0] = 1
        back = np.full(n + 1, _INVERSE, dtype=np.uint64)
        back[0] = 1
        self.back = np.multiply.accumulate(back)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_VALUES[text] * np.multiply.accumulate(power)[:n], dtype=np.uint64)])

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.back[start]


def triggers(text: np.ndarray) -> np.ndarray:
    """Whether a trigger begins at each byte."""
    out = np.zeros(len(text), dtype=bool)
    if len(text) >= TRIGGER:
        h = np.zeros(len(text) - TRIGGER + 1, dtype=np.uint32)
        for k in range(TRIGGER):
            h = h * np.uint32(0x01000193) ^ text[k : len(text) - TRIGGER + 1 + k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        out[: len(h)] = (h >> np.uint32(13)) % np.uint32(SPACING) == 0
    return out


def repeated_windows(excerpts: list[bytes], wanted: list[int], sizes: tuple[int, ...]) -> list[list[np.ndarray]]:
    """For each size, and each excerpt: whether each of its first `wanted` windows of that size equals another such window of any excerpt.

    Sizes ascend. Windows of the first size lie within their excerpts; longer ones that don't are no windows.
    """
    size = np.array([len(e) for e in excerpts], dtype=np.int64)
    stop = np.cumsum(size)
    start = stop - size
    text = np.frombuffer(b"".join(excerpts), dtype=np.uint8)
    mark = triggers(text)
    for k in range(1, TRIGGER):  # none reaches over an excerpt's end
        mark[(stop - k)[size >= k]] = False
    at = np.flatnonzero(mark)
    owner = np.searchsorted(stop, at, side="right")
    last = np.concatenate([owner[1:] != owner[:-1], [True]]) if len(at) else np.zeros(0, dtype=bool)
    until = np.where(last, stop[owner], np.concatenate([at[1:], [0]])[: len(at)] + TRIGGER)
    whole = text.tobytes()
    phrases = [whole[i:j] for i, j in zip(at.tolist(), until.tolist(), strict=True)]
    # Ranks: separators, one of its own for each excerpt with phrases, below all phrases.
    used = np.unique(owner)
    rank_of = {p: k for k, p in enumerate(sorted(set(phrases)), len(used))}
    symbols, where, sep = [], [], len(used)
    for p, i, end in zip(phrases, range(len(phrases)), last.tolist(), strict=True):
        where.append(len(symbols))
        symbols.append(rank_of[p])
        if end:
            sep -= 1
            symbols.append(sep)
    rank = np.empty(len(symbols), dtype=np.int64)
    rank[np.array(suffix_array(symbols), dtype=np.int64)] = np.arange(len(symbols))
    rank = rank[np.array(where, dtype=np.int64)]

    wanted_ = np.array(wanted, dtype=np.int64)
    of = np.repeat(np.arange(len(excerpts)), wanted_)
    place = np.arange(len(of)) - np.repeat(np.cumsum(wanted_) - wanted_, wanted_) + start[of]
    end = stop[of]
    sums = Text(text)
    nxt = np.searchsorted(at, place)
    trigger = np.concatenate([at, [len(text)]])[nxt]
    out, hit = [], np.ones(len(of), dtype=bool)
    for window in sizes:
        own = np.flatnonzero(hit & (place + window <= end))  # a longer window repeats only where a shorter one does
        i, p = place[own], trigger[own]
        inside = p + TRIGGER <= i + window
        # What lies before the next phrase, its trigger included; a window without a trigger stands for itself.
        head = sums.hashes(i, np.where(inside, p + TRIGGER, i + window))
        tail = np.where(inside, np.concatenate([rank, [-1]])[np.where(inside, nxt[own], len(at))], -1)
        order = np.lexsort((tail, head))
        hit = np.zeros(len(of), dtype=bool)
        hit[own[_equal_neighbours(whole, i, order, head, sums.hashes(i, i + window), window)]] = True
        out.append(np.split(hit, np.cumsum(wanted_)[:-1]))
    return out


def _equal_neighbours(text: bytes, i: np.ndarray, order: np.ndarray, head: np.ndarray, full: np.ndarray, window: int) -> np.ndarray:
    """Which windows (beginning at i) equal a neighbour in order. Hashes tell whom to compare, bytes decide."""
    a, b = order[:-1], order[1:]
    same = (head[a] == head[b]) & (full[a] == full[b])
    a, b = a[same], b[same]
    # Pairs at one distance whose windows follow one another are compared as one string.
    x, y = np.minimum(i[a], i[b]), np.maximum(i[a], i[b])
    by = np.lexsort((x, y - x))
    x, y = x[by], y[by]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(x) > window) | (np.diff(y - x) != 0)])) if len(x) else np.empty(0, np.int64)
    until = np.append(first[1:], len(x))[: len(first)] - 1
    wrong = [k for k, (p, q, r, s) in enumerate(zip(x[first].tolist(), x[until].tolist(), y[first].tolist(), y[until].tolist(), strict=True)) if text[p : q + window] != text[r : s + window]]
    hit = np.zeros(len(i), dtype=bool)
    hit[a] = hit[b] = True
    if wrong:  # hashes that lie: of all windows with one of them only the bytes tell
        bad = np.isin(full, full[np.concatenate([a, b])][np.isin(i[np.concatenate([a, b])], np.concatenate([x[f : u + 1] for f, u in zip(first[wrong], until[wrong], strict=True)]))])
        places = np.flatnonzero(bad)
        counts = Counter(text[k : k + window] for k in i[places].tolist())
        hit[places] = [counts[text[k : k + window]] > 1 for k in i[places].tolist()]
    return np.flatnonzero(hit)
