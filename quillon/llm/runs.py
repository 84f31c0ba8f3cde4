"""Kernels of periodic run detection: LZ factors from a suffix automaton, Main's search at their boundaries, copied runs.

A run is (start, end, period): a stretch of at least two periods (here: of least(period) members) that keeps its smallest
period and can't be extended. Positions are places in a list of integer codes."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Sequence

import numpy as np


def factors(codes: Sequence[int]) -> list[tuple[int, int, int]]:
    """(start, end, source) of each LZ factor: the longest stretch from start that also begins before it, at source (it may
    overlap itself), or one new member with source -1.

    The automaton of all suffixes knows for each state where its stretches end first; walking from the root stays at stretches
    that have begun before as long as that end allows it. States with one way out keep it in two lists, others in a table."""
    n = len(codes)
    length, link, first, only, target = [0], [-1], [-1], [-1], [-1]
    more: dict[int, dict[int, int]] = {}
    last = 0
    for i, c in enumerate(codes):
        new = len(length)
        length.append(i + 1)
        link.append(0)
        first.append(i)
        only.append(-1)
        target.append(-1)
        p, q = last, -1
        while p >= 0:
            o = only[p]
            if o == -1:
                only[p], target[p] = c, new
            elif o == -2:
                ways = more[p]
                q = ways.get(c, -1)
                if q >= 0:
                    break
                ways[c] = new
            elif o == c:
                q = target[p]
                break
            else:
                more[p] = {o: target[p], c: new}
                only[p] = -2
            p = link[p]
        if p >= 0:
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                first.append(first[q])
                only.append(only[q])
                target.append(target[q])
                if only[q] == -2:
                    more[twin] = dict(more[q])
                while p >= 0:
                    if only[p] == -2:
                        if more[p].get(c) != q:
                            break
                        more[p][c] = twin
                    elif only[p] == c and target[p] == q:
                        target[p] = twin
                    else:
                        break
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    out = []
    at = 0
    while at < n:
        state, size = 0, 0
        while at + size < n:
            c = codes[at + size]
            o = only[state]
            to = more[state].get(c, -1) if o == -2 else target[state] if o == c else -1
            if to < 0 or first[to] - size >= at:
                break
            state, size = to, size + 1
        if size:
            out.append((at, at + size, first[state] - size + 1))
            at += size
        else:
            out.append((at, at + 1, -1))
            at += 1
    return out


def prefixes(a: Sequence[int]) -> list[int]:
    """For each place of a, how far the stretch from there agrees with the beginning of a."""
    n = len(a)
    out = [0] * n
    if n:
        out[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = out[i - left]
            if k < right - i:
                out[i] = k
                continue
            k = right - i
        while i + k < n and a[k] == a[i + k]:
            k += 1
        out[i] = k
        left, right = i, i + k
    return out


def at_boundary(codes: Sequence[int], before: int, s: int, end: int, least: Callable[[int], int], exponent: float) -> list[tuple[int, int, int]]:
    """Runs that hold the members on both sides of s or start at s, and end by `end`; and those within before..s that end at s.

    before..s and s..end are factors. A run that held all of the left factor and the member after it, and began a period
    before that factor, would make the factor longer; so runs begin less than a period before `before`, which bounds the period."""
    n = len(codes)
    most = int((end - before) / (exponent - 1)) + 1
    low = max(0, before - most)
    stop = min(n, end + 1)
    right = list(codes[s:stop])
    left = list(codes[low:s])
    left.reverse()
    m, r = len(left), len(right)
    # agreement to the right of s with what is q before s, and q after s; to the left of s with the same
    on = prefixes([*right, -1, *codes[low:stop]])
    after = on[:r]
    behind = on[r + 1 :]
    back = prefixes(left)
    ahead = prefixes([*left, -1, *reversed(right), *left])[m + 1 :]
    found: dict[tuple[int, int], int] = {}
    for q in range(1, min(most, max(m, r)) + 1):
        if q <= m:
            f = s + min(behind[m - q], r)
            b = s - q - (back[q] if q < m else 0)
            if f <= end and f - b >= least(q) and (f > s or b > before) and found.get((b, f), q) >= q:
                found[b, f] = q
        if q <= r:
            f = s + q + (after[q] if q < r else 0)
            b = s - (ahead[r - q] if r - q < len(ahead) else 0)
            if f <= end and f - b >= least(q) and found.get((b, f), q) >= q:
                found[b, f] = q
    return [(b, f, q) for (b, f), q in found.items()]


def runs(codes: Sequence[int], least: Callable[[int], int], exponent: float = 2.0) -> list[tuple[int, int, int]]:
    """All runs of at least least(period) members, by start; least(q) must be at least exponent * q, the exponent at least 2."""
    n = len(codes)
    parts = factors(codes)
    # each run that is not strictly within one factor, at the last boundary that it meets
    touching: dict[tuple[int, int], int] = {}
    for k, (s, e, _) in enumerate(parts):
        if k:
            for b, f, q in at_boundary(codes, parts[k - 1][0], s, e, least, exponent):
                touching[b, f] = min(q, touching.get((b, f), q))
    if parts:
        s, e, _ = parts[-1]
        for b, f, q in at_boundary(codes, s, n, n, least, exponent):
            touching[b, f] = min(q, touching.get((b, f), q))
    own = sorted((b, f, q) for (b, f), q in touching.items())
    # runs strictly within a factor are those of its earlier occurrence, moved; a source run always starts before its copy
    out: list[tuple[int, int, int]] = []
    starts: list[int] = []
    j = 0
    for s, e, source in parts:
        i = bisect_right(starts, source)
        while True:
            while source >= 0 and i < len(out) and out[i][1] + s - source >= e and out[i][0] + s - source < e:
                i += 1
            copied = source >= 0 and i < len(out) and out[i][0] + s - source < e
            if j < len(own) and own[j][0] < e and (not copied or own[j][0] <= out[i][0] + s - source):
                out.append(own[j])
                j += 1
            elif copied:
                b, f, q = out[i]
                out.append((b + s - source, f + s - source, q))
                i += 1
            else:
                break
            starts.append(out[-1][0])
    return sorted(out)


def width(shortest: int, exponent: float) -> int:
    """So many members from any place of a run of at least max(shortest, exponent * period), some stretch of that width over
    the place occurs a period before or after it, within the run: the least of its length - 2 * period + 1, over all periods."""
    if exponent <= 2:
        return 1
    return max(1, min(max(shortest, int(np.ceil(exponent * q))) - 2 * q + 1 for q in range(1, shortest + 2)))


def stretches(codes: np.ndarray, size: int) -> list[tuple[int, int]]:
    """The maximal stretches covered by places whose `size` members, by a hash, occur again: no run lies outside them or across two."""
    n = len(codes) - size + 1
    if n < 2:
        return []
    mixed = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        mixed = (mixed ^ codes[i : i + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    again = np.zeros(n, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    turns = np.zeros(len(codes) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(turns, at, 1)
    np.add.at(turns, at + size, -1)
    covered = np.concatenate([[False], np.cumsum(turns[:-1]) > 0, [False]]).astype(np.int8)
    edges = np.diff(covered)
    return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))
