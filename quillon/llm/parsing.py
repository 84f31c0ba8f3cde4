"""Kernels of relative Lempel-Ziv parsing over words: hashes, anchors, longest matches and factors."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of the two rolling hashes over words, modulo 2**64.
WORD_BASE, OTHER_BASE = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15
#: Words of so many bytes are known by their hash.
SHORT = 16
#: The lowest i bytes of a number.
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps))
        _powers[base] = tuple(both)  # type: ignore[assignment]
    up, down = _powers[base]
    return up[:n], down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_ids(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each word [^\\x20\\x09-\\x0D]+ in its order: a word under SHORT bytes itself with its length, a longer one's XXH3."""
    size = len(data)
    if not size:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
    padded = np.frombuffer(data + bytes(16), dtype=np.uint8)
    b = padded[:size]
    inside = np.zeros(size + 2, dtype=np.int8)
    inside[1:-1] = (b != 32) & ((b < 9) | (b > 13))
    turns = np.diff(inside)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    eight = np.ndarray(size + 9, dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    n = ends - starts
    low = eight[starts] & MASKS[np.minimum(n, 8)]
    high = eight[starts + 8] & MASKS[np.clip(n - 8, 0, 7)] | (n.astype(np.uint64) << np.uint64(56))
    for i in np.flatnonzero(n >= SHORT).tolist():
        low[i], high[i] = np.frombuffer(xxhash.xxh3_128_digest(data[starts[i] : ends[i]]), dtype=np.uint64)
    return low, high


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two different hashes of each word's 128 bits."""
    low, high = word_ids(data)
    return mixed(low + mixed(high)), mixed(high + mixed(low ^ np.uint64(WORD_BASE)))


def gram_hashes(words: np.ndarray, k: int, base: int = WORD_BASE) -> np.ndarray:
    """A hash of each run of k words, from the words' hashes."""
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    up, down = powers(base, len(words))
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up, out=sums[1:])
    return mixed((sums[k:] - sums[:-k])[:n] * down[:n])


def window_anchors(words: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a document: value, first window and number of windows.

    A window's anchor is the least hash among its runs of k words, the first one of several, so equal windows have
    equal anchors. Neighbouring windows with one anchor at one place make one row: each window is in one row, and
    windows of one row are at different distances from the anchor, so none of them are equal."""
    low = gram_hashes(words, k)
    span = window - k + 1
    if len(low) < span:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    at, size = np.arange(len(low)), 1
    while size < span:
        step = min(size, span - size)
        later = low[step:] < low[:-step]
        low, at = np.where(later, low[step:], low[:-step]), np.where(later, at[step:], at[:-step])
        size += step
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return low[first], first, np.diff(np.append(first, len(low)))


def longest_matches(ids: np.ndarray, depth: int) -> np.ndarray:
    """For each place the longest run that also starts at another place, up to `depth` or more; ids under 0 match nothing else.

    Suffixes are ordered by doubling ranks; the longest match of a suffix is with a neighbour in that order."""
    n = len(ids)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    ranks, size = [rank], 1
    while size <= depth:
        behind = np.full(n, -1, dtype=np.int64)
        behind[:-size] = rank[size:]
        key = rank * (n + 1) + behind + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank, size = new, size * 2
        ranks.append(rank)
        if size >= n:
            break
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    same = np.zeros(n - 1, dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        step = 1 << level
        inside = (a + step <= n) & (b + step <= n)
        at = np.flatnonzero(inside)
        hit = at[ranks[level][a[at]] == ranks[level][b[at]]]
        same[hit] += step
        a[hit] += step
        b[hit] += step
    out = np.zeros(n, dtype=np.int64)
    np.maximum.at(out, order[:-1], same)
    np.maximum.at(out, order[1:], same)
    return out


def factors(longest: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The greedy parse's duplicate spans, as (first, past the last).

    Each factor is the longest match at its place (or one word), the next starts at its end. A factor of at least `least`
    words is a span. At its end the places inside the factor are checked for matches of that length that cross the
    boundary; they all hold the boundary, so they make one span from the first of them to where the last ends."""
    reach = [i + n if n >= least else 0 for i, n in enumerate(longest.tolist())]
    sizes = longest.tolist()
    out: list[tuple[int, int]] = []
    at = covered = 0
    while at < len(sizes):
        end = at + max(1, sizes[at])
        if reach[at] > covered:
            out.append((at, end))
            covered = end
        crossing = [i for i in range(at + 1, min(end, len(sizes))) if reach[i] > max(end, covered)]
        if crossing:
            covered = max(reach[i] for i in crossing)
            out.append((crossing[0], covered))
        at = end
    return out
