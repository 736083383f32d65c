"""Suffix arrays of byte strings by induced sorting, vectorised bucket by bucket.

Suffixes are classified as smaller (S) or larger (L) than their successor.  The leftmost S suffixes
(LMS) are sorted first: their substrings by one round of induction, then, where substrings are
equal, the string of their names recursively.  Two linear passes induce the order of all suffixes.  Within a
bucket of one byte the passes go in waves: a wave is what the wave before has placed in the same bucket,
so each numpy step handles as many suffixes as the text's structure allows.

A reduced string of more distinct names than ``SMALL`` is ordered by doubling ranks instead of by
induction, as waves over so many small buckets would be no vectors any more.
"""

from __future__ import annotations

import numpy as np

from orrery.llm import bytesops as B

SMALL = 512


def classify(t: np.ndarray) -> np.ndarray:
    """True where the suffix is of type S; the last one is L (what follows the end is smallest)."""
    n = len(t)
    s = np.zeros(n, bool)
    if n < 2:
        return s
    differs = t[:-1] != t[1:]
    nxt = np.where(differs, np.arange(n - 1), n - 1)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]  # the next place where neighbours differ
    inside = nxt < n - 1
    s[:-1][inside] = t[nxt[inside]] < t[nxt[inside] + 1]
    return s


def lms_positions(s: np.ndarray) -> np.ndarray:
    return np.flatnonzero(s[1:] & ~s[:-1]) + 1


def _place(sa, at, c, v, forward):
    """Put the suffixes v of first symbols c at their buckets' running heads (tails), keeping their order."""
    order = np.argsort(c, kind="stable")
    c, v = c[order], v[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    size = np.diff(np.append(first, len(c)))
    rank = np.arange(len(c)) - np.repeat(first, size)
    sa[at[c] + rank if forward else at[c] - rank] = v
    at[c[first]] += size if forward else -size


def induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array, given the LMS suffixes in order (or, for sorting LMS substrings, in any order)."""
    n = len(t)
    ti = t.astype(np.uint8 if sigma <= 1 << 8 else np.uint16 if sigma <= 1 << 16 else np.int64)  # small symbols are sorted by radix
    where = np.int32 if n < 1 << 31 else np.int64
    lms = lms.astype(where)
    count = np.bincount(ti, minlength=sigma)
    end = np.cumsum(count)
    start = end - count
    n_large = np.bincount(ti[~s], minlength=sigma)
    n_lms = np.bincount(ti[lms], minlength=sigma)
    by_char = np.split(lms[np.argsort(ti[lms], kind="stable")], np.cumsum(n_lms)[:-1])
    used = np.flatnonzero(count)
    sa = np.full(n, -1, where)
    head = start.copy()
    large = ~s

    def push_large(v):
        v = v[v > 0] - 1
        v = v[large[v]]
        if len(v):
            _place(sa, head, ti[v], v, True)

    push_large(np.array([n], where))
    for c in used:
        done = start[c]
        while done < head[c]:
            upto = head[c]
            push_large(sa[done:upto])
            done = upto
        if n_lms[c]:
            push_large(by_char[c])
    tail = end - 1

    def push_small(v):
        v = v[v > 0] - 1
        v = v[s[v]]
        if len(v):
            _place(sa, tail, ti[v], v, False)

    for c in used[::-1]:
        done = end[c] - 1
        while done > tail[c]:
            upto = tail[c]
            push_small(sa[upto + 1 : done + 1][::-1])
            done = upto
        if n_large[c]:
            push_small(sa[start[c] : start[c] + n_large[c]][::-1])
    return sa


def _names(t: np.ndarray, lms: np.ndarray, in_order: np.ndarray) -> np.ndarray:
    """Rank of each LMS substring (both ends included), by position; equal substrings share a name."""
    stop = np.append(lms[1:] + 1, len(t))
    if t.dtype == np.uint8:
        h = B.span_hashes(B.prefix_sums(t), lms, stop)
    else:
        mixed = B.mix(t.astype(np.uint64) + np.uint64(1))
        p, q = B.powers(len(t) + 1)
        sums = np.zeros(len(t) + 1, np.uint64)
        np.cumsum(mixed * p[: len(t)], out=sums[1:])
        h = B.mix((sums[stop] - sums[lms]) * q[lms] + (stop - lms).astype(np.uint64))
    h[-1] ^= np.uint64(1)  # the last one runs into the end and equals no other
    number = np.empty(len(t), np.int32 if len(t) < 1 << 31 else np.int64)
    number[lms] = np.arange(len(lms))
    where = number[in_order]
    hs = h[where]
    names = np.empty(len(lms), np.int64)
    names[where] = np.concatenate([[0], np.cumsum(hs[1:] != hs[:-1])])
    return names


def _double(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, by doubling."""
    n = len(names)
    rank, h = names.astype(np.int64), 1
    while True:
        key = rank * (n + 1)
        key[: n - h] += rank[h:] + 1
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order
        h *= 2
        if h >= n:
            return order


def suffix_array(t: np.ndarray, sigma: int = 256) -> np.ndarray:
    """Start positions of the suffixes in order."""
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    s = classify(t)
    lms = lms_positions(s)
    if len(lms):
        rough = induce(t, s, lms, sigma)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        in_order = rough[is_lms[rough]]
        names = _names(t, lms, in_order)
        distinct = int(names.max()) + 1
        if distinct < len(lms):
            order = suffix_array(names, distinct) if distinct <= SMALL else _double(names)
            in_order = lms[order]
        lms = in_order
    return induce(t, s, lms, sigma)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, length: int, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each usable position in text order: its predecessor in the suffix array (phi), and whether the
    common prefix of both reaches ``length``; bytes are compared where hashes agree."""
    phi = np.full(len(t), -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    reach = np.zeros(len(t), bool)
    pos = np.flatnonzero(usable & (phi >= 0))
    pos = pos[usable[phi[pos]]]
    sums = B.prefix_sums(t)
    same = B.span_hashes(sums, pos, pos + length) == B.span_hashes(sums, phi[pos], phi[pos] + length)
    pos = pos[same]
    view = np.lib.stride_tricks.sliding_window_view(t, length) if len(t) >= length else None
    for i in range(0, len(pos), 1 << 15):
        p = pos[i : i + (1 << 15)]
        reach[p] = (view[p] == view[phi[p]]).all(1)
    return phi, reach
