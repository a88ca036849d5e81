"""Suffix arrays of token arrays in memory."""

from __future__ import annotations

import numpy as np


def joined(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense token numbers of several texts in one array, and the distinct hashes that they stand for.

    Numbers start after those of the separators: one, different from all others, follows each text.
    """
    distinct, number = np.unique(h, return_inverse=True)
    n = len(rows) - 1
    out = np.empty(len(h) + n, np.int64)
    place = np.arange(len(h)) + np.repeat(np.arange(n), np.diff(rows))
    out[place] = number + n
    out[rows[1:] + np.arange(n)] = np.arange(n)
    return out, distinct


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """The starts of all suffixes in order; a suffix is less than any longer one that it begins. Prefix doubling, only within groups that aren't told apart yet."""
    n = len(tokens)
    if n < 2:
        return np.arange(n)
    wide = np.int64(tokens.max()) + 2
    if wide < 1 << 31:
        sa = np.argsort((tokens.astype(np.int64) + 1) * wide + np.append(tokens[1:].astype(np.int64) + 1, 0), kind="stable")
        pair = (tokens[sa], np.where(sa + 1 < n, tokens[np.minimum(sa + 1, n - 1)], -1))
        h = 2
    else:
        sa = np.argsort(tokens, kind="stable")
        pair, h = (tokens[sa], np.zeros(n, np.int64)), 1
    new = np.ones(n, bool)
    new[1:] = (pair[0][1:] != pair[0][:-1]) | (pair[1][1:] != pair[1][:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = first
    at = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in sa whose group has others
    while len(at):
        s, group = sa[at], first[at]
        nxt = s + h
        key = np.where(nxt < n, rank[np.minimum(nxt, n - 1)], -1)
        order = np.lexsort((key, group))
        s, group, key = s[order], group[order], key[order]
        sa[at] = s
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        first_here = at[lead]
        rank[s] = first_here
        open_ = ~(new & np.append(new[1:], True))
        first[at] = first_here
        at = at[open_]
        h *= 2
    return sa


def narrow(tokens: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int | np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of each interval of sa whose suffixes have this token at this depth, by two binary searches."""
    n = len(tokens)
    depth = np.broadcast_to(depth, lo.shape)

    def bisect(a: np.ndarray, b: np.ndarray, d: np.ndarray, t: np.ndarray, right: bool) -> np.ndarray:
        out = a.copy()
        live = np.flatnonzero(a < b)
        a, b, d, t = a[live], b[live], d[live], t[live]
        while len(live):
            mid = (a + b) // 2
            at = sa[mid] + d
            value = np.where(at < n, tokens[np.minimum(at, n - 1)], -1)
            up = (value <= t) if right else (value < t)
            a, b = np.where(up, mid + 1, a), np.where(up, b, mid)
            out[live] = a
            go = np.flatnonzero(a < b)
            if len(go) < len(live):
                live, a, b, d, t = live[go], a[go], b[go], d[go], t[go]
        return out

    first = bisect(lo, hi, depth, token, False)
    last = first.copy()
    some = np.flatnonzero(first < hi)
    at = sa[first[some]] + depth[some]
    some = some[(at < n) & (tokens[np.minimum(at, n - 1)] == token[some])]
    last[some] = bisect(first[some], hi[some], depth[some], token[some], True)
    return first, last
