"""Suffix sorting by external induced sorting: work goes through disk-backed priority queues by first token.

A suffix is of type S if it is less than the one after it, else L; S* suffixes are those of type S after one of type L.
The S* substrings are named in order; where names repeat, the string of names is sorted by the same method, recursively.
The sorted S* suffixes induce the L suffixes in one ascending pass, and these induce the S suffixes in one descending pass.

A pass goes through ranges of first tokens of about `block` suffixes. A queue keeps the tuples (token, order of the inducing
suffix, position) by range, and moves what is over `memory` tuples to files in a folder. All tuples of a range are taken
together: those that are induced within it are added in waves, and one sort with pointer doubling along the chains
of induction puts them in order, so a pass has no step for a single suffix.

Common-prefix values go the same way: neighbours that were induced by two suffixes share one token more than the least
value between those two, S* neighbours as many tokens as their common names cover and what the next names share, and where the
L and the S suffixes of a token meet, the shorter run of it counts. Values are capped, and take a byte each.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow.fs as fs

BLOCK = 1 << 22
MEMORY = 1 << 24
TUPLE = np.dtype([("token", "i8"), ("order", "i8"), ("at", "i8")])


class Queue:
    """Tuples by range, lowest or highest range first as its user asks; what exceeds memory is in files."""

    def __init__(self, folder: str | None, memory: int) -> None:
        self.folder, self.memory, self.held, self.count = folder, memory, {}, 0
        self.files: dict[int, list[str]] = {}
        self.fs, self.base = fs.FileSystem.from_uri(folder) if folder else (None, None)

    def push(self, range_: np.ndarray, token: np.ndarray, order: np.ndarray, at: np.ndarray) -> None:
        if not len(at):
            return
        t = np.empty(len(at), TUPLE)
        t["token"], t["order"], t["at"] = token, order, at
        by = np.argsort(range_, kind="stable")
        r, t = range_[by], t[by]
        cut = np.flatnonzero(np.r_[True, r[1:] != r[:-1], True])
        for lo, hi in zip(cut[:-1], cut[1:]):
            self.held.setdefault(int(r[lo]), []).append(t[lo:hi])
        self.count += len(at)
        if self.fs and self.count > self.memory:
            self.spill()

    def spill(self) -> None:
        for r, parts in self.held.items():
            name = f"{self.base}/queue-{uuid.uuid4().hex}"
            with self.fs.open_output_stream(name) as f:
                for p in parts:
                    f.write(p.tobytes())
            self.files.setdefault(r, []).append(name)
        self.held, self.count = {}, 0

    def pop(self, range_: int) -> np.ndarray:
        parts = []
        for name in self.files.pop(range_, []):
            with self.fs.open_input_stream(name) as f:
                parts.append(np.frombuffer(f.read(), TUPLE))
            self.fs.delete_file(name)
        here = self.held.pop(range_, [])
        self.count -= sum(map(len, here))
        parts += here
        return np.concatenate(parts) if parts else np.empty(0, TUPLE)


def types(t: np.ndarray) -> np.ndarray:
    """Which suffixes are of type S; the last one, a sentinel less than all, is."""
    n = len(t)
    less = t[:-1] < t[1:]
    differs = np.flatnonzero(t[:-1] != t[1:])
    s = np.ones(n, bool)
    # in a run of equal tokens the type is that of the run's last
    s[:-1] = less[differs[np.searchsorted(differs, np.arange(n - 1))]] if n > 1 else True
    return s


def _dense(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by (group, key) and, in it, where a new pair begins."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    return order, new


def names(t: np.ndarray, s: np.ndarray, star: np.ndarray) -> np.ndarray:
    """The rank of each S* substring among the distinct ones; tokens are compared with their types, L before S."""
    size = np.diff(np.append(star, star[-1])) + 1
    rank = np.zeros(len(star), np.int64)
    open_ = np.arange(len(star))
    depth = 0
    while len(open_):
        where = star[open_] + depth
        inside = depth < size[open_]
        where = np.minimum(where, len(t) - 1)
        key = np.where(inside, 2 * t[where] + s[where], -1)
        order, new = _dense(rank[open_], key)
        first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        alone = new & np.append(new[1:], True)
        # a group's new ranks begin at its old one, as many as there are members before
        old = rank[open_][order]
        begin = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], np.arange(len(order)), 0))
        rank[open_[order]] = old + first - begin
        go = ~alone & (depth < size[open_[order]])
        open_ = open_[order][go]
        depth += 1
    return rank


def chains(token: np.ndarray, kind: np.ndarray, fixed: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The order of a range's tuples by (token, kind, order of the parent).

    fixed is the order of a parent before the range, or -1 where the parent is in the range, and then parent is its place.
    """
    n = len(token)
    rank = np.empty(n, np.int64)
    order, new = _dense(token * 2 + kind, np.where(fixed >= 0, fixed, np.iinfo(np.int64).max))
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    up = np.where(fixed >= 0, np.arange(n), parent)
    tied = np.flatnonzero(fixed < 0)
    while len(tied):
        group, key = rank[tied], rank[up[tied]]
        order, new = _dense(group, key)
        old = group[order]
        begin = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], np.arange(len(order)), 0))
        first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        changed = old + first - begin
        nxt = up[up]
        rank = rank.copy()
        rank[tied[order]] = changed
        up = nxt
        alone = new & np.append(new[1:], True)
        tied = tied[order][~alone]
    return np.argsort(rank, kind="stable")


def _ranges(t: np.ndarray, block: int) -> np.ndarray:
    """The range of each token: neighbours in order together, about block suffixes a range."""
    count = np.bincount(t)
    return np.cumsum(count) // block


def _pass(t: np.ndarray, mine: np.ndarray, seeds: np.ndarray, range_of: np.ndarray, sign: int, folder: str | None, memory: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One pass: the suffixes that `mine` marks, induced, with the seeds in between, in order (ascending for sign 1, descending for -1); which are seeds; the place of each one's inducer, or of the seed among the seeds."""
    last = int(range_of.max())
    flip = (lambda x: x) if sign > 0 else (lambda x: last - x)
    queue, out, done = Queue(folder, memory), ([], [], []), 0
    seed_range = flip(range_of[t[seeds]])
    cut = np.searchsorted(seed_range, np.arange(last + 2))
    for r in range(last + 1):
        got = queue.pop(r)
        own = seeds[cut[r] : cut[r + 1]]
        wave = np.concatenate([got["at"], own])
        waves, parents, pushed = [wave], [np.full(len(wave), -1)], []
        total = 0
        while len(wave):
            place_of = np.flatnonzero(wave > 0)
            before = wave[place_of] - 1
            ok = mine[before]
            place_of, before = place_of[ok] + total, before[ok]
            to = flip(range_of[t[before]])
            away = to > r
            pushed.append((place_of[away], before[away], to[away]))
            total += len(wave)
            wave = before[~away]
            waves.append(wave)
            parents.append(place_of[~away])
        at, parent = np.concatenate(waves), np.concatenate(parents)
        inner = len(at) - len(got) - len(own)
        fixed = np.concatenate([got["order"], np.arange(len(own)), np.full(inner, -1)])
        kind = np.concatenate([np.zeros(len(got), np.int64), np.ones(len(own), np.int64), np.zeros(inner, np.int64)])
        if not len(at):
            continue
        token = t[at] if sign > 0 else (len(range_of) - t[at])
        order = chains(token, kind, fixed, parent)
        place = np.empty(len(at), np.int64)
        place[order] = np.arange(len(at)) + done
        for of, before, to in pushed:
            queue.push(to, t[before], place[of], before)
        by = np.where(parent >= 0, place[np.maximum(parent, 0)], fixed)
        by[len(got) : len(got) + len(own)] += cut[r]
        for part, values in zip(out, (at, kind, by)):
            part.append(values[order])
        done += len(at)
    return tuple(np.concatenate(x) for x in out)


class RangeLeast:
    """The least value of any range, by the least values of all ranges whose size is a power of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        while len(self.levels[-1]) > 1 << len(self.levels) - 1:
            v, step = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(v[:-step], v[step:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Over lo .. hi, both of them in it."""
        level = np.frexp((hi - lo + 1).astype(float))[1] - 1
        out = np.empty(len(lo), self.levels[0].dtype)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            v = self.levels[k]
            out[at] = np.minimum(v[lo[at]], v[hi[at] - (1 << int(k)) + 1])
        return out


def _run_lengths(t: np.ndarray) -> np.ndarray:
    """How often each suffix's first token stands at its beginning."""
    end = np.flatnonzero(np.append(t[1:] != t[:-1], True))
    return end[np.searchsorted(end, np.arange(len(t)))] - np.arange(len(t)) + 1


def _carried(t: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray], seed_values: np.ndarray, run: np.ndarray, most: int) -> np.ndarray:
    """The common-prefix value of each suffix of a pass with the one before it; seed_values has those of the seeds with the seed before."""
    at, kind, by = found
    values = np.zeros(len(at), np.uint8)
    same = np.zeros(len(at), bool)
    same[1:] = t[at[1:]] == t[at[:-1]]
    seeds = np.flatnonzero(same & (kind == 1) & np.append(False, kind[:-1] == 1))
    values[seeds] = seed_values[by[seeds]]
    seam = np.flatnonzero(same & np.append(False, kind[1:] != kind[:-1]))
    values[seam] = np.minimum(np.minimum(run[at[seam]], run[at[seam - 1]]), most)
    open_ = np.flatnonzero(same & (kind == 0) & np.append(False, kind[:-1] == 0))
    values[open_] = most
    lo, hi = by[open_ - 1] + 1, by[open_]
    while len(open_):  # from above: each round settles one more step of the chains of induction
        new = np.minimum(RangeLeast(values).of(lo, hi).astype(np.int64) + 1, most).astype(np.uint8)
        if (new == values[open_]).all():
            break
        values[open_] = new
    return values


def _compared(t: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    for d in range(most):
        x, y = a[live] + d, b[live] + d
        ok = (x < len(t)) & (y < len(t))
        live, x, y = live[ok], x[ok], y[ok]
        live = live[t[x] == t[y]]
        if not len(live):
            break
        out[live] = d + 1
    return out


def suffix_array(tokens: np.ndarray, folder: str | None = None, block: int = BLOCK, memory: int = MEMORY) -> np.ndarray:
    """The starts of all suffixes of tokens (0 or more each) in order; a suffix is less than a longer one that it begins. folder: a URI for the queues' files."""
    if len(tokens) < 2:
        return np.arange(len(tokens))
    _, number = np.unique(tokens, return_inverse=True)
    return _sorted(np.append(number + 1, 0), folder, block, memory, 0)[0][1:]


def suffix_array_lcp(tokens: np.ndarray, most: int, folder: str | None = None, block: int = BLOCK, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """suffix_array, and how many tokens each suffix has in common with the one before it, up to `most` (254 at most)."""
    if len(tokens) < 2:
        return np.arange(len(tokens)), np.zeros(len(tokens), np.uint8)
    _, number = np.unique(tokens, return_inverse=True)
    sa, lcp = _sorted(np.append(number + 1, 0), folder, block, memory, most)
    return sa[1:], np.append(np.uint8(0), lcp[2:])


def _sorted(t: np.ndarray, folder: str | None, block: int, memory: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    s = types(t)
    star = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if not len(star):
        sa = np.arange(len(t))[::-1].copy() if not s[:-1].any() else np.argsort(t, kind="stable")
        return sa, np.append(0, _compared(t, sa[:-1], sa[1:], most)).astype(np.uint8)
    name = names(t, s, star)
    ranks = np.unique(name, return_inverse=True)[1]
    if ranks.max() + 1 == len(star):
        order, common = np.argsort(name, kind="stable"), np.zeros(len(star), np.int64)
    else:
        order, common = _sorted(ranks, folder, block, memory, most)
    star_values = np.zeros(len(star), np.int64)
    if most:
        a, b, r = order[:-1], order[1:], common[1:].astype(np.int64)
        # r common names cover the tokens up to where the next ones begin; a capped r covers more than `most`
        after = np.minimum(a + r, len(star) - 1)
        covered = star[after] - star[a]
        rest = _compared(t, star[after], star[np.minimum(b + r, len(star) - 1)], most)
        star_values[1:] = np.minimum(np.where(r >= most, most, covered + rest), most)
    range_of = _ranges(t, block)
    low = _pass(t, ~s, star[order], range_of, 1, folder, memory)
    is_l = ~s[low[0]]
    run = _run_lengths(t) if most else t
    low_values = _carried(t, low, star_values.astype(np.uint8), run, most)[is_l] if most else None
    # descending: the L suffixes in between are the seeds, the sentinel comes last of all
    seeds = low[0][is_l][::-1].copy()
    high = _pass(t, np.append(s[:-1], False), seeds, range_of, -1, folder, memory)
    sa = np.append(high[0], len(t) - 1)[::-1].copy()
    if not most:
        return sa, np.zeros(0, np.uint8)
    # the value of a seed with the one before it, descending, is that of the one before with it, ascending
    values = _carried(t, high, np.append(np.uint8(0), low_values[::-1][:-1]), run, most)
    return sa, np.r_[np.zeros(2, np.uint8), values[:0:-1]]
