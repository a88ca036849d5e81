"""Segmentation lattices over batches of sentences, in numpy.

All sentences of a batch lie in one array of code points, the longest first, and a dynamic program advances all of them by
one code point a step. Spans are looked up in the vocabulary by hashes of code point ranges, all at once.

A text of more than `LONG` code points is cut into chunks that advance side by side: a first pass finds how each chunk
carries the scores of the places before it to those at its end, these matrices are applied one after the other, and a second pass
fills the places in. So a long text takes some `CHUNK` steps and not one for each code point.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

NEVER = -(1 << 60)
FIXED = 1 << 24  # steps of a unigram log probability in the best path's sums, so that they don't hang on the order of addition
LONG, CHUNK, BATCH = 1024, 256, 400_000
FEW = 12  # sentences that are walked one by one
STEPS = 1 << 14  # characters of texts whose expected uses are found a character a step
BOS, EOS = 250, 251
BOS_ID = 0xFFFE  # stands before the first word in a model's bigrams
MODES = ("ascii", "utf8len", "ranges", "compat")
LOSSLESS_WS = 1
OTHER, SPACE, DIGIT, ALPHA, HIRAGANA, KATAKANA, KANJI, FULLWIDTH, SYMBOL = range(9)

_MULT = np.uint64(0xD6E8FEB86659FD93)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_tables = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(which: str, n: int) -> np.ndarray:
    t, base = _tables[which], _MULT if which == "up" else _INV
    while len(t) < n:
        t = np.concatenate([t, t * (t[-1:] * base)])
    _tables[which] = t
    return t[:n]


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xE9846AF9B1A615D)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xE9846AF9B1A615D)
    return x ^ (x >> np.uint64(28))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts and the texts' offsets into them."""
    size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.r_[0, np.cumsum(size)]


def classes(points: np.ndarray, mode: str = "compat", ranges: tuple = (), fallback: str = "utf8len") -> np.ndarray:
    """The character class of each code point; ranges have lo, hi and class_id."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r}: one of {', '.join(MODES)}")
    out = np.full(len(points), OTHER, np.uint8)
    if mode == "utf8len" or mode == "ranges" and fallback == "utf8len":
        out[:] = np.where(points < 0x800, 9, np.where(points < 0x10000, 10, 11))
    if mode == "compat":
        given = ((0x3040, 0x309F, HIRAGANA), (0x30A0, 0x30FF, KATAKANA), (0x4E00, 0x9FFF, KANJI), (0xFF00, 0xFFEF, FULLWIDTH))
    else:
        given = tuple((r.lo, r.hi, r.class_id) for r in ranges if r.class_id) if mode == "ranges" else ()
    for lo, hi, c in given:
        out[(points >= lo) & (points <= hi)] = c
    out[points <= 0x7F] = SYMBOL
    for lo, hi, c in ((0x30, 0x39, DIGIT), (0x41, 0x5A, ALPHA), (0x61, 0x7A, ALPHA), (0x2580, 0x2584, SPACE)):
        out[(points >= lo) & (points <= hi)] = c
    out[np.isin(points, (32, 9, 10, 13))] = SPACE
    return out


class SpanHash:
    """Hashes of ranges of an array of code points."""

    def __init__(self, points: np.ndarray) -> None:
        n = len(points)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(scrambled(points.astype(np.uint64) + np.uint64(1)) * _powers("up", n), out=self.sums[1:])
        self.down = _powers("down", n + 1)

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return scrambled((self.sums[start + size] - self.sums[start]) * self.down[start] + np.asarray(size).astype(np.uint64))


class PieceTable:
    """Ids of pieces; -1 where there is none. Small vocabularies are a table of transitions by character, others are found by the hash of code points."""

    DENSE = 1 << 22  # transitions of the table at most

    def __init__(self, pieces: list[str]) -> None:
        points, offs = code_points(pieces)
        keys = SpanHash(points).of(offs[:-1], np.diff(offs))
        self.bits = max(4, (4 * max(1, len(pieces))).bit_length())
        self.keys, self.ids = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int64)
        at, todo = self._slot(keys), np.arange(len(pieces))
        while len(todo):
            free = self.ids[at] < 0
            self.ids[at[free]], self.keys[at[free]] = todo[free], keys[todo[free]]
            left = self.ids[at] != todo
            at, todo = (at[left] + 1) & (len(self.ids) - 1), todo[left]
        self._trie = None
        letters = np.unique(points)
        if (len(points) + 2) * (len(letters) + 1) <= self.DENSE:
            self._trie = self._transitions(pieces, letters)

    @staticmethod
    def _transitions(pieces: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Numbers of code points, 0 for those of no piece; the state after each state and number, flat; and states' ids. State 0 leads nowhere, 1 is the beginning."""
        number = np.zeros(0x110000, np.uint16)
        number[letters] = np.arange(1, len(letters) + 1)
        of = {chr(c): k for k, c in enumerate(letters.tolist(), 1)}
        wide, states, ids = len(letters) + 1, {}, [-1, -1]
        for k, piece in enumerate(pieces):
            at = 1
            for ch in piece:
                key = at * wide + of[ch]
                if key not in states:
                    states[key] = len(ids)
                    ids.append(-1)
                at = states[key]
            ids[at] = k
        there = np.zeros(len(ids) * wide, np.int64)
        there[list(states)] = list(states.values())
        return number, there, np.array(ids, np.int32), wide

    def spans(self, lat: Lattice) -> np.ndarray:
        """The id of the span of each length up to the lattice's that ends at each place."""
        out = np.full((lat.max_len, lat.places), -1, np.int32)
        if self._trie is None:
            hashes = SpanHash(lat.points)
            for k in range(1, lat.max_len + 1):
                ok = np.flatnonzero(lat.pos >= k)
                out[k - 1, ok] = self.find(hashes.of(lat.end[ok] - k, k))
            return out
        number, there, ids, wide = self._trie
        ch = np.zeros(lat.places, np.int64)  # a text's end has the number of no piece's character
        ch[np.arange(len(lat.points)) + np.repeat(np.arange(len(lat.size)), lat.size)] = number.take(lat.points)
        state = np.ones(lat.places, np.int64)
        for k in range(1, min(lat.max_len, lat.places - 1) + 1):
            state = there.take(state[: lat.places - k + 1] * wide + ch[k - 1 :])
            out[k - 1, k:] = ids.take(state[:-1])
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.ids[at], -1)
        go = np.flatnonzero((self.keys[at] != keys) & (self.ids[at] >= 0))
        at = at[go]
        while len(go):
            at = (at + 1) & (len(self.ids) - 1)
            hit = (self.keys[at] == keys[go]) & (self.ids[at] >= 0)
            out[go[hit]] = self.ids[at[hit]]
            more = ~hit & (self.ids[at] >= 0)
            go, at = go[more], at[more]
        return out


def emission_table(weights: dict[int, int], codes: list[int]) -> np.ndarray:
    """(label, prev, cur, next) -> sum of the five templates' Q8.8 weights, clamped to 16 bits, by the places of classes in codes."""
    w = lambda t, y, a, b=0: weights.get(t << 24 | y << 16 | a << 8 | b, 0)
    n = len(codes)
    out = np.zeros((2, n, n, n), np.int64)
    for y in (0, 1):
        cur = np.array([w(0, y, c) for c in codes])
        prev = np.array([w(1, y, c) for c in codes])
        nxt = np.array([w(2, y, c) for c in codes])
        pc = np.array([[w(3, y, a, b) for b in codes] for a in codes])
        cn = np.array([[w(4, y, a, b) for b in codes] for a in codes])
        out[y] = cur[None, :, None] + prev[:, None, None] + nxt[None, None, :] + pc[:, :, None] + cn[None, :, :]
    return np.clip(out, -32768, 32767)


@dataclass
class Model:
    """A joint model: pieces with Q8.8 unigram scores, CRF weights and scalars; bigrams (previous id or BOS_ID, id) -> score may be empty.

    cc_mode, cc_ranges and cc_fallback say what classes characters have; flags are those of the model file.
    """

    pieces: list[str]
    logp_q: np.ndarray
    crf: dict[int, int] = field(default_factory=dict)
    max_len: int = 8
    lambda0: int = 256
    unk_base: int = -1280
    unk_per_cp: int = -256
    trans00: int = 51
    trans01: int = -102
    trans10: int = 0
    trans11: int = -154
    bos_to1: int = 128
    bigrams: dict[tuple[int, int], int] = field(default_factory=dict)
    logp: np.ndarray | None = None  # natural logarithms, where the model was trained here
    flags: int = 0
    cc_mode: str = "compat"
    cc_fallback: str = "utf8len"
    cc_ranges: tuple = ()

    def __post_init__(self) -> None:
        self._table = self._emit = self._pairs = self._number = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_table": None, "_emit": None, "_pairs": None, "_number": None}

    @property
    def lossless_ws(self) -> bool:
        return bool(self.flags & LOSSLESS_WS)

    @property
    def codes(self) -> list[int]:
        """The classes that characters may have, then those of the text's ends."""
        return [*range(12), *sorted({r.class_id for r in self.cc_ranges if r.class_id > 11}), BOS, EOS]

    @property
    def number(self) -> np.ndarray:
        """The place in codes of each code point's class."""
        if self._number is None:
            number = np.zeros(256, np.int64)
            number[self.codes[:-2]] = np.arange(len(self.codes) - 2)
            self._number = number[classes(np.arange(0x110000, dtype=np.uint32), self.cc_mode, self.cc_ranges, self.cc_fallback)].astype(np.int16)
        return self._number

    @property
    def table(self) -> PieceTable:
        if self._table is None:
            self._table = PieceTable(self.pieces)
        return self._table

    @property
    def emit(self) -> np.ndarray:
        if self._emit is None:
            self._emit = emission_table(self.crf, self.codes)
        return self._emit

    @property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The bigrams' keys in order and their scores; in a key the text's beginning has the number after the last piece."""
        if self._pairs is None:
            n = len(self.pieces) + 1
            both = sorted(((n - 1 if a == BOS_ID else a) * n + b, q) for (a, b), q in self.bigrams.items())
            self._pairs = np.array([k for k, _ in both], np.int64), np.array([q for _, q in both], np.int64)
        return self._pairs


class Lattice:
    """The spans of a batch of sentences, longest sentence first; ids[k - 1] has the piece of length k that ends before each place.

    The sentences are strings, or their code points and offsets.
    """

    def __init__(self, texts: list[str] | tuple[np.ndarray, np.ndarray], table: PieceTable, max_len: int) -> None:
        points, offs = texts if isinstance(texts, tuple) else code_points(texts)
        self.order = np.argsort(-np.diff(offs), kind="stable")
        self.size = np.diff(offs)[self.order]
        self.offs = np.r_[0, np.cumsum(self.size)].astype(np.int64)
        n, rows, self.max_len = len(points), len(self.size), max_len
        self.points = points[np.arange(n) + np.repeat(offs[:-1][self.order] - self.offs[:-1], self.size)] if n else points
        # place p of sentence s is offs[s] + s + p, for p from 0 to its length
        self.base = self.offs[:-1] + np.arange(rows)
        self.places = n + rows
        self.row = np.repeat(np.arange(rows), self.size + 1)
        self.end = np.arange(self.places) - self.row  # code points before each place
        self.pos = self.end - np.repeat(self.offs[:-1], self.size + 1)
        self.ids = table.spans(self)

    def steps(self):
        """For p = 1, 2, ..: p and the places p of all sentences that reach it."""
        top = int(self.size.max(initial=0))
        alive = np.searchsorted(-self.size, -np.arange(top + 1), side="right")
        for p in range(1, top + 1):
            yield p, self.base[: alive[p]] + p

    def class_codes(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """prev, cur and next class of each code point, as places in the model's codes."""
        first, last = len(m.codes) - 2, len(m.codes) - 1
        cur = m.number.take(self.points).astype(np.int64)
        prev, nxt = np.r_[first, cur[:-1]][: len(cur)], np.r_[cur[1:], last][-len(cur) :] if len(cur) else cur
        some = self.size > 0
        prev[self.offs[:-1][some]] = first
        nxt[self.offs[1:][some] - 1] = last
        return prev, cur, nxt

    def joint_scores(self, m: Model) -> np.ndarray:
        """The score of the span of each length that ends at each place, in Q8.8."""
        prev, cur, nxt = self.class_codes(m)
        at = (prev * len(m.codes) + cur) * len(m.codes) + nxt
        e0, e1 = (m.emit[y].ravel().take(at) for y in (0, 1))
        sums = np.r_[0, np.cumsum(e0), 0]
        pref, own = sums.take(self.end), np.append(e1, 0).take(self.end)
        more = own - sums.take(self.end + 1)  # of a word that goes on after its first character
        out = np.full((self.max_len, self.places), NEVER, np.int64)
        for k in range(1, min(self.max_len, self.places - 1) + 1):
            seg = own[:-k] + m.trans11 if k == 1 else more[:-k] + pref[k:] + (m.trans10 + (k - 2) * m.trans00 + m.trans01)
            unknown = int(np.clip(m.unk_base + m.unk_per_cp * k, -32768, 32767))
            lm = m.lambda0 * np.append(np.asarray(m.logp_q, np.int64), unknown) >> 8 if len(m.logp_q) else None
            out[k - 1, k:] = seg + (m.lambda0 * unknown >> 8 if lm is None else lm.take(self.ids[k - 1, k:], mode="wrap"))
            np.putmask(out[k - 1], self.pos < k, NEVER)
        return out

    def lm_scores(self, logp: np.ndarray) -> np.ndarray:
        """The natural log probability of the dictionary span of each length at each place, -inf where there is none."""
        padded = np.append(logp, -np.inf)
        return padded[self.ids]

    def lm_fixed(self, logp: np.ndarray) -> np.ndarray:
        """lm_scores in steps of 1 / FIXED, NEVER where there is no piece."""
        padded = np.append(np.rint(logp * FIXED).astype(np.int64), NEVER)
        return padded[self.ids]

    def unsorted(self, rows: list) -> list:
        out = [None] * len(rows)
        for k, r in zip(self.order.tolist(), rows):
            out[k] = r
        return out

    def cut(self, lengths: np.ndarray) -> list[np.ndarray]:
        """Each sentence's boundaries, from the length of the last span at each place; in the order of the sorted sentences."""
        return self.split(self.marked(lengths))

    def marked(self, lengths: np.ndarray) -> np.ndarray:
        """Where each sentence's boundaries are, from the length of the last span at each place."""
        mark = np.zeros(self.places, bool)
        mark[self.base] = True
        some = self.size > 0
        at, base = (self.base + self.size)[some], self.base[some]
        while len(at) >= FEW:
            mark[at] = True
            at = at - lengths[at]
            go = at > base
            at, base = at[go], base[go]
        for end, begin in zip(at.tolist(), base.tolist()):
            back, p, out = lengths[begin : end + 1].tolist(), end - begin, []
            while p > 0:
                out.append(p)
                p -= back[p]
            mark[begin + np.array(out)] = True
        return mark

    def split(self, mark: np.ndarray) -> list[np.ndarray]:
        """The marked places of each sentence."""
        hits = np.flatnonzero(mark)
        return np.split(self.pos[hits], np.searchsorted(hits, self.base[1:])) if len(self.base) else []

    def reversed(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """scores as those of the sentences read backwards, and the place that each place then has."""
        there = 2 * self.base[self.row] + self.size[self.row] - np.arange(self.places)
        out = np.full_like(scores, -np.inf)
        for k in range(1, self.max_len + 1):
            ok = np.flatnonzero(self.pos >= k)
            out[k - 1, ok] = scores[k - 1, there[ok] + k]
        return out, there


def log_sum(each: np.ndarray) -> np.ndarray:
    """The logarithm of the sum of the exponentials along the first axis; each is overwritten."""
    top = np.maximum(each.max(axis=0), -1e300)
    each -= top
    np.exp(each, out=each)
    out = each.sum(axis=0)
    np.log(out, out=out)
    out += top
    return out


def by_step(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """The places of rows, longest first, in the order of steps; for each step from 1 on the number of rows that reach it and where its places begin."""
    top = int(size.max(initial=0))
    alive = np.searchsorted(-size, -np.arange(1, top + 1), side="right")
    offs = np.r_[0, np.cumsum(alive)]
    at = first[np.arange(offs[-1]) - np.repeat(offs[:-1], alive)] + np.repeat(np.arange(1, top + 1), alive)
    return at, alive.tolist(), offs.tolist()


@np.errstate(divide="ignore")
def forward(lat: Lattice, scores: np.ndarray, start: float, add=np.maximum, weights: np.ndarray | None = None) -> np.ndarray:
    """What `add` makes of the scores of all paths to each place: the best, or with logaddexp their sum.

    weights: is filled, with logaddexp, with the weights of the last spans of the paths to each place, by length; the greatest is 1.
    """
    never = NEVER if scores.dtype.kind == "i" else -np.inf
    best = np.full(lat.places, never, scores.dtype)
    best[lat.base] = start
    if int(lat.size.max(initial=0)) > LONG:
        _forward_in_chunks(lat, scores, best, never, add, weights)
    else:
        entry = np.full((lat.max_len, len(lat.base)), never, scores.dtype)
        entry[0] = start
        _forward(scores, best, lat.base, lat.size, entry, never, add, weights)
    return best


def _forward(scores: np.ndarray, best: np.ndarray, first: np.ndarray, size: np.ndarray, entry: np.ndarray, never: float, add, weights: np.ndarray | None) -> None:
    """Fills best in after the rows' first places; entry: the scores there and at the places before."""
    width, rows = entry.shape
    at, alive, offs = by_step(first, size)
    edge = [scores[k].take(at) for k in range(width)]
    run, more = np.empty(width * rows + len(at), scores.dtype), np.empty(rows, scores.dtype)
    run[: width * rows] = entry[::-1].ravel()
    begin = [j * rows for j in range(width)]  # of the last steps, in run
    if add is np.logaddexp:
        for n, lo in zip(alive, offs):
            each = np.empty((width, n))
            for k in range(width):
                b = begin[-1 - k]
                np.add(run[b : b + n], edge[k][lo : lo + n], out=each[k])
            run[width * rows + lo : width * rows + lo + n] = log_sum(each)
            for k in range(width if weights is not None else 0):
                edge[k][lo : lo + n] = each[k]  # not read any more
            begin = [*begin[1:], width * rows + lo]
        best[at] = run[width * rows :]
        for k in range(width if weights is not None else 0):
            weights[k, at] = edge[k]
        return
    for n, lo in zip(alive, offs):
        new, tmp = run[width * rows + lo : width * rows + lo + n], more[:n]
        np.add(run[begin[-1] : begin[-1] + n], edge[0][lo : lo + n], out=new)
        for k in range(1, width):
            b = begin[-1 - k]
            np.add(run[b : b + n], edge[k][lo : lo + n], out=tmp)
            add(new, tmp, out=new)
        if never == NEVER:
            np.maximum(new, never, out=new)
        begin = [*begin[1:], width * rows + lo]
    best[at] = run[width * rows :]


def _in_chunks(lat: Lattice, chunk: int) -> tuple[np.ndarray, ...]:
    """Of each chunk its text, number in it, first place and size; each text's first chunk and number of chunks; and the chunks that others come after."""
    count = np.maximum(-(-lat.size // chunk), 1)
    of = np.repeat(np.arange(len(count)), count)
    lead = np.cumsum(count) - count
    number = np.arange(len(of)) - lead[of]
    return of, number, lat.base[of] + number * chunk, np.minimum(lat.size[of] - number * chunk, chunk), lead, count, np.flatnonzero(number < count[of] - 1)


def _forward_in_chunks(lat: Lattice, scores: np.ndarray, best: np.ndarray, never: float, add, weights: np.ndarray | None) -> None:
    width, chunk = lat.max_len, max(CHUNK, lat.max_len)
    of, number, first, size, lead, count, inner = _in_chunks(lat, chunk)
    # how the places before a chunk, and its first, bear on its last ones; the last chunk of a text leads nowhere
    entry = np.full((width, len(of)), never, scores.dtype)  # of a chunk: the score at its first place and at those before
    entry[0, lead] = best[lat.base]
    if len(inner):
        edge = scores.take(first[inner] + np.arange(1, chunk + 1)[:, None], axis=1)
        ring = [np.full((width, len(inner)), never, scores.dtype) for _ in range(width)]
        for j in range(width):
            ring[-1 - j][j] = 0
        for t in range(chunk):
            if add is np.logaddexp:
                acc = log_sum(np.stack([ring[-1 - k] + edge[k, t] for k in range(width)]))
            else:
                acc = ring[-1] + edge[0, t]
                for k in range(1, width):
                    acc = add(acc, ring[-1 - k] + edge[k, t])
            ring = [*ring[1:], np.maximum(acc, never)]
        carry = np.stack(ring[::-1])  # place from a chunk's end, place before its begin, chunk
        where = np.full(len(of), -1)
        where[inner] = np.arange(len(inner))
        for c in range(int(count.max()) - 1):
            here = lead[count > c + 1] + c
            entry[:, here + 1] = np.maximum(add.reduce(carry[:, :, where[here]] + entry[:, here], axis=1), never)
    order = np.argsort(-size, kind="stable")
    _forward(scores, best, first[order], size[order], entry[:, order], never, add, weights)


def last_lengths(lat: Lattice, scores: np.ndarray, best: np.ndarray, longest_wins: bool = False) -> np.ndarray:
    """The length of the best path's last span at each place, 0 where no path leads: of equal ones the shortest, or the longest."""
    never = NEVER // 2 if scores.dtype.kind == "i" else -np.inf
    top, arg = np.full(lat.places, never, scores.dtype), np.zeros(lat.places, np.uint8 if lat.max_len < 256 else np.int64)
    for k in range(lat.max_len, 0, -1) if longest_wins else range(1, lat.max_len + 1):
        if k < lat.places:
            cand = best[:-k] + scores[k - 1, k:]
            more = cand > top[k:]
            np.copyto(top[k:], cand, where=more)
            arg[k:][more] = k
    return arg


def marked_path(lat: Lattice, scores: np.ndarray, start: float, longest_wins: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the boundaries of the best paths are, their scores, and which sentences have one; in the order of the sorted sentences."""
    best = forward(lat, scores, start)
    length = last_lengths(lat, scores, best, longest_wins)
    final = best[lat.base + lat.size]
    ok = final > NEVER // 2 if scores.dtype.kind == "i" else np.isfinite(final)
    return lat.marked(np.maximum(length, 1)), final, ok


def viterbi(lat: Lattice, scores: np.ndarray, start: float, longest_wins: bool = False) -> tuple[list[np.ndarray | None], np.ndarray]:
    """Boundaries and score of each sentence's best path, in the sentences' own order; None where no path covers it.

    At equal scores the shortest last span wins, or the longest.
    """
    mark, final, ok = marked_path(lat, scores, start, longest_wins)
    bounds = [b if good else None for b, good in zip(lat.split(mark), ok)]
    return lat.unsorted(bounds), np.array(lat.unsorted(final.tolist())) if len(final) else final


def _pair_gain(m: Model, prev: np.ndarray, cur: np.ndarray) -> np.ndarray:
    """What a bigram adds to a span's score that has the unigram's in it; 0 where the model has no such bigram."""
    keys, values = m.pairs
    if not len(keys):
        return np.zeros(len(cur), np.int64)
    key = prev.astype(np.int64) * (len(m.pieces) + 1) + cur
    where = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    hit = (keys[where] == key) & (prev >= 0) & (cur >= 0)
    uni = m.logp_q[np.maximum(cur, 0)].astype(np.int64) if len(m.logp_q) else 0
    return np.where(hit, (m.lambda0 * values[where] >> 8) - (m.lambda0 * uni >> 8), 0)


def _pair_edges(lat: Lattice, scores: np.ndarray, m: Model, p: int, k: int, at: np.ndarray):
    """(j, score) of the spans of length k that end at p, after each word length j that there may be before them, 0 for none."""
    cur = lat.ids[k - 1, at]
    if p == k:
        yield 0, scores[k - 1, at] + _pair_gain(m, np.full(len(at), len(m.pieces)), cur)
    for j in range(1, min(lat.max_len, p - k) + 1):
        yield j, scores[k - 1, at] + _pair_gain(m, lat.ids[j - 1, at - k], cur)


def _walk(lat: Lattice, s: int, step) -> np.ndarray:
    """Sentence s's boundaries, from its end: step(place) gives the place before."""
    at, out = int(lat.base[s] + lat.size[s]), []
    while at > lat.base[s]:
        out.append(at - int(lat.base[s]))
        at = step(at)
    return np.array([0, *out[::-1]])


def bigram_viterbi(lat: Lattice, scores: np.ndarray, m: Model) -> tuple[list[np.ndarray | None], np.ndarray]:
    """As viterbi over states (place, last length), for a model that has bigrams. Texts of any length advance by a code point a step."""
    L = lat.max_len
    best = np.full((L + 1, lat.places), NEVER, np.int64)
    back = np.zeros((L + 1, lat.places), np.uint8)
    best[0, lat.base] = m.bos_to1
    for p, at in lat.steps():
        for k in range(1, min(L, p) + 1):
            top, arg = np.full(len(at), NEVER, np.int64), np.zeros(len(at), np.uint8)
            for j, edge in _pair_edges(lat, scores, m, p, k, at):
                cand = best[j, at - k] + edge
                more = cand > top
                top, arg = np.where(more, cand, top), np.where(more, np.uint8(j), arg)
            best[k, at], back[k, at] = top, arg
    ends = lat.base + lat.size
    last = np.argmax(best[1:, ends], axis=0) + 1
    final = np.where(lat.size > 0, best[last, ends], m.bos_to1)
    bounds = []
    for s in range(len(ends)):
        k = int(last[s])

        def step(at: int) -> int:
            nonlocal k
            to, k = at - k, int(back[k, at])
            return to

        bounds.append(_walk(lat, s, step))
    return lat.unsorted(bounds), np.array(lat.unsorted(final.tolist()))


def _best_of(cand: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n greatest of each row of these arrays side by side, and their places; of equal ones the first."""
    both = np.concatenate(cand, axis=1)
    if both.shape[1] < n:
        both = np.concatenate([both, np.full((len(both), n - both.shape[1]), NEVER)], axis=1)
    order = np.argsort(-both, axis=1, kind="stable")[:, :n]
    return np.maximum(np.take_along_axis(both, order, 1), NEVER), order


class Lists:
    """Sorted lists of the n best scores, a column each, merged by compare and exchange. A score's low bits say where it comes from, so that of equal ones the shorter span's, then the better one's is first."""

    LEAST = -(1 << 48)  # scores of texts are above

    def __init__(self, n: int, width: int) -> None:
        self.n, self.width = 1 << (n - 1).bit_length(), 1 << (width - 1).bit_length()
        self.bits = (self.n * self.width - 1).bit_length()
        self.mask = np.int64((1 << self.bits) - 1)
        self.rank = np.arange(self.n - 1, -1, -1)
        self.never = np.int64(self.LEAST << self.bits)

    def edges(self, scores: np.ndarray) -> np.ndarray:
        """scores of spans by length, for next()."""
        out = np.maximum(scores, self.LEAST) << self.bits
        for k in range(len(out)):
            out[k] += (self.width - 1 - k) * self.n
        return out

    def packed(self, scores: np.ndarray) -> np.ndarray:
        """Lists of scores, n along the first axis, as they are kept."""
        return (np.maximum(scores, self.LEAST) << self.bits) + self.rank.reshape(-1, *[1] * (scores.ndim - 1))

    def next(self, ring: list[np.ndarray], edge: list[np.ndarray], m: int) -> tuple[np.ndarray, np.ndarray]:
        """The lists at places and where each score comes from; ring: the lists at the places before, last first, of which m columns count."""
        both = np.empty((self.width, *ring[0].shape[:-1], m), np.int64)
        for k, e in enumerate(edge):
            np.add(ring[k][..., :m], e, out=both[k])
        both[len(edge) :] = self.never
        while len(both) > 1:
            x = np.maximum(both[0::2], both[1::2, ::-1])
            half = self.n // 2
            while half:
                v = x.reshape(len(x), self.n // (2 * half), 2, half, *x.shape[2:])
                low = np.minimum(v[:, :, 0], v[:, :, 1])
                np.maximum(v[:, :, 0], v[:, :, 1], out=v[:, :, 0])
                v[:, :, 1] = low
                half //= 2
            both = x
        code = both[0] & self.mask
        out = np.maximum(both[0] - code, self.never) + self.rank.reshape(-1, *[1] * (code.ndim - 1))
        return out, code


def _nbest_lists(lat: Lattice, scores: np.ndarray, start: int, n: int) -> tuple[Lists, np.ndarray, np.ndarray]:
    """The final scores of each sentence, n along the first axis, and at each place where its n best come from. Texts beyond LONG are taken in chunks side by side, as in forward()."""
    lists, width = Lists(n, lat.max_len), lat.max_len
    codes = np.zeros((lists.n, lat.places), np.uint8 if lists.mask < 256 else np.uint16)
    edges = lists.edges(scores)
    chunk = max(CHUNK, width) if int(lat.size.max(initial=0)) > LONG else max(1, int(lat.size.max(initial=0)))
    of, number, first, size, lead, count, inner = _in_chunks(lat, chunk)
    entry = np.full((width, lists.n, len(of)), lists.LEAST, np.int64)
    entry[0, 0, lead] = start
    if len(inner):
        edge = edges.take(first[inner] + np.arange(1, chunk + 1)[:, None], axis=1)
        ring = [np.full((lists.n, width, len(inner)), lists.LEAST, np.int64) for _ in range(width)]
        for j in range(width):
            ring[j][0, j] = 0
        ring = [lists.packed(x) for x in ring]
        for t in range(chunk):
            ring = [lists.next(ring, edge[:, t], len(inner))[0], *ring[:-1]]
        carry = np.stack(ring) >> lists.bits  # place from a chunk's end, n, place before its begin, chunk
        where = np.full(len(of), -1)
        where[inner] = np.arange(len(inner))
        for c in range(int(count.max()) - 1):
            here = lead[count > c + 1] + c
            all_ = carry[:, :, None, :, where[here]] + entry[:, :, here].swapaxes(0, 1)  # place, n of the chunk, n of the entry, place before, text
            best = -np.sort(-all_.reshape(width, -1, len(here)), axis=1)[:, : lists.n]
            entry[:, :, here + 1] = np.maximum(best, lists.LEAST)
    order = np.argsort(-size, kind="stable")
    at, alive, offs = by_step(first[order], size[order])
    edge = edges.take(at, axis=1)
    ring = [lists.packed(entry[j][:, order]) for j in range(width)]
    ends, found = entry[0][:, order], np.empty((lists.n, len(at)), codes.dtype)
    for t, (m, lo) in enumerate(zip(alive, offs)):
        new, code = lists.next(ring, edge[:, lo : lo + m], m)
        found[:, lo : lo + m] = code
        ring = [new, *ring[:-1]]
        stay = alive[t + 1] if t + 1 < len(alive) else 0
        if stay < m:
            ends[:, stay:m] = new[:, stay:] >> lists.bits
    for r in range(lists.n):
        codes[r, at] = found[r]
    final = np.empty_like(ends)
    final[:, order] = ends
    return lists, final[:, lead + count - 1], codes


def marked_nbest(lat: Lattice, scores: np.ndarray, start: int, n: int, want: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the boundaries of the n best paths are, n along the first axis; their scores, and which there are. In the order of the sorted sentences.

    want(number of paths of each sentence, sentence's own number): the rank of the only path that is asked for, which is then alone.
    """
    lists, final, codes = _nbest_lists(lat, scores, start, n)
    final = final[:n]
    there = final > Lists.LEAST // 2
    rows = np.arange(len(lat.base))
    if want is None:
        path, row = np.nonzero(there)
        rank, layers = path, n
    else:
        rank = want(there.sum(axis=0), lat.order)
        row, path, layers = rows, np.zeros(len(rows), np.int64), 1
        final, there = final[rank, rows][None], there[rank, rows][None]
    mark = np.zeros(layers * lat.places, bool)
    mark[(np.arange(layers)[:, None] * lat.places + lat.base).ravel()] = True
    some = lat.size[row] > 0
    row, path, rank = row[some], path[some], rank[some]
    code = np.arange(int(lists.mask) + 1)
    length, better = lists.width - code // lists.n, lists.n - 1 - code % lists.n
    flat, base, at, to = codes.ravel(), lat.base[row], lat.base[row] + lat.size[row], path * lat.places
    while len(at) >= FEW:
        mark[to + at] = True
        c = flat.take(rank * lat.places + at)
        at = at - length.take(c)
        rank = better.take(c)
        go = at > base
        if not go.all():
            at, base, to, rank = at[go], base[go], to[go], rank[go]
    length, better = length.tolist(), better.tolist()
    for end, begin, here, r in zip(at.tolist(), base.tolist(), to.tolist(), rank.tolist()):
        back, p, out = codes[:, begin : end + 1].tolist(), end - begin, []
        while p > 0:
            out.append(p)
            c = back[r][p]
            p, r = p - length[c], better[c]
        mark[here + begin + np.array(out)] = True
    return mark.reshape(layers, lat.places), final, there


def nbest(lat: Lattice, scores: np.ndarray, start: int, n: int) -> list[list[tuple[int, np.ndarray]]]:
    """The n best (score, boundaries) of each sentence, best first; of equal scores first the one of the shorter last span. A place takes a byte or two for each of n."""
    mark, final, there = marked_nbest(lat, scores, start, n)
    bounds = [lat.split(x) for x in mark]
    return lat.unsorted([[(int(final[r, s]), bounds[r][s]) for r in np.flatnonzero(there[:, s]).tolist()] for s in range(len(lat.base))])


def bigram_nbest(lat: Lattice, scores: np.ndarray, m: Model, n: int) -> list[list[tuple[int, np.ndarray]]]:
    """As nbest over states (place, last length), for a model that has bigrams."""
    L, rows = lat.max_len, len(lat.base)
    ring = np.full((L + 1, L + 1, rows, n), NEVER, np.int64)
    ring[0, 0, :, 0] = m.bos_to1
    before, rank = np.zeros((L + 1, lat.places, n), np.uint8), np.zeros((L + 1, lat.places, n), np.uint8)
    final, last = np.full((rows, n), NEVER, np.int64), np.zeros((rows, n), np.int64)
    for p, at in lat.steps():
        a, now = len(at), ring[p % (L + 1)]
        now[:] = NEVER
        for k in range(1, min(L, p) + 1):
            cand, js = [], []
            for j, edge in _pair_edges(lat, scores, m, p, k, at):
                cand.append(ring[(p - k) % (L + 1), j, :a] + edge[:, None])
                js.append(j)
            now[k, :a], order = _best_of(cand, n)
            before[k, at], rank[k, at] = np.array(js)[np.minimum(order // n, len(js) - 1)], order % n
        done = np.flatnonzero(lat.size[:a] == p)
        if len(done):
            final[done], order = _best_of([now[k, done] for k in range(1, L + 1)], n)
            last[done] = order  # (length - 1) * n + rank
    out = []
    for s in range(rows):
        if not lat.size[s]:
            out.append([(m.bos_to1, np.array([0]))])
            continue
        found = []
        for i in np.flatnonzero(final[s] > NEVER // 2).tolist():
            k, r = int(last[s, i]) // n + 1, int(last[s, i]) % n

            def step(at: int) -> int:
                nonlocal k, r
                to, k, r = at - k, int(before[k, at, r]), int(rank[k, at, r])
                return to

            found.append((int(final[s, i]), _walk(lat, s, step)))
        out.append(found)
    return lat.unsorted(out)


def xorshift32(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint32)
    x ^= x << np.uint32(13)
    x ^= x >> np.uint32(17)
    x ^= x << np.uint32(5)
    return x


def _seeded(lat: Lattice, seeds: np.ndarray) -> np.ndarray:
    state = seeds[lat.order].astype(np.uint32)
    return np.where(state == 0, np.uint32(0x12345678), state)


def _temperature(t: float) -> float:
    return t if np.isfinite(t) and t > 0 else 1.0


def _drawn(state: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The row of each column that a state's number falls on, by the columns' weights; the last that has one where rounding leaves none."""
    total = np.cumsum(weight, axis=0)
    u = (state >> np.uint32(8)) / float(1 << 24) * total[-1]
    hit = (u <= total) & (weight > 0)
    k = np.argmax(hit, axis=0)
    none = np.flatnonzero(~hit[k, np.arange(len(k))])
    k[none] = len(weight) - 1 - np.argmax(weight[::-1, none] > 0, axis=0)
    return k


def _drawn_long(sums: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray]:
    """The ends and lengths of one text's words, drawn from the last to the first by a plain walk, from the sums of the weights at each place."""
    total, p, ends, sizes = sums.T.tolist(), sums.shape[1] - 1, [], []
    while p > 0:
        state ^= state << 13 & 0xFFFFFFFF
        state ^= state >> 17
        state ^= state << 5 & 0xFFFFFFFF
        c = total[p]
        u = (state >> 8) / float(1 << 24) * c[-1]
        k = next(j for j, x in enumerate(c) if u <= x and x > 0) + 1
        ends.append(p)
        sizes.append(k)
        p -= k
    return np.array(ends), np.array(sizes)


def marked_sample(lat: Lattice, scores: np.ndarray, start: int, temperature: float, seeds: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Paths drawn with each seed of the sentence of that number, in the sentences' own order, as sample() does.

    Where the boundaries are, a row for the first path of each sentence, one for the second and so on; and of each path its row, its sentence in the sorted order and its score.
    """
    t = _temperature(temperature)
    edge = np.where(scores > NEVER // 2, scores / 256.0 / t, -np.inf)
    sums = np.zeros(edge.shape)
    forward(lat, edge, start / 256.0 / t, np.logaddexp, sums)
    del edge
    np.cumsum(sums, axis=0, out=sums)
    there = np.empty(len(lat.order), np.int64)
    there[lat.order] = np.arange(len(lat.order))
    row = there[of]
    by = np.argsort(row, kind="stable")
    layer = np.empty(len(row), np.int64)
    layer[by] = np.arange(len(row)) - np.searchsorted(row[by], row[by])
    layers = int(layer.max(initial=0)) + 1
    mark = np.zeros(layers * lat.places, bool)
    mark[(np.arange(layers)[:, None] * lat.places + lat.base).ravel()] = True
    state = seeds.astype(np.uint32)
    state = np.where(state == 0, np.uint32(0x12345678), state)
    score, live = np.full(len(row), start, np.int64), np.flatnonzero(lat.size[row] > 0)
    state, at, base, to = state[live], (lat.base + lat.size)[row[live]], lat.base[row[live]], layer[live] * lat.places
    places, flat, points = np.arange(lat.max_len)[:, None] * lat.places, sums.ravel(), scores.ravel()
    while len(live) >= FEW:
        mark[to + at] = True
        total = flat.take(places + at)
        state = xorshift32(state)
        u = (state >> np.uint32(8)) / float(1 << 24) * total[-1]
        k = ((total < u) | (total <= 0)).sum(axis=0)  # the first length whose sum reaches the number
        score[live] += points.take(k * lat.places + at)
        at = at - (k + 1)
        go = at > base
        if not go.all():
            live, state, at, base, to = live[go], state[go], at[go], base[go], to[go]
    for i, x, end, begin, here in zip(live.tolist(), state.tolist(), at.tolist(), base.tolist(), to.tolist()):
        path, more = _drawn_long(sums[:, begin : end + 1], x)
        mark[here + begin + path] = True
        score[i] += int(scores[more - 1, begin + path].sum())
    return mark.reshape(layers, lat.places), layer, row, score


def sample(lat: Lattice, scores: np.ndarray, start: int, temperature: float, seeds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """A path of each sentence, drawn with probability proportional to exp(score / temperature), and its score; seeds in the sentences' own order.

    One number is drawn for each word, from the last to the first.
    """
    mark, _, _, score = marked_sample(lat, scores, start, temperature, seeds, np.arange(len(lat.order)))
    return lat.unsorted(lat.split(mark[0])), score


def bigram_sample(lat: Lattice, scores: np.ndarray, m: Model, temperature: float, seeds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """As sample over states (place, last length), for a model that has bigrams."""
    L, t = lat.max_len, _temperature(temperature)
    alpha = np.full((L + 1, lat.places), -np.inf)
    alpha[0, lat.base] = m.bos_to1 / 256.0 / t
    for p, at in lat.steps():
        for k in range(1, min(L, p) + 1):
            acc = np.full(len(at), -np.inf)
            for j, edge in _pair_edges(lat, scores, m, p, k, at):
                acc = np.logaddexp(acc, alpha[j, at - k] + edge / 256.0 / t)
            alpha[k, at] = acc
    state = _seeded(lat, seeds)
    at, score = lat.base + lat.size, np.full(len(lat.base), m.bos_to1, np.int64)
    mark = np.zeros(lat.places, bool)
    mark[lat.base] = True
    live = np.flatnonzero(lat.size > 0)
    word = np.zeros(len(at), np.int64)
    if len(live):
        lw = alpha[1:, at[live]].T
        state[live] = xorshift32(state[live])
        word[live] = _drawn(state[live], np.exp(lw - lw.max(axis=1, keepdims=True)).T) + 1
    while len(live):
        here, k = at[live], word[live]
        mark[here] = True
        to, cur = here - k, lat.ids[k - 1, here]
        own = scores[k - 1, here]
        first = lat.pos[to] == 0
        gain = np.stack([_pair_gain(m, np.where(lat.pos[to] >= j, lat.ids[j - 1, to], -1), cur) for j in range(1, L + 1)], axis=1)
        lw = alpha[1:, to].T + (own[:, None] + gain) / 256.0 / t
        lw[first] = 0.0
        state[live[~first]] = xorshift32(state[live[~first]])
        j = _drawn(state[live], np.exp(lw - lw.max(axis=1, keepdims=True)).T)
        score[live] += own + np.where(first, _pair_gain(m, np.full(len(live), len(m.pieces)), cur), gain[np.arange(len(live)), j])
        at[live], word[live] = to, j + 1
        live = live[~first]
    return lat.unsorted(lat.split(mark)), np.array(lat.unsorted(score.tolist()))


def _marks(lat: Lattice, bounds: list[np.ndarray | None]) -> np.ndarray:
    """Boundaries of the sentences, in their own order, by place."""
    mark = np.zeros(lat.places, bool)
    for k, base in zip(lat.order.tolist(), lat.base.tolist()):
        if bounds[k] is not None:
            mark[base + bounds[k]] = True
    return mark


def best_marks(lat: Lattice, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """best_paths by place: where the boundaries are, and scores in the order of the sorted sentences."""
    scores = lat.joint_scores(m)
    if not m.bigrams:
        return marked_path(lat, scores, m.bos_to1)[:2]
    bounds, score = bigram_viterbi(lat, scores, m)
    return _marks(lat, bounds), score[lat.order]


def best_n_marks(lat: Lattice, m: Model, n: int, want=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """best_n by place, as marked_nbest() gives it."""
    scores = lat.joint_scores(m)
    if not m.bigrams:
        return marked_nbest(lat, scores, m.bos_to1, n, want)
    found = bigram_nbest(lat, scores, m, n)
    count = np.array([len(f) for f in found])[lat.order]
    rank = np.repeat(np.arange(n)[:, None], len(found), axis=1) if want is None else want(count, lat.order)[None]
    there, mark, final = rank < count, np.zeros((len(rank), lat.places), bool), np.zeros(rank.shape, np.int64)
    for path, row in zip(*np.nonzero(there)):
        final[path, row], b = found[lat.order[row]][rank[path, row]]
        mark[path, lat.base[row] + b] = True
    return mark, final, there


def drawn_marks(lat: Lattice, m: Model, temperature: float, seeds: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """drawn_paths by place, with several seeds for a sentence, as marked_sample() gives it."""
    scores = lat.joint_scores(m)
    if not m.bigrams:
        return marked_sample(lat, scores, m.bos_to1, temperature, seeds, of)
    there = np.empty(len(lat.order), np.int64)
    there[lat.order] = np.arange(len(lat.order))
    layer, marks, score = np.zeros(len(of), np.int64), [], np.zeros(len(of), np.int64)
    left = np.arange(len(of))
    while len(left):  # one seed of each sentence at a time
        now = left[np.unique(of[left], return_index=True)[1]]
        each = np.ones(len(lat.order), np.int64)
        each[of[now]] = seeds[now]
        bounds, s = bigram_sample(lat, scores, m, temperature, each)
        score[now], layer[now] = s[of[now]], len(marks)
        marks.append(_marks(lat, bounds))
        left = np.setdiff1d(left, now)
    return np.array(marks).reshape(-1, lat.places), layer, there[of], score


def best_paths(lat: Lattice, m: Model) -> tuple[list[np.ndarray | None], np.ndarray]:
    """Boundaries and score of each sentence's best path by the joint model."""
    scores = lat.joint_scores(m)
    return bigram_viterbi(lat, scores, m) if m.bigrams else viterbi(lat, scores, m.bos_to1)


def best_n(lat: Lattice, m: Model, n: int) -> list[list[tuple[int, np.ndarray]]]:
    scores = lat.joint_scores(m)
    return bigram_nbest(lat, scores, m, n) if m.bigrams else nbest(lat, scores, m.bos_to1, n)


def drawn_paths(lat: Lattice, m: Model, temperature: float, seeds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    scores = lat.joint_scores(m)
    return bigram_sample(lat, scores, m, temperature, seeds) if m.bigrams else sample(lat, scores, m.bos_to1, temperature, seeds)


def expected_counts(lat: Lattice, logp: np.ndarray) -> tuple[np.ndarray, float, int, float, int]:
    """Expected uses of each piece, sum of log Z, sentences, expected tokens, and sentences that no path covers (not counted otherwise)."""
    scores = lat.lm_scores(logp)
    ends = lat.base + lat.size
    weights = np.zeros(scores.shape)
    with np.errstate(invalid="ignore"):
        z = forward(lat, scores, 0.0, np.logaddexp, weights)[ends]
        ok = np.isfinite(z) & (lat.size > 0)
        weights /= np.maximum(weights.sum(axis=0), 1e-300)
    uses = _uses(lat, weights, ok) if int(lat.size.max(initial=0)) <= STEPS else _uses_of_long(lat, weights, ok)
    counts = np.zeros(len(logp) + 1)
    for ids, use in zip(lat.ids, uses):
        counts += np.bincount(ids + 1, use, len(counts))
    return counts[1:], float(z[ok].sum()), int(ok.sum()), float(uses.sum()), int(((lat.size > 0) & ~ok).sum())


def _uses(lat: Lattice, weights: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """How likely each span is in a path, by length and place: a place's share goes to the spans that end there, by their weights, and so to the places before."""
    width, rows = len(weights), len(lat.base)
    at, alive, offs = by_step(lat.base, lat.size)
    edge = [w.take(at) for w in weights]
    share = np.zeros((width + 1) * rows + len(at))  # from the steps before the first on
    begin = [*(j * rows for j in range(1, width + 1)), *((width + 1) * rows + lo for lo in offs)]
    top = len(alive)
    for t in np.unique(lat.size[lat.size > 0]).tolist():
        lo, hi = alive[t] if t < top else 0, alive[t - 1]
        share[begin[width + t - 1] + lo : begin[width + t - 1] + hi] = ok[lo:hi]
    for t in range(top, 0, -1):
        n, lo = alive[t - 1], offs[t - 1]
        here = share[begin[width + t - 1] : begin[width + t - 1] + n]
        for k in range(1, width + 1):
            use = edge[k - 1][lo : lo + n]
            use *= here
            b = begin[width + t - 1 - k]
            share[b : b + n] += use
    out = np.zeros(weights.shape)
    for k in range(width):
        out[k, at] = edge[k]
    return out


def _uses_of_long(lat: Lattice, weights: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """_uses() by chunks side by side: read backwards, shares are sums of paths whose spans weigh what they do."""
    with np.errstate(divide="ignore", invalid="ignore"):
        scores = np.log(weights)
        back, there = lat.reversed(scores)
        share = np.exp(forward(lat, back, 0.0, np.logaddexp)[there])
    share[~ok[lat.row]] = 0
    return weights * share


def batch_for(n: int) -> int:
    """Code points of a batch of which n paths are kept at each place."""
    return max(20_000, 4 * BATCH // max(n, 4))


def batches(texts: list[str], most: int = BATCH) -> list[list[int]]:
    """Numbers of the texts in groups of about so many code points, texts of like length together."""
    return [x.tolist() for x in groups(np.fromiter((len(t) for t in texts), np.int64, len(texts)), most)]


def slices(offs: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows of about so many code points; a longer row is a range by itself."""
    out, lo = [], 0
    while lo < len(offs) - 1:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


def groups(size: np.ndarray, most: int = BATCH) -> list[np.ndarray]:
    """batches() by the texts' sizes."""
    order = np.argsort(size, kind="stable")
    total = np.r_[0, np.cumsum(size[order] + 1)]
    out, lo = [], 0
    while lo < len(order):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most + 1, side="right")) - 1)
        out.append(order[lo:hi])
        lo = hi
    return out


# --- Arrow


def utf8_sizes(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


def encoded(points: np.ndarray, offs: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Code points as UTF-8, and what the offsets are in it."""
    if not len(points) or points.max() < 0x80:
        return points.astype(np.uint8).tobytes(), offs
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.r_[0, np.cumsum(utf8_sizes(points))][offs]


def string_array(points: np.ndarray, offs: np.ndarray) -> pa.Array:
    data, offs = encoded(points, offs)
    kind, of = (pa.string(), np.int32) if len(data) < 1 << 31 else (pa.large_string(), np.int64)
    return pa.StringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs.astype(of)), pa.py_buffer(data)) if kind == pa.string() else pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs.astype(of)), pa.py_buffer(data))


def arrow_points(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a column of strings and its rows' offsets; a null has none."""
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    if not len(raw) or raw.max() < 0x80:
        return raw.astype(np.uint32), offs
    begins = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    return np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32), begins[offs]


def some_rows(points: np.ndarray, offs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of these rows, one after the other, and their offsets."""
    size = offs[rows + 1] - offs[rows]
    new = np.r_[0, np.cumsum(size)]
    return points[np.arange(new[-1]) + np.repeat(offs[rows] - new[:-1], size)], new


def _begins(lat: Lattice, mark: np.ndarray) -> np.ndarray:
    """Which code points a word begins with, from the boundaries by place."""
    keep = np.ones(lat.places, bool)
    keep[lat.base + lat.size] = False
    return mark[keep]


def word_counts(lat: Lattice, mark: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(_begins(lat, mark))][lat.offs])


def token_lists(lat: Lattice, mark: np.ndarray) -> pa.Array:
    """Each sentence's words, in the sorted order."""
    at = np.flatnonzero(_begins(lat, mark))
    words = string_array(lat.points, np.append(at, len(lat.points)))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, lat.offs), pa.int32()), words)


def joined_words(lat: Lattice, mark: np.ndarray, sep: str) -> pa.Array:
    """Each sentence's words with a character between them, in the sorted order."""
    if not sep:
        return string_array(lat.points, lat.offs)
    inner = _begins(lat, mark)
    inner[lat.offs[:-1][lat.size > 0]] = False
    more = np.cumsum(inner)
    out = np.full(len(lat.points) + (int(more[-1]) if len(more) else 0), ord(sep), np.uint32)
    out[np.arange(len(lat.points)) + more] = lat.points
    return string_array(out, lat.offs + np.r_[0, more][lat.offs])


def labels(lat: Lattice, mark: np.ndarray) -> pa.Array:
    """Each sentence's characters as 1 where a word begins, else 0, in the sorted order."""
    return string_array(_begins(lat, mark) + np.uint32(48), lat.offs)
