"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

Texts become arrays of code points; the vocabulary's pattern is applied by letter classes and run boundaries, without a
regular expression. Each batch's distinct pre-tokens, as ragged numpy arrays of byte symbols, are merged together: in every
round each sequence merges its pair of the lowest rank, all sequences at once, until none has a pair that merges. The
symbols that survive are counted, and each text's count is the sum over its pre-tokens. Pre-tokens already counted by
this worker are looked up in a table of hashes, which starts anew at `KNOWN` entries; equal 64-bit hashes stand for equal pre-tokens.

Counts are those of the public rank file at `path` (a parameter, by default in /opt/tokenizers) for ordinary text:
strings of special tokens aren't special.

Defined cases: a null text has a null count, an empty one 0. Code points that Unicode doesn't assign, or that stand
outside letters, numbers and white space, are symbols of the third class. Rows are counted one by one, so repeated rows
and ties need no rule; a text of any length is read whole, as one row of a batch, and one of a single pre-token takes a round over it for each rank at which it merges. Other columns aren't touched. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexweave.llm.core import _BYTE, chunks, column, mix, powers, string_bytes, table
from lexweave.ship import map_arrow

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KNOWN = 2_000_000
CHUNK = 1 << 20

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
_SPACES = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _classes() -> np.ndarray:
    table_ = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(0x323B0):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table_[c] = LETTER
        elif kind == "N":
            table_[c] = NUMBER
    table_[list(_SPACES)] = SPACE
    return table_


class Vocabulary:
    """Merge ranks of symbol pairs. Symbols are the ids of the rank file; a pair merges if the bytes of both together have an id."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        pairs = {}
        for token, rank in ids.items():
            for k in range(1, len(token)):
                left, right = ids.get(token[:k]), ids.get(token[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.array(sorted(pairs), np.int64)
        self.bytes = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        self.bits = max(8, int(4 * len(keys)).bit_length())
        self.slots, self.ranks = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        todo, at = keys, self._slot(keys)
        while len(todo):  # open addressing: the first of those that want a free slot gets it, the rest go one further
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            left = self.slots[at] != todo
            todo, at = todo[left], (at[left] + 1) & (len(self.slots) - 1)
        where = self._find(keys)
        self.ranks[where] = [pairs[k] for k in keys.tolist()]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot, or that of the first free one where it isn't there."""
        at = self._slot(keys)
        open_ = np.flatnonzero((self.slots[at] != keys) & (self.slots[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            open_ = open_[(self.slots[at[open_]] != keys[open_]) & (self.slots[at[open_]] >= 0)]
        return at

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, a huge number where it doesn't merge."""
        keys = left << 32 | right
        at = self._find(keys)
        return np.where(self.slots[at] == keys, self.ranks[at], NEVER)


NEVER = np.int64(1) << 40


def merged_counts(v: Vocabulary, symbols: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many symbols are left of each sequence (none of them empty) when no pair merges."""
    out = np.diff(offs).copy()
    seq = np.repeat(np.arange(len(out)), out)
    live = out[seq] > 1
    symbols, seq = symbols[live], seq[live]
    rank = np.full(len(symbols), NEVER)
    if len(symbols):
        inner = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inner] = v.rank(symbols[inner], symbols[inner + 1])
    while len(symbols):
        start = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        size = np.diff(np.r_[start, len(seq)])
        least = np.minimum.reduceat(rank, start)
        go = least < NEVER
        hit = (rank == np.repeat(least, size)) & np.repeat(go, size)
        # of a run of hits (as in "aaa") every second one merges, from the left
        at = np.flatnonzero(hit)
        run = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1)])
        place = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
        at = at[place % 2 == 0]
        symbols[at] = rank[at]
        keep = np.repeat(go, size)
        keep[at + 1] = False
        out[seq[start]] = size
        np.subtract.at(out, seq[at], 1)
        stale = np.zeros(len(symbols), bool)
        stale[at] = True
        stale[at[at > 0] - 1] = True
        stale[at[at > 1] - 2] = True  # the one before a symbol that went away is found again below
        symbols, seq, rank, stale = symbols[keep], seq[keep], rank[keep], stale[keep]
        if len(symbols):
            last = np.r_[seq[1:] != seq[:-1], True]
            rank[last] = NEVER
            new = np.flatnonzero(stale & ~last)
            rank[new] = v.rank(symbols[new], symbols[new + 1])
    return out


def pretoken_starts(points: np.ndarray, rows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the pattern's matches begin; rows are the texts' offsets into the code points.

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[rows] = True
    kind = kinds[points]
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # a run of white space before other text gives up its last one: to the run after it if it is a blank, else as a token
    run_end = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n]) if n else np.zeros(0, np.int64)
    blank = points[run_end] == 32
    start[run_end] = True
    start[run_end[blank] + 1] = False
    # an apostrophe that stands alone, without a blank of its own before it, takes a contraction's letters
    nxt = np.r_[kind[1:], 0][:n]
    lone = np.flatnonzero((points == 39) & start & (nxt == LETTER) & ~first[1:])
    if len(lone):
        pad = np.r_[points, np.zeros(3, points.dtype)]
        same_row = ~first[np.minimum(lone + 2, n)]
        a, b = pad[lone + 1], np.where(same_row, pad[lone + 2], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        some = one | two
        lone, size = lone[some], np.where(one, 1, 2)[some]
        start[lone + 1] = False
        after = lone + 1 + size
        ok = after < n
        start[after[ok]] = True
    return np.flatnonzero(start)


class Counter:
    def __init__(self, path: str) -> None:
        self.vocabulary, self.kinds = Vocabulary(path), _classes()
        self.forget()

    def forget(self) -> None:
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.later: list[tuple[np.ndarray, np.ndarray]] = []

    def learn(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        """Takes sorted new hashes in; small tables wait until they are as many as half the large one, so that a hash is moved few times."""
        self.later.append((hashes, counts))
        waiting = sum(len(h) for h, _ in self.later)
        if len(self.hashes) + waiting > KNOWN:
            self.forget()
            self.hashes, self.counts = hashes, counts
        elif len(self.later) > 8 or 2 * waiting > len(self.hashes):
            h, c = (np.concatenate([x, *(t[k] for t in self.later)]) for k, x in ((0, self.hashes), (1, self.counts)))
            order = np.argsort(h, kind="stable")
            self.hashes, self.counts, self.later = h[order], c[order], []

    def count(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The number of tokens of each text."""
        out = np.zeros(len(offs) - 1, np.int64)
        for lo, hi in chunks(offs, CHUNK):
            out[lo:hi] = self._count(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        return out

    def _count(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if not len(data):
            return np.zeros(len(offs) - 1, np.int64)
        lead = np.flatnonzero((data & 0xC0) != 0x80)  # the byte where each code point begins
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        rows = np.searchsorted(lead, offs)
        start = pretoken_starts(points, rows, self.kinds)
        at = lead[start]
        size = np.diff(np.r_[at, len(data)])
        value = _BYTE[data] * powers(int(size.max()))[np.arange(len(data)) - np.repeat(at, size)]
        h = mix(np.add.reduceat(value, at) + size.astype(np.uint64))
        different, first, back = np.unique(h, return_index=True, return_inverse=True)
        known, counts = np.zeros(len(different), bool), np.zeros(len(different), np.int64)
        for hashes, found in ((self.hashes, self.counts), *self.later):
            place = np.searchsorted(hashes, different)
            place[place == len(hashes)] = 0
            hit = hashes[place] == different if len(hashes) else known & False
            known |= hit
            counts[hit] = found[place[hit]]
        new = np.flatnonzero(~known)
        if len(new):
            s, n = at[first[new]], size[first[new]]
            inner = np.r_[0, np.cumsum(n)]
            symbols = self.vocabulary.bytes[data[np.arange(inner[-1]) + np.repeat(s - inner[:-1], n)]]
            counts[new] = merged_counts(self.vocabulary, symbols, inner)
            self.learn(different[new], counts[new].astype(np.int32))
        total = np.r_[0, np.cumsum(counts[back])]
        token_rows = np.searchsorted(at, offs)
        return total[token_rows[1:]] - total[token_rows[:-1]]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """This worker's counter for a rank file."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, tokens) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path)
        for b in batches:
            n = of.count(*string_bytes(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, mask=~b.column(1).is_valid().to_numpy(zero_copy_only=False))], ["doc_id", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "text").alias("text")), run, f"doc_id {kind}, tokens bigint")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents"))
