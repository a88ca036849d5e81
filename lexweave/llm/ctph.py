"""Document fingerprints by context-triggered piecewise hashing, and all pairs that match.

A rolling hash of the last 7 bytes ends a piece where it is -1 modulo the block size 3 * 2**k. Each piece gives one of 64
letters by a hash of its bytes; the letters are the text's signature at that block size. k is the least at which the
signature has at most 64 letters; the one at k + 1 is kept besides. Texts are compatible where they have signatures at a
common block size: k equal, or one apart. Their score is 100 * (1 - edit distance / length of the longer signature),
the better one where two block sizes are common. As is usual with such hashes, signatures that share no `GRAM` letters in a row score 0,
and runs of one letter count as three of them, as they say little. Documents of equal fingerprint are a group, whose
rows all bear its group_id; pairs of distinct fingerprints that score `LEAST_SCORE` or more stand in `matches`, each pair once: in the
list of the group that comes later in the order of lowest doc_ids, on the rows of its lowest doc_id. The first match of a
document, match_id, is the one of the lowest doc_id among all documents before it that match.

Equal fingerprints are compared once, and pairs are made of distinct ones by an inverted index of their letter runs: at
the first run of each stretch of letters that both have, so that long stretches make a pair once.

Defined cases: a null text has no fingerprint and no match; an empty one has an empty signature at block size 3, which
matches other empty ones only. Documents of equal fingerprint match the lowest doc_id among them with 100; rows repeated
in full all have the same result. A null doc_id comes after all others. A text of any length is read whole, as one row of a batch; its signature has 64 letters at most.
Equality of fingerprints is that of their 64-bit hashes. An empty table gives an empty table. Other
columns aren't used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.core import Buckets, Prefix, by_bucket, chunks, column, forget, mix, partitions, spread, stored, string_bytes, table
from lexweave.ship import map_arrow

WINDOW = 7
LONGEST = 64
GRAM = 7
LEVELS = 40
LEAST_SCORE = 50
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_NUMBER = np.zeros(256, np.uint8)
_NUMBER[ALPHABET] = np.arange(64)


def trigger_levels(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each byte the greatest k at whose block size a piece ends there, or -1. The window starts anew in each row."""
    n = len(data)
    total = np.zeros(n, np.uint32)
    wide = data.astype(np.uint32)
    place = np.arange(n) - np.repeat(offs[:-1], np.diff(offs))
    for j in range(WINDOW):
        c = wide[: n - j] if j else wide
        # the sum, the weighted sum and the shifted xor of a window each take this byte in
        part = np.where(place[j:] >= j, c, 0)
        if j == 0:
            plain, weighted, shifted = part.copy(), part * np.uint32(WINDOW), part.copy()
        else:
            plain[j:] += part
            weighted[j:] += part * np.uint32(WINDOW - j)
            shifted[j:] ^= part << np.uint32(5 * j)
    total = (plain + weighted + shifted).astype(np.uint64) + np.uint64(1)
    third = total // np.uint64(3)
    level = np.bitwise_count((third & -third.astype(np.int64).view(np.uint64)) - np.uint64(1)).astype(np.int8)
    return np.where(total % np.uint64(3) == 0, np.minimum(level, LEVELS - 2), np.int8(-1))


def signatures(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """k of each row, and for k and k + 1 the letters (0 to 63) of all rows and their offsets."""
    rows = len(offs) - 1
    k_of = np.zeros(rows, np.int64)
    letters: list[list[np.ndarray]] = [[], []]
    sizes: list[list[np.ndarray]] = [[], []]
    for lo, hi in chunks(offs):
        d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        level = trigger_levels(d, o) if len(d) else np.zeros(0, np.int8)
        at = np.flatnonzero(level >= 0)
        row = np.searchsorted(o, at, side="right") - 1
        last = at + 1 == o[row + 1]
        at, row = at[~last], row[~last]  # the text's end ends a piece anyway
        counts = np.bincount(row * LEVELS + level[at], minlength=(hi - lo) * LEVELS).reshape(-1, LEVELS)
        above = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
        k = np.argmax(above + 1 <= LONGEST, axis=1)
        k_of[lo:hi] = k
        p = Prefix(d)
        some = np.flatnonzero(np.diff(o))
        for up in (0, 1):
            ends = at[level[at] >= k[row] + up] + 1
            begin = np.sort(np.concatenate([ends, o[:-1][some]]))
            size = np.diff(np.r_[begin, len(d)])
            letters[up].append((p.hash(begin, size) >> np.uint64(58)).astype(np.uint8))
            sizes[up].append(np.bincount(np.searchsorted(o, begin, side="right") - 1, minlength=hi - lo))
    flat = [np.concatenate(x) if x else np.zeros(0, np.uint8) for x in letters]
    outs = [np.r_[0, np.cumsum(np.concatenate(x))] if x else np.zeros(1, np.int64) for x in sizes]
    return k_of, flat, outs


def capped_runs(letters: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters with runs of one letter cut to three, and the new offsets."""
    if not len(letters):
        return letters, offs
    new = np.r_[True, letters[1:] != letters[:-1]]
    new[offs[:-1][offs[:-1] < len(letters)]] = True
    at = np.flatnonzero(new)
    place = np.arange(len(letters)) - np.repeat(at, np.diff(np.r_[at, len(letters)]))
    keep = place < 3
    total = np.r_[0, np.cumsum(keep)]
    return letters[keep], total[offs]


def myers(a: np.ndarray, a_offs: np.ndarray, b: np.ndarray, b_offs: np.ndarray) -> np.ndarray:
    """The edit distance of each row of letters a to that of b, at most 64 letters each: a's rows are the bits of a word."""
    n = len(a_offs) - 1
    out = np.zeros(n, np.int64)
    for lo in range(0, n, 8192):
        hi = min(n, lo + 8192)
        m, w = np.diff(a_offs[lo : hi + 1]), np.diff(b_offs[lo : hi + 1])
        rows = hi - lo
        place = np.zeros((64, rows), np.uint64)  # of each letter of the alphabet: where it stands in a
        x = a[a_offs[lo] : a_offs[hi]]
        row = np.repeat(np.arange(rows), m)
        bit = np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m)
        np.bitwise_or.at(place, (x, row), np.uint64(1) << bit.astype(np.uint64))
        vp, vn, dist = np.full(rows, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(rows, np.uint64), m.copy()
        last = np.maximum(m - 1, 0).astype(np.uint64)
        y = np.zeros((rows, max(1, int(w.max(initial=0)))), np.uint8)
        y[np.arange(y.shape[1]) < w[:, None]] = b[b_offs[lo] : b_offs[hi]]
        each, one = np.arange(rows), np.uint64(1)
        for j in range(int(w.max(initial=0))):
            live = j < w
            pm = place[y[:, j], each]
            d0 = (((pm & vp) + vp) ^ vp) | pm | vn
            hp, hn = vn | ~(d0 | vp), d0 & vp
            dist = dist + np.where(live, (hp >> last & one).astype(np.int64) - (hn >> last & one).astype(np.int64), 0)
            hp = hp << one | one
            vp, vn = np.where(live, (hn << one) | ~(d0 | hp), vp), np.where(live, hp & d0, vn)
        out[lo:hi] = np.where(m == 0, w, dist)
    return out


def scores(a: tuple, b: tuple) -> np.ndarray:
    """100 * (1 - distance / longer length), rounded down, of rows of (letters, offsets); 0 where both are empty."""
    longest = np.maximum(np.diff(a[1]), np.diff(b[1]))
    return np.where(longest > 0, 100 * (longest - myers(*a, *b)) // np.maximum(longest, 1), 0)


GRAM_RECORD = np.dtype([("key", "u8"), ("print", "u8")])
PAIR = np.dtype([("a", "u8"), ("b", "u8")])


def gram_records(k: np.ndarray, letters: np.ndarray, offs: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """A record for each run of GRAM letters; in a key are the block size, the letters of 6 bits each and in 7 bits the letter before them, 64 for none."""
    count = np.maximum(np.diff(offs) - (GRAM - 1), 0)
    inner = np.cumsum(count) - count
    at = np.arange(count.sum()) + np.repeat(offs[:-1] - inner, count)
    key = np.repeat(k, count).astype(np.uint64)
    for j in range(GRAM):
        key = key << np.uint64(6) | letters[at + j].astype(np.uint64)
    start = at == np.repeat(offs[:-1], count)
    out = np.empty(len(at), GRAM_RECORD)
    out["key"] = key << np.uint64(7) | np.where(start, 64, letters[np.maximum(at - 1, 0)] if len(letters) else 0).astype(np.uint64)
    out["print"] = np.repeat(prints, count)
    return np.unique(out)


def met(records: np.ndarray, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """PAIR records (a < b) of the fingerprints that share letters of which those before differ or are none, about `most` at a time."""
    r = np.unique(records)
    gram = r["key"] >> np.uint64(7)
    before = r["key"] & np.uint64(127)
    end = np.searchsorted(gram, gram, side="right")
    n = end - np.arange(len(r)) - 1  # records of the same letters after each
    total = np.r_[0, np.cumsum(n)]
    lo = 0
    while lo < len(r):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, side="right")) - 1)
        i = np.repeat(np.arange(lo, hi), n[lo:hi])
        j = i + 1 + np.arange(len(i)) - np.repeat(total[lo:hi] - total[lo], n[lo:hi])
        ok = (r["print"][i] != r["print"][j]) & ((before[i] != before[j]) | (before[i] == 64))
        x, y = r["print"][i[ok]], r["print"][j[ok]]
        out = np.empty(len(x), PAIR)
        out["a"], out["b"] = np.minimum(x, y), np.maximum(x, y)
        yield np.unique(out)
        lo = hi


def packed_letters(letters: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(ALPHABET[letters].tobytes())]).cast(pa.binary())


def unpacked(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    col = col.cast(pa.large_binary())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return _NUMBER[raw[offs[0] : offs[-1]]], offs - offs[0]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, k, short, long) of every row: the signatures at k and k + 1 as bytes, a letter each; all null for a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, letters, offs = signatures(*string_bytes(b.column(1)))
            null = pa.array(b.column(1).is_null())
            sigs = [packed_letters(x, o) for x, o in zip(letters, offs)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.compute.if_else(null, pa.scalar(None, c.type), c) for c in (pa.array(k.astype(np.int32)), *sigs))], ["doc_id", "k", "short", "long"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "text").alias("text")), run, f"doc_id {kind}, k int, short binary, long binary")


def matches(prints: DataFrame) -> DataFrame:
    """(print, match_id, score, matches) of each distinct fingerprint that matches ones before it: the first of them, and all."""
    spark = prints.sparkSession
    count = partitions(spark)

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Buckets(count)
        for b in batches:
            ids, k = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            for up in (0, 1):
                r = gram_records(k + up, *capped_runs(*unpacked(b.column(2 + up))), ids)
                out.add(0, mix(r["key"] >> np.uint64(7)), r)
            if out.full():
                yield from out.flush()
        yield from out.flush()

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Buckets(count)
        for got in by_bucket(batches, {0: GRAM_RECORD}):
            for pairs in met(got[0]):
                out.add(0, mix(pairs["a"] ^ mix(pairs["b"])), pairs)
                if out.full():
                    yield from out.flush()
        yield from out.flush()

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in by_bucket(batches, {0: PAIR}):
            r = np.unique(got[0])
            yield pa.RecordBatch.from_arrays([pa.array(r[c].view(np.int64)) for c in ("a", "b")], ["a", "b"])

    grams = map_arrow(prints.select("print", "k", "short", "long"), grams_of, Buckets.SCHEMA)
    pairs = stored(map_arrow(spread(map_arrow(spread(grams), pairs_of, Buckets.SCHEMA)), distinct, "a bigint, b bigint"))
    order = F.struct(F.isnull("first").alias("late"), F.col("first").alias("id"), F.col("print").alias("print"))
    sig = prints.select(F.col("print").alias("p"), order.alias("at"), "k", "short", "long")
    found = stored(_scored(pairs, sig))
    forget(pairs)
    each = found.select(F.greatest("x", "y").alias("own"), F.least("x", "y").alias("at"), "score")
    lists = each.groupBy(F.col("own.print").alias("print")).agg(F.sort_array(F.collect_list(F.struct("at", "score"))).alias("m"))
    as_list = F.transform("m", lambda x: F.struct(x["at"]["print"].alias("group_id"), x["at"]["id"].alias("doc_id"), x["score"].alias("score")))
    return lists.select("print", F.col("m")[0]["at"]["id"].alias("match_id"), F.col("m")[0]["score"].alias("score"), as_list.alias("matches"))


def _scored(pairs: DataFrame, sig: DataFrame) -> DataFrame:
    """(x, y, score) of the pairs that score enough, each fingerprint by its place in the order."""
    a = sig.select(F.col("p").alias("a"), F.col("at").alias("x"), F.col("k").alias("ka"), F.col("short").alias("sa"), F.col("long").alias("la"))
    b = sig.select(F.col("p").alias("b"), F.col("at").alias("y"), F.col("k").alias("kb"), F.col("short").alias("sb"), F.col("long").alias("lb"))
    both = pairs.join(a, "a").join(b, "b").select("x", "y", "ka", "kb", "sa", "sb", "la", "lb")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ka, kb = b.column(2).to_numpy(), b.column(3).to_numpy()
            best = np.zeros(b.num_rows, np.int64)
            # short with short and long with long where k is equal, else the long one of the finer text with the short one of the other
            for shift, x, y in ((0, 4, 5), (0, 6, 7), (1, 6, 5), (-1, 4, 7)):
                at = np.flatnonzero(kb - ka == shift)
                if len(at):
                    i = pa.array(at)
                    best[at] = np.maximum(best[at], scores(capped_runs(*unpacked(b.column(x).take(i))), capped_runs(*unpacked(b.column(y).take(i)))))
            ok = pa.array(np.flatnonzero(best >= LEAST_SCORE))
            yield pa.RecordBatch.from_arrays([b.column(0).take(ok), b.column(1).take(ok), pa.array(best.astype(np.int32)).take(ok)], ["x", "y", "score"])

    kind = sig.schema["at"].dataType.simpleString()
    return map_arrow(both, score, f"x {kind}, y {kind}, score int")


def matched(docs: DataFrame) -> DataFrame:
    """(doc_id, block_size, signature, signature2, match_id, score, group_id, matches) of every document."""
    found = stored(fingerprints(docs)).withColumn("print", F.xxhash64("k", "short", "long"))
    some = found.filter("k is not null")
    firsts = stored(some.groupBy("print").agg(F.first("k").alias("k"), F.first("short").alias("short"), F.first("long").alias("long"), F.min("doc_id").alias("first")))
    best = stored(matches(firsts)).withColumnRenamed("print", "p")
    per_print = firsts.join(best, firsts["print"] == best["p"], "left").select(F.col("print").alias("p"), "first", "match_id", "score", "matches")
    rows = found.join(per_print, found["print"] == per_print["p"], "left")
    same = ~F.col("doc_id").eqNullSafe(F.col("first")) & F.col("p").isNotNull()
    return rows.select("doc_id", F.expr("3 * shiftleft(cast(1 as bigint), k)").alias("block_size"), F.col("short").cast("string").alias("signature"), F.col("long").cast("string").alias("signature2"), F.when(same, F.col("first")).otherwise(F.col("match_id")).alias("match_id"), F.when(same, 100).otherwise(F.col("score")).alias("score"), F.col("p").alias("group_id"), F.when(~same, F.col("matches")).alias("matches"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its group of equal ones and all matches before it."""
    return matched(table(spark, sf_dir, "documents"))
