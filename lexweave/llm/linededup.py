"""Line dedup by a segment-partition edit join over all lines of all documents.

A line of one byte or more goes if a line before it is equal to it, and a line of `LEAST` bytes or more also if a line before it is
at most `EDITS` byte edits away, whether or not that line stays itself. In lines of fewer than LEAST bytes so many edits can
change every word, so that near ones aren't repeats. Lines are in the order (document, line_no), documents in that of doc_id, integers by value and
others by their 64-bit hash, then of the text's hash.

The join: every distinct line is cut into EDITS + 1 even segments, of which a line within EDITS edits must hold one
unchanged. Segments go into an index by (line length, segment number, hash); a line probes, for each length that its
partner may have, the substrings at the places that multi-match-aware selection leaves. Each entry bears 64 parities of the line's
byte pairs: an edit turns four of them at most, so pairs that differ in more are left out before they are sent. Pairs that meet are verified
by edit distance in a band of 2 * EDITS + 1 diagonals, held in the bits of a word and advanced for many pairs at once.
Equality of whole lines is that of their 64-bit hashes: each hash's first line is an aggregate that tasks add up before the shuffle, and is joined to all lines
that have it, so a line that stands in a third of all documents isn't one task's work.

Defined cases: a null text stays null, an empty one empty. Documents with a null doc_id stay as they are and take no
lines from others. Rows of equal doc_id and equal text are one document, and lose the same lines; rows of equal doc_id and other
texts are documents of their own. A text of any length is cut into lines in memory, as one row of a batch. A document that
loses lines and has none left goes; n_chars, where docs have it, is counted again. Other columns pass unchanged.
An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.core import Buckets, Prefix, by_bucket, chunks, column, fresh, id_key, mix, partitions, spread, stored, string_bytes, table, with_ids
from lexweave.ship import map_arrow

EDITS = 2
LEAST = 32
BROADCAST_HASHES = 1_000_000

SEGMENT = np.dtype([("key", "u8"), ("hash", "u8"), ("bits", "u8")])
INDEX, PROBE = 1, 2


def line_table(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, line_no, start, size) of every line of every row; a row of no bytes has one empty line."""
    breaks = np.flatnonzero(data == 10)
    row = np.searchsorted(offs, breaks, side="right") - 1
    starts = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offs[1:], breaks]), kind="stable")
    lines = np.bincount(row, minlength=len(offs) - 1) + 1
    rows = np.repeat(np.arange(len(offs) - 1), lines)
    first = np.cumsum(lines) - lines
    return rows, np.arange(len(rows)) - first[rows], starts, ends - starts


def segment(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i of lines of these lengths; the last ones are a byte longer where it doesn't divide."""
    base, more = length // (edits + 1), length % (edits + 1)
    longer = i - (edits + 1 - more)
    return i * base + np.maximum(longer, 0), base + (longer >= 0)


_PAIR_BIT = np.uint64(1) << (mix(np.arange(1 << 16, dtype=np.uint64)) >> np.uint64(58))


def parities(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 bits of each line: of which of 64 classes of byte pairs it has an odd number. Lines have two bytes or more."""
    if not len(start):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data), np.uint64)
    np.bitwise_xor.accumulate(_PAIR_BIT[data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]], out=sums[1:])
    return sums[start + size - 1] ^ sums[start]


def segment_records(p: Prefix, start: np.ndarray, size: np.ndarray, hashes: np.ndarray, bits: np.ndarray, edits: int, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """Index and probe records of these lines."""

    def records(at: np.ndarray, n: np.ndarray, length: np.ndarray, i: int, k: np.ndarray | slice) -> np.ndarray:
        out = np.empty(len(at), SEGMENT)
        out["key"] = p.hash(at, n) ^ mix((length * (edits + 1) + i).astype(np.uint64))
        out["hash"], out["bits"] = hashes[k], bits[k]
        return out

    for i in range(edits + 1):
        at, n = segment(size, i, edits)
        yield INDEX, records(start + at, n, size, i, slice(None))
        for less in range(edits + 1):
            length = size - less
            at, n = segment(length, i, edits)
            lo = np.maximum(np.maximum(at - i, at + less - (edits - i)), 0)
            hi = np.minimum(np.minimum(at + i, at + less + (edits - i)), size - n)
            for shift in range(-edits, 2 * edits + 1):
                ok = (length >= least) & (at + shift >= lo) & (at + shift <= hi)
                if ok.any():
                    yield PROBE, records((start + at + shift)[ok], n[ok], length[ok], i, ok)


def _distinct(r: np.ndarray, *names: str) -> np.ndarray:
    """The records in the order of these fields, the first of those that agree in them."""
    order = np.lexsort([r[n] for n in reversed(names)])
    r = r[order]
    new = np.ones(len(r), bool)
    new[1:] = np.logical_or.reduce([r[n][1:] != r[n][:-1] for n in names])
    return r[new]


def meet(index: np.ndarray, probe: np.ndarray, edits: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a < b) of line hashes of which one probes a key under which the other is indexed, and whose parities allow so few edits; about `most` are looked at together."""
    index, probe = _distinct(index, "key", "hash"), _distinct(probe, "key", "hash")
    first = np.searchsorted(index["key"], probe["key"])
    n = np.searchsorted(index["key"], probe["key"], side="right") - first
    some = np.flatnonzero(n)
    probe, first, n = probe[some], first[some], n[some]
    # a probe's entries are taken in runs, so that a key of many lines is never held as pairs
    runs = -(-n // most)
    of = np.repeat(np.arange(len(n)), runs)
    begin = (np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)) * most
    size = np.minimum(n[of] - begin, most)
    total = np.r_[0, np.cumsum(size)]
    for lo, hi in chunks(total, most):
        k = of[lo:hi]
        at = np.arange(total[hi] - total[lo]) + np.repeat(first[k] + begin[lo:hi] - (total[lo:hi] - total[lo]), size[lo:hi])
        i = np.repeat(k, size[lo:hi])
        ok = (np.bitwise_count(probe["bits"][i] ^ index["bits"][at]) <= 4 * edits) & (probe["hash"][i] != index["hash"][at])
        a, b = probe["hash"][i[ok]], index["hash"][at[ok]]
        if len(a):
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pairs[0], pairs[1]


def edit_distances(a: np.ndarray, a_offs: np.ndarray, b: np.ndarray, b_offs: np.ndarray, most: int) -> np.ndarray:
    """The edit distance of each row of bytes a to that of b, or most + 1 if it is greater.

    The band's rows j - most .. j + most are the top bits of a word; all pairs of about one length advance together.
    """
    swap = np.diff(a_offs) < np.diff(b_offs)
    out = np.full(len(a_offs) - 1, most + 1, np.int64)
    flat = np.concatenate([a, b, np.zeros(1, np.uint8)])
    a_at, b_at = a_offs[:-1], b_offs[:-1] + len(a)
    long_at, short_at = np.where(swap, b_at, a_at), np.where(swap, a_at, b_at)
    long_n, short_n = np.maximum(np.diff(a_offs), np.diff(b_offs)), np.minimum(np.diff(a_offs), np.diff(b_offs))
    fit = np.flatnonzero(long_n - short_n <= most)
    fit = fit[np.argsort(short_n[fit], kind="stable")]
    width, top = 2 * most + 1, np.uint64(63)
    for part in range(0, len(fit), 4096):
        k = fit[part : part + 4096]
        # rows: the longer line, columns: the shorter one
        m, n, x0, y0 = long_n[k], short_n[k], long_at[k], short_at[k]
        vp = np.full(len(k), np.uint64(((1 << (most + 1)) - 1) << (63 - most)), np.uint64)
        vn = np.zeros(len(k), np.uint64)
        dist = np.minimum(m, most)
        for j in range(int(n.max(initial=0))):
            live = j < n
            y = flat[np.where(live, y0 + j, len(flat) - 1)]
            pm = np.zeros(len(k), np.uint64)
            for d in range(width):
                i = j - most + d
                inside = (i >= 0) & (i < m)
                pm |= (inside & (flat[np.where(inside, x0 + i, len(flat) - 1)] == y)).astype(np.uint64) << np.uint64(63 - 2 * most + d)
            d0 = (((pm & vp) + vp) ^ vp) | pm | vn
            hp, hn = vn | ~(d0 | vp), d0 & vp
            down = j < m - most
            bit = np.where(down, 63, np.maximum(62 - (j - (m - most)), 0)).astype(np.uint64)
            step = np.where(down, 1 - (d0 >> top).astype(np.int64), ((hp >> bit) & np.uint64(1)).astype(np.int64) - ((hn >> bit) & np.uint64(1)).astype(np.int64))
            dist = dist + np.where(live, step, 0)
            x = d0 >> np.uint64(1)
            vp, vn = np.where(live, hn | ~(x | hp), vp), np.where(live, x & hp, vn)
        out[k] = np.minimum(dist, most + 1)
    return out


def _in(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(hashes), bool)
    return of[np.minimum(np.searchsorted(of, hashes), len(of) - 1)] == hashes


def _text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(column(docs, "text"))


def duplicates(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """(doc_id, line_no, kept_doc_id, kept_line_no, edits) of every line that goes, once: 0 edits from the first line equal to it, or else from the first line near it."""
    found = repeated_lines(docs, edits, least).select("doc", F.col("line").alias("line_no"), "kept_doc", F.col("kept_line").alias("kept_line_no"), "edits")
    return with_ids(found, docs, {"doc": "doc_id", "kept_doc": "kept_doc_id"}).select("doc_id", "line_no", "kept_doc_id", "kept_line_no", "edits")


def repeated_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """(doc, text, line, kept_doc, kept_line, edits) of every line that goes; doc and text are the document's key and its text's hash."""
    spark, count = docs.sparkSession, partitions(docs.sparkSession)
    slim = docs.select(id_key(docs).alias("doc"), _text_hash(docs).alias("hash"), column(docs, "text").alias("text")).filter(column(docs, "doc_id").isNotNull() & column(docs, "text").isNotNull())
    least = max(least, edits + 1)  # a segment has a byte at least
    gone = "doc bigint, text bigint, line int, kept_doc bigint, kept_text bigint, kept_line int"
    names = [x.split()[0] for x in gone.split(", ")]

    def lines_of(b: pa.RecordBatch, least: int) -> Iterator[tuple]:
        data, offs = string_bytes(b.column(2))
        ids, texts = b.column(0).to_numpy(), b.column(1).to_numpy()
        for lo, hi in chunks(offs):
            d = data[offs[lo] : offs[hi]]
            rows, no, start, size = line_table(d, offs[lo : hi + 1] - offs[lo])
            ok = size >= least
            yield d, Prefix(d), ids[lo + rows[ok]], texts[lo + rows[ok]], no[ok], start[ok], size[ok]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, p, ids, texts, no, start, size in lines_of(b, 1):
                yield pa.RecordBatch.from_arrays([pa.array(p.hash(start, size).view(np.int64)), pa.array(ids), pa.array(texts), pa.array(no.astype(np.int32))], ["hash", "doc", "text", "line"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Buckets(count)
        for b in batches:
            for d, p, _, _, _, start, size in lines_of(b, least):
                h, first = np.unique(p.hash(start, size), return_index=True)
                bits = parities(d, start[first], size[first])
                for kind, records in segment_records(p, start[first], size[first], h, bits, edits, least):
                    out.add(kind, mix(records["key"]), records)
                if out.full():
                    yield from out.flush()
        yield from out.flush()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in by_bucket(batches, {INDEX: SEGMENT, PROBE: SEGMENT}):
            for a, b in meet(got[INDEX], got[PROBE], edits):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["x", "y"])

    lines = map_arrow(slim, each, "hash bigint, doc bigint, text bigint, line int")
    here = F.struct("doc", "text", "line")
    repeated = lines.groupBy("hash").agg(F.min(here).alias("at"), F.max(here).alias("last")).filter("at <> last")
    all_equal = lines.join(repeated.select("hash", "at"), "hash").filter(here != F.col("at"))
    equal = stored(all_equal.select("doc", "text", "line", F.col("at.doc").alias("kept_doc"), F.col("at.text").alias("kept_text"), F.col("at.line").alias("kept_line"), F.lit(0).alias("edits")).distinct())
    pairs = stored(map_arrow(spread(map_arrow(slim, cut, Buckets.SCHEMA)), join, "x bigint, y bigint").distinct())
    wanted = stored(pairs.select(F.explode(F.array("x", "y")).alias("hash")).distinct())
    most = wanted.count()
    if not most:
        return equal.drop("kept_text")
    few = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in wanted.collect()], np.int64).view(np.uint64))) if most <= BROADCAST_HASHES else None

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, p, ids, texts, no, start, size in lines_of(b, least):
                h = p.hash(start, size)
                k = np.flatnonzero(_in(h, few.value)) if few is not None else np.arange(len(h))
                for part in range(0, len(k), 8192):
                    q = k[part : part + 8192]
                    line = [d[s : s + n].tobytes() for s, n in zip(start[q], size[q])]
                    yield pa.RecordBatch.from_arrays([pa.array(h[q].view(np.int64)), pa.array(ids[q]), pa.array(texts[q]), pa.array(no[q].astype(np.int32)), pa.array(line, pa.binary())], ["hash", "doc", "text", "line", "bytes"])

    lines = map_arrow(slim, fetch, "hash bigint, doc bigint, text bigint, line int, bytes binary")
    if few is None:
        lines = lines.join(wanted, "hash", "left_semi")
    known = stored(lines.groupBy("hash").agg(F.min(F.struct("doc", "text", "line")).alias("at"), F.first("bytes").alias("bytes")))
    both = pairs.join(known.select(F.col("hash").alias("x"), F.col("at").alias("x_at"), F.col("bytes").alias("x_bytes")), "x").join(known.select(F.col("hash").alias("y"), F.col("at").alias("y_at"), F.col("bytes").alias("y_bytes")), "y")
    ordered = both.select(F.greatest("x_at", "y_at").alias("gone"), F.least("x_at", "y_at").alias("kept"), "x_bytes", "y_bytes").select(*(F.col(f"{s}.{f}").alias(f"{t}{f}") for s, t in (("gone", ""), ("kept", "kept_")) for f in ("doc", "text", "line")), "x_bytes", "y_bytes")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n = edit_distances(*string_bytes(b.column(6)), *string_bytes(b.column(7)), edits)
                k = pa.array(np.flatnonzero(n <= edits))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(k) for c in range(6)), pa.array(n.astype(np.int32)).take(k)], [*names, "edits"])

    near = map_arrow(ordered, verify, f"{gone}, edits int")
    first = near.groupBy("doc", "text", "line").agg(F.min(F.struct("kept_doc", "kept_text", "kept_line", "edits")).alias("k"))
    return equal.unionByName(first.select("doc", "text", "line", "k.*")).drop("kept_text")


def drop_lines(text: list, gone: list) -> list:
    """Each text without the lines of these numbers; None where lines went and none is left."""
    out = []
    for t, g in zip(text, gone):
        if t is not None and g:
            lines, g = t.split("\n"), set(g)
            left = [x for k, x in enumerate(lines) if k not in g]
            t = "\n".join(left) if left else None
        out.append(t)
    return out


def without_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that repeat others. Columns as in docs."""
    names = docs.columns
    key, hash_, list_, flag = (fresh(docs, k) for k in ("key_of_lines", "text_of_lines", "gone_lines", "emptied"))
    gone = stored(repeated_lines(docs)).groupBy(F.col("doc").alias(key), F.col("text").alias(hash_)).agg(F.collect_list("line").alias(list_))
    joined = docs.join(gone.hint("shuffle_hash"), (id_key(docs) == F.col(key)) & (_text_hash(docs) == F.col(hash_)) & column(docs, "doc_id").isNotNull(), "left").drop(key, hash_)
    at, kind = names.index("text"), ", ".join(f"`{c.replace('`', '``')}` {f.dataType.simpleString()}" for c, f in zip(names, docs.schema))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = b.column(len(names)).is_valid()
            if not some.true_count:
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.zeros(b.num_rows, bool))], names=[*names, flag])
                continue
            was = b.column(at).to_pylist()
            now = drop_lines(was, b.column(len(names)).to_pylist())
            cols = list(b.columns[:-1])
            cols[at] = pa.array(now, b.column(at).type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array([w is not None and n is None for w, n in zip(was, now)])], names=[*names, flag])

    out = map_arrow(joined, cut, f"{kind}, {flag} boolean").filter(f"not {flag}").drop(flag)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length(column(out, "text")).cast(docs.schema["n_chars"].dataType))
    return out


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that goes, with the earlier line that it repeats."""
    return duplicates(table(spark, sf_dir, "documents"))
