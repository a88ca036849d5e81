"""Near-duplicate groups from SimHash fingerprints, found in hierarchical indexes over Gray order.

A fingerprint has 128 bits: for every distinct word of a text, each bit of the word's hash votes.
Each of some tables permutes the bits and splits the fingerprints by the leading bits of
their Gray rank. Within a part they are sorted by Gray rank, so neighbours share most bits; every
`FAN` neighbours become a node that holds the bits on which they all agree, wherever these are, and parents factor out
what their children share in turn. A query walks down from the roots and adds up the differences on
each node's own bits; once they exceed the radius, the whole group below is pruned. A leaf's own bits are added
in two halves, so that nearly all that are left are pruned before their second half is read.

How many leading bits split the fingerprints follows from their number, so that a part holds some ten of them on average, and
the number of tables from that: as many as two fingerprints at exactly the radius need to meet in one of them with
probability `RECALL`. Closer ones meet more surely. Work so grows with a power of the number of fingerprints of about 1.3, not 2.

What the tables leave out is found exactly (`missed`), so that no link within the radius is lost: the bits are cut into pieces, of which one at least differs
in no more than its share of the radius (shares and pieces add up to radius + 1), and in blocks of fingerprints all values so near to a query's piece are looked up. Only links between
components that the tables left apart count; buckets that are wholly of the query's own component are passed over. Blocks of `BLOCK` fingerprints meet in pairs;
within one the work grows with a power of about 1.5, beyond that with the square of their number, at some hundredth of all pairs.

Only distinct fingerprints enter the index, so copies by the thousand cost one entry. Pairs within
the radius are joined to connected components; what a task finds leaves it as a star for each of its own components, never as all pairs.

Defined cases: a null, empty or wordless text has no fingerprint (null) and is always kept, in a group
of its own (group_id = doc_id). Order within a group is (doc_id, nulls last; text hash); the first
stays. Rows equal in doc_id and text are copies, of which the stage keeps the one whose other columns have the least hash. Other columns are passed
on as they are. A text of any length is read whole, as one row of a batch. An empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from lexweave.llm.core import chunks, column, distinct_in_rows, forget, fresh, mix, shared_dir, stored, string_bytes, table, words
from lexweave.ship import map_arrow

BITS = 128
RADIUS = 22
RECALL = 0.92
PART = 16  # fingerprints of a part, on average, if all parts were alike
FAN = 8
BLOCK = 1 << 20  # fingerprints of a block that is searched exactly
SLICE = 1 << 14  # queries of a task, at least, where there are that many
WIDEST = 22  # bits of a piece that are looked up
MOST = 1 << 20  # pairs looked at in one go


def sizing(n: int, radius: int) -> tuple[int, int]:
    """Leading bits and tables for so many fingerprints."""
    prefix = max(16, min(40, n.bit_length() - PART.bit_length() + 1))
    same = np.prod(1 - radius / (BITS - np.arange(prefix)))
    return prefix, int(np.ceil(np.log(1 - RECALL) / np.log1p(-same)))


def fingerprint_rows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16 bytes a row, and which rows have words."""
    n = len(offs) - 1
    out = np.zeros((n, BITS // 8), np.uint8)
    some = np.zeros(n, bool)
    for lo, hi in chunks(offs):
        w = words(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        h, rows = distinct_in_rows(w.hash, w.rows)
        count = np.diff(rows)
        full = np.flatnonzero(count)
        if len(full) == 0:
            continue
        both = np.stack([h, mix(h ^ np.uint64(0x5851F42D4C957F2D))], axis=1).astype(">u8").view(np.uint8).reshape(len(h), 16)
        for a, b in chunks(rows, 1 << 15):
            rows_here = full[(full >= a) & (full < b)]
            if len(rows_here):
                votes = np.add.reduceat(np.unpackbits(both[rows[a] : rows[b]], axis=1), rows[rows_here] - rows[a], axis=0, dtype=np.int32)
                out[lo + rows_here] = np.packbits(votes * 2 > count[rows_here, None], axis=1)
        some[lo + full] = True
    return out, some


def fixed_binary(rows: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    n, size = rows.shape
    offs = np.arange(n + 1, dtype=np.int32) * size
    bits = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [bits, pa.py_buffer(offs.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def codes_of(col: pa.Array) -> np.ndarray:
    _, offs, data = col.buffers()
    start = np.frombuffer(offs, np.int32)[col.offset] if len(col) else 0
    return np.frombuffer(data, np.uint8)[start : start + 16 * len(col)].reshape(-1, 16) if len(col) else np.zeros((0, 16), np.uint8)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, code) of every row; code is null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, some = fingerprint_rows(*string_bytes(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fixed_binary(code, some)], ["doc_id", "text_hash", "code"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select(column(docs, "doc_id").alias("doc_id"), F.xxhash64(column(docs, "text")).alias("text_hash"), column(docs, "text").alias("text"))
    return map_arrow(slim, run, f"doc_id {kind}, text_hash bigint, code binary")


def permutations(tables: int) -> np.ndarray:
    rng = np.random.default_rng(77)
    return np.stack([rng.permutation(BITS) for _ in range(tables)])


def permuted(code: np.ndarray, order: np.ndarray) -> np.ndarray:
    return np.packbits(np.unpackbits(code, axis=1)[:, order], axis=1)


def two_words(code: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(code).view(">u8").astype(np.uint64)


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The place of each 128-bit code (two words) in the reflected Gray sequence."""
    hi, lo = code[:, 0].copy(), code[:, 1].copy()
    for s in (1, 2, 4, 8, 16, 32):
        s_, r_ = np.uint64(s), np.uint64(64 - s)
        lo ^= (lo >> s_) | (hi << r_)
        hi ^= hi >> s_
    lo ^= hi
    return np.stack([hi, lo], axis=1)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1, dtype=np.int16)


class Forest:
    """One index tree per group over codes that are sorted by (group, Gray rank)."""

    def __init__(self, code: np.ndarray, group: np.ndarray) -> None:
        n = len(code)
        self.code, self.visits = code, 0  # visits: leaves that are read to the end
        same, first_leaf = code, np.arange(n)
        mask = np.full_like(code, np.uint64(0xFFFFFFFFFFFFFFFF))
        below, masks = [], [mask]
        nodes, patterns, leaves = group, [same], [first_leaf]
        while True:
            starts = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
            rank = np.arange(len(nodes)) - np.repeat(starts, np.diff(np.r_[starts, len(nodes)]))
            cut = np.flatnonzero(rank % FAN == 0)
            both = np.bitwise_and.reduceat(patterns[-1], cut, axis=0)
            any_ = np.bitwise_or.reduceat(patterns[-1], cut, axis=0)
            agree = np.bitwise_and.reduceat(masks[-1], cut, axis=0) & ~(both ^ any_)
            below.append(np.r_[cut, len(nodes)])
            masks.append(agree)
            patterns.append(both & agree)
            leaves.append(leaves[-1][cut])
            nodes = nodes[cut]
            if len(nodes) == len(starts):
                break
        self.below, self.patterns, self.leaves = below, patterns, leaves
        self.own = []  # each node's bits without its parent's
        for level, m in enumerate(masks):
            if level + 1 < len(masks):
                parent = np.repeat(masks[level + 1], np.diff(below[level]), axis=0)
                self.own.append(m & ~parent)
            else:
                self.own.append(m)
        self.roots = np.repeat(np.arange(len(nodes)), np.diff(np.r_[leaves[-1], n]))

    def pairs(self, q: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(a, b), a < b, for each of the codes a = q."""
        node, level = self.roots[q], len(self.patterns) - 1
        sofar = np.zeros(len(q), np.int16)
        while True:
            if level == 0:
                for half in (0, 1):
                    differ = (self.code[q, half] ^ self.code[node, half]) & self.own[0][node, half]
                    sofar = sofar + np.bitwise_count(differ)
                    go = (sofar <= radius) & (node > q)
                    q, node, sofar = q[go], node[go], sofar[go]
                    self.visits += len(q) if half == 0 else 0
                return q, node
            sofar = sofar + popcount((self.code[q] ^ self.patterns[level][node]) & self.own[level][node])
            last = np.r_[self.leaves[level][1:], len(self.code)] - 1
            go = (sofar <= radius) & (last[node] > q)
            q, node, sofar = q[go], node[go], sofar[go]
            level -= 1
            a, b = self.below[level][node], self.below[level][node + 1]
            n = b - a
            node = np.arange(n.sum()) + np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n)
            q, sofar = np.repeat(q, n), np.repeat(sofar, n)


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each item's component."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        live = x != y
        a, b = a[live], b[live]
        lo, hi = np.minimum(x, y)[live], np.maximum(x, y)[live]
        np.minimum.at(label, hi, lo)
        while not (label == (up := label[label])).all():
            label = up


def links(key: np.ndarray, code: np.ndarray, orders: np.ndarray, prefix: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a partition's (group key, code) rows: each code that has a neighbour, with its component's representative."""
    order = np.argsort(key, kind="stable")
    key, code = key[order], code[order]
    n = np.diff(np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]))
    many = np.repeat(n, n) > 1
    key, code = key[many], code[many]
    if len(key) == 0:
        return code, code
    plain = two_words(code)
    ids = np.unique(code.view("V16").ravel(), return_inverse=True)
    found_a, found_b = [], []
    for t in np.unique(key >> prefix):
        at = np.flatnonzero(key >> prefix == t)
        rank = gray_rank(two_words(permuted(code[at], orders[t])))
        at = at[np.lexsort((rank[:, 1], rank[:, 0], key[at]))]
        forest = Forest(plain[at], key[at])
        sizes = np.diff(np.flatnonzero(np.r_[True, key[at][1:] != key[at][:-1], True]))
        work = np.r_[0, np.cumsum(np.repeat(sizes, sizes))]
        for lo, hi in chunks(work, 1 << 20):
            a, b = forest.pairs(np.arange(lo, hi), radius)
            found_a.append(ids[1][at[a]])
            found_b.append(ids[1][at[b]])
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    root = roots_of(len(ids[0]), a, b)
    some = np.unique(np.r_[a, b])
    some = some[root[some] != some]
    flat = ids[0].view(np.uint8).reshape(-1, 16)
    return flat[root[some]], flat[some]


def edges(codes: DataFrame, radius: int, prefix: int, tables: int) -> DataFrame:
    """(a, b): links between distinct codes that connect every found pair's component."""
    orders = permutations(tables)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = codes_of(b.column(0))
            for t in range(tables):
                lead = two_words(permuted(code, orders[t]))[:, 0] >> np.uint64(64 - prefix)
                yield pa.RecordBatch.from_arrays([pa.array(lead.astype(np.int64) + (t << prefix)), b.column(0)], ["key", "code"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), codes_of(b.column(1)).copy()) for b in batches if b.num_rows]
        if got:
            a, b = links(np.concatenate([k for k, _ in got]), np.concatenate([c for _, c in got]), orders, prefix, radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([fixed_binary(a), fixed_binary(b)], ["a", "b"])

    spread_out = map_arrow(codes, spread, "key bigint, code binary")
    return map_arrow(spread_out.repartition("key"), search, "a binary, b binary").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, by alternating large and small stars; each round is written to the shared folder.

    A node's least neighbour is an aggregate that tasks add up before the shuffle, and is joined to its links, so a hub is never one task's work.
    """
    now = stored(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    size = now.count()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = stored(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(least.select("u", F.col("m").alias("v")).unionByName(small).distinct())
        forget(large)
        count = new.count()
        done = count == size and new.exceptAll(now).isEmpty()
        forget(now)
        now, size = new, count
        if done:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def pieces(n: int, radius: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, share) of the pieces: two codes within the radius differ in no more than its share in one of them; as many as cost least among n codes."""

    def cut(count: int) -> list[tuple[int, int, int]]:
        at = np.arange(count + 1) * BITS // count
        wide = np.diff(at)
        share = np.full(count, (radius + 1) // count - 1)
        share[np.argsort(-wide, kind="stable")[: (radius + 1) % count]] += 1
        return [(int(a), int(min(w, WIDEST)), int(s)) for a, w, s in zip(at, wide, share)]

    def cost(got: list[tuple[int, int, int]]) -> float:
        return sum(comb(w, k) * (1 + n / 2**w) for _, w, s in got for k in range(min(s, w) + 1))

    return min(map(cut, range(1, min(radius + 1, BITS) + 1)), key=cost)


def piece(two: np.ndarray, at: int, wide: int) -> np.ndarray:
    end = at + wide
    if end <= 64:
        v = two[:, 0] >> np.uint64(64 - end)
    elif at >= 64:
        v = two[:, 1] >> np.uint64(128 - end)
    else:
        v = (two[:, 0] << np.uint64(end - 64)) | (two[:, 1] >> np.uint64(128 - end))
    return (v & np.uint64((1 << wide) - 1)).astype(np.int64)


def changes(wide: int, most: int) -> Iterator[int]:
    """All numbers of so many bits of which at most `most` are set; 0 first, one after those without its highest bit."""
    now = [(0, 0)]
    yield 0
    for bit in range(wide):
        new = [(m | 1 << bit, k + 1) for m, k in now if k < most]
        yield from (m for m, _ in new)
        now += new


def across(q: np.ndarray, q_root: np.ndarray, x: np.ndarray, x_root: np.ndarray, radius: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (of q, of x) within the radius whose roots differ, some more than once; codes and roots as two words. at: where the q stand in x, if they do, so that each pair is looked at from one side."""
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if not len(q) or not len(x):
        return found_a[0], found_b[0]
    for first, wide, share in pieces(len(x), radius):
        key, of = piece(x, first, wide), piece(q, first, wide)
        order, mine = np.argsort(key, kind="stable"), np.argsort(of, kind="stable")
        starts = np.r_[0, np.cumsum(np.bincount(key, minlength=1 << wide))].astype(np.int32)
        x0, x1, of = x[order, 0].copy(), x[order, 1].copy(), of[mine]
        q0, q1 = q[mine, 0].copy(), q[mine, 1].copy()
        root, q_of = x_root[order], q_root[mine]
        bucket = np.flatnonzero(np.diff(starts) > FAN)
        whole = np.zeros(1 << wide, bool)  # large buckets of one component
        if len(bucket):
            sorted_key = key[order]
            same = np.ones(1 << wide, bool)
            differs = (root[1:] != root[:-1]).any(axis=1) & (sorted_key[1:] == sorted_key[:-1])
            same[sorted_key[1:][differs]] = False
            whole[bucket] = same[bucket]
        some = whole.any()
        half, top = np.arange(len(of)), -1
        for change in changes(wide, share):
            if at is not None and change.bit_length() != top:
                top = change.bit_length()
                half = np.flatnonzero((of >> (top - 1)) & 1 == 0) if top else np.arange(len(of))
            to = of[half] ^ change
            lo = starts[to]
            n = starts[to + 1] - lo
            if some:
                own = np.flatnonzero(whole[to])
                n[own[(root[lo[own]] == q_of[half[own]]).all(axis=1)]] = 0
            total = np.r_[0, np.cumsum(n, dtype=np.int64)]
            for i, j in chunks(total, MOST) if total[-1] else ():
                a = np.repeat(half[i:j], n[i:j])
                b = np.arange(total[j] - total[i]) + np.repeat(lo[i:j] - (total[i:j] - total[i]), n[i:j])
                near = np.bitwise_count(q0[a] ^ x0[b])
                go = np.flatnonzero(near <= radius)
                a, b, near = a[go], b[go], near[go]
                go = near + np.bitwise_count(q1[a] ^ x1[b]) <= radius
                a, b = a[go], b[go]
                go = (q_of[a] != root[b]).any(axis=1)
                found_a.append(mine[a[go]])
                found_b.append(order[b[go]])
    return np.concatenate(found_a), np.concatenate(found_b)


def missed(rooted: DataFrame, count: int, radius: int, block: int = BLOCK, slice_: int = SLICE) -> DataFrame:
    """(a, b): links between the roots of (code, root) rows that connect all components with a pair of codes within the radius. Blocks of codes are files in the shared folder."""
    spark, folder = rooted.sparkSession, shared_dir(rooted.sparkSession)
    blocks = max(1, -(-count // block))
    slices = max(1, min(32 // blocks, -(-count // (blocks * slice_))))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [np.hstack([codes_of(b.column(0)), codes_of(b.column(1))]) for b in batches if b.num_rows]
        if got:
            files, base = fs.FileSystem.from_uri(folder)
            name = f"{base}/codes-{uuid.uuid4().hex}"
            with files.open_output_stream(name) as f:
                f.write(np.concatenate(got).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    put = rooted.withColumn("to", F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int")).repartitionById(blocks, "to").select("code", "root")
    names = [r["name"] for r in map_arrow(put, write, "name string").collect()]  # a name for each block
    pairs = [(i, j, k) for i in range(len(names)) for j in range(i + 1) for k in range(slices)]
    shared = spark.sparkContext.broadcast((names, pairs))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(folder)

        def read(name: str) -> np.ndarray:
            with files.open_input_stream(name) as f:
                return np.frombuffer(f.read(), ">u8").astype(np.uint64).reshape(-1, 4)

        for b in batches:
            for k in b.column(0).to_pylist():
                names, pairs = shared.value
                i, j, k = pairs[k]
                x = read(names[j])
                at = np.arange(k, len(x), slices) if i == j else None
                q = x[at] if i == j else read(names[i])[k::slices]
                a, b = across(q[:, :2], q[:, 2:], x[:, :2], x[:, 2:], radius, at)
                if len(a):
                    both = np.unique(np.hstack([q[a, 2:], x[b, 2:]]), axis=0).astype(">u8").view(np.uint8).reshape(-1, 32)
                    yield pa.RecordBatch.from_arrays([fixed_binary(both[:, :16]), fixed_binary(both[:, 16:])], ["a", "b"])

    return map_arrow(spark.range(0, len(pairs), 1, max(1, len(pairs))), search, "a binary, b binary").distinct()


def linked(codes: DataFrame, radius: int) -> DataFrame:
    """(node, root): the component of every code, by all pairs within the radius."""
    count = codes.count()
    of = components(edges(codes, radius, *sizing(count, radius)))
    first = stored(codes.join(of, codes["code"] == of["node"], "left").select("code", F.coalesce("root", "code").alias("root")))
    more = stored(missed(first, count, radius))
    if more.isEmpty():
        return first.withColumnRenamed("code", "node")
    up = components(more).select(F.col("node").alias("low"), F.col("root").alias("high"))
    return first.join(up, first["root"] == up["low"], "left").select(F.col("code").alias("node"), F.coalesce("high", "root").alias("root"))


def groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_hash, code, group_id, links, copies, keep): group_id is the doc_id that stays, links the other rows of the group, copies the rows that are equal in doc_id and text."""
    prints = stored(fingerprints(docs))
    marked = prints.filter("code is not null")
    codes = stored(marked.select("code").distinct())
    of = linked(codes, radius)
    rooted = marked.join(of, marked["code"] == of["node"], "left").select("doc_id", "text_hash", "code", F.coalesce("root", "code").alias("root"))
    order = F.struct(F.isnull("doc_id").alias("late"), "doc_id", "text_hash")
    best = rooted.groupBy(F.col("root").alias("best_root")).agg(F.min(order).alias("best"), (F.count("*") - 1).alias("links"))
    rows = rooted.groupBy("doc_id", "text_hash", "code", "root").agg(F.count("*").alias("copies"))
    joined = rows.join(best, rows["root"] == best["best_root"]).select("doc_id", "text_hash", "code", F.col("best.doc_id").alias("group_id"), "links", "copies", (F.col("best") == order).alias("keep"))
    alone = prints.filter("code is null").groupBy("doc_id", "text_hash", "code").agg(F.count("*").alias("copies"))
    return joined.unionByName(alone.select("doc_id", "text_hash", "code", F.col("doc_id").alias("group_id"), F.lit(0).cast("bigint").alias("links"), "copies", F.lit(True).alias("keep")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which each group keeps one; texts without words all stay. Columns as in docs."""
    found = stored(groups(docs)).filter("code is not null")
    d, h, n = (fresh(docs, k) for k in ("doc_of", "hash_of", "place_of"))
    gone = found.filter("not keep").select(F.col("doc_id").alias(d), F.col("text_hash").alias(h))
    here = F.xxhash64(column(docs, "text"))
    same = column(docs, "doc_id").eqNullSafe(F.col(d)) & (here == F.col(h))
    rest = docs.join(gone, same, "left_anti")
    again = found.filter("keep and copies > 1").select(F.col("doc_id").alias(d), F.col("text_hash").alias(h))
    if again.isEmpty():
        return rest
    all_ = F.xxhash64(*(column(docs, f.name) for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))))
    one = rest.join(again, same, "left_semi").withColumn(n, F.row_number().over(Window.partitionBy(column(docs, "doc_id"), here).orderBy(all_))).filter(F.col(n) == 1).drop(n)
    return rest.join(again, same, "left_anti").unionByName(one)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group, how many others are in it, and whether it stays."""
    return groups(table(spark, sf_dir, "documents")).select("doc_id", "group_id", "links", "keep")
