"""Best-fit-decreasing packing of documents into sequences of a fixed capacity.

Sizes are UTF-8 bytes, the tokens of a byte-level model, and one more for the separator after each document. A text
of any length, if longer than `CAPACITY`, is first cut into pieces of CAPACITY and a rest. Pieces are taken from the largest to the
smallest; each goes into the open bin with the least remaining capacity that still holds it, or opens a bin. Bins are
kept by remaining capacity, and a segment tree over the capacities, each node marking whether a bin is open below it,
finds the tightest one in logarithmic time.

A shard of about `SHARD` pieces is packed by one task; shards are cut by a hash of doc_id, text, copy and piece, so the result is the
same on any cluster, and neither one row repeated in full nor one text of many pieces fills a shard. Only ids and sizes are moved, never texts. Full pieces need no search: each is a bin of its own.

Defined cases: a null text has no pieces; an empty one is a separator alone, a piece of size 1. Ties in size go by
(doc_id, nulls first; text hash; piece). Rows repeated in full are packed as often as they stand there; they are told
apart by `copy`. An empty table gives no bins. Other columns aren't used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.core import column, stored, table
from lexweave.ship import map_arrow

CAPACITY = 8192
SHARD = 100_000


class OpenBins:
    """Open bins by remaining capacity, under a segment tree that counts the open ones."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << max(1, capacity.bit_length())
        self.tree = bytearray(2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, left: int, number: int) -> None:
        self.bins[left].append(number)
        k, tree = left + self.leaves, self.tree
        while k and not tree[k]:
            tree[k] = 1
            k >>= 1

    def tightest(self, size: int) -> int:
        """The least remaining capacity of size or more that a bin has, or -1."""
        tree, k = self.tree, size + self.leaves
        while not tree[k]:
            while k & 1:  # a right child: what is to the right hangs off an ancestor
                k >>= 1
            if k == 0:
                return -1
            k += 1
            if k & (k - 1) == 0:  # past the end of this level
                return -1
        while k < self.leaves:
            k <<= 1
            if not tree[k]:
                k += 1
        return k - self.leaves

    def take(self, left: int) -> int:
        number = self.bins[left].pop()
        if not self.bins[left]:
            k, tree = left + self.leaves, self.tree
            tree[k] = 0
            k >>= 1
            while k and not (tree[2 * k] or tree[2 * k + 1]):
                tree[k] = 0
                k >>= 1
        return number


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; sizes go down and are from 1 to capacity."""
    bins, at = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    whole = int(np.searchsorted(-sizes, -capacity, side="right"))
    bins[:whole] = np.arange(whole)
    opened, free = whole, OpenBins(capacity)
    for k, size in enumerate(sizes[whole:].tolist(), whole):
        left = free.tightest(size)
        if left < 0:
            number, left = opened, capacity
            opened += 1
        else:
            number = free.take(left)
        bins[k], at[k] = number, capacity - left
        if left > size:
            free.put(left - size, number)
    return bins, at


def pieces(docs: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, text_hash, copy, piece, start, size): what is to be packed."""
    slim = docs.select(column(docs, "doc_id").alias("doc_id"), F.xxhash64(column(docs, "text")).alias("text_hash"), (F.octet_length(column(docs, "text")) + 1).alias("tokens")).filter("tokens is not null")
    same = slim.groupBy("doc_id", "text_hash", "tokens").agg(F.count("*").alias("copies"))
    each = same.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).withColumn("piece", F.explode(F.expr(f"sequence(0, cast((tokens - 1) div {capacity} as int))")))
    return each.select("doc_id", "text_hash", "copy", "piece", (F.col("piece").cast("bigint") * capacity).alias("start"), F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("int").alias("size"))


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(shard, bin, at, doc_id, copy, piece, start, size) of every piece; shard and bin name a sequence, at is the place in it."""
    all_pieces = stored(pieces(docs, capacity))
    shards = max(1, -(-all_pieces.count() // shard))
    kind = all_pieces.schema["doc_id"].dataType.simpleString()
    placed = all_pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_hash", "copy", "piece"), F.lit(shards)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, schema) if (batches := [b for b in batches if b.num_rows]) else None
        if rows is None:
            return
        rows = rows.sort_by([("shard", "ascending")])
        of = rows["shard"].to_numpy()
        cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True])
        for lo, hi in zip(cut[:-1], cut[1:]):
            t = rows.slice(lo, hi - lo)
            # one key at a time, the least first: each sort is stable
            order = np.argsort(t["piece"].to_numpy(), kind="stable")
            for key in (t["copy"], t["text_hash"]):
                order = order[np.argsort(key.to_numpy()[order], kind="stable")]
            ids = pa.compute.rank(t["doc_id"].combine_chunks(), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
            order = order[np.argsort(ids[order], kind="stable")]
            sizes = t["size"].to_numpy()
            order = order[np.argsort(-sizes[order].astype(np.int64), kind="stable")]
            bins, at = best_fit(sizes[order], capacity)
            t = t.take(pa.array(order))
            for b in pa.table([t["shard"], pa.array(bins.astype(np.int32)), pa.array(at.astype(np.int32)), t["doc_id"], t["copy"], t["piece"], t["start"], t["size"]], names=out).to_batches(max_chunksize=65536):
                yield b

    out = ["shard", "bin", "at", "doc_id", "copy", "piece", "start", "size"]
    moved = placed.repartition("shard")
    schema = pa.schema([("doc_id", _arrow(placed, "doc_id")), ("text_hash", pa.int64()), ("copy", pa.int32()), ("piece", pa.int32()), ("start", pa.int64()), ("size", pa.int32()), ("shard", pa.int32())])
    return map_arrow(moved, run, f"shard int, bin int, at int, doc_id {kind}, copy int, piece int, start bigint, size int")


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: the place of every piece of every document."""
    return pack(docs)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    return pack(table(spark, sf_dir, "documents"))
