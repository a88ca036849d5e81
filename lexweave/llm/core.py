"""What the operators share: Arrow text as numpy bytes, word hashes, the shared folder, sizes.

A word is a run of letters, digits and non-ASCII bytes; ASCII and Latin-1 capitals count as small letters.
All arithmetic is modulo 2**64 on whole Arrow batches; no Python object is made for a word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

CHUNK_BYTES = 2 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    word = np.zeros(256, bool)
    low = np.arange(256, dtype=np.uint8)
    for lo, hi in ((48, 57), (65, 90), (97, 122), (128, 255)):
        word[lo : hi + 1] = True
    low[65:91] += 32
    return word, low


IS_WORD, LOWER = _byte_classes()
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """P**0 .. P**(n-1) modulo 2**64; the table grows by doubling."""
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * (_powers[-1:] * _P)])
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def string_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's offsets; a null is a row of no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer text is a range by itself."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


class Words(NamedTuple):
    hash: np.ndarray  # uint64 of each word
    start: np.ndarray  # first byte
    size: np.ndarray  # bytes
    rows: np.ndarray  # offsets into the words, one more than rows


def words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray = IS_WORD, lower: bool = True) -> Words:
    """The words of each row, in order."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(z.astype(np.uint64), z, z, np.zeros(len(offs), np.int64))
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offs[:-1][offs[:-1] < n]
    first[edges] = inside[edges]
    at = np.flatnonzero(inside)
    start = np.flatnonzero(first)
    if len(start) == 0:
        z = np.zeros(0, np.int64)
        return Words(z.astype(np.uint64), z, z, np.zeros(len(offs), np.int64))
    into = np.searchsorted(at, start)
    size = np.diff(np.append(into, len(at)))
    letters = data[at]
    if lower:
        letters = LOWER[letters]
        latin = np.flatnonzero((letters[1:] >= 0x80) & (letters[1:] <= 0x9E) & (letters[1:] != 0x97) & (letters[:-1] == 0xC3)) + 1
        letters[latin] += 0x20
    value = _BYTE[letters]
    value *= powers(int(size.max()))[np.arange(len(at)) - np.repeat(into, size)]
    h = mix(np.add.reduceat(value, into) + size.astype(np.uint64))
    return Words(h, start, size, np.searchsorted(start, offs))


def grams(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word runs within each row, and the rows' offsets into them."""
    if n == 1:
        return h, rows
    count = np.maximum(np.diff(rows) - (n - 1), 0)
    out = np.concatenate([[0], np.cumsum(count)])
    if out[-1] == 0:
        return np.zeros(0, np.uint64), out
    at = np.arange(out[-1]) + np.repeat(rows[:-1] - out[:-1], count)
    g = np.zeros(out[-1], np.uint64)
    for k in range(n):
        g = g * _P + h[at + k]
    return mix(g), out


def distinct_in_rows(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values and their offsets."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(rows)))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir; a folder of this machine only where that is unset, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lexweave-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def stored(df: DataFrame) -> DataFrame:
    """df as a table written once to the shared folder and read again: its lineage ends there, and losing an executor loses nothing."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/lexweave-{uuid.uuid4().hex}.parquet"
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # once the table is written, nothing reads the shuffles that led to it
    try:
        df.write.parquet(at)
    finally:
        spark.conf.set(CLEANUP, was)
    out = spark.read.parquet(at)
    out._lexweave_at = at
    return out


def forget(df: DataFrame) -> None:
    """Deletes the files of a table from stored() that nothing will read any more."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df._lexweave_at)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(df: DataFrame, name: str):
    """A column by its exact name, also when other columns differ from it only in case or hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_key(docs: DataFrame) -> Column:
    """A number for each doc_id that tells them apart and puts them in order: integers by value, others by their 64-bit hash."""
    id_ = column(docs, "doc_id")
    return id_.cast("bigint") if isinstance(docs.schema["doc_id"].dataType, IntegralType) else F.xxhash64(id_)


def with_ids(found: DataFrame, docs: DataFrame, keys: dict[str, str]) -> DataFrame:
    """found with the documents' own ids, under new names, in place of columns of id_key()s."""
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, IntegralType):
        return found.withColumns({k: F.col(k).cast(kind) for k in keys}).withColumnsRenamed(keys)
    ids = docs.select(id_key(docs).alias("k"), column(docs, "doc_id").alias("id")).filter("id is not null").distinct()
    for k, name in keys.items():
        found = found.join(ids.select(F.col("k").alias(k), F.col("id").alias(name)), k).drop(k)
    return found


class Prefix:
    """Hashes of any byte ranges of a buffer in constant time each, by a polynomial's prefix sums modulo 2**64."""

    INVERSE = pow(int(_P), -1, 1 << 64)
    _back = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(len(data)), out=self.sums[1:])
        cls = Prefix
        while len(cls._back) <= len(data):
            cls._back = np.concatenate([cls._back, cls._back * (cls._back[-1:] * np.uint64(cls.INVERSE))])

    def hash(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * self._back[start] + size.astype(np.uint64))


class Runs(Prefix):
    """Hashes of any runs of words, from the words' hashes."""

    def __init__(self, hashes: np.ndarray) -> None:
        super().__init__(np.zeros(len(hashes), np.uint8))
        np.cumsum(hashes * powers(len(hashes)), out=self.sums[1:])


class Buckets:
    """Records on their way to the reducers: packed arrays, split by a hash, sent as one binary value a bucket and kind."""

    SCHEMA = "bucket int, kind int, block binary"

    def __init__(self, count: int, most: int = 48 << 20) -> None:
        self.count, self.most, self.held, self.bytes = count, most, {}, 0

    def add(self, kind: int, by: np.ndarray, records: np.ndarray) -> None:
        if len(records):
            self.held.setdefault(kind, []).append(((by % np.uint64(self.count)).astype(np.int32), records))
            self.bytes += records.nbytes

    def full(self) -> bool:
        return self.bytes > self.most

    def flush(self) -> Iterator[pa.RecordBatch]:
        for kind, parts in self.held.items():
            to, records = np.concatenate([t for t, _ in parts]), np.concatenate([r for _, r in parts])
            order = np.argsort(to, kind="stable")
            to, records = to[order], records[order]
            cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            size = records.dtype.itemsize
            offs = np.append(cut, len(to)).astype(np.int64) * size
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(offs), pa.py_buffer(records.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(to[cut]), pa.array(np.full(len(cut), kind, np.int32)), data], ["bucket", "kind", "block"])
        self.held, self.bytes = {}, 0


def by_bucket(batches: Iterator[pa.RecordBatch], kinds: dict[int, np.dtype]) -> Iterator[dict[int, np.ndarray]]:
    """A partition's records of each kind, bucket after bucket."""
    blocks: dict[int, dict[int, list[bytes]]] = {}
    for b in batches:
        for to, kind, block in zip(*(c.to_pylist() for c in b.columns)):
            blocks.setdefault(to, {}).setdefault(kind, []).append(block)
    for to in sorted(blocks):
        got = blocks.pop(to)
        yield {k: np.frombuffer(b"".join(got.get(k, [])), t) for k, t in kinds.items()}


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(blocks: DataFrame) -> DataFrame:
    """The blocks, each bucket in one partition, buckets spread evenly."""
    return blocks.repartitionById(partitions(blocks.sparkSession), "bucket") if hasattr(blocks, "repartitionById") else blocks.repartition(partitions(blocks.sparkSession), "bucket")
