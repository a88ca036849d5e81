"""Matroska: parse EBML elements, clusters, lacing and cues into packet tables.

`packets` parses one file a row (a binary column) and gives a row for each frame: track, timestamp, byte range, flags.
Element ids and sizes are variable-length integers of 1 to 8 bytes; segments and clusters may have unknown size, and then
end where an element of their own level or above begins. SimpleBlocks and BlockGroups are read, with no lacing, Xiph, fixed
size and EBML lacing, and EncryptedBlocks. Timestamps are nanoseconds: (cluster + block) times the segment's TimestampScale, and within a laced
block one DefaultDuration of the track after the other; what a segment says of its scale and tracks holds for its own packets alone, also for those before it. A packet is `cued` if a cue point names its cluster, track and time.
`encoding` says how the track's frames are stored: 'zlib', 'bzlib', 'lzo', 'strip' (`prefix` has the bytes that were taken off each frame's
beginning) or 'encrypted'; null for plain ones. The EBML header's limits on the lengths of ids and sizes are kept. CRC-32 elements that stand first in an element of a segment are checked.

The tables hold no media, so `muxed` makes a file of each document: its UTF-8 text in frames of two tracks, with each
kind of lacing, clusters of known and of unknown size, Void and CRC-32 elements, and cues. The packets' byte ranges then
give the text back, byte by byte.

Defined cases: a null file gives one row with error 'null', an empty one 'empty', one that doesn't begin with an EBML header
'not ebml'; a file that ends within an element, or with a size or lacing that can't be, gives the packets before that place
and one more row, with offset at it and error 'truncated', 'size' or 'lacing'; an element whose CRC-32 isn't that of its content is read all the same, and one
more row has its offset and the error 'crc'. A file is one binary value, of any length that Spark holds, and is parsed as a whole. Frames of no bytes are packets like others. A
file of no packets and no error gives no rows. Repeated rows are parsed each; an empty table gives an empty table. Other
columns aren't touched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexweave.llm.core import column, table
from lexweave.ship import map_arrow

EBML, SEGMENT, CLUSTER, CUES, INFO, TRACKS = 0x1A45DFA3, 0x18538067, 0x1F43B675, 0x1C53BB6B, 0x1549A966, 0x1654AE6B
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_TYPE, CODEC, DURATION = 0x2AD7B1, 0xAE, 0xD7, 0x83, 0x86, 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
VOID, CRC32, ENCRYPTED_BLOCK = 0xEC, 0xBF, 0xAF
ENCODINGS, ENCODING, COMPRESSION, ALGORITHM, SETTINGS, ENCRYPTION = 0x6D80, 0x6240, 0x5034, 0x4254, 0x4255, 0x5035
MAX_ID, MAX_SIZE = 0x42F2, 0x42F3
COMPRESSIONS = ("zlib", "bzlib", "lzo", "strip")
LEVEL_0 = {EBML, SEGMENT}
LEVEL_1 = {CLUSTER, CUES, INFO, TRACKS, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS}
UNKNOWN = -1
LACING = ("none", "xiph", "fixed", "ebml")


class Broken(Exception):
    def __init__(self, at: int, why: str) -> None:
        super().__init__(why)
        self.at, self.why = at, why


def read_id(d: bytes, at: int, end: int, most: int = 4) -> tuple[int, int]:
    """An element id, its marker bits kept, and where it ends."""
    if at >= end:
        raise Broken(at, "truncated")
    n = 9 - d[at].bit_length()
    if n > most:
        raise Broken(at, "size")
    if at + n > end:
        raise Broken(at, "truncated")
    return int.from_bytes(d[at : at + n], "big"), at + n


def read_size(d: bytes, at: int, end: int, most: int = 8) -> tuple[int, int]:
    """A variable-length integer without its marker, UNKNOWN if all its bits are set, and where it ends."""
    if at >= end:
        raise Broken(at, "truncated")
    n = 9 - d[at].bit_length()
    if n > most:
        raise Broken(at, "size")
    if at + n > end:
        raise Broken(at, "truncated")
    mask = (1 << 7 * n) - 1
    value = int.from_bytes(d[at : at + n], "big") & mask
    return (UNKNOWN if value == mask else value), at + n


def number(d: bytes, at: int, end: int) -> int:
    return int.from_bytes(d[at:end], "big")


def elements(d: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, first byte, first byte of the content, its end) of the elements of known size from at to end."""
    while at < end:
        start = at
        name, at = read_id(d, at, end)
        size, body = read_size(d, at, end)
        if size == UNKNOWN:
            raise Broken(start, "size")
        if body + size > end:
            raise Broken(start, "truncated")
        yield name, start, body, body + size
        at = body + size


def frames_of(d: bytes, at: int, end: int) -> tuple[int, int, int, int, list[tuple[int, int]]]:
    """(track, timestamp, flags, lacing, [(offset, size)]) of a block's content."""
    begin = at
    track, at = read_size(d, at, end)
    if track == UNKNOWN or at + 3 > end:
        raise Broken(begin, "truncated")
    time = int.from_bytes(d[at : at + 2], "big", signed=True)
    flags = d[at + 2]
    at += 3
    lacing = flags >> 1 & 3
    if lacing == 0:
        return track, time, flags, 0, [(at, end - at)]
    if at >= end:
        raise Broken(begin, "lacing")
    count = d[at] + 1
    at += 1
    sizes = []
    if lacing == 2:
        if (end - at) % count:
            raise Broken(begin, "lacing")
        sizes = [(end - at) // count] * count
    else:
        size = 0
        for k in range(count - 1):
            if lacing == 1:
                size = 0
                while True:
                    if at >= end:
                        raise Broken(begin, "lacing")
                    size += d[at]
                    at += 1
                    if d[at - 1] < 255:
                        break
            else:
                from_ = at
                value, at = read_size(d, at, end)
                n = at - from_
                if value == UNKNOWN:
                    value = (1 << 7 * n) - 1
                size = value if k == 0 else size + value - ((1 << 7 * n - 1) - 1)
            if size < 0:
                raise Broken(begin, "lacing")
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
        if sizes[-1] < 0:
            raise Broken(begin, "lacing")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return track, time, flags, lacing, out


class Parser:
    """One file's packets. rows: (track, timestamp ns, keyframe, lacing, frame within its block, offset, size, cluster offset, ticks, encoding, prefix)."""

    def __init__(self, d: bytes) -> None:
        self.d, self.rows, self.error, self.crc = d, [], None, []
        self.cues, self.segment, self.most = set(), 0, (4, 8)
        self.begin()
        try:
            if not d:
                raise Broken(0, "empty")
            if d[:4] != b"\x1a\x45\xdf\xa3":
                raise Broken(0, "not ebml")
            self.top(0, len(d))
        except Broken as e:
            self.error = (e.at, e.why)
            try:
                self.settle()
            except Broken as f:
                self.error = (f.at, f.why)

    def begin(self) -> None:
        """Another segment: nothing is known of its scale and tracks."""
        self.scale, self.durations, self.encodings, self.blocks = 1_000_000, {}, {}, []

    def settle(self) -> None:
        """The packets of the segment's blocks, by what it says of its tracks."""
        blocks, self.blocks = self.blocks, []
        for at, track, ticks, key, lacing, frames, lasts, cluster, hidden in blocks:
            step = self.durations.get(track, 0) or (lasts * self.scale // len(frames) if lasts else 0)
            ns = ticks * self.scale
            if track >= 1 << 31 or not -(1 << 62) < ns + step * len(frames) < 1 << 62:
                raise Broken(at, "size")
            encoding, prefix = self.encodings.get(track, (None, None))
            for k, (o, n) in enumerate(frames):
                self.rows.append((track, ns + k * step, key, lacing, k, o, n, cluster, ticks, "encrypted" if hidden else encoding, prefix))

    def top(self, at: int, end: int) -> None:
        while at < end:
            start = at
            name, at = read_id(self.d, at, end, self.most[0])
            size, body = read_size(self.d, at, end, self.most[1])
            if name == SEGMENT:
                self.segment = body
                self.begin()
                at = self.inside(body, end if size == UNKNOWN else min(end, body + size), size == UNKNOWN)
                self.settle()
            elif size == UNKNOWN:
                raise Broken(start, "size")
            else:
                if name == EBML and body + size <= end:
                    limits = {n: number(self.d, b, e) for n, _, b, e in elements(self.d, body, body + size) if n in (MAX_ID, MAX_SIZE)}
                    self.most = min(8, max(4, limits.get(MAX_ID, 4))), min(8, max(1, limits.get(MAX_SIZE, 8)))
                at = body + size
            if size != UNKNOWN and body + size > end:
                raise Broken(start, "truncated")

    def inside(self, at: int, end: int, open_: bool) -> int:
        """A segment's elements; returns where it ends."""
        while at < end:
            start = at
            name, after = read_id(self.d, at, end, self.most[0])
            if open_ and name in LEVEL_0:
                return start
            size, body = read_size(self.d, after, end, self.most[1])
            stop = min(end, body + size) if size != UNKNOWN else end
            if size != UNKNOWN and body + size <= end:
                self.checked(start, body, stop)
            if name == CLUSTER:
                at = self.cluster(start, body, stop, size == UNKNOWN)
            elif size == UNKNOWN:
                raise Broken(start, "size")
            else:
                if body + size <= end:
                    if name == INFO:
                        for n, _, b, e in elements(self.d, body, stop):
                            if n == SCALE:
                                self.scale = number(self.d, b, e)
                    elif name == TRACKS:
                        self.tracks(body, stop)
                    elif name == CUES:
                        self.cue_points(body, stop)
                at = body + size
            if size != UNKNOWN and body + size > end:
                raise Broken(start, "truncated")
        return at

    def checked(self, start: int, body: int, stop: int) -> None:
        """Notes an element whose CRC-32, if it has one in front, isn't that of the rest."""
        if self.d[body : body + 2] == b"\xbf\x84" and body + 6 <= stop and zlib.crc32(memoryview(self.d)[body + 6 : stop]) != int.from_bytes(self.d[body + 2 : body + 6], "little"):
            self.crc.append(start)

    def tracks(self, at: int, end: int) -> None:
        for name, _, body, stop in elements(self.d, at, end):
            if name == TRACK_ENTRY:
                found = {n: number(self.d, b, e) for n, _, b, e in elements(self.d, body, stop) if n in (TRACK_NUMBER, DURATION)}
                if TRACK_NUMBER in found:
                    self.durations[found[TRACK_NUMBER]] = found.get(DURATION, 0)
                    for n, _, b, e in elements(self.d, body, stop):
                        if n == ENCODINGS:
                            self.encodings[found[TRACK_NUMBER]] = self.encoding(b, e)

    def encoding(self, at: int, end: int) -> tuple[str | None, bytes | None]:
        """How frames are stored by a list of encodings: encrypted, or the first compression."""
        out = None, None
        for name, _, body, stop in elements(self.d, at, end):
            for n, _, b, e in elements(self.d, body, stop) if name == ENCODING else ():
                if n == ENCRYPTION:
                    return "encrypted", None
                if n == COMPRESSION and out[0] is None:
                    parts = {m: (x, y) for m, _, x, y in elements(self.d, b, e)}
                    kind = number(self.d, *parts[ALGORITHM]) if ALGORITHM in parts else 0
                    lo, hi = parts.get(SETTINGS, (0, 0))
                    if kind < len(COMPRESSIONS):
                        out = COMPRESSIONS[kind], self.d[lo:hi] if kind == 3 else None
        return out

    def cue_points(self, at: int, end: int) -> None:
        for name, _, body, stop in elements(self.d, at, end):
            if name != CUE_POINT:
                continue
            time, places = 0, []
            for n, _, b, e in elements(self.d, body, stop):
                if n == CUE_TIME:
                    time = number(self.d, b, e)
                elif n == CUE_POSITIONS:
                    f = {m: number(self.d, x, y) for m, _, x, y in elements(self.d, b, e)}
                    places.append((f.get(CUE_TRACK), f.get(CUE_CLUSTER)))
            self.cues.update((track, time, self.segment + at_) for track, at_ in places if at_ is not None)

    def cluster(self, start: int, at: int, end: int, open_: bool) -> int:
        base = 0
        while at < end:
            here = at
            name, after = read_id(self.d, at, end, self.most[0])
            if open_ and (name in LEVEL_1 or name in LEVEL_0):
                return here
            size, body = read_size(self.d, after, end, self.most[1])
            if size == UNKNOWN:
                raise Broken(here, "size")
            stop = body + size
            if stop > end:
                raise Broken(here, "truncated")
            if name == TIMESTAMP:
                base = number(self.d, body, stop)
            elif name == SIMPLE_BLOCK:
                self.block(body, stop, base, start, None)
            elif name == ENCRYPTED_BLOCK:
                self.block(body, stop, base, start, None, hidden=True)
            elif name == BLOCK_GROUP:
                block, key, lasts = None, True, None
                for n, _, b, e in elements(self.d, body, stop):
                    if n == BLOCK:
                        block = (b, e)
                    elif n == REFERENCE:
                        key = False
                    elif n == BLOCK_DURATION:
                        lasts = number(self.d, b, e)
                if block:
                    self.block(*block, base, start, key, lasts)
            at = stop
        return at

    def block(self, at: int, end: int, base: int, cluster: int, key: bool | None, lasts: int | None = None, hidden: bool = False) -> None:
        track, time, flags, lacing, frames = frames_of(self.d, at, end)
        self.blocks.append((at, track, base + time, bool(flags & 0x80) if key is None else key, lacing, frames, lasts, cluster, hidden))


COLUMNS = "packet int, track int, timestamp_ns bigint, keyframe boolean, lacing string, frame int, offset bigint, size bigint, cluster bigint, cued boolean, encoding string, prefix binary, error string"
_KINDS = (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.binary(), pa.string())


def parse(d: bytes | None) -> list[tuple]:
    """A file's rows of COLUMNS."""
    if d is None:
        return [(0, *[None] * 11, "null")]
    p = Parser(d)
    rows = [(k, t, ns, key, LACING[lace], f, o, n, c, f == 0 and (t, tick, c) in p.cues, how, prefix, None) for k, (t, ns, key, lace, f, o, n, c, tick, how, prefix) in enumerate(p.rows)]
    for at, why in [*((at, "crc") for at in p.crc), *([p.error] if p.error else [])]:
        rows.append((len(rows), None, None, None, None, None, at, *[None] * 5, why))
    return rows


def packets(files: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """(key, the COLUMNS of each packet) of every file in a binary column."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, of = [], []
            for k, d in enumerate(b.column(1)):
                found = parse(d.as_py())
                rows.extend(found)
                of.extend([k] * len(found))
                if len(rows) > 50_000:
                    yield _batch(b, rows, of)
                    rows, of = [], []
            if rows:
                yield _batch(b, rows, of)

    def _batch(b: pa.RecordBatch, rows: list, of: list) -> pa.RecordBatch:
        cols = [pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)]
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int32())), *cols], names=[key, *(x.split(" ")[0] for x in COLUMNS.split(", "))])

    return map_arrow(files.select(column(files, key).alias(key), column(files, media).alias("media")), run, f"`{key}` {kind}, {COLUMNS}")


# --- writing


def vint(value: int, least: int = 1) -> bytes:
    n = least
    while value >= (1 << 7 * n) - 1:
        n += 1
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(name: int, body: bytes, width: int = 1) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + vint(len(body), width) + body


def integer(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], lacing: int) -> bytes:
    """The content of a block after its flags."""
    if lacing == 0:
        return frames[0]
    head = bytes([len(frames) - 1])
    if lacing == 1:
        for f in frames[:-1]:
            head += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif lacing == 3:
        head += vint(len(frames[0]))
        for a, b in zip(frames, frames[1:-1]):
            diff, n = len(b) - len(a), 1
            while not -((1 << 7 * n - 1) - 1) <= diff <= (1 << 7 * n - 1) - 1:
                n += 1
            head += (diff + (1 << 7 * n - 1) - 1 | 1 << 7 * n).to_bytes(n, "big")
    return head + b"".join(frames)


FRAME = 400
PER_CLUSTER = 24
HEADER = element(EBML, integer(0x4286, 1) + integer(0x42F7, 1) + integer(0x42F2, 4) + integer(0x42F3, 8) + element(0x4282, b"matroska") + integer(0x4287, 4) + integer(0x4285, 2))


def with_crc(content: bytes) -> bytes:
    return element(CRC32, zlib.crc32(content).to_bytes(4, "little")) + content


HEAD = element(INFO, with_crc(integer(SCALE, 1_000_000))) + element(
    TRACKS, element(TRACK_ENTRY, integer(TRACK_NUMBER, 1) + integer(TRACK_TYPE, 1) + element(CODEC, b"V_UNCOMPRESSED")) + element(TRACK_ENTRY, integer(TRACK_NUMBER, 2) + integer(TRACK_TYPE, 2) + integer(DURATION, 20_000_000) + element(CODEC, b"A_PCM/INT/LIT"))
)


def mux(data: bytes, frame: int = FRAME) -> bytes:
    """A Matroska file whose packets, in order, hold the bytes of data."""
    blocks, at, k = [], 0, 0
    while at < len(data):
        lacing = k % 4
        count = 1 if lacing == 0 else 2 + k % 3
        parts = []
        for j in range(count):
            n = frame if lacing in (0, 2) else frame // 2 + (k * 37 + j * 61) % frame
            parts.append(data[at : at + n])
            at += n
        parts = [p for p in parts if p] or [b""]
        if lacing == 2 and len({len(p) for p in parts}) > 1:
            lacing = 1
        if len(parts) == 1:
            lacing = 0
        blocks.append((1 if k % 2 == 0 else 2, k, lacing, parts))
        k += 1
    body, cues = [HEAD], []
    place = len(HEAD)
    for c in range(0, len(blocks), PER_CLUSTER):
        group = blocks[c : c + PER_CLUSTER]
        first = group[0][1] * 40
        inner = [integer(TIMESTAMP, first)]
        for track, n, lacing, parts in group:
            key = n % 8 == 0
            head = vint(track) + (n * 40 - first).to_bytes(2, "big", signed=True)
            content = laced(parts, lacing)
            if n % 5 == 4:
                inner.append(element(BLOCK_GROUP, element(BLOCK, head + bytes([lacing << 1]) + content) + integer(BLOCK_DURATION, 40) + (b"" if key else element(REFERENCE, b"\xd8"))))
            else:
                inner.append(element(SIMPLE_BLOCK, head + bytes([(0x80 if key else 0) | lacing << 1]) + content, 1 + n % 3))
            if key:
                cues.append(element(CUE_POINT, integer(CUE_TIME, n * 40) + element(CUE_POSITIONS, integer(CUE_TRACK, track) + integer(CUE_CLUSTER, place))))
        content = b"".join(inner)
        known = c // PER_CLUSTER % 2 == 0
        whole = element(CLUSTER, with_crc(content), 4) if known else CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + content
        if known:
            whole += element(VOID, bytes(c % 7))
        body.append(whole)
        place += len(whole)
    if cues:
        body.append(element(CUES, b"".join(cues)))
    content = b"".join(body)
    return HEADER + element(SEGMENT, content, 8)


def muxed(docs: DataFrame) -> DataFrame:
    """(doc_id, media): a file of each document's text; null for a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                files = [None if t is None else mux(t.encode()) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(files, pa.binary())], ["doc_id", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "text").alias("text")), run, f"doc_id {kind}, media binary")


def op1_matroska_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packet of a file made of each document."""
    return packets(muxed(table(spark, sf_dir, "documents")))
