"""Suffix-array dedup: passages of `WORDS` words or more that repeat across documents, found by external induced sorting.

Two passages of WORDS words that are equal have the same least hash among their runs of `RUN` words. Texts are cut where
that least hash changes as a window moves over them, so equal passages meet at the same hash wherever they stand. Hashes
that only one document has lead nowhere. The distinct pieces of text of all others, each with the WORDS - 1 words after it and the first document that has it, go to the
shard of their hash, once from each task, and there their suffixes are sorted, with common-prefix values (see induced.py);
neighbours that agree in WORDS words are the same passage. What is found of a piece is joined to all documents that have it, so neither a hash nor a piece that a third of them share is one task's work. There are as many shards as keep one at about `SHARD` words. A shard's queues move to files in the
shared folder where they pass `MEMORY` tuples; its text, suffix order and prefix values stay in memory, some 100 bytes a word.

A passage is a repeat in every document that has it but the one of the lowest doc_id; repeats within one document alone
don't count. Rows are maximal: of consecutive places whose passage the same document has first.

Defined cases: a null or wordless text, or one of fewer than WORDS words, has no repeats. Documents with a null doc_id are
left out; integers are in order by value, ids of other types by their 64-bit hash. A text of any length is cut into pieces in memory, as one row of a batch.
Equal hashes of 64 bits stand for equal pieces. In a shard words are told apart by 32 bits of their hashes, so that two passages that differ in one word are taken for equal in one of 2**32 cases. Rows of equal doc_id are one document, so rows repeated in full aren't repeats of each other, and one row is given
for all of them. Other columns aren't used. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.core import _P, Runs, chunks, column, grams, id_key, mix, partitions, shared_dir, stored, string_bytes, table, with_ids, words
from lexweave.llm.induced import suffix_array_lcp
from lexweave.llm.suffixes import joined
from lexweave.ship import map_arrow

WORDS = 50
RUN = 8
SHARD = 2_000_000

REMEMBERED = 1_000_000  # pieces that a task knows it has sent
PIECE = np.dtype([("content", "u8"), ("doc", "i8"), ("place", "i4"), ("places", "i4")])
TOKEN = np.dtype("u4")
SPAN = np.dtype([("doc", "i8"), ("place", "i4"), ("places", "i4"), ("first", "i8"), ("first_place", "i4")])


def sliding_least(g: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    have, m = 1, g
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(g) - width + 1], m[width - have :]) if width > have else m


def pieces(h: np.ndarray, rows: np.ndarray, most: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first place, number of places, least hash) of the stretches of places that have one least hash; a place begins `most` words."""
    g, g_rows = grams(h, rows, run)
    width = most - run + 1
    count = np.maximum(np.diff(rows) - (most - 1), 0)
    total = np.concatenate([[0], np.cumsum(count)])
    if not total[-1]:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    least = sliding_least(g, width)
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(total[-1]) - total[row]
    least = least[g_rows[:-1][row] + place]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], place[at], np.diff(np.append(at, len(least))), least[at]


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .., all in one."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def spans_of(piece: np.ndarray, tokens: np.ndarray, most: int, sort=suffix_array_lcp) -> tuple[np.ndarray, np.ndarray]:
    """A shard's distinct contents, and SPANs of places in them, `doc` being a content's number, by the first document that has each place."""
    size = piece["places"].astype(np.int64) + most - 1
    offs = np.r_[0, np.cumsum(size)]
    # of a content that several tasks sent, the first document's
    order = np.lexsort((piece["place"], piece["doc"], piece["content"]))
    one = order[np.flatnonzero(np.r_[True, piece["content"][order][1:] != piece["content"][order][:-1]])]
    rows = np.r_[0, np.cumsum(size[one])]
    text, _ = joined(tokens[_ragged(offs[one], size[one])], rows)
    sa, common = sort(text, most)
    begin = rows[:-1] + np.arange(len(one))
    which = np.searchsorted(begin, sa, side="right") - 1
    off = sa - begin[which]
    at = np.flatnonzero(off < piece["places"][one][which])
    # neighbours agree as far as all suffixes from the one to the other do
    same = np.minimum.reduceat(common[: at[-1] + 1], at[:-1] + 1) >= most if len(at) > 1 else np.zeros(0, bool)
    which, off = which[at], off[at]
    group = np.r_[0, np.cumsum(~same)]
    cut = np.flatnonzero(np.r_[True, ~same])
    doc, place = piece["doc"][one][which], piece["place"][one][which] + off
    first = np.minimum.reduceat(doc, cut)
    at_first = np.where(doc == first[group], place, np.iinfo(np.int64).max)
    return piece["content"][one], runs(which, off, first[group], np.minimum.reduceat(at_first, cut)[group])


def runs(doc: np.ndarray, place: np.ndarray, first: np.ndarray, first_place: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
    """Single places, or spans of them, as the longest spans of places that one and the same document has first; first_place is that of a span's first place."""
    places = np.ones(len(doc), np.int64) if places is None else places
    order = np.lexsort((-places, place, first, doc))
    doc, place, first, first_place, places = (x[order].astype(np.int64) for x in (doc, place, first, first_place, places))
    same = np.zeros(len(doc), bool)
    same[1:] = (doc[1:] == doc[:-1]) & (first[1:] == first[:-1])
    # the greatest end so far within a document and its first one
    base = np.cumsum(~same) * (np.int64(1) << 32)
    end = np.maximum.accumulate(base + place + places) - base
    same[1:] &= place[1:] <= end[:-1]
    at = np.flatnonzero(~same)
    out = np.empty(len(at), SPAN)
    out["doc"], out["place"], out["first"], out["first_place"] = doc[at], place[at], first[at], first_place[at]
    out["places"] = np.maximum.reduceat(end, at) - place[at] if len(at) else 0
    return out


def unpacked(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces and their tokens, of blocks that hold how many bytes of pieces there are, the pieces and the tokens."""
    size = [int.from_bytes(x[:8], "little") for x in blocks]
    return np.frombuffer(b"".join(x[8 : 8 + n] for x, n in zip(blocks, size)), PIECE), np.frombuffer(b"".join(x[8 + n :] for x, n in zip(blocks, size)), TOKEN)


class Sent:
    """Which pieces a task has sent, of those that stand in its texts again and again, and with which document."""

    def __init__(self) -> None:
        self.least: dict[int, int] = {}

    def new(self, content: np.ndarray, doc: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Which of these distinct contents must be sent: those that weren't, or not with so low a document."""
        out = np.ones(len(content), bool)
        for k in np.flatnonzero(count > 1).tolist():
            c, d = int(content[k]), int(doc[k])
            if self.least.get(c, d + 1) <= d:
                out[k] = False
            else:
                if len(self.least) >= REMEMBERED:
                    self.least = {}
                self.least[c] = d
        return out


def repeated(docs: DataFrame, most: int = WORDS, run: int = RUN, shard: int = SHARD) -> DataFrame:
    """(doc_id, start_word, words, first_doc_id, first_start_word) of every repeat."""
    count, folder = partitions(docs.sparkSession), shared_dir(docs.sparkSession)
    slim = docs.select(id_key(docs).alias("doc_id"), column(docs, "text").alias("text")).filter("doc_id is not null and text is not null")

    def cut(b: pa.RecordBatch) -> Iterator[tuple]:
        data, offs = string_bytes(b.column(1))
        for lo, hi in chunks(offs):
            w = words(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            yield lo, w, pieces(w.hash, w.rows, most, run)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo, _, (row, _, _, least) in cut(b):
                if len(row):
                    both = np.unique(np.stack([ids[lo + row].view(np.uint64), least]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(both[1].view(np.int64)), pa.array(both[0].view(np.int64))], ["least", "doc"])

    found = stored(map_arrow(slim, anchors, "least bigint, doc bigint"))
    shared = found.groupBy("least").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("least")
    of_doc = stored(found.join(shared, "least").groupBy("doc").agg(F.collect_list("least").alias("leasts")))
    # a hash that documents share leads to a piece of some 75 words in each
    hits = of_doc.agg(F.sum(F.size("leasts").cast("bigint"))).first()[0] or 0
    shards = max(count, -(-hits * (most + (most - run) // 2) // shard))
    some = slim.join(of_doc.hint("shuffle_hash"), slim["doc_id"] == of_doc["doc"]).select("doc_id", "text", "leasts")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of kind 0: a document's piece by its content; of kind 1: a block of distinct pieces for a shard."""
        sent, held, names = Sent(), [], ["kind", "content", "doc", "place", "bucket", "block"]
        for b in batches:
            ids = b.column(0).to_numpy()
            lists = b.column(2)
            begin = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            leasts = lists.flatten().to_numpy().view(np.uint64)
            for lo, w, (row, place, places, least) in cut(b):
                n = len(w.rows) - 1
                here = leasts[begin[lo] : begin[lo + n]]
                wanted = mix(here ^ (np.repeat(np.arange(n, dtype=np.uint64), np.diff(begin[lo : lo + n + 1])) * _P))
                ok = np.flatnonzero(np.isin(mix(least ^ (row.astype(np.uint64) * _P)), wanted))
                if not len(ok):
                    continue
                size = places[ok] + most - 1
                start = w.rows[row[ok]] + place[ok]
                content = Runs(w.hash).hash(start, size)
                doc = ids[lo + row[ok]]
                zero = pa.nulls(len(ok), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ok), np.int32)), pa.array(content.view(np.int64)), pa.array(doc), pa.array(place[ok].astype(np.int32)), zero, pa.nulls(len(ok), pa.binary())], names)
                order = np.lexsort((place[ok], doc, content))
                cut_ = np.flatnonzero(np.r_[True, content[order][1:] != content[order][:-1]])
                k = order[cut_]
                k = k[sent.new(content[k], doc[k], np.diff(np.append(cut_, len(order))))]
                p = np.empty(len(k), PIECE)
                p["content"], p["doc"], p["place"], p["places"] = content[k], doc[k], place[ok[k]], places[ok[k]]
                held.append((mix(least[ok[k]]) % np.uint64(shards), p, w.hash[_ragged(start[k], size[k])].astype(TOKEN)))
            if sum(t.nbytes for _, _, t in held) > 48 << 20:
                yield flushed(held, names)
                held = []
        if held:
            yield flushed(held, names)

    def flushed(held: list, names: list[str]) -> pa.RecordBatch:
        to, p, t = (np.concatenate([h[k] for h in held]) for k in range(3))
        size = p["places"].astype(np.int64) + most - 1
        offs = np.r_[0, np.cumsum(size)]
        order = np.argsort(to, kind="stable")
        t = t[_ragged(offs[:-1][order], size[order])]
        to, p, ends = to[order], p[order], np.cumsum(size[order])
        cuts = np.append(np.flatnonzero(np.r_[True, to[1:] != to[:-1]][: len(to)]), len(to))
        begin = np.r_[0, ends]
        blocks = [(c := p[a:b].tobytes(), len(c).to_bytes(8, "little"))[1] + c + t[begin[a] : begin[b]].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        n = len(blocks)
        return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), *(pa.nulls(n, pa.int64()) for _ in range(2)), pa.nulls(n, pa.int32()), pa.array(to[cuts[:-1]].astype(np.int32)), pa.array(blocks, pa.binary())], names)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for to, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(to, []).append(block)
        for to in sorted(held):
            content, s = spans_of(*unpacked(held.pop(to)), most, lambda t, n: suffix_array_lcp(t, n, folder))
            cols = content[s["doc"]].view(np.int64), s["place"], s["places"], s["first"], s["first_place"]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in cols], ["content", "off", "places", "first", "first_place"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            s = runs(*(np.concatenate([b.column(k).to_numpy() for b in got]) for k in range(5)))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (s["doc"], s["place"], s["places"] + (most - 1), s["first"], s["first_place"])], ["doc", "start_word", "words", "first", "first_start_word"])

    parts = stored(map_arrow(some, send, "kind int, content bigint, doc bigint, place int, bucket int, block binary"))
    blocks = parts.filter("kind = 1").select("bucket", "block").repartitionById(shards, "bucket")
    spans = stored(map_arrow(blocks, sort, "content bigint, off int, places int, first bigint, first_place int"))
    # a piece's places in all its documents but the first that have them
    each = parts.filter("kind = 0").select("content", "doc", "place").join(spans, "content").filter("first < doc")
    places = each.select("doc", (F.col("place") + F.col("off")).alias("place"), "first", "first_place", "places")
    out = map_arrow(places.repartition("doc"), merge, "doc bigint, start_word int, words int, first bigint, first_start_word int")
    return with_ids(out, docs, {"doc": "doc_id", "first": "first_doc_id"}).select("doc_id", "start_word", "words", "first_doc_id", "first_start_word")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage that repeats one of a document before it."""
    return repeated(table(spark, sf_dir, "documents"))
