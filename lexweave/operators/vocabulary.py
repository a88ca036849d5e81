"""Vocabulary induction: character counts, the keep-set, rare characters, n-gram candidates, pruning, selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lexweave.functions.text import characters, code_point
from lexweave.operators.lattice import Lattice, PieceTable, SpanHash, arrow_points, code_points, groups, slices, some_rows, string_array
from lexweave.ship import map_arrow
from lexweave.sources.corpus import spread

MIN_PROB = 1e-12
SMOOTHING = 0.1
BLOCK = 1_000_000  # characters that are counted at a time
WORD_BYTES = 16 << 20  # of lines whose words are counted at a time, but for a batch


def codepoint_counts(lines: DataFrame) -> DataFrame:
    """(cp, ch, cnt) of every character of the lines but NUL. Tasks send each character once."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for b in parts:
            points, offs = arrow_points(b.column(0))
            for lo, hi in slices(offs, BLOCK):
                here = np.bincount(points[offs[lo] : offs[hi]])
                total[: len(here)] += here
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), string_array(at.astype(np.uint32), np.arange(len(at) + 1)), pa.array(total[at])], ["cp", "ch", "cnt"])

    parts = map_arrow(lines.select("line"), count, "cp bigint, ch string, cnt bigint")
    return parts.groupBy("cp", "ch").agg(F.sum("cnt").alias("cnt")).filter("cp <> 0")


def char_vocab_size(char_vocab: int, target_vocab: int) -> int:
    """How many characters are kept, so that they don't use up the vocabulary."""
    if target_vocab > 0 and char_vocab >= target_vocab:
        char_vocab = target_vocab // 2 if target_vocab >= 512 else target_vocab - 1
    return max(char_vocab, 256)


def keep_chars(counts: DataFrame, char_vocab: int, fallback: str = "?") -> DataFrame:
    """(cp, ch): the fallback, printable ASCII, and the most frequent others up to char_vocab; of equal counts the lower code point."""
    spark = counts.sparkSession
    fixed = sorted({*range(0x20, 0x7F), ord(fallback)})
    always = spark.createDataFrame([(c, chr(c)) for c in fixed], "cp bigint, ch string")
    others = counts.filter(~F.col("cp").isin(9, 10, 13)).join(F.broadcast(always.select("cp")), "cp", "left_anti")
    ranked = others.withColumn("r", F.row_number().over(Window.orderBy(F.desc("cnt"), "cp"))).filter(F.col("r") <= max(0, char_vocab - len(fixed)))
    return always.unionByName(ranked.select("cp", "ch"))


def map_rare(lines: DataFrame, keep: DataFrame, fallback: str = "?") -> DataFrame:
    """The lines with characters outside the keep-set as the fallback. The keep-set has char_vocab members at most; a character is looked up in a table of all code points."""
    table = np.zeros(0x110000, bool)
    table[[r[0] for r in keep.select("cp").collect()]] = True
    shared = lines.sparkSession.sparkContext.broadcast(np.packbits(table))
    names = lines.columns
    at, other = names.index("line"), np.uint32(ord(fallback))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).view(bool)
        for b in parts:
            texts = b.column(at).to_pylist()
            points, offs = code_points([t or "" for t in texts])
            all_text = np.where(known[points], points, other).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            new = [None if t is None else all_text[lo:hi] for t, lo, hi in zip(texts, offs.tolist(), offs[1:].tolist())]
            cols = list(b.columns)
            cols[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return map_arrow(lines, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema))


def _starts(points: np.ndarray, filter_starts: str) -> np.ndarray:
    if filter_starts == "none":
        return np.ones(len(points), bool)
    ok = points != 32
    if filter_starts == "punct":
        for lo, hi in ((33, 47), (58, 64), (91, 96), (123, 126)):
            ok &= (points < lo) | (points > hi)
    return ok


def ngram_counts(lines: DataFrame, n_min: int = 2, n_max: int = 8, min_count: int = 50, fallback: str | None = None, filter_starts: str = "punct") -> DataFrame:
    """(n, piece, cnt): how often each run of n characters stands in the lines, overlapping ones too.

    Runs with NUL, white space or the fallback, and such that begin with ASCII punctuation, don't count. Blocks of lines
    are counted by numpy before the shuffle, so a piece crosses it once a block and not once an occurrence; a block has about `BLOCK` characters, whatever the lines' lengths.
    Where so many characters fit 64 bits, by their numbers in the block, these are what is sorted, else hashes.
    """
    bad = np.array([0, 9, 10, 13, 32, *([ord(fallback)] if fallback else [])], np.uint32)

    def counted(points: np.ndarray, offs: np.ndarray) -> Iterator[pa.RecordBatch]:
        left = np.repeat(offs[1:], np.diff(offs)) - np.arange(len(points))
        before = np.r_[0, np.cumsum(np.isin(points, bad))]
        begins = _starts(points, filter_starts)
        known = np.bincount(points) > 0
        letters = np.flatnonzero(known).astype(np.uint32)
        number = (np.cumsum(known) - 1)[points].astype(np.uint64)
        bits = np.uint64(max(1, (len(letters) - 1).bit_length()))
        spans = SpanHash(points) if n_max * int(bits) > 64 else None
        for n in range(n_min, n_max + 1):
            at = np.flatnonzero(begins & (left >= n))
            at = at[before[at + n] == before[at]]
            if not len(at):
                continue
            if n * int(bits) <= 64:
                key = number[at]
                for j in range(1, n):
                    key = key << bits | number[at + j]
                key.sort()
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                cnt, key = np.diff(np.append(first, len(key))), key[first]
                chars = np.stack([letters[(key >> np.uint64(j) * bits & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] for j in range(n - 1, -1, -1)], axis=1)
            else:
                _, first, cnt = np.unique(spans.of(at, n), return_index=True, return_counts=True)
                chars = points[at[first][:, None] + np.arange(n)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cnt), n)), string_array(chars.ravel(), np.arange(len(cnt) + 1) * n), pa.array(cnt)], ["n", "piece", "cnt"])

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def work() -> Iterator[pa.RecordBatch]:
            points, size = np.concatenate([x for x, _ in held]), np.concatenate([n for _, n in held])
            held.clear()
            yield from counted(points, np.r_[0, np.cumsum(size)])

        total = 0
        for b in parts:
            points, offs = arrow_points(b.column(0))
            for lo, hi in slices(offs, BLOCK):
                if offs[hi] > offs[lo]:
                    held.append((points[offs[lo] : offs[hi]], np.diff(offs[lo : hi + 1])))
                    total += int(offs[hi] - offs[lo])
                if total >= BLOCK // 2:
                    yield from work()
                    total = 0
        if held:
            yield from work()

    parts = map_arrow(spread(lines.select("line")), count, "n bigint, piece string, cnt bigint")
    return parts.groupBy("n", "piece").agg(F.sum("cnt").alias("cnt")).filter(F.col("cnt") >= min_count)


def _words_of(lines: DataFrame, emit, schema: str) -> DataFrame:
    """What emit(words as a dictionary and numbers in it, which of them begin a line) gives for blocks of lines; words are apart by blanks."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []

        def work() -> pa.RecordBatch:
            each = pc.split_pattern(pa.concat_arrays(held).drop_null(), " ")
            held.clear()
            words = each.flatten()
            size = pc.binary_length(words).to_numpy(zero_copy_only=False)
            keep = size > 0
            row = np.repeat(np.arange(len(each)), each.value_lengths().to_numpy(zero_copy_only=False))[keep]
            found = words.filter(pa.array(keep)).dictionary_encode()
            first = np.ones(len(row), bool)
            first[1:] = row[1:] != row[:-1]
            return emit(found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), first)

        total = 0
        for b in parts:
            held.append(b.column(0))
            total += b.column(0).nbytes
            if total >= WORD_BYTES:
                yield work()
                total = 0
        if held:
            yield work()

    return map_arrow(spread(lines.select("line")), count, schema)


def word_counts(lines: DataFrame) -> DataFrame:
    """(w, n): how often each word stands in the lines, and for null how many words there are. Tasks count blocks of lines, so that a word crosses the shuffle once a block at most."""

    def emit(words: pa.Array, number: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        n = np.append(np.bincount(number, minlength=len(words)), len(number))
        return pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.nulls(1, words.type)]), pa.array(n)], ["w", "n"])

    return _words_of(lines, emit, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))


PAIR, SECOND, OTHER = range(3)


def pair_counts(lines: DataFrame, frequent: list[str]) -> DataFrame:
    """(kind, key, n) of the pairs of words one after the other. PAIR: both are frequent, the key is the first one's number times their count and the second's number;
    SECOND: all pairs whose second word is frequent, by its number; OTHER: all others, by the second word's length in characters."""
    shared = lines.sparkSession.sparkContext.broadcast(pa.array(frequent, pa.string()))

    def emit(words: pa.Array, number: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        known, wide = pc.index_in(words, shared.value).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), len(shared.value)
        later = np.flatnonzero(~first)
        a, b = known[number[later - 1]], known[number[later]]
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)[number[later]]
        cols: list[list[np.ndarray]] = [[], [], []]
        for kind, key in ((PAIR, a[(a >= 0) & (b >= 0)] * wide + b[(a >= 0) & (b >= 0)]), (SECOND, b[b >= 0]), (OTHER, size[b < 0])):
            key, n = np.unique(key, return_counts=True)
            for c, x in zip(cols, (np.full(len(key), kind, np.int32), key, n)):
                c.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["kind", "key", "n"])

    return _words_of(lines, emit, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def top_per_length(counts: DataFrame, per_length: int) -> DataFrame:
    """The most frequent pieces of each length; of equal counts the first in order."""
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("cnt"), "piece"))
    return counts.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= per_length)


def candidates(counts: DataFrame, total: int = 50_000, max_len: int = 8) -> DataFrame:
    """(n, piece, cnt): the most frequent of all, after a limit for each length."""
    per = max(512, total // max(1, max_len - 1))
    return top_per_length(counts, per).drop("rank").orderBy(F.desc("cnt"), "n", "piece").limit(total)


def start_filter(counts: DataFrame) -> str:
    """Which characters may not begin a piece: ASCII punctuation and blanks, or blanks alone where nothing else is there, or none."""
    cp = F.col("cp")
    space = cp.isin(9, 10, 13, 32)
    punct = cp.between(33, 47) | cp.between(58, 64) | cp.between(91, 96) | cp.between(123, 126)
    plain, marks = counts.agg(F.count_if(~space & ~punct), F.count_if(punct)).first()
    return "punct" if plain else "space" if marks else "none"


def _last_needed(sizes: DataFrame, budget: int, ranges: int = 4096) -> int | None:
    """An integer doc_id up to which the bytes reach the budget with little over, or None where all are needed: sums of equal ranges of ids, then of the parts of the one where the budget ends."""
    lo, hi = sizes.agg(F.min("doc_id"), F.max("doc_id")).first()
    before = 0
    while lo is not None:
        width = (hi - lo) // ranges + 1
        part = F.expr(f"(doc_id - {lo}) div {width}")
        for k, n in sizes.filter(F.col("doc_id").between(lo, hi)).groupBy(part.alias("k")).agg(F.sum("bytes")).orderBy("k").collect():
            if before + n >= budget:
                lo, hi = lo + k * width, min(hi, lo + (k + 1) * width - 1)
                break
            before += n
        else:
            return None
        if width == 1 or n <= budget:
            return hi
    return None


def byte_budget(lines: DataFrame, budget: int) -> DataFrame:
    """The first lines, in the order of (doc_id, line_no), until their bytes and newlines reach the budget.

    With integer ids only the documents that the budget needs are ordered; the others are read for sums by ranges of ids.
    """
    sizes = lines.withColumn("bytes", F.octet_length("line") + 1)
    if isinstance(lines.schema["doc_id"].dataType, IntegralType) and (last := _last_needed(sizes, budget)) is not None:
        sizes = sizes.filter(F.col("doc_id") <= last)
    docs = sizes.groupBy("doc_id").agg(F.sum("bytes").alias("doc_bytes"))
    upto = docs.withColumn("before", F.sum("doc_bytes").over(Window.orderBy("doc_id")) - F.col("doc_bytes")).filter(F.col("before") < budget).drop("doc_bytes")
    inner = Window.partitionBy("doc_id").orderBy("line_no")
    some = sizes.join(upto, "doc_id").withColumn("at", F.col("before") + F.sum("bytes").over(inner) - F.col("bytes"))
    return some.filter(F.col("at") < budget).select("doc_id", "line_no", "line")


def vocabulary(singles: DataFrame, found: DataFrame) -> DataFrame:
    """(piece_id, piece, len_cp, mandatory, cnt, logp): characters and candidates, each piece once, ids in the order of pieces."""
    both = singles.select(F.col("ch").alias("piece"), "cnt", F.lit(True).alias("m")).unionByName(found.select("piece", "cnt", F.lit(False).alias("m")))
    one = both.groupBy("piece").agg(F.max("cnt").alias("cnt"), F.bool_or("m").alias("mandatory"))
    total = one.agg(F.sum("cnt").alias("total"))
    return one.crossJoin(F.broadcast(total)).select(
        (F.row_number().over(Window.orderBy("piece")) - 1).cast("bigint").alias("piece_id"), "piece", F.char_length("piece").cast("bigint").alias("len_cp"), "mandatory", "cnt", F.log(F.col("cnt") / F.col("total")).alias("logp")
    )


def settled(vocab: DataFrame) -> DataFrame:
    """A vocabulary as a table of its own, computed once. It has cand_total + char_vocab rows at most, however large the corpus."""
    return vocab.sparkSession.createDataFrame(vocab.toArrow(), vocab.schema).coalesce(1)


def normalized(vocab: DataFrame, logp: str = "logp", least: float = MIN_PROB) -> DataFrame:
    """Probabilities that sum to one, none under the floor: divided by their sum, raised to the floor, twice."""
    for _ in range(2):
        total = vocab.agg(F.sum(F.exp(logp)).alias("__total"))
        vocab = vocab.crossJoin(F.broadcast(total)).withColumn(logp, F.log(F.greatest(F.exp(logp) / F.col("__total"), F.lit(least)))).drop("__total")
    return vocab


def m_step(counts: DataFrame, smoothing: float = SMOOTHING, least: float = MIN_PROB) -> DataFrame:
    """logp from the column cnt of expected counts."""
    total = counts.agg(F.sum(F.col("cnt") + smoothing).alias("__sum"))
    p = F.greatest((F.col("cnt") + smoothing) / F.col("__sum"), F.lit(least))
    return normalized(counts.crossJoin(F.broadcast(total)).withColumn("logp", F.log(p)).drop("__sum"), least=least)


def char_costs(vocab: DataFrame) -> DataFrame:
    """(piece, char_cost): what a piece costs character by character; null where one isn't in the vocabulary."""
    single = vocab.filter("len_cp = 1").select(F.col("piece").alias("ch"), F.col("logp").alias("ch_logp"))
    each = vocab.select("piece", F.explode(characters(F.col("piece"))).alias("ch")).join(F.broadcast(single), "ch", "left")
    return each.groupBy("piece").agg(F.when(F.count("*") == F.count("ch_logp"), -F.sum("ch_logp")).alias("char_cost"))


def mdl_scores(vocab: DataFrame, lambda0: float, lambda_len: float) -> DataFrame:
    """vocab with keep_always and score: what a piece saves against its characters, less its own cost; null where a character is missing."""
    score = (F.col("char_cost") + F.col("logp")) * F.col("cnt") - (F.lit(lambda0) + F.lit(lambda_len) * F.col("len_cp"))
    return vocab.join(char_costs(vocab), "piece").select(vocab["*"], (F.col("mandatory") | (F.col("len_cp") <= 1)).alias("keep_always"), score.alias("score"))


def mdl_prune(vocab: DataFrame, target: int = 0, lambda0: float = 0.0, lambda_len: float = 0.15) -> DataFrame:
    """The pieces that are kept: mandatory ones, and the best others up to the target size (even at a negative score) or, without a target, those of positive score. Renormalised, ids anew."""
    scored = mdl_scores(vocab, lambda0, lambda_len)
    always, other = scored.filter("keep_always"), scored.filter("not keep_always and score is not null")
    if target > 0:
        room = F.broadcast(always.agg((F.lit(target) - F.count("*")).alias("room")))
        rank = F.row_number().over(Window.orderBy(F.desc(F.round("score", 6)), "piece"))
        other = other.withColumn("__r", rank).crossJoin(room).filter(F.col("__r") <= F.col("room")).drop("__r", "room")
    elif lambda0 > 0 or lambda_len > 0:
        other = other.filter("score > 0")
    kept = always.unionByName(other).drop("keep_always", "score")
    return renumbered(normalized(kept))


def renumbered(vocab: DataFrame) -> DataFrame:
    return vocab.withColumn("piece_id", (F.row_number().over(Window.orderBy("piece")) - 1).cast("bigint"))


def export_selection(vocab: DataFrame, keep_single_top: int = 400) -> DataFrame:
    """All pieces of two characters or more and the most likely single ones, their logp unchanged."""
    single = Window.orderBy(F.desc(F.round(F.exp("logp"), 15)), "piece_id")
    top = vocab.filter("len_cp < 2").withColumn("__r", F.row_number().over(single)).filter(F.col("__r") <= keep_single_top).drop("__r")
    return renumbered(vocab.filter("len_cp >= 2").unionByName(top))


def span_counts(lines: DataFrame, pieces: list[str], max_len: int) -> DataFrame:
    """(len, piece_id, n): how many spans of each length are each piece, -1 for those of no piece. Every task sends a row a piece, not one a span."""
    shared = lines.sparkSession.sparkContext.broadcast(pieces)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable(shared.value)
        total = np.zeros((max_len, len(shared.value) + 1), np.int64)
        for b in parts:
            points, offs = arrow_points(b.column(0))
            for part in groups(np.diff(offs)):
                lat = Lattice(some_rows(points, offs, part), table, max_len)
                for k in range(max_len):
                    total[k] += np.bincount(lat.ids[k][lat.pos > k] + 1, minlength=total.shape[1])
        k, piece = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k + 1), pa.array(piece - 1), pa.array(total[k, piece])], ["len", "piece_id", "n"])

    parts = map_arrow(spread(lines.select("line")), count, "len bigint, piece_id bigint, n bigint")
    return parts.groupBy("len", "piece_id").agg(F.sum("n").alias("n"))


def spans(lines: DataFrame, max_len: int) -> DataFrame:
    """(doc_id, line_no, start, len, piece) of every span of at most max_len characters, by built-in functions alone."""
    chars = spread(lines).select("doc_id", "line_no", characters(F.col("line")).alias("c"))
    start = chars.select("doc_id", "line_no", "c", F.explode(F.sequence(F.lit(1), F.size("c"))).alias("s"))
    window = start.select("doc_id", "line_no", (F.col("s") - 1).alias("start"), F.expr(f"slice(c, s, {max_len})").alias("w"))
    each = window.select("doc_id", "line_no", "start", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("len"))
    return each.select("doc_id", "line_no", F.col("start").cast("bigint").alias("start"), F.col("len").cast("bigint").alias("len"), F.array_join(F.expr("slice(w, 1, len)"), "").alias("piece"))

