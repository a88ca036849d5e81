"""Training: EM with description-length pruning for the unigram model, and the two-label boundary CRF."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.text import ClassRange, char_class, characters, code_point
from lexweave.operators import lattice as L
from lexweave.operators import vocabulary as V
from lexweave.ship import map_arrow
from lexweave.sources.corpus import corpus_lines, spread, with_eol, within_limits


@dataclass(frozen=True)
class TrainConfig:
    vocab: int = 8000
    max_piece_len: int = 8
    iters: int = 5
    sample_bytes: int = 20_000_000
    cand_total: int = 50_000
    min_count: int = 50
    char_vocab: int = 6000
    fallback_char: str = "?"
    max_line_bytes: int = 4096
    max_sentence_cp: int = 2048
    skip_long_cp: bool = True
    precheck_lines: int = 5000
    keep_single_top: int = 400
    unk_base: float = -5.0
    unk_per_cp: float = -1.0
    lambda0: float = 1.0
    mdl_lambda0: float = 0.0
    mdl_lambda_len: float = 0.15
    crf_epochs: int = 20
    crf_opt: str = "lbfgs"
    crf_lr: float = 0.05
    crf_l2: float = 1e-4
    crf_lbfgs_m: int = 8
    crf_tol: float = 1e-4
    crf_unsupervised: bool = False
    crf_unsup_sentences: int = 1000
    lossless_ws: bool = False  # marks the model, so that its users encode white space
    encode_corpus: bool = False  # encodes the lines to train on, too
    lossless_eol: bool = False  # ends each line with the sign for its newline
    cc_mode: str = "compat"
    cc_ranges: tuple[ClassRange, ...] = ()
    cc_fallback: str = "utf8len"

    def classes(self, cp: Column) -> Column:
        return char_class(cp, self.cc_mode, self.cc_ranges, self.cc_fallback)


class NoCover(ValueError):
    """Some line can't be made of the vocabulary's pieces."""


# --- unigram model


def e_step(lines: DataFrame, pieces: list[str], logp: np.ndarray, max_len: int) -> DataFrame:
    """(piece_id, cnt): expected uses of each piece; at -1 the sum of log Z, -2 sentences, -3 expected tokens, -4 sentences that nothing covers.

    Every task sums its own lines and sends a row a piece.
    """
    shared = lines.sparkSession.sparkContext.broadcast((pieces, logp))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lp = shared.value
        table = L.PieceTable(names)
        counts, more = np.zeros(len(lp)), np.zeros(4)
        for b in batches:
            points, offs = L.arrow_points(b.column(0))
            for part in L.groups(np.diff(offs)):
                lat = L.Lattice(L.some_rows(points, offs, part), table, max_len)
                c, *rest = L.expected_counts(lat, lp)
                counts += c
                more += rest
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1, -2, -3, -4]), pa.array(np.r_[counts[some], more])], ["piece_id", "cnt"])

    parts = map_arrow(spread(lines.select("line")), work, "piece_id bigint, cnt double")
    return parts.groupBy("piece_id").agg(F.sum("cnt").alias("cnt"))


def uncovered(lines: DataFrame, vocab: DataFrame) -> DataFrame:
    """(ch, lines): characters of the lines that aren't in the vocabulary, and in how many lines they stand."""
    each = lines.select("doc_id", "line_no", F.explode(F.array_distinct(characters(F.col("line")))).alias("ch"))
    return each.join(F.broadcast(vocab.select(F.col("piece").alias("ch"))), "ch", "left_anti").groupBy("ch").agg(F.count("*").alias("lines"))


def first_lines(lines: DataFrame, n: int) -> DataFrame:
    return lines.orderBy("doc_id", "line_no").limit(n)


def precheck(lines: DataFrame, vocab: DataFrame, most: int, max_len: int) -> None:
    """Raises NoCover where some of the first lines can't be made of the pieces, before any pass over all of them."""
    first = first_lines(lines, most)
    pieces = [r[0] for r in vocab.select("piece").collect()]
    missed = e_step(first, pieces, np.zeros(len(pieces)), max_len).filter("piece_id = -4").first()
    if missed and missed[1]:
        _no_cover(first, vocab, int(missed[1]))


def _no_cover(lines: DataFrame, vocab: DataFrame, n: int) -> None:
    missing = uncovered(lines, vocab).orderBy(F.desc("lines")).limit(5).collect()
    raise NoCover(f"{n} lines can't be covered; characters without a piece: {[r[0] for r in missing]}")


@dataclass
class EmStep:
    loglik: float
    sentences: int
    tokens: float
    vocab: int


def em_train(lines: DataFrame, vocab: DataFrame, config: TrainConfig) -> tuple[DataFrame, list[EmStep]]:
    """The vocabulary after EM and pruning, from uniform probabilities, and what each iteration found. The vocabulary is at most some ten thousand rows, so it goes over the driver once an iteration."""
    spark = lines.sparkSession
    n = vocab.count()
    now = vocab.withColumn("logp", F.lit(-float(np.log(n)))).orderBy("piece_id").toPandas()
    history = []
    for _ in range(config.iters):
        pieces, logp = now["piece"].tolist(), now["logp"].to_numpy()
        got = {int(r[0]): r[1] for r in e_step(lines, pieces, logp, config.max_piece_len).collect()}
        if got.get(-4, 0):
            _no_cover(lines, spark.createDataFrame(now[["piece"]]), int(got[-4]))
        now["cnt"] = [got.get(k, 0.0) for k in range(len(pieces))]
        frame = V.m_step(spark.createDataFrame(now))
        kept = V.mdl_prune(frame, config.vocab, config.mdl_lambda0, config.mdl_lambda_len)
        now = kept.orderBy("piece_id").toPandas()
        history.append(EmStep(got.get(-1, 0.0), int(got.get(-2, 0)), got.get(-3, 0.0), len(now)))
    return spark.createDataFrame(now), history


def induce(docs: DataFrame, config: TrainConfig) -> tuple[DataFrame, DataFrame]:
    """The mapped lines to train on, and the first vocabulary."""
    lines = corpus_lines(docs)
    if config.lossless_eol:
        lines = with_eol(lines)
    lines = within_limits(lines, config.max_line_bytes, None)
    if config.encode_corpus:
        from lexweave.functions.text import lossless_encode

        lines = lines.withColumn("line", lossless_encode(F.col("line")))
    counts = V.codepoint_counts(spread(lines))
    keep = V.keep_chars(counts, V.char_vocab_size(config.char_vocab, config.vocab), config.fallback_char)
    mapped = V.map_rare(lines, keep, config.fallback_char)
    if config.skip_long_cp:
        mapped = mapped.filter(F.char_length("line") <= config.max_sentence_cp)
    mapped = spread(mapped).persist(StorageLevel.MEMORY_AND_DISK)
    singles = V.codepoint_counts(mapped)
    some = V.byte_budget(mapped, config.sample_bytes)
    some = some.repartition(some.sparkSession.sparkContext.defaultParallelism)  # sample_bytes at most
    grams = V.ngram_counts(some, 2, config.max_piece_len, config.min_count, config.fallback_char, V.start_filter(singles))
    singles = singles.select("ch", "cnt")
    return mapped, V.vocabulary(singles, V.candidates(grams, config.cand_total, config.max_piece_len))


def train(docs: DataFrame, config: TrainConfig = TrainConfig(), gold: DataFrame | None = None, crf_config: tuple | None = None) -> tuple[L.Model, list[EmStep]]:
    """A joint model of a table of documents; gold, if given, has lines of tokens apart by blanks, crf_config is what parse_crf_config gives."""
    lines, first = induce(docs, config)
    first = V.settled(first)
    if config.precheck_lines:
        precheck(lines, first, config.precheck_lines, config.max_piece_len)
    trained, history = em_train(lines, first, config)
    chosen = V.export_selection(trained, config.keep_single_top).orderBy("piece_id").toPandas()
    if len(chosen) > 0xFFFE:
        raise ValueError(f"{len(chosen)} pieces: 65534 at most")
    crf = CrfWeights.preset()
    if crf_config:
        crf = crf.overridden(crf_config[0], crf_config[1])
    if gold is not None:
        crf = crf_fit(gold_sequences(gold, config.max_sentence_cp, config.classes), crf, config)
    if config.crf_unsupervised:
        some = first_lines(corpus_lines(docs), config.crf_unsup_sentences)
        lm = L.Model(trained.toPandas()["piece"].tolist(), np.zeros(0), max_len=config.max_piece_len, logp=trained.toPandas()["logp"].to_numpy())
        crf = crf_fit(pseudo_labels(some, lm, config.classes), crf, config)
    lines.unpersist()
    q = quantized(chosen["logp"].to_numpy())
    return (
        L.Model(chosen["piece"].tolist(), q, crf.quantized(), config.max_piece_len, int(quantized(config.lambda0)), int(quantized(config.unk_base)), int(quantized(config.unk_per_cp)), **crf.scalars(), logp=chosen["logp"].to_numpy(), flags=L.LOSSLESS_WS if config.lossless_ws or config.encode_corpus else 0, cc_mode=config.cc_mode, cc_fallback=config.cc_fallback, cc_ranges=config.cc_ranges),
        history,
    )


def quantized(x) -> np.ndarray:
    return np.rint(np.clip(np.asarray(x, float) * 256, -32768, 32767)).astype(np.int64)


# --- CRF

CUR, PREV, NEXT = tuple(range(9)), (L.BOS, *range(9)), (*range(9), L.EOS)
_PRESET = (
    (1, 1, L.BOS, 2.0), (1, 1, L.SPACE, 1.5), (1, 1, L.SYMBOL, 1.2), (1, 1, L.FULLWIDTH, 1.2), (0, 1, L.SPACE, 1.5), (0, 1, L.SYMBOL, 1.5), (0, 1, L.FULLWIDTH, 1.5), (0, 0, L.SPACE, -2.0), (0, 0, L.SYMBOL, -2.0), (0, 0, L.FULLWIDTH, -2.0), (0, 0, L.KANJI, 0.4),
    (0, 0, L.KATAKANA, 0.4), (0, 0, L.ALPHA, 0.2), (0, 0, L.DIGIT, 0.2), (0, 0, L.HIRAGANA, 0.1),
)


def key_of(t: int, y: int, a: int, b: int = 0) -> int:
    return t << 24 | y << 16 | a << 8 | b


def feature_keys() -> np.ndarray:
    """The keys of all 418 features, in order."""
    keys = [key_of(0, y, c) for y in (0, 1) for c in CUR] + [key_of(1, y, c) for y in (0, 1) for c in PREV] + [key_of(2, y, c) for y in (0, 1) for c in NEXT]
    keys += [key_of(3, y, a, b) for y in (0, 1) for a in PREV for b in CUR] + [key_of(4, y, a, b) for y in (0, 1) for a in CUR for b in NEXT]
    return np.array(sorted(keys), np.int64)


@dataclass
class CrfWeights:
    """Feature weights by feature_keys(), and transitions named by (from, to)."""

    feat: np.ndarray
    trans: np.ndarray  # 00, 01, 10, 11
    bos: float = 0.5

    @classmethod
    def preset(cls) -> CrfWeights:
        start = {key_of(t, y, a): w for t, y, a, w in _PRESET}
        return cls(np.array([start.get(int(k), 0.0) for k in feature_keys()]), np.array([0.2, -0.4, 0.0, -0.6]))

    def overridden(self, scalars: dict[str, float], weights: dict[int, float]) -> CrfWeights:
        trans = [scalars.get(f"trans{n}", w) for n, w in zip(("00", "01", "10", "11"), self.trans)]
        return CrfWeights(np.array([weights.get(int(k), w) for k, w in zip(feature_keys(), self.feat)]), np.array(trans), scalars.get("bos_to1", self.bos))

    def quantized(self) -> dict[int, int]:
        return {int(k): int(w) for k, w in zip(feature_keys(), quantized(self.feat))}

    def scalars(self) -> dict[str, int]:
        return {f"trans{n}": int(quantized(w)) for n, w in zip(("00", "01", "10", "11"), self.trans)} | {"bos_to1": int(quantized(self.bos))}


def gold_sequences(lines: DataFrame, max_sentence_cp: int = 2048, of=char_class) -> DataFrame:
    """(cls, y) of each line of tokens: its characters' classes by the function `of`, and 1 where a token begins. Lines without tokens, or too long, are left out."""
    keys = [c for c in lines.columns if c != "line"]
    chars = characters(F.col("line"))
    before = F.concat(F.array(F.lit(" ")), F.slice(chars, F.lit(1), F.greatest(F.size(chars) - 1, F.lit(0))))
    pairs = F.zip_with(chars, before, lambda c, p: F.struct(c.alias("c"), p.isin(" ", "\t").cast("int").alias("y")))
    some = lines.select(*keys, F.filter(pairs, lambda s: ~s["c"].isin(" ", "\t")).alias("s")).filter((F.size("s") > 0) & (F.size("s") <= max_sentence_cp))
    return some.select(*keys, F.transform("s", lambda s: of(code_point(s["c"]))).alias("cls"), F.col("s.y").alias("y"))


def pseudo_labels(lines: DataFrame, model: L.Model, of=char_class, keep: DataFrame | None = None) -> DataFrame:
    """(cls, y) of each line by the unigram model's best path; every character begins a word where there is none.

    With keep, (ch) of the characters that aren't rare, the path is that of the line with rare ones mapped.
    """
    from lexweave.operators.segment import tokenize_lm

    if keep is not None:
        lines = V.map_rare(lines, keep)
    keys = [c for c in lines.columns if c != "line"]
    found = tokenize_lm(lines, model)
    n = F.char_length("line")
    marks = F.flatten(F.transform("tokens", lambda t: F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(0), F.char_length(t) - 1))))
    return found.select(*keys, F.transform(characters(F.col("line")), lambda c: of(code_point(c))).alias("cls"), F.when(F.col("tokens").isNull(), F.array_repeat(F.lit(1), n)).otherwise(marks).alias("y")).filter(F.size("cls") > 0)


def gold_classes(points: np.ndarray) -> np.ndarray:
    """What text.gold_class gives for these code points."""
    out = np.zeros(len(points), np.uint8)
    given = ((0x2000, 0x206F, 8), (0x3000, 0x303F, 8), (0xFF61, 0xFF65, 8), (0xFF01, 0xFF60, 7), (0x4E00, 0x9FFF, 6), (0x3400, 0x4DBF, 6), (0x30A0, 0x30FF, 5), (0x31F0, 0x31FF, 5), (0x3040, 0x309F, 4))
    latin = ((0x41, 0x5A, 3), (0x61, 0x7A, 3), (0xFF21, 0xFF3A, 3), (0xFF41, 0xFF5A, 3), (0x30, 0x39, 2), (0xFF10, 0xFF19, 2), (32, 32, 1), (9, 10, 1), (13, 13, 1))
    for lo, hi, c in (*given, *latin):
        out[(points >= lo) & (points <= hi)] = c
    return out


@cache
def _class_table(mode: str, ranges: tuple, fallback: str) -> np.ndarray:
    """The class of every code point; the mode gold is that of gold_classes()."""
    points = np.arange(0x110000, dtype=np.uint32)
    return gold_classes(points) if mode == "gold" else L.classes(points, mode, ranges, fallback)


def gold_arrays(texts: list[str] | tuple[np.ndarray, np.ndarray], max_sentence_cp: int = 2048, mode: str = "compat", ranges: tuple = (), fallback: str = "utf8len") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What gold_sequences gives for these lines, or their code points and offsets, as flat arrays of classes and labels, and the kept lines' offsets."""
    return _gold_arrays(texts, max_sentence_cp, mode, ranges, fallback)[:3]


def _gold_arrays(texts: list[str] | tuple[np.ndarray, np.ndarray], max_sentence_cp: int, mode: str, ranges: tuple = (), fallback: str = "utf8len") -> tuple[np.ndarray, ...]:
    """gold_arrays() and which lines are kept."""
    points, offs = texts if isinstance(texts, tuple) else L.code_points(texts)
    blank = (points == 32) | (points == 9)
    before = np.r_[True, blank[:-1]][: len(points)]
    before[offs[:-1][np.diff(offs) > 0]] = True
    size = np.diff(np.r_[0, np.cumsum(~blank)][offs])
    good = (size > 0) & (size <= max_sentence_cp)
    keep = ~blank & np.repeat(good, np.diff(offs))
    return _class_table(mode, ranges, fallback).take(points[keep]).astype(np.int64), before[keep].astype(np.int64), np.r_[0, np.cumsum(size[good])], good


def gold_strings(lines: DataFrame, max_sentence_cp: int = 2048, mode: str = "gold") -> DataFrame:
    """gold_sequences() with y as a string of labels and cls as one of classes with commas between them; the class function is a mode's."""
    names = [c for c in lines.columns if c != "line"]
    at = [lines.columns.index(c) for c in names]
    text = lines.columns.index("line")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points, offs = L.arrow_points(b.column(text))
            for lo, hi in L.slices(offs, L.BATCH):
                cls, y, kept, good = _gold_arrays((points[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]), max_sentence_cp, mode)
                digits = np.full(2 * len(cls), ord(","), np.uint32)
                digits[::2] = cls + 48
                inner = np.ones(len(digits), bool)
                inner[2 * kept[1:] - 1] = False
                rows = pa.array(lo + np.flatnonzero(good))
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(rows) for k in at), L.string_array(y + np.uint32(48), kept), L.string_array(digits[inner], 2 * kept - np.arange(len(kept)))], [*names, "y", "cls"])

    kept = [f"`{c}` {lines.schema[c].dataType.simpleString()}" for c in names]
    return map_arrow(spread(lines), work, ", ".join([*kept, "y string", "cls string"]))


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct columns of whole numbers from 0 up, and how often each is there."""
    base = [int(x) + 1 for x in rows.max(axis=1, initial=0)]
    if np.prod(base, dtype=float) > 1 << 23:
        return np.unique(rows, axis=1, return_counts=True)
    n = np.bincount(np.ravel_multi_index(tuple(rows), base))
    at = np.flatnonzero(n)
    return np.stack(np.unravel_index(at, base)), n[at]


def gold_counts(lines: DataFrame, count, keys: str, max_sentence_cp: int = 2048) -> DataFrame:
    """(keys.., cnt): count(cls, y, offs) gives arrays of keys, a row each, for lines of tokens. Tasks send each key once."""
    names = [k.strip().split()[0] for k in keys.split(",")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, int] = {}
        for b in batches:
            points, offs = L.arrow_points(b.column(0))
            for lo, hi in L.slices(offs, 1_000_000):
                found, n = _distinct(count(*gold_arrays((points[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]), max_sentence_cp)))
                for key, k in zip(zip(*found.tolist()), n.tolist()):
                    total[key] = total.get(key, 0) + k
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*zip(*total), total.values())], [*names, "cnt"])

    parts = map_arrow(spread(lines.select("line")), work, f"{keys}, cnt bigint")
    return parts.groupBy(*names).agg(F.sum("cnt").alias("cnt"))


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cls, y = (b.column(k).combine_chunks() if isinstance(b.column(k), pa.ChunkedArray) else b.column(k) for k in (0, 1))
    return cls.flatten().to_numpy(zero_copy_only=False).astype(np.int64), y.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.r_[0, np.cumsum(cls.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)


class Features:
    """The five features of each position for both labels, as numbers of feature_keys() (or their number where there is none)."""

    def __init__(self) -> None:
        self.keys = feature_keys()

    def at(self, label: int, prev: np.ndarray, cur: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        keys = np.stack([key_of(0, label, 0) + (cur << 8), key_of(1, label, 0) + (prev << 8), key_of(2, label, 0) + (nxt << 8), key_of(3, label, 0) + (prev << 8 | cur), key_of(4, label, 0) + (cur << 8 | nxt)])
        where = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[where] == keys, where, len(self.keys))


def contexts(cls: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes before and after each position."""
    prev, nxt = np.r_[L.BOS, cls[:-1]][: len(cls)], np.r_[cls[1:], L.EOS][: len(cls)] if len(cls) else cls
    some = np.diff(offs) > 0
    prev[offs[:-1][some]], nxt[offs[1:][some] - 1] = L.BOS, L.EOS
    return prev, nxt


def crf_gradient(cls: np.ndarray, y: np.ndarray, offs: np.ndarray, w: CrfWeights) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Gradient by feature and by transition (00, 01, 10, 11), log-likelihood and positions of these sequences.

    The first label is 1, and so is the one after the end.
    """
    order = np.argsort(-np.diff(offs), kind="stable")
    size = np.diff(offs)[order]
    at = np.arange(size.sum()) + np.repeat(offs[:-1][order] - (np.cumsum(size) - size), size)
    cls, y = cls[at], y[at]
    base = np.cumsum(size) - size
    offs = np.r_[base, len(cls)] if len(size) else np.zeros(1, np.int64)
    keep = size > 0
    base, size = base[keep], size[keep]
    # features hang on a position's class and those beside it only, so they are looked up once for all such triples
    codes, number = np.unique(np.r_[cls, L.BOS, L.EOS]), np.zeros(256, np.int64)
    number[codes] = np.arange(len(codes))
    prev, nxt = contexts(cls, offs)
    triple = np.ravel_multi_index((number[prev], number[cls], number[nxt]), (len(codes),) * 3)
    f = Features()
    hit = [f.at(k, *(codes[x.ravel()] for x in np.indices((len(codes),) * 3))) for k in (0, 1)]
    padded = np.append(w.feat, 0.0)
    e = [padded[h].sum(axis=0)[triple] for h in hit]
    t = w.trans.reshape(2, 2)
    a = [np.full(len(cls), -np.inf), np.full(len(cls), -np.inf)]
    b = [np.zeros(len(cls)), np.zeros(len(cls))]
    top = int(size.max(initial=0))
    alive = np.searchsorted(-size, -np.arange(top + 1), side="right")
    a[1][base] = e[1][base]
    for p in range(1, top):
        i = base[: alive[p + 1]] + p
        for k in (0, 1):
            a[k][i] = e[k][i] + np.logaddexp(a[0][i - 1] + t[0, k], a[1][i - 1] + t[1, k])
    last = base + size - 1
    z = np.logaddexp(a[0][last] + t[0, 1], a[1][last] + t[1, 1])
    for k in (0, 1):
        b[k][last] = t[k, 1]
    for p in range(top - 2, -1, -1):
        i = base[: alive[p + 2]] + p
        for k in (0, 1):
            b[k][i] = np.logaddexp(t[k, 0] + e[0][i + 1] + b[0][i + 1], t[k, 1] + e[1][i + 1] + b[1][i + 1])
    zs = np.repeat(z, size)
    grad = np.zeros(len(w.feat) + 1)
    for k in (0, 1):
        p = np.exp(a[k] + b[k] - zs)
        off = np.bincount(triple, weights=(y == k) - p, minlength=len(codes) ** 3)
        for row in hit[k]:
            grad += np.bincount(row, weights=off, minlength=len(grad))
    first = np.zeros(len(cls), bool)
    first[base] = True
    i = np.flatnonzero(~first)
    g = np.zeros((2, 2))
    ll = e[1][base].sum() - z.sum()
    for j in (0, 1):
        for k in (0, 1):
            real = (y[i - 1] == j) & (y[i] == k)
            g[j, k] += real.sum() - np.exp(a[j][i - 1] + t[j, k] + e[k][i] + b[k][i] - zs[i]).sum()
            ll += real.sum() * t[j, k]
        end = y[last] == j
        g[j, 1] += end.sum() - np.exp(a[j][last] + t[j, 1] - z).sum()
        ll += end.sum() * t[j, 1]
        ll += e[j][i][y[i] == j].sum()
    return grad[:-1], g.ravel(), float(ll), len(cls)


def crf_pass(sequences: DataFrame, w: CrfWeights, max_sentence_cp: int = 2048) -> tuple[np.ndarray, np.ndarray, float, int]:
    """crf_gradient over a whole table of (cls, y), or of lines of tokens; every task sends one row of 424 numbers."""
    shared = sequences.sparkSession.sparkContext.broadcast(w)
    lines = "cls" not in sequences.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(w.feat) + 6)
        for b in batches:
            if not b.num_rows:
                continue
            cls, y, offs = gold_arrays(L.arrow_points(b.column(0)), max_sentence_cp) if lines else _flat(b)
            for part in L.groups(np.diff(offs), 2 * L.BATCH):  # of like length
                some, at = L.some_rows(cls, offs, part)
                grad, trans, ll, n = crf_gradient(some, L.some_rows(y, offs, part)[0], at, shared.value)
                total += np.r_[grad, trans, ll, n]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "v"])

    rows = map_arrow(sequences.select(*(["line"] if lines else ["cls", "y"])), work, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(len(w.feat) + 6)
    for k, v in rows:
        total[k] = v
    return total[: len(w.feat)], total[len(w.feat) : -2], total[-2], int(total[-1])


def crf_fit(sequences: DataFrame, start: CrfWeights, config: TrainConfig) -> CrfWeights:
    """The weights that gradient ascent or L-BFGS finds for (cls, y), or for lines of tokens; bos_to1 stays as it is. What several passes read is kept."""
    data = sequences.select("cls", "y") if "cls" in sequences.columns else sequences.select("line")
    if config.crf_opt != "sgd" or config.crf_epochs > 1:
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        f = lambda v: CrfWeights(v[:-4], v[-4:], start.bos)

        def value(v: np.ndarray) -> tuple[float, np.ndarray]:
            grad, trans, ll, n = crf_pass(data, f(v))
            n = max(n, 1)
            return -(ll - 0.5 * config.crf_l2 * float(v @ v)) / n, -(np.r_[grad, trans] - config.crf_l2 * v) / n

        v = np.r_[start.feat, start.trans]
        if config.crf_opt == "sgd":
            for _ in range(max(1, config.crf_epochs)):
                v = v - config.crf_lr * value(v)[1]
            return f(v)
        return f(lbfgs(value, v, max(1, config.crf_epochs), config.crf_lbfgs_m, config.crf_tol))
    finally:
        data.unpersist()


def lbfgs(value, v: np.ndarray, iters: int, m: int = 8, tol: float = 1e-4) -> np.ndarray:
    """The point where value(v) = (objective, gradient) is least, by limited-memory quasi-Newton steps with backtracking."""
    m = min(max(m, 1), 32)
    now, grad = value(v)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iters):
        if np.linalg.norm(grad) < tol:
            break
        q, alphas = grad.copy(), []
        for s, y in reversed(steps):
            alphas.append(a := s @ q / (y @ s))
            q -= a * y
        if steps:
            s, y = steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(alphas)):
            q += s * (a - y @ q / (y @ s))
        slope = -(grad @ q)
        if slope >= 0:
            q, slope, steps = grad.copy(), -(grad @ grad), []
        step = 1.0
        for _ in range(20):
            there, g = value(v - step * q)
            if there <= now + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * q, g - grad
        steps = [*steps, (s, y)][-m:] if y @ s > 1e-12 else []
        v, now, grad = v + s, there, g
    return v


def preset_table(spark: SparkSession) -> DataFrame:
    """(tid, label, v1, v2, key, weight) of the 418 features."""
    ids = lambda name, values: F.explode(F.lit(list(values))).alias(name)
    one, zero = spark.range(1), F.lit(0).alias("v2")
    tid = lambda n: F.lit(n).alias("tid")
    table = one.select(tid(0), ids("v1", CUR)).select("tid", "v1", zero)
    table = table.union(one.select(tid(1), ids("v1", PREV)).select("tid", "v1", zero)).union(one.select(tid(2), ids("v1", NEXT)).select("tid", "v1", zero))
    table = table.union(one.select(tid(3), ids("v1", PREV)).select("tid", "v1", ids("v2", CUR))).union(one.select(tid(4), ids("v1", CUR)).select("tid", "v1", ids("v2", NEXT)))
    from lexweave.functions.text import feature_key

    given = F.create_map(*(F.lit(x) for t, y, a, w in _PRESET for x in (key_of(t, y, a), w)))
    all_ = table.select("tid", ids("label", (0, 1)), "v1", "v2").withColumn("key", feature_key(F.col("tid"), F.col("label"), F.col("v1"), F.col("v2")))
    return all_.select("tid", "label", "v1", "v2", "key", F.coalesce(F.try_element_at(given, F.col("key").cast("int")), F.lit(0.0)).alias("weight"))
